"""Secrets in texts: three fixed patterns, and a linear-chain conditional random field.

The field tags every token (run without white space) of a text as begin, inside or outside of a
secret.  Its features are the token's shape over its whole length -- length, classes of
characters, how often they change, how surprising its letters are in these texts, what it looks
like (address, date, path, ...) --, the kinds of its neighbours, how far back a word that names
a secret stands, and features of the whole text.  Tags are decoded by Viterbi, exactly: a token that is outside in the best sequence
whatever its neighbours' tags are, as bounds of emissions and moves show, parts the chain; what
lies between such tokens is decoded, runs of one length at a time.

It is trained here, on the regularised likelihood, with windows of a bounded sample of documents
(SAMPLE, chosen by a hash of doc_id; WINDOWS of them): those around the fixed patterns' matches,
others as they are, and others into which made-up secrets of many kinds, or made-up strings that
are none, are put.  In a part of them the words that name a secret, or the features of the
secret's own shape, are blanked, so that either may tell.  Its spans are added where they have
at least LEAST_VALUE characters and touch no span of a pattern.

Defined results: a null or empty text has no spans; texts are scanned whole, however long;
repeated rows give equal results; of equally good sequences the one with more outside tags, then
begin tags is taken; rows with a null doc_id are scanned; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import string
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, ddl, map_texts, numbered_words, sized_slices

COLUMNS = [("doc_id", "long"), ("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"),
           ("spans", "string"), ("n_tagged", "long")]
KINDS = ("assign", "access", "hex", "tagged")
NAMES = ("passw", "secret", "token", "api")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so this drops exactly the shorter ones
LEAST_VALUE, LEAST_ACCESS = 12, 18
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
OUT, BEGIN, INSIDE = 0, 1, 2

#: Most documents, and windows of each sort, that the field is trained on; tokens of a window to either side.
SAMPLE, WINDOWS, AROUND = 4000, 1200, 8
EPOCHS, RATE, PENALTY = 60, 0.3, 2e-5
#: What a tag other than outside must be better by, in units of the score.
CAUTION = 1.0

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, in code points, by start and then kind."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


# Features of tokens

_SYMBOLS = np.array([28 if b > 127 else 26 if chr(b).isdigit() else ord(chr(b).lower()) - 97 if chr(b).isalpha() else 27 for b in range(256)])
_CLASSES = np.array([4 if b > 127 else 2 if chr(b).isdigit() else 1 if chr(b).isupper() else 0 if chr(b).islower() else 3 for b in range(256)])
EDGE, SYMBOLS = 29, 30
#: What a token may look like; the first four make a token's kind as a neighbour.
LOOKS = [
    r"(?i)passw|secret|token|api_?key|bearer|credential|passphrase|private|auth|pwd",
    r"[:=]['\"]?$",
    r"^-----|-----$",
    r"^[\"'(\[]*\pL+[\"')\],.;:!?]*$",
    r"(?i)^[\"'(<]*(?:https?|ftp|www\.)[:.]?",
    r"://[^/\s:@]+:[^/\s@]{6,}@",
    r"^[^@\s:/]+@[\w.-]+\.\pL{2,}[^\pL]*$",
    r"^[^\pL]*[0-9][0-9.,:/+()%-]*[^\pL0-9]*$",
    r"^[\"'(]*[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}",
    r"^[.~]?/?(?:[\w.-]+/)+[\w.-]*$",
    r"^[\"'(=:]*[A-Za-z]{2,8}[_-][A-Za-z0-9_-]{12,}",
    r"eyJ[\w-]+\.",
    r"[.,;:!?]$",
    r"=[\"']?$",
    r"(?i)^[\"'({]*[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}[^0-9a-f]*$",
    r"^[\"']?[A-Za-z0-9+/]{40,}={0,2}[\"']?$",
    r"^[a-z]+(?:[A-Z][a-z]+)+[().,;:]*$|^\pL+(?:[-_]\pL+)+[().,;:]*$",
    r"[:=]['\"]?[^:=\s/]{12,}$",
]
NAME, KIND_LOOKS = 0, 4
KINDS_OF_WORDS = 1 << (KIND_LOOKS + 1)  # the four looks, and whether letters and digits mix
FAR = 8  # a name this far back, or none


def bucket(values: np.ndarray, bounds: list[float]) -> np.ndarray:
    return np.searchsorted(bounds, values, "right")


class Shapes:
    """Features of distinct tokens: numbers of features, the kind each is as a neighbour, whether it is a name, and how random it looks."""

    GROUPS = [10 * 32, 36, 10 * 8, 10 * 10, 24, *([2] * len(LOOKS)), 10 * 16]
    RANDOM = 8

    def __init__(self, surprise: np.ndarray):
        self.surprise = surprise

    def __call__(self, words: list[bytes]):
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size) - size
        classes, symbols = _CLASSES[raw], _SYMBOLS[raw]
        before = np.append(EDGE, symbols[:-1])[: len(raw)]
        before[first] = EDGE
        odd = np.add.reduceat(self.surprise[before, symbols], first) / size
        n = [np.add.reduceat((classes == k).astype(np.int64), first) for k in range(5)]
        change = np.append(False, classes[1:] != classes[:-1])[: len(raw)]
        change[first] = False
        changes = np.add.reduceat(change.astype(np.int64), first) / size
        length = bucket(size, [2, 4, 6, 8, 12, 16, 24, 40, 80])
        mask = sum((n[k] > 0) << k for k in range(5))
        digits, upper = bucket(n[2] / size, [1e-9, 0.1, 0.25, 0.5, 0.999]), bucket(n[1] / size, [1e-9, 0.1, 0.25, 0.5, 0.999])
        texts = pa.array(words, pa.binary()).cast(pa.string())
        looks = [pc.match_substring_regex(texts, look).to_numpy(zero_copy_only=False).astype(np.int64) for look in LOOKS]
        odd_bucket = bucket(odd, [2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7])
        alone = looks[3] | looks[6] << 1 | looks[7] << 2 | (looks[4] | looks[9]) << 3
        columns = [length * 32 + mask, digits * 6 + upper, length * 8 + bucket(changes, [1e-9, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6]), length * 10 + odd_bucket, np.minimum(size // 3, 23), *looks, length * 16 + alone]
        starts = np.cumsum([0, *self.GROUPS[:-1]])
        mixed = ((n[2] > 0) & (n[0] + n[1] > 0)).astype(np.int64)
        kind = sum(looks[k] << k for k in range(KIND_LOOKS)) | mixed << KIND_LOOKS
        random = np.where(size < LEAST_VALUE, 0, 1 + np.minimum(odd_bucket // 2, 4) + (mixed & (changes > 0.2)) * 2)
        return np.stack(columns, 1) + starts, kind, looks[NAME].astype(bool), np.minimum(random, self.RANDOM - 1)


def surprise_of(texts: list[str]) -> np.ndarray:
    """How surprising each character is behind another, in bits, over the texts' tokens."""
    counts = np.full((SYMBOLS, SYMBOLS), 0.5)
    for text in texts:
        raw = _SYMBOLS[np.frombuffer(text.encode(), np.uint8)]
        blank = np.isin(np.frombuffer(text.encode(), np.uint8), (32, 9, 10, 11, 12, 13))
        row = np.where(blank, EDGE, raw)
        np.add.at(counts, (row[:-1], row[1:]), 1)
    counts = counts[:, :EDGE] if len(texts) else np.ones((SYMBOLS, EDGE))
    return -np.log2(counts / counts.sum(1, keepdims=True))


class Layout:
    """Where each group of features begins: own, before, after, name and look, text; the last feature is blank."""

    own = 0
    before = sum(Shapes.GROUPS)
    after = before + KINDS_OF_WORDS + 1
    named = after + KINDS_OF_WORDS + 1
    text = named + (FAR + 1) * Shapes.RANDOM
    blank = text + 9 * 2 * 4
    size = blank + 1


class Tokens:
    """The tokens of some texts, in one row: features of distinct ones, and of places."""

    def __init__(self, shapes: Shapes, texts: pa.Array):
        self.words, self.index, self.sizes = numbered_words(texts)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        if not len(self.index):
            return
        self.columns, kind, name, random = shapes(self.words)
        at, doc = np.arange(len(self.index)), np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.first, self.last = at == self.starts[doc], at == self.ends[doc] - 1
        kinds = kind[self.index]
        self.before = np.where(self.first, KINDS_OF_WORDS, np.append(0, kinds[:-1]))
        self.after = np.where(self.last, KINDS_OF_WORDS, np.append(kinds[1:], 0))
        names = name[self.index]
        nearest = np.maximum.accumulate(np.where(names, at, -1))
        nearest = np.append(-1, nearest[:-1])  # the name before, not the token itself
        far = np.where(nearest >= self.starts[doc], np.minimum(at - nearest, FAR), 0)
        self.named = far * Shapes.RANDOM + random[self.index]
        length = np.minimum(np.frompyfunc(int.bit_length, 1, 1)(pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False).astype(object)).astype(np.int64) // 3, 8)
        has = np.bincount(doc, names, len(self.sizes)) > 0
        telling = bucket(np.bincount(doc, kinds >> KIND_LOOKS, len(self.sizes)) / np.maximum(self.sizes, 1), [1e-9, 0.02, 0.1])
        self.text = (length * 2 + has) * 4 + telling
        self.doc = doc

    def features(self, text_kind: np.ndarray) -> np.ndarray:
        """Numbers of all features of each token."""
        near = np.stack([Layout.before + self.before, Layout.after + self.after, Layout.named + self.named, Layout.text + text_kind[self.doc]], 1)
        return np.concatenate([self.columns[self.index], near], 1)


# The field


class Field:
    """Weights of features for the three tags, and of moves between tags; a text begins and ends next to an outside tag."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, shapes: Shapes):
        self.weights, self.moves, self.shapes = weights.astype(np.float32), moves, shapes

    def emissions(self, tokens: Tokens) -> np.ndarray:
        w = self.weights
        own = w[tokens.columns].sum(1)
        e = own[tokens.index]
        for start, values in ((Layout.before, tokens.before), (Layout.after, tokens.after), (Layout.named, tokens.named), (Layout.text, tokens.text[tokens.doc])):
            e += w[start + values]
        e[:, OUT] += CAUTION
        return e

    def surely_out(self, e: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Tokens that are outside in the best sequence, whatever the tags around them.

        If a sequence has another tag b there, it gets better by taking outside instead, with an
        inside tag behind it made a begin; the gain is at least what is computed here.
        """
        m, best = self.moves, np.full(len(e), np.inf)
        next_change = np.append(e[1:, BEGIN] - e[1:, INSIDE], 0)
        for b in (BEGIN, INSIDE):
            into = (m[:, OUT] - m[:, b]).min()
            plain = min(m[OUT, c] - m[b, c] for c in (OUT, BEGIN))
            changed = m[OUT, BEGIN] - m[b, INSIDE] + (m[BEGIN] - m[INSIDE]).min() + next_change
            best = np.minimum(best, e[:, OUT] - e[:, b] + into + np.where(last, plain, np.minimum(plain, changed)))
        return best > 0

    def tags(self, tokens: Tokens) -> np.ndarray:
        """The best sequence of each text."""
        tags = np.zeros(len(tokens.index), np.int8)
        if not len(tags):
            return tags
        e = self.emissions(tokens)
        open_ = np.flatnonzero(~self.surely_out(e, tokens.last))
        if not len(open_):
            return tags
        begins = np.append(True, (open_[1:] != open_[:-1] + 1) | tokens.first[open_[1:]])
        first = open_[begins]
        sizes = np.diff(np.append(np.flatnonzero(begins), len(open_)))
        for size in np.unique(sizes).tolist():
            at = first[sizes == size][:, None] + np.arange(size)
            tags[at] = best_paths(e[at].astype(np.float64), self.moves)
        return tags


def best_paths(e: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Viterbi over chains of one length (chains, tokens, tags), each between two outside tags."""
    score, back = e[:, 0] + moves[OUT], []
    for k in range(1, e.shape[1]):
        through = score[:, :, None] + moves[None]
        back.append(through.argmax(1))
        score = through.max(1) + e[:, k]
    at = (score + moves[:, OUT]).argmax(1)
    path = [at]
    for step in reversed(back):
        at = step[np.arange(len(at)), at]
        path.append(at)
    return np.stack(path[::-1], 1)


def trained(windows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves from (features, tags) of windows, by AdaGrad on the likelihood with an L2 penalty; windows of all lengths at once."""
    n, longest, width = len(windows), max(len(t) for _, t in windows), windows[0][0].shape[1]
    x, gold = np.full((n, longest, width), Layout.blank), np.zeros((n, longest), np.int64)
    real = np.zeros((n, longest), bool)
    for k, (features, tags) in enumerate(windows):
        x[k, : len(tags)], gold[k, : len(tags)], real[k, : len(tags)] = features, tags, True
    places, flat = np.flatnonzero(real), x[real].ravel()
    onehot = np.eye(3)[gold]
    moves = np.zeros((3, 3))
    moves[OUT, INSIDE] = -20.0  # inside never follows outside
    fixed = moves.copy()
    weights, seen, seen_moves = np.zeros((Layout.size, 3)), np.full((Layout.size, 3), 1e-6), np.full((3, 3), 1e-6)
    shut = np.array([0.0, -1e4, -1e4])  # behind a window's end only outside tags
    hard = np.concatenate([np.zeros((n, 1), int), gold, np.zeros((n, 1), int)], 1)
    steps_gold = np.zeros((3, 3))
    np.add.at(steps_gold, (hard[:, :-1][:, : longest + 1], hard[:, 1:]), 1)
    for _ in range(EPOCHS):
        e = np.tile(shut, (n * longest, 1))
        e[places] = np.stack([weights[:, k][flat].reshape(-1, width).sum(1) for k in range(3)], 1)
        e = e.reshape(n, longest, 3)
        ahead, behind = np.empty_like(e), np.empty_like(e)
        ahead[:, 0] = e[:, 0] + moves[OUT]
        for k in range(1, longest):
            ahead[:, k] = np.logaddexp.reduce(ahead[:, k - 1, :, None] + moves, axis=1) + e[:, k]
        behind[:, -1] = moves[:, OUT]
        for k in range(longest - 2, -1, -1):
            behind[:, k] = np.logaddexp.reduce(moves + (e[:, k + 1] + behind[:, k + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(ahead[:, -1] + moves[:, OUT], axis=1)
        share = np.exp(ahead + behind - total[:, None, None])
        both = np.exp(ahead[:, :-1, :, None] + moves + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum((0, 1))
        slope = steps_gold - both
        slope[OUT] -= share[:, 0].sum(0)
        slope[:, OUT] -= share[:, -1].sum(0)
        error = (onehot - share)[real]
        g = np.stack([np.bincount(flat, np.repeat(error[:, k], width), Layout.size) for k in range(3)], 1) / n - PENALTY * weights
        g[Layout.blank] = 0
        seen += g * g
        weights += RATE * g / np.sqrt(seen)
        slope = slope / n - PENALTY * (moves - fixed)
        seen_moves += slope * slope
        moves += RATE * slope / np.sqrt(seen_moves)
        np.minimum(moves, np.where(fixed < 0, fixed, np.inf), out=moves)
    return weights, moves


# Made-up secrets, and strings that are none

MIXED, LOWER, URL_SAFE = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "-_"


def drawn(random, letters: str, low: int, high: int) -> str:
    return "".join(random.choice(list(letters), random.integers(low, high + 1)))


def some(random, choices):
    return choices[int(random.integers(len(choices)))]


def made_secret(random, word) -> tuple[list[str], int, int]:
    """Tokens, and the first and the last one that belong to the secret."""
    wrap = some(random, ["{}", "{}", "{}", '"{}"', "'{}'", "{},", "{}.", "({})"])
    name = some(random, ["password", "passwd", "token", "secret", "api key", "credential", "passphrase", "pwd", "access token", "auth token", "secret key", "Password", "TOKEN"]).split()
    prefix = drawn(random, string.ascii_lowercase, 2, 5) + some(random, ["_", "-", "_live_", "_test_", "-prod-", ""])
    value = some(random, [
        lambda: prefix + drawn(random, MIXED, 16, 40),
        lambda: drawn(random, MIXED, 16, 44),
        lambda: drawn(random, string.ascii_letters, 16, 32),
        lambda: drawn(random, LOWER, 20, 40),
        lambda: drawn(random, string.ascii_uppercase + string.digits, 18, 40),
        lambda: drawn(random, MIXED + "+/", 24, 64) + some(random, ["", "=", "=="]),
        lambda: "eyJ" + drawn(random, URL_SAFE, 16, 40) + "." + drawn(random, URL_SAFE, 20, 80) + "." + drawn(random, URL_SAFE, 20, 43),
        lambda: drawn(random, MIXED + "!#$%&*@^", 12, 24),
        lambda: drawn(random, URL_SAFE, 24, 60),
    ])()
    kind = int(random.integers(10))
    if kind == 0:
        scheme, user = some(random, ["postgres", "mysql", "https", "amqp", "redis", "mongodb", "ftp"]), word().lower()
        return [wrap.format(f"{scheme}://{user}:{drawn(random, MIXED + '!$%_-', 8, 20)}@{word().lower()}.{some(random, ['example.com', 'internal', 'net', 'org'])}{some(random, ['', '/db', ':5432/main'])}")], 0, 0
    if kind == 1:
        label = some(random, ["RSA PRIVATE", "PRIVATE", "EC PRIVATE", "OPENSSH PRIVATE"])
        body = [drawn(random, MIXED + "+/", 64, 64) for _ in range(int(random.integers(2, 6)))] + [drawn(random, MIXED + "+/", 16, 60) + some(random, ["", "=", "=="])]
        tokens = [*f"-----BEGIN {label} KEY-----".split(), *body, *f"-----END {label} KEY-----".split()]
        if random.random() < 0.4:
            return body[:1], 0, 0  # a line alone
        return tokens, 0, len(tokens) - 1
    if kind == 2:
        return [some(random, ["Authorization:", "authorization", "header"]), some(random, ["Bearer", "bearer", "Basic"]), wrap.format(value)], 2, 2
    if kind in (3, 4):
        between = some(random, [["is"], ["is", "now"], [":"], ["for", word(), "is"], ["for", "this", word(), "is"], ["="], ["was"], []])
        tokens = [*some(random, [["the"], ["your"], ["my"], []]), *name, *between, wrap.format(value)]
        return tokens, len(tokens) - 1, len(tokens) - 1
    if kind == 5:
        key = "_".join(name).upper()
        return [some(random, ["export", "set", "ENV"]), f"{some(random, ['DB', 'APP', 'SVC'])}_{key}", wrap.format(value)], 2, 2
    return [wrap.format(value)], 0, 0


def made_plain(random, word) -> list[str]:
    """Tokens that are no secret, though they look odd or stand near its names."""
    digits = lambda n: drawn(random, string.digits, n, n)
    host = lambda: f"{word().lower()}.{some(random, ['com', 'org', 'net', 'example'])}"
    return some(random, [
        lambda: [f"{word().lower()}.{word().lower()}{digits(2)}@{host()}"],
        lambda: [f"https://{some(random, ['www.', ''])}{host()}/{word().lower()}/{word().lower()}-{digits(4)}{some(random, ['', '.html', '?id=' + digits(5)])}"],
        lambda: ["-".join(drawn(random, "0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12))],
        lambda: [f"20{digits(2)}-0{digits(1)}-1{digits(1)}T{digits(2)}:{digits(2)}:{digits(2)}Z"],
        lambda: [f"+{digits(2)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"],
        lambda: [digits(int(random.integers(10, 20)))],
        lambda: [f"/{word().lower()}/{word().lower()}/{word().lower()}{digits(2)}.txt"],
        lambda: [word().lower() + "".join(word().capitalize() for _ in range(3))],
        lambda: ["_".join(word().lower() for _ in range(int(random.integers(2, 5))))],
        lambda: ["-".join(word().lower() for _ in range(int(random.integers(3, 6))))],
        lambda: [f"v{digits(1)}.{digits(2)}.{digits(1)}-{some(random, ['rc', 'beta', 'alpha'])}.{digits(2)}"],
        lambda: [word() + word().lower() + word().lower()],
        lambda: [word().upper() + word().upper()],
        lambda: [f"{some(random, ['ISBN', 'DOI:', 'No.'])}", f"{digits(3)}-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}"],
        lambda: ["the", some(random, ["password", "token", "secret", "API"]), some(random, ["must", "should", "of", "page", "is", "for"]), word(), word() + word().lower(), word()],
        lambda: [f"{word().lower()}='{word().lower()}'", f"{word().lower()}={digits(4)}"],
        lambda: [f"#{word()}{word()}{digits(4)}"],
        lambda: [f"{digits(1)},{digits(3)},{digits(3)}.{digits(2)}", "EUR"],
        lambda: ["*" * int(random.integers(3, 30))],
        lambda: ["=" * int(random.integers(12, 50))],
    ])()


def windows_of(text: str, key: int) -> list[tuple[list[str], list[int], int]]:
    """Windows of a text with their tags: around matches of the fixed patterns, and a few others; last whether it has a match."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    spans = base_spans(text)
    tags, open_until, k = [], -1, 0
    for start, end in tokens:
        while k < len(spans) and spans[k][2] <= start:
            k += 1
        touching = [s for s in spans[k : k + 4] if s[0] < end and s[2] > start]
        tags.append(OUT if not touching else INSIDE if start < open_until else BEGIN)
        open_until = max([open_until, *(s[2] for s in touching)])
    marked = [k for k, t in enumerate(tags) if t == BEGIN]
    random = np.random.default_rng(key & 0xFFFFFFFF)
    centres = sorted(set(random.choice(marked, min(2, len(marked)), replace=False).tolist() if marked else []) | set(random.integers(0, max(len(tokens), 1), 2).tolist() if tokens else []))
    out = []
    for c in centres:
        low, high = max(0, c - AROUND), min(len(tokens), c + AROUND + 1)
        while low and tags[low] == INSIDE:
            low -= 1
        while high < len(tokens) and tags[high] == INSIDE:
            high += 1
        out.append(([text[a:b] for a, b in tokens[low:high]], tags[low:high], int(any(tags[low:high]))))
    return out


def trained_field(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> Field:
    """A field from at most `windows` windows with matches, and as many without, of at most `sample` documents."""
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")

    def make():
        def work(key, data: bytes):
            rows = [f"{marked}\x1f{''.join(map(str, tags))}\x1f{' '.join(tokens)}" for tokens, tags, marked in windows_of(data.decode(), key)]
            return (rows,)

        return work

    found = map_texts(texts, make, [("doc_id", "long"), ("rows", "array<string>")]).select(F.explode("rows").alias("row")).distinct()
    order = F.xxhash64("row"), F.col("row")
    rows = [r["row"] for kind in "10" for r in found.where(F.col("row").startswith(kind)).orderBy(*order).limit(windows).collect()]
    return field_from([(text.split(" "), list(map(int, tags)), marked == "1") for marked, tags, text in (r.split("\x1f", 2) for r in rows)])


def field_from(found: list[tuple[list[str], list[int], bool]]) -> Field:
    """Train on windows as they are and with strings put into those without a match."""
    random = np.random.default_rng(5)
    texts, tags = [w for w, _, _ in found], [t for _, t, _ in found]
    plain = [w for w, _, marked in found if not marked] or [["the", "text"]]
    words = sorted({w for tokens in plain for w in tokens if w.isalpha() and w.isascii() and 2 < len(w) < 12}) or ["text"]
    word = lambda: some(random, words)
    for k, tokens in enumerate(plain * max(1, -(-WINDOWS // len(plain)))):
        if k >= 2 * WINDOWS:
            break
        at = int(random.integers(len(tokens) + 1))
        for secret in (True, False):
            if secret:
                new, first, last = made_secret(random, word)
                new_tags = [OUT if not first <= i <= last else BEGIN if i == first else INSIDE for i in range(len(new))]
            else:
                new = made_plain(random, word)
                new_tags = [OUT] * len(new)
            texts.append([*tokens[:at], *new, *tokens[at:]])
            tags.append([OUT] * at + new_tags + [OUT] * (len(tokens) - at))
    shapes = Shapes(surprise_of([" ".join(t) for t in plain]))
    rows = Tokens(shapes, pa.array([" ".join(t) for t in texts], pa.string()))
    # a window does not tell how long its text is: the feature is drawn
    features = rows.features(np.where(random.random(len(texts)) < 0.5, rows.text, (random.integers(0, 9, len(texts)) * 2 + rows.text // 4 % 2) * 4 + random.integers(0, 4, len(texts))))
    own, named = len(Shapes.GROUPS), len(Shapes.GROUPS) + 2
    windows = []
    for start, end, gold in zip(rows.starts.tolist(), rows.ends.tolist(), tags):
        x, y = features[start:end].copy(), np.array(gold, np.int64)
        draw = random.random()
        if draw < 0.25:  # the words that name it do not count
            x[:, named] = Layout.named + (x[:, named] - Layout.named) % Shapes.RANDOM
            x[:, own : own + 2] = Layout.blank
        elif draw < 0.35:  # its own shape does not count, its neighbours must tell
            x[np.ix_(y > 0, range(own))] = Layout.blank
        if len(y):
            windows.append((x, y))
    weights, moves = trained(windows) if windows else (np.zeros((Layout.size, 3)), np.array([[0, 0, -20.0], [0, 0, 0], [0, 0, 0]]))
    return Field(weights, moves, shapes)


def scan(column: pa.Array, field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text the spans of the patterns, and these with the field's."""
    tokens = Tokens(field.shapes, column)
    tags = field.tags(tokens)
    some_tags = np.add.reduceat(np.append(tags != OUT, False).astype(np.int64), np.minimum(tokens.starts, len(tags))) if len(tags) else np.zeros(len(column), np.int64)
    out = []
    for k, text in enumerate(column.to_numpy(zero_copy_only=False).tolist()):
        base = base_spans(text) if text else []
        if not text or not tokens.sizes[k] or not some_tags[k]:
            out.append((base, base))
            continue
        out.append((base, sorted(base + added_spans(text, tags[tokens.starts[k] : tokens.ends[k]].tolist(), base))))
    return out


def added_spans(text: str, tags: list[int], base: list[Span]) -> list[Span]:
    """Spans of tagged tokens, without quotes and marks around them, that are long enough and touch no span of a pattern."""
    added, places = [], [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    k = 0
    while k < len(tags):
        first = k
        k += 1
        if tags[first] == OUT:
            continue
        while k < len(tags) and tags[k] == INSIDE:
            k += 1
        start, end = places[first][0], places[k - 1][1]
        while end > start and text[end - 1] in ".,;:)\"'":
            end -= 1
        while start < end and text[start] in "(\"'":
            start += 1
        if end - start >= LEAST_VALUE and not any(s[0] < end and s[2] > start for s in base):
            added.append((start, 3, end))
    return added


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    return scan(pa.array([text], pa.string()), field)[0]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scanned(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs (doc_id, text)."""
    field, schema = trained_field(docs, sample), arrow_schema(COLUMNS)

    def run(batches):
        for part in sized_slices(batches):
            rows = []
            for doc, (base, spans) in zip(part.column(0).to_pylist(), scan(part.column(1), field)):
                counts = [sum(s[1] == k for s in spans) for k in range(4)]
                rows.append((doc, *counts[:3], sha256(written(base).encode()).hexdigest(), written(spans), counts[3]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl(COLUMNS))


def redacted_text(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each maximal union of overlapping spans replaced by the mark."""
    out, at, reach = [], 0, -1
    for start, _, end in sorted(spans):
        if start >= reach:
            out += [text[at:start], mark]
        reach = max(reach, end)
        at = reach
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with secrets replaced in `text`; the columns stay, n_chars (where it exists) is counted again."""
    field = trained_field(docs, sample)

    @F.pandas_udf("string")
    def cleaned(texts):
        import pandas as pd

        column = pa.array(texts, pa.string(), from_pandas=True)
        out: list[str | None] = []
        for part in sized_slices([pa.RecordBatch.from_arrays([column], names=["text"])]):
            rows = part.column(0)
            out += [t and redacted_text(t, spans) for t, (_, spans) in zip(rows.to_pylist(), scan(rows, field))]
        return pd.Series(out, index=texts.index, dtype=object)

    out = docs.withColumn("text", cleaned("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
