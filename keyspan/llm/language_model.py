"""Scores of texts under a hierarchical Pitman-Yor model of word pairs.

Every word is a context with a restaurant, whose customers are the words that follow it in the
training texts; the tables of all these restaurants are the customers of one parent restaurant,
over a uniform distribution of all known words and one unknown.  Seating is sampled by Gibbs:

* Given the parent's probabilities, the restaurants of contexts are independent, and given a
  gamma variable for each, so are the tables of their words: t tables of c customers have weight
  S(c, t) (discount * variable * probability) ** t, S being the generalised Stirling numbers.  So
  a sweep draws each restaurant's variable and then, for all its customers at once, the tables of
  each word.
* Given all tables of contexts, the parent's customers are known; its variable, its tables and
  its probabilities (gamma variables of customers less discounted tables) are drawn likewise.

These two steps alternate ROUNDS times, contexts with several sweeps in each; the samples are
taken in the last round.  A score averages the samples' predictive probabilities, each from one
sample's own tables of context, word and parent.

Blocks of documents (see blocks.py) ask parts of a hash space, first for the count and the number of each of their words, then for each
pair of numbers; a part keeps its pairs that occur more than once as its state, on which the
rounds work, as any other pair has one table.  Numbers are given by frequency, so that what is
sent is small.  A context of more than PART_WORDS customers is spread over parts; its gamma
variable, like the parent's, is drawn from the total of its tables, one number for each such
context and part.  The number of parts and all draws depend on the data alone.  All counts cover
all training texts; no word or pair is left out.  Words are told apart by 64-bit hashes.

Defined results: a null or empty text is its end alone; a null doc_id is held out and scored;
texts are read whole; rows that share a doc_id each count; an empty table gives no rows; with
no training text all probabilities are uniform over the unknown word; other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import hashed, mixed, numbered_words

COLUMNS = [("doc_id", "long"), ("held_out", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"),
           ("base_score", "double"), ("score", "double")]
END = b"\n"  # no word has a line end
FOLDS, ADDED = 10, 0.1
#: Discount and strength of the restaurants of contexts, and of their parent.
DISCOUNT, STRENGTH = 0.8, 1.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.6, 10.0
#: Turns of contexts and parent; sweeps of contexts in each before anything is taken, and between samples; samples.
ROUNDS, SWEEPS, BETWEEN, SAMPLES = 2, 3, 2, 3
#: Customers of a word up to which its numbers of tables are weighed one by one.
EXACT = 64
#: Weight from which the numbers of tables of more customers are by the saddle point: against exact
#: sums for 100, 600 and 5,000 customers, either way is within 4 % of the mean.
WIDE = 30
#: Words for each part, and least number of parts: both fixed, so that results depend on no setting.
PART_WORDS, LEAST_PARTS = 3_000_000, 16
SEED = 11


def held_out(doc: int) -> bool:
    return doc == B.NULL_ID or zlib.crc32(str(doc).encode()) % FOLDS == 0


def seated(count, context, base, tables, contexts: int, fixed, variable, sweeps: int, random, discount: float = DISCOUNT, strength: float = STRENGTH) -> np.ndarray:
    """Tables of each dish after some sweeps.

    count, context, base, tables: customers, restaurant, parent probability and present tables of
    each dish.  fixed: tables of each restaurant that are not among the dishes.
    variable: each restaurant's gamma variable where it is given, 0 where it is to be drawn.
    """
    order = np.argsort(count, kind="stable")
    ascending = count[order]
    for _ in range(sweeps):
        total = fixed + np.bincount(context, tables, contexts)
        v = np.where(variable > 0, variable, random.gamma(strength / discount + total))
        tables = np.empty(len(count))
        tables[order] = drawn_tables(ascending, (discount * v[context] * base)[order], discount, random)
    return tables


_STIRLING: dict[float, list[np.ndarray]] = {}


def stirling(discount: float) -> list[np.ndarray]:
    """Logarithms of S(c, t) for t = 1 .. c, for each c up to EXACT."""
    if discount in _STIRLING:
        return _STIRLING[discount]
    rows = [np.zeros(0), np.ones(1)]
    for c in range(1, EXACT):
        rows.append(np.append((c - discount * np.arange(1, c + 1)) * rows[c], 0) + np.append(0, rows[c]))
    _STIRLING[discount] = [np.log(r) for r in rows]
    return _STIRLING[discount]


def drawn_tables(c: np.ndarray, weight: np.ndarray, discount: float, random) -> np.ndarray:
    """A draw of t under S(c, t) weight ** t for each dish; c ascends.

    Up to EXACT customers all t are weighed.  For more, a weight under WIDE lets mean and variance
    follow their equations from there on as customers come, with the third cumulant that Poisson
    and binomial numbers have; others are by the saddle point of the generating function
    exp(weight / discount (1 - (1 - z) ** discount)).  The draw is then normal.
    """
    t, logs = np.empty(len(c)), np.log(weight)
    sizes, first = np.unique(np.minimum(c, EXACT), return_index=True)
    variance = np.zeros(len(c) - int(np.searchsorted(c, EXACT, "right")))
    large, mean = len(c) - len(variance), np.zeros(len(variance))
    for n, start, end in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(c)]):
        places = np.arange(1.0, n + 1)  # no matrix products, whose library would take threads of its own
        step = max(1, (1 << 17) // n)
        for at in range(start, end, step):
            k = slice(at, min(at + step, end))
            shares = logs[k, None] * places + stirling(discount)[n]
            shares = np.exp(shares - shares.max(1, keepdims=True))
            up = np.cumsum(shares, 1)
            t[k] = 1 + (up[:, :-1] < (random.random(len(up)) * up[:, -1])[:, None]).sum(1)
            if k.stop > large:
                late = max(large - at, 0)
                own = slice(at + late - large, k.stop - large)
                mean[own], squares = (np.einsum("ij,j->i", shares[late:], x) / up[late:, -1] for x in (places, places * places))
                variance[own] = np.maximum(squares - mean[own] ** 2, 0)
    if len(variance):
        size, w, m, v, n = c[large:], weight[large:], mean, variance, np.full(len(variance), float(EXACT))

        def slopes(n, m, v, w):
            all_ = w + n - 0.5 - discount * m
            up = (w - discount * v) / all_
            third = v * (2 * v / np.maximum(m - 1, 1e-9) - 1)
            return up, (w - discount * third) / all_ - up * up

        at = 0
        while at < len(size):
            k = slice(at, None)
            step = np.minimum(n[k] / 8, size[k] - n[k])
            dm, dv = slopes(n[k], m[k], v[k], w[k])
            dm, dv = slopes(n[k] + step / 2, m[k] + step / 2 * dm, np.maximum(v[k] + step / 2 * dv, 0), w[k])
            m[k] += step * dm
            v[k] = np.maximum(v[k] + step * dv, 0)
            n[k] += step
            at = int(np.searchsorted(size, n[-1], "right")) if n[-1] < size[-1] else len(size)
        wide = np.flatnonzero(w >= WIDE)
        low, high, x, y = np.full(len(wide), -40.0), np.full(len(wide), 40.0), np.log(w[wide]), np.log(size[wide])
        for _ in range(40 if len(wide) else 0):
            # z / (1 - z) = exp(mid)
            mid = (low + high) / 2
            over = x + mid - discount * np.logaddexp(0, mid) > y
            low, high = np.where(over, low, mid), np.where(over, mid, high)
        z, rest = 1 / (1 + np.exp(-low)), 1 / (1 + np.exp(low))
        m[wide] = w[wide] / discount * -np.expm1(-discount * np.logaddexp(0, low))
        v[wide] = np.maximum(m[wide] - size[wide] * rest / (1 - discount * z), 0)
        m[wide] += (1 - discount) * z / (1 - discount * z) ** 2 / 2
        t[large:] = np.clip(np.rint(random.normal(m, np.sqrt(v))), 1, size)
    return t


def first_tables(count: np.ndarray) -> np.ndarray:
    """Where a chain begins."""
    return np.maximum(1, np.floor(count**DISCOUNT))


class Tokens:
    """The tokens of a block in one row: numbers of distinct words, with the one before each."""

    def __init__(self, ids: bytes, sizes: bytes, texts: bytes):
        distinct, index, counts = numbered_words(B.texts_of(sizes, texts), lower=True)
        keys = hashed([*distinct, END])
        order = np.argsort(keys)
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        self.ids, self.sizes, self.keys = np.frombuffer(ids, np.int64), counts + 1, keys[order]
        self.word = np.insert(rank[index], np.cumsum(counts), rank[-1])
        self.before = np.append(rank[-1], self.word[:-1])[: len(self.word)]  # before each text is an end
        self.held = np.array([held_out(i) for i in self.ids.tolist()], bool)
        self.train = np.repeat(~self.held, self.sizes)
        self.doc = np.repeat(np.arange(len(self.ids)), self.sizes)

    def parts(self, parts: int) -> list[tuple[int, np.ndarray]]:
        return list(B.split_by((self.keys % np.uint64(parts)).astype(np.int64), parts))

    def counted(self, parts: int, answers: list) -> tuple[np.ndarray, np.ndarray]:
        """The count and the number of each distinct word."""
        out = np.zeros((2, len(self.keys)), np.int64)
        for (_, k), data in zip(self.parts(parts), B.in_order(answers)):
            out[:, k] = [B.from_planes(section(data, 0)), B.from_planes(section(data, 1))]
        return out[0], out[1]

    def pairs(self, parts: int, counts: np.ndarray, numbers: np.ndarray):
        """Distinct pairs, by number: their places in each part, contexts and words (places of distinct words), each token's pair, and by how many a context is spread."""
        order = np.argsort(numbers)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        keys, inverse = np.unique(rank[self.before] * len(order) + rank[self.word], return_inverse=True)
        context, word = np.divmod(keys, max(len(order), 1))
        context, word = order[context], order[word]
        spread = 1 + counts[context] // PART_WORDS
        home = mixed(numbers[context].astype(np.uint64) + mixed(mixed(numbers[word].astype(np.uint64)) % spread.astype(np.uint64)))
        return list(B.split_by((home % np.uint64(parts)).astype(np.int64), parts)), context, word, inverse, spread


def over_tokens(blocks: DataFrame, work, columns: list[tuple[str, str]], *more: str) -> DataFrame:
    """Rows that work(block, tokens, *more) yields for each block."""
    return B.over_rows(blocks.select("block", "ids", "sizes", "texts", *more), lambda: lambda block, ids, sizes, texts, *rest: work(block, Tokens(ids, sizes, texts), *rest), columns)


def runs_of(context: np.ndarray) -> np.ndarray:
    """Places where a new context begins, in a sorted row."""
    return np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(context)])


def sections(*parts: bytes) -> bytes:
    """Byte strings one after the other, each with its size."""
    return b"".join(x for p in parts for x in (len(p).to_bytes(4, "little"), p))


def section(body: bytes, number: int) -> bytes:
    at = 0
    for _ in range(number):
        at += 4 + int.from_bytes(body[at : at + 4], "little")
    return body[at + 4 : at + 4 + int.from_bytes(body[at : at + 4], "little")]


def all_sections(body: bytes) -> list[np.ndarray]:
    """The numbers of every section, each of which is planed."""
    out, at = [], 0
    while at < len(body):
        size = int.from_bytes(body[at : at + 4], "little")
        out.append(B.from_planes(body[at + 4 : at + 4 + size]))
        at += 4 + size
    return out


def numbers_of(*values: np.ndarray) -> bytes:
    return sections(*(B.planed(v) for v in values))


def by_sample(x: np.ndarray) -> list[np.ndarray]:
    """The first sample, and each other one's differences to the one before: small numbers, those below zero odd."""
    d = np.diff(x, axis=0)
    return [x[0], *(d << 1 ^ d >> 63)]


def from_samples(values: list[np.ndarray]) -> np.ndarray:
    d = np.stack(values[1:]) if len(values) > 1 else np.empty((0, len(values[0])), np.int64)
    return np.cumsum(np.concatenate([values[0][None], d >> 1 ^ -(d & 1)]), 0)


def logs(x: np.ndarray) -> bytes:
    """Numbers above zero, to 0.04 %, in two bytes each."""
    return np.clip(np.rint((np.log2(x) + 32) * 1000), 0, 65535).astype("<u2").tobytes()


def from_logs(data: bytes) -> np.ndarray:
    return np.exp2(np.frombuffer(data, "<u2") / 1000 - 32)


def steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences in rows that begin at the places `first`, each row's first value as it is."""
    out = np.diff(values, prepend=0)
    out[first] = values[first]
    return out


def from_steps(out: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.cumsum(out)
    return total - np.repeat(total[first] - out[first], lengths)


def asked_words(found: DataFrame, parts: int) -> DataFrame:
    """Each block's distinct words and their counts in its training texts."""

    def work(block, tokens):
        counts = np.bincount(tokens.word[tokens.train], minlength=len(tokens.keys))
        for p, k in tokens.parts(parts):
            yield p, block, sections(tokens.keys[k].tobytes(), B.planed(counts[k]))

    return over_tokens(found, work, B.ASKED)


def counted_words(parts: int):
    """The count of each word over all blocks and its number: its rank by count in the part, times the parts, plus the part; as block -1, the part's numbers of tokens and of words."""

    def answer(part, blocks, bodies):
        keys = [np.frombuffer(section(b, 0), np.uint64) for b in bodies]
        counts = np.concatenate([B.from_planes(section(b, 1)) for b in bodies])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
        number = np.empty(len(distinct), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(distinct)) * parts + part
        edges = np.cumsum([len(k) for k in keys])[:-1]
        for block, n, m in zip(blocks, np.split(total[inverse], edges), np.split(number[inverse], edges)):
            yield block, part, numbers_of(n, m)
        yield -1, part, np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()

    return answer


def asked_pairs(found: DataFrame, parts: int) -> DataFrame:
    """Each block's distinct pairs, by context: its number, how many pairs it has and by how many it is spread; of each pair the word and the pair's count."""

    def work(block, tokens, words):
        counts, numbers = tokens.counted(parts, words)
        places, context, word, inverse, spread = tokens.pairs(parts, counts, numbers)
        times = np.bincount(inverse[tokens.train], minlength=len(context))
        for p, k in places:
            first = runs_of(context[k])
            lengths = np.diff(np.append(first, len(k)))
            yield p, block, numbers_of(np.diff(numbers[context[k[first]]], prepend=0), lengths, spread[k[first]], steps(numbers[word[k]], first), times[k])

    return over_tokens(found, work, B.ASKED, "counted")


#: Rows of a part that are no answers to blocks: its state, and its totals.
STATE, TOTALS, TO_PARTS, MORE = -1, -2, -10, -(1 << 40)


class State:
    """What a part knows of its pairs: contexts, words, and of pairs that occur more than once the count and the tables of each sample.

    own: numbers of contexts; shared: whether a context is spread over parts; single: its pairs
    that occur once; words: numbers of words in seen pairs; once: how many pairs of a word occur
    once; context, word: places of a pair's in these; count ascends; tables: one row a sample.
    """

    def __init__(self, body: bytes):
        own, shared, self.single, words, self.once, self.context, self.word, count, *tables = all_sections(body)
        self.own, self.shared, self.words, self.count = np.cumsum(own), shared.astype(bool), np.cumsum(words), np.cumsum(count)
        self.tables = [t.astype(np.float64) for t in tables]

    def written(self) -> bytes:
        return numbers_of(np.diff(self.own, prepend=0), self.shared.astype(np.int64), self.single, np.diff(self.words, prepend=0), self.once, self.context, self.word, np.diff(self.count, prepend=0), *(t.astype(np.int64) for t in self.tables))

    @classmethod
    def of(cls, own, shared, context, word, count) -> State:
        """From distinct pairs in order; count 0 stands for pairs of held-out texts alone."""
        new = cls.__new__(cls)
        new.own, new.shared = own, shared
        once = count == 1
        new.single = np.bincount(context[once], minlength=len(own)).astype(np.int64)
        seen = count > 0
        new.words, place = np.unique(word[seen], return_inverse=True)
        new.once = np.bincount(place[once[seen]], minlength=len(new.words)).astype(np.int64)
        many = count[seen] > 1
        new.context, new.word, new.count = context[seen][many], place[many], count[seen][many]
        new.tables = [first_tables(new.count)]
        return new

    def has(self) -> np.ndarray:
        """Which words are in a pair that occurs more than once: of these the parent's probability is asked for."""
        return np.bincount(self.word, minlength=len(self.words)) > 0

    def of_words(self) -> list[np.ndarray]:
        """Tables of each word, a row for each sample."""
        return [self.once + np.bincount(self.word, t, len(self.words)).astype(np.int64) for t in self.tables]

    def of_contexts(self) -> list[np.ndarray]:
        return [self.single + np.bincount(self.context, t, len(self.own)).astype(np.int64) for t in self.tables]

    def messages(self, part: int, parts: int, contexts: bool):
        """The state; the totals that the driver gathers: tables, and those of spread contexts; for each part, tables of its words, which of them the state has, and tables of the contexts that they are."""
        yield STATE, part, self.written()
        words, rooms = self.of_words(), self.of_contexts()
        yield TOTALS, part, numbers_of(np.array([w.sum() for w in words]), self.own[self.shared], rooms[-1][self.shared])
        to_words = dict(B.split_by(self.words % parts, parts))
        to_contexts = dict(B.split_by(self.own % parts, parts)) if contexts else {}
        none = np.empty(0, np.int64)
        for q in sorted(to_words.keys() | to_contexts.keys()):
            w, c = to_words.get(q, none), to_contexts.get(q, none)
            yield TO_PARTS - q, part, numbers_of(np.diff(self.words[w] // parts, prepend=0), np.diff(self.own[c] // parts, prepend=0), self.has()[w].astype(np.int64), *(x[w] for x in words), *(x[c] for x in rooms))


def merged_pairs(parts: int):
    """For each block the counts of its pairs; under MORE - block, the places in the part's state of those that occur more than once; the state and its messages."""

    def answer(part, blocks, bodies):
        asked = [all_sections(b) for b in bodies]
        contexts = [np.cumsum(a[0]) for a in asked]
        lengths = [a[1] for a in asked]
        spread, times = (np.concatenate([a[k] for a in asked]) for k in (2, 4))
        word = np.concatenate([from_steps(a[3], np.cumsum(n) - n, n) for a, n in zip(asked, lengths)])
        sizes = [int(n.sum()) for n in lengths]
        own, which = np.unique(np.concatenate(contexts), return_inverse=True)
        shared = np.zeros(len(own), bool)
        shared[which] = spread > 1
        width = int(word.max()) + 1
        keys, inverse = np.unique(np.repeat(which, np.concatenate(lengths)) * width + word, return_inverse=True)
        context, word = np.divmod(keys, width)
        count = np.bincount(inverse, times, len(keys)).astype(np.int64)
        place = np.cumsum(count > 1) - 1
        for block, k in zip(blocks, np.split(inverse, np.cumsum(sizes)[:-1])):
            n = count[k]
            yield block, part, B.planed(n)
            yield MORE - block, part, B.planed(np.diff(place[k[n > 1]], prepend=0))
        yield from State.of(own, shared, context, word, count).messages(part, parts, False)

    return answer


def parent_draws(parts: int, uniform: float, turn: int, variable: float):
    """The parent restaurant's step: to each part that sent tables, gamma variables of its words' customers less discounted tables; as block TOTALS, the tables drawn here."""

    def answer(part, blocks, bodies):
        random = np.random.default_rng([SEED, 1, turn, part])
        sent = [all_sections(b) for b in bodies]
        ranks = [np.cumsum(s[0]) for s in sent]
        size = 1 + max((int(r[-1]) for r in ranks if len(r)), default=-1)
        customers = np.zeros(size, np.int64)
        for r, s in zip(ranks, sent):
            customers[r] += s[3]
        tables, mass = parent_step(customers, variable, uniform, random)
        for block, r, s in zip(blocks, ranks, sent):
            yield block, part, logs(mass[r[s[2] > 0]])
        yield TOTALS, part, np.array([tables.sum()]).tobytes()

    return answer


def parent_tables(customers: np.ndarray, variable: float, uniform: float, random) -> np.ndarray:
    """Tables of each word in the parent restaurant, given its gamma variable."""
    known = np.flatnonzero(customers)
    known = known[np.argsort(customers[known], kind="stable")]
    tables = np.zeros(len(customers))
    if len(known):
        tables[known] = drawn_tables(customers[known], np.full(len(known), PARENT_DISCOUNT * variable * uniform), PARENT_DISCOUNT, random)
    return tables


def parent_step(customers: np.ndarray, variable: float, uniform: float, random) -> tuple[np.ndarray, np.ndarray]:
    """The parent's tables of each word, and gamma variables of its customers less discounted tables."""
    tables = parent_tables(customers, variable, uniform, random)
    return tables, random.gamma(np.maximum(customers - PARENT_DISCOUNT * tables, 1e-9))


def parent_shares(mass: np.ndarray, tables: float, customers: float, uniform: float) -> np.ndarray:
    """The parent's probabilities, given all its tables and customers: its draws, and the rest that goes to the uniform distribution."""
    return (mass + (PARENT_STRENGTH + PARENT_DISCOUNT * tables) * uniform) / (PARENT_STRENGTH + customers)


def children(states: DataFrame, masses: DataFrame, parts: int, turn: int, last: bool, share_of, variables: dict[int, float]) -> DataFrame:
    """The contexts' step of each part: its messages with new tables, in the last turn of SAMPLES samples."""

    def work(part, body, answers):
        random, state = np.random.default_rng([SEED, 2, turn, part]), State(body)
        base, has = np.zeros(len(state.words)), state.has()
        for (_, k), data in zip(B.split_by(state.words % parts, parts), B.in_order(answers)):
            base[k[has[k]]] = from_logs(data)
        base = share_of(base)
        given = np.array([variables.get(n, 0.0) for n in state.own.tolist()]) if variables else np.zeros(len(state.own))
        step = lambda t, n: seated(state.count, state.context, base[state.word], t, len(state.own), state.single, given, n, random)
        state.tables = [step(state.tables[-1], SWEEPS)]
        if last:
            while len(state.tables) < SAMPLES:
                state.tables.append(step(state.tables[-1], BETWEEN))
        yield from state.messages(part, parts, last)

    joined = states.join(masses, "part", "left")  # a part without training pairs has asked for nothing
    return B.over_rows(joined.select("part", "body", "masses"), lambda: work, [("block", "long"), ("part", "long"), ("answer", "binary")])


def seated_words(parts: int, uniform: float, variables: list[float]):
    """For each word of each block, by sample: its customers and tables in the parent restaurant, and the tables of its own; as block TOTALS, the parent's totals here."""

    def answer(part, blocks, bodies):
        sent = [all_sections(b) for k, b in zip(blocks, bodies) if k <= TO_PARTS]
        wanted = [(k, B.from_planes(section(b, 1)) // parts) for k, b in zip(blocks, bodies) if k >= 0]
        size = 1 + max([-1, *(int(r.max()) for _, r in wanted if len(r))])
        customers, own, tables = (np.zeros((SAMPLES, size), np.int64) for _ in range(3))
        for s in sent:
            w, c = np.cumsum(s[0]), np.cumsum(s[1])
            for k in range(SAMPLES):
                customers[k, w] += s[3 + k]
                own[k, c] += s[3 + SAMPLES + k]
        for k in range(SAMPLES):
            tables[k] = parent_tables(customers[k], variables[k], uniform, np.random.default_rng([SEED, 3, k, part]))
        yield TOTALS, part, numbers_of(customers.sum(1), tables.sum(1))
        for block, ranks in wanted:
            yield block, part, numbers_of(*(v for x in (customers, tables, own) for v in by_sample(x[:, ranks])))

    return answer


def sampled_tables(parts: int):
    """For each block, the tables of its pairs that occur more than once, by sample."""

    def answer(part, blocks, bodies):
        state = next(State(b) for k, b in zip(blocks, bodies) if k == STATE)
        tables = [t.astype(np.int64) for t in state.tables]
        for block, body in zip(blocks, bodies):
            if block >= 0:
                at = np.cumsum(B.from_planes(body))
                yield block, part, numbers_of(*(t[at] for t in tables))

    return answer


def as_asked(rows: DataFrame) -> DataFrame:
    """Messages from part to part, as questions."""
    return rows.where(F.col("block").between(MORE + 1, TO_PARTS)).select((TO_PARTS - F.col("block")).alias("part"), (TO_PARTS - F.col("part")).alias("block"), F.col("answer").alias("body"))


def totals_of(rows: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """Over all parts, the tables of each sample, and those of each spread context: a few numbers for each part."""
    total, spread = 0, {}
    for r in rows.where(F.col("block") == TOTALS).orderBy("part").collect():
        tables, contexts, rooms = all_sections(r["answer"])
        total = total + tables
        for c, t in zip(contexts.tolist(), rooms.tolist()):
            spread[c] = spread.get(c, 0) + t
    return np.atleast_1d(total), spread


def scored(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text)."""
    found = B.cut(B.in_blocks(docs), forget=True)
    parts = max(LEAST_PARTS, -(-(found.agg(F.sum("words")).first()[0] or 0) // PART_WORDS))
    words = B.cut(B.answered(asked_words(found, parts), parts, counted_words(parts)), forget=True)
    # what comes to the driver: two numbers for each part
    totals = [np.frombuffer(r["answer"], np.int64) for r in words.where("block = -1").collect()]
    train_tokens, vocabulary = (int(x) for x in np.sum(totals, axis=0)) if totals else (0, 0)
    uniform = 1.0 / (vocabulary + 1)
    random = np.random.default_rng([SEED, 0])

    def variable_for(tables: float) -> float:
        return float(random.gamma(PARENT_STRENGTH / PARENT_DISCOUNT + tables))

    with_words = B.with_answers(found, words.where("block >= 0"), "counted")
    merged = B.cut(B.answered(asked_pairs(with_words, parts), parts, merged_pairs(parts)), forget=True)
    rows, above = merged, min(vocabulary, train_tokens)  # the parent begins with a table for each word
    for turn in range(ROUNDS):
        customers, spread = totals_of(rows)
        masses = B.cut(B.answered(as_asked(rows), parts, parent_draws(parts, uniform, turn, variable_for(above))), forget=True)
        above = math.fsum(float(np.frombuffer(r["answer"], np.float64)[0]) for r in masses.where(F.col("block") == TOTALS).collect())
        # a part's answers come back under the number by which it asked
        gathered = masses.where(F.col("block") <= TO_PARTS).select((TO_PARTS - F.col("block")).alias("part"), F.struct("part", "answer").alias("a")).groupBy("part").agg(F.collect_list("a").alias("masses"))
        states = rows.where(F.col("block") == STATE).select("part", F.col("answer").alias("body"))
        variables = {c: float(random.gamma(STRENGTH / DISCOUNT + t)) for c, t in sorted(spread.items())}
        tables, all_customers = above, float(customers[-1])
        share_of = lambda mass, t=tables, c=all_customers: parent_shares(mass, t, c, uniform)
        rows = B.cut(children(states, gathered, parts, turn, turn == ROUNDS - 1, share_of, variables), forget=True)
    asked = words.where("block >= 0").select("part", "block", F.col("answer").alias("body"))
    parent = B.cut(B.answered(asked.unionByName(as_asked(rows)), parts, seated_words(parts, uniform, [variable_for(above) for _ in range(SAMPLES)])), forget=True)
    rooms = [all_sections(r["answer"]) for r in parent.where(F.col("block") == TOTALS).collect()]
    customers_all, tables_all = (sum(r[k] for r in rooms) for k in (0, 1)) if rooms else (np.zeros(SAMPLES), np.zeros(SAMPLES))
    wanted = merged.where(F.col("block") <= MORE).select("part", (MORE - F.col("block")).alias("block"), F.col("answer").alias("body")).unionByName(rows.where(F.col("block") == STATE).select("part", "block", F.col("answer").alias("body")))
    tables = B.answered(wanted, parts, sampled_tables(parts))

    def work(block, tokens, words, pairs, samples, parent):
        counts, numbers = tokens.counted(parts, words)
        customers, tables, own = (np.zeros((SAMPLES, len(counts)), np.int64) for _ in range(3))
        for (_, k), data in zip(tokens.parts(parts), B.in_order(parent)):
            values = all_sections(data)
            for x, at in ((customers, 0), (tables, SAMPLES), (own, 2 * SAMPLES)):
                x[:, k] = from_samples(values[at : at + SAMPLES])
        places, context, word, inverse, _ = tokens.pairs(parts, counts, numbers)
        n, t = np.zeros(len(context), np.int64), np.zeros((SAMPLES, len(context)), np.int64)
        for (_, k), data, drawn in zip(places, B.in_order(pairs), B.in_order(samples)):
            n[k] = B.from_planes(data)
            t[:, k] = n[k] > 0
            t[:, k[n[k] > 1]] = all_sections(drawn)
        share = np.zeros(len(context))
        for s in range(SAMPLES):
            above = (customers[s] - PARENT_DISCOUNT * tables[s] + (PARENT_STRENGTH + PARENT_DISCOUNT * tables_all[s]) * uniform) / (PARENT_STRENGTH + customers_all[s])
            # a word is followed as often as it occurs, and an end as often as texts begin
            share += (n - DISCOUNT * t[s] + (STRENGTH + DISCOUNT * own[s][context]) * above[word]) / (STRENGTH + counts[context]) / SAMPLES
        size = len(tokens.ids)
        score = np.bincount(tokens.doc, np.log10(share)[inverse], size)
        base = np.log10((counts + ADDED) / (train_tokens + ADDED * (vocabulary + 1)))[tokens.word]
        base = np.bincount(tokens.doc, base, size)
        known = np.bincount(tokens.doc, counts[tokens.word] > 0, size).astype(np.int64)
        for doc, *values in zip(tokens.ids.tolist(), tokens.held.tolist(), tokens.sizes.tolist(), known.tolist(), [train_tokens] * size, base.tolist(), score.tolist()):
            yield None if doc == B.NULL_ID else doc, *values

    full = B.with_answers(B.with_answers(B.with_answers(with_words, merged.where("block >= 0"), "pairs"), tables, "samples"), parent.where("block >= 0"), "parent")
    return over_tokens(full, work, COLUMNS, "counted", "pairs", "samples", "parent")
