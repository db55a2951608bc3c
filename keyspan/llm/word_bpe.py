"""Token ids of texts under a word tokenizer, from the ids of their distinct words.

The tokenizer (lower-casing, white space dropped, merges never across words) is read from its
file.  A slice of texts is split and its words numbered by Arrow; ids are looked up once for each
distinct word and then gathered by number.  Words that are lower-case Latin letters, with or
without ASCII marks behind them, are merged here, many at a time: in each round every word's
pairs of the lowest rank are merged, which is what the tokenizer does one by one, as a merge
never makes a pair of a lower rank than its own (checked when the file is read).  All other
words go to the tokenizer itself.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a task remembers.
WORDS = 500_000
#: Bytes of words that are merged together, and words whose ids are gathered at once.
TOGETHER, GATHERED = 200_000, 60_000
#: Lower-case letters up to U+024F, whose lower-case and composed forms are settled, and ASCII marks.
LETTERS = "".join(c for c in map(chr, range(ord("a"), 0x250)) if c.isalpha() and c.islower())
PLAIN = f"^[{LETTERS}]+[!-/:-@\\[-`{{-~]*$"
NEVER = 1 << 30


def strings(x: pa.Array) -> list[str]:
    return x.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist


class PairRanks:
    """The rank of a pair of symbols, NEVER if it is not merged: a hash table, and a sorted list of what collides in it."""

    BITS = 18

    def __init__(self, left: np.ndarray, right: np.ndarray):
        key = left.astype(np.int64) << 20 | right
        rank, slot = np.arange(len(key)), self.slots(key)
        _, first = np.unique(slot, return_index=True)
        self.key, self.rank, self.crowded = np.full(1 << self.BITS, -1), np.full(1 << self.BITS, NEVER), np.zeros(1 << self.BITS, bool)
        self.key[slot[first]], self.rank[slot[first]] = key[first], rank[first]
        rest = np.setdiff1d(rank, first)
        self.crowded[slot[rest]] = True
        order = rest[np.argsort(key[rest])]
        self.rest_key, self.rest_rank = np.append(key[order], 1 << 62), np.append(rank[order], NEVER)

    def slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        slot = self.slots(key)
        found = self.key[slot] == key
        out = np.where(found, self.rank[slot], NEVER)
        again = np.flatnonzero(~found & self.crowded[slot])
        at = np.searchsorted(self.rest_key, key[again])
        out[again] = np.where(self.rest_key[at] == key[again], self.rest_rank[at], NEVER)
        return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class Merger:
    """Merges of many words at once; words are lower-case letters up to LETTERS."""

    def __init__(self, model: dict):
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters])
        self.last = np.array([vocabulary[c + end] for c in letters])
        self.marks = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [a + b for a, b in pairs]
        self.result = np.array([vocabulary[m] for m in made])
        self.ranks = PairRanks(np.array([vocabulary[a] for a, _ in pairs]), np.array([vocabulary[b] for _, b in pairs]))
        born = {m: k for k, m in enumerate(made)}
        if len(born) < len(made) or any(max(born.get(a, -1), born.get(b, -1)) >= k for k, (a, b) in enumerate(pairs)):
            raise ValueError("merges are not in the order in which symbols arise")

    def __call__(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, given as bytes one after the other with their sizes, and how many ids each word has."""
        last = np.zeros(len(raw), bool)
        last[np.cumsum(size) - 1] = True
        word_of = np.repeat(np.arange(len(size)), size)
        mark = self.marks[raw]
        last[:-1] |= ~mark[:-1] & mark[1:]  # marks behind letters are a word of their own
        symbol = np.where(last, self.last[raw], self.inner[raw])
        word = np.cumsum(last) - last
        whole = word_of[last]
        rank = np.full(len(symbol), NEVER)
        inside = np.flatnonzero(~last)
        rank[inside] = self.ranks(symbol[inside], symbol[inside + 1])
        done_symbols, done_words = [], []
        while len(symbol):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            over = lowest == NEVER
            if over.any():
                done_symbols.append(symbol[over])
                done_words.append(word[over])
            at = np.flatnonzero((rank == lowest) & ~over)
            if not len(at):
                break
            if len(at) > 1 and (at[1:] == at[:-1] + 1).any():  # a symbol repeated: every other pair of the run, from the left
                begins = np.append(True, at[1:] != at[:-1] + 1)
                at = at[(at - at[begins][np.cumsum(begins) - 1]) % 2 == 0]
            symbol[at] = self.result[rank[at]]
            stays = ~over
            stays[at + 1] = False
            place = np.cumsum(stays) - 1
            at = place[at]
            symbol, word, rank = symbol[stays], word[stays], rank[stays]
            rank[at] = NEVER
            changed = np.concatenate([at, at[at > 0] - 1])
            changed = changed[changed + 1 < len(word)]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed] = self.ranks(symbol[changed], symbol[changed + 1])
        symbols, of = np.concatenate(done_symbols or [symbol]), np.concatenate(done_words or [word])
        return symbols[np.argsort(of, kind="stable")], np.bincount(whole[of], minlength=len(size))


class WordTokenizer:
    """Ids of texts, an end id behind each text's."""

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end_id
        with open(path, encoding="utf-8") as file:
            self.merger = Merger(json.load(file)["model"])
        self.forget()

    def forget(self) -> None:
        kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 and self.end < 1 << 16 else np.uint32
        self.number: dict[str, int] = {"\n": 0, "": 1}  # no word has a line end
        self.ids, self.filled = np.full(1 << 20, self.end, kind), 1
        self.start, self.size = np.zeros(1 << 20, np.int64), np.zeros(1 << 20, np.int64)
        self.size[0] = 1

    def keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Give numbers to new words; ids of all of them, one word after the other."""
        while len(self.ids) < self.filled + len(ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while len(self.size) < len(self.number) + len(words):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        n = len(self.number)
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.start[n : n + len(words)] = self.filled + np.cumsum(sizes) - sizes
        self.size[n : n + len(words)] = sizes
        self.filled += len(ids)
        self.number.update(zip(words, range(n, n + len(words))))

    def merge(self, words: pa.Array, named: list[str]) -> None:
        """Look up words that match PLAIN, for the words as they are in texts."""
        edges, text = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64), words.buffers()[2]
        at = 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + TOGETHER, "right")) - 1)
            ids, sizes = self.merger(np.frombuffer(text, np.uint8)[edges[at] : edges[to]], np.diff(edges[at : to + 1]))
            self.keep(named[at:to], ids, sizes)
            at = to

    def learn(self, words: list[str]) -> None:
        """Look up the ids of new words."""
        every = pa.array(words, pa.string())
        low = pc.ascii_lower(every)
        plain = pc.match_substring_regex(low, PLAIN)
        self.merge(low.filter(plain), strings(every.filter(plain)))
        other = strings(every.filter(pc.invert(plain)))
        for at in range(0, len(other), 4096):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(other[at : at + 4096], add_special_tokens=False)]
            self.keep(other[at : at + 4096], np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has; a null is an empty text."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = words.flatten().dictionary_encode()
        distinct = strings(coded.dictionary)
        if len(self.number) > WORDS:
            self.forget()
        if new := [w for w in distinct if w not in self.number]:
            self.learn(new)
        edges = words.offsets.to_numpy()
        # number 0 is the end id, behind each text's words
        number = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))
        number = np.insert(number[coded.indices.to_numpy()], edges[1:] - edges[0], 0)
        gathered, sizes = [], []
        for at in range(0, len(number), GATHERED):
            some = number[at : at + GATHERED]
            size = self.size[some]
            ends = np.cumsum(size)
            gathered.append(self.ids[np.repeat(self.start[some] - ends + size, size) + np.arange(ends[-1])])
            sizes.append(size)
        ends = np.cumsum(np.concatenate(sizes or [edges[:0]]))
        last = np.cumsum(np.diff(edges) + 1) - 1
        return np.concatenate(gathered or [self.ids[:0]]), np.diff(ends[last], prepend=0)
