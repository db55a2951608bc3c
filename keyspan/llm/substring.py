"""Removal of long repeated word sequences, by difference-cover anchors.

A match of WINDOW words starts anywhere in either document.  Anchors are runs of ANCHOR words
that begin at positions which are, modulo PERIOD, in COVER; as every difference modulo PERIOD is
one of two members of COVER, some anchor of a match begins within its first PERIOD words at
cover positions of both documents.  So only COVER / PERIOD of the positions are hashed and
compared.  From the anchors that occur in more than one document, matches are extended: every
window of WINDOW words around a shared anchor is hashed (128 bits), and a window is removed from
a document if it also starts in one with a smaller doc_id.

Anchors and windows are asked for by blocks (see blocks.py), so that a passage that many
documents hold is sent once for each block of documents.  Answers are bits.

Defined results: a null, empty or short text has no window and keeps all its words; texts are
compared whole; repeats inside one document stay; rows that share a doc_id are one document to
the comparison, yet each gives a row; rows with a null doc_id are compared with nothing and
keep their words; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import hashed_twice, map_texts, mixed, numbered_words, windows

COLUMNS = [("doc_id", "long"), ("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string")]
WINDOW = 13
#: A difference cover of the numbers modulo 7 (fixed values): 0-0, 1-0, 3-1, 3-0, 0-3, 1-3, 0-1.
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Words:
    """The words of a block's documents in one row of numbers."""

    def __init__(self, texts: pa.Array):
        distinct, index, self.sizes = numbered_words(texts)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.hash = hashed_twice(distinct)[index]
        self.place = np.arange(len(self.doc)) - self.starts[self.doc]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the block and hashes of all anchors of documents that have a window."""
        at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.place + ANCHOR <= self.sizes[self.doc]) & (self.sizes[self.doc] >= WINDOW))
        return at, windows(self.hash[:, 0], ANCHOR)[at]

    def around(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of these anchors within their first PERIOD words."""
        hit = np.zeros(len(self.doc) + 1, np.int64)
        low = np.maximum(anchors - PERIOD + 1, self.starts[self.doc[anchors]])
        np.add.at(hit, low, 1)
        np.add.at(hit, anchors + 1, -1)
        return np.flatnonzero((np.cumsum(hit[:-1]) > 0) & (self.place + WINDOW <= self.sizes[self.doc]))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and for each key its place among them."""
    return np.unique(keys, return_inverse=True)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each anchor, by all its bits; of these only 48 are sent, so that two anchors of a part may be taken for one, which only adds candidates."""
    return (mixed(keys) % np.uint64(parts)).astype(np.int64)


def shared_anchors(found: DataFrame, parts: int) -> DataFrame:
    """Per block and part, a bit for each distinct anchor of the block: whether another document has it too."""

    def make():
        def work(block, ids, texts):
            words = Words(texts)
            at, anchor = words.anchors()
            keys, inverse = distinct(anchor)
            docs = ids[words.doc[at]]
            least, most = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
            np.minimum.at(least, inverse, docs)
            np.maximum.at(most, inverse, docs)
            many = least < most
            for p, k in B.split_by(part_of(keys, parts), parts):
                yield p, block, len(k).to_bytes(8, "little") + B.six_bytes(keys[k]) + np.packbits(many[k]).tobytes()

        return work

    def answer(part, blocks, bodies):
        sizes = [int.from_bytes(b[:8], "little") for b in bodies]
        keys = np.concatenate([B.from_six(b[8 : 8 + 6 * n]) for b, n in zip(bodies, sizes)])
        many = np.concatenate([np.unpackbits(np.frombuffer(b[8 + 6 * n :], np.uint8))[:n] for b, n in zip(bodies, sizes)]).astype(bool)
        _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
        shared = times > 1
        shared[inverse[many]] = True
        for block, bits in zip(blocks, np.split(shared[inverse], np.cumsum(sizes)[:-1])):
            yield block, part, B.packed_bits(bits)

    return B.answered(B.over_blocks(found, make, B.ASKED), parts, answer)


def candidate_windows(words: Words, answers: list, parts: int) -> np.ndarray:
    """Starts of the windows around shared anchors."""
    at, anchor = words.anchors()
    keys, inverse = distinct(anchor)
    shared = np.zeros(len(keys), bool)
    for (_, k), bits in zip(B.split_by(part_of(keys, parts), parts), B.in_order(answers)):
        shared[k] = B.bits_of(bits, len(k))
    return words.around(at[shared[inverse]])


def window_keys(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows, as rows of two numbers, and for each start its row."""
    both = np.stack([windows(words.hash[:, k], WINDOW)[at] if len(at) else np.empty(0, np.uint64) for k in (0, 1)], axis=1)
    order = np.lexsort((both[:, 1], both[:, 0]))
    ranked = both[order]
    new = np.append(True, (ranked[1:] != ranked[:-1]).any(1))[: len(ranked)]
    inverse = np.empty(len(at), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], inverse


def with_windows(found: DataFrame, parts: int) -> DataFrame:
    """Blocks with the answers from which `removed_words` tells what goes."""
    with_anchors = B.with_answers(found, B.cut(shared_anchors(found, parts)), "anchors")

    def make():
        def work(block, ids, texts, answers):
            words = Words(texts)
            at = candidate_windows(words, answers, parts)
            keys, inverse = window_keys(words, at)
            least = np.full(len(keys), np.iinfo(np.int64).max)
            np.minimum.at(least, inverse, ids[words.doc[at]])
            for p, k in B.split_by((keys[:, 0] % np.uint64(parts)).astype(np.int64), parts):
                yield p, block, len(k).to_bytes(8, "little") + keys[k].tobytes() + B.packed(least[k].tobytes())

        return work

    def answer(part, blocks, bodies):
        sizes = [int.from_bytes(b[:8], "little") for b in bodies]
        keys = np.concatenate([np.frombuffer(b[8 : 8 + 16 * n], np.uint64) for b, n in zip(bodies, sizes)]).reshape(-1, 2)
        least = np.concatenate([np.frombuffer(B.unpacked(b[8 + 16 * n :]), np.int64) for b, n in zip(bodies, sizes)])
        order = np.lexsort((least, keys[:, 1], keys[:, 0]))
        ranked = keys[order]
        new = np.append(True, (ranked[1:] != ranked[:-1]).any(1))
        first = least[order][new][np.cumsum(new) - 1]
        earlier = np.empty(len(keys), bool)
        earlier[order] = first < least[order]
        for block, bits in zip(blocks, np.split(earlier, np.cumsum(sizes)[:-1])):
            yield block, part, B.packed_bits(bits)

    answers = B.answered(B.over_blocks(with_anchors, make, B.ASKED, "anchors"), parts, answer)
    return B.with_answers(with_anchors, answers, "windows")


def removed_words(words: Words, ids: np.ndarray, anchors: list, answers: list, parts: int) -> np.ndarray:
    """For each word of the block, whether a window that an earlier document has covers it."""
    at = candidate_windows(words, anchors, parts)
    keys, inverse = window_keys(words, at)
    docs = ids[words.doc[at]]
    least = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, docs)
    earlier = np.zeros(len(keys), bool)
    for (_, k), b in zip(B.split_by((keys[:, 0] % np.uint64(parts)).astype(np.int64), parts), B.in_order(answers)):
        earlier[k] = B.bits_of(b, len(k))
    goes = at[earlier[inverse] | (least[inverse] < docs)]
    cover = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(cover, goes, 1)
    np.add.at(cover, goes + WINDOW, -1)
    return np.cumsum(cover[:-1]) > 0


def kept_rows(docs: DataFrame, columns: list[tuple[str, str]], make) -> DataFrame:
    """What make()(text, its words joined by a space, their number, for each word whether it goes or None) gives, if it is not None, for each document with an id."""
    found = B.cut(B.in_blocks(docs.where("doc_id is not null")))
    parts = B.parts_for(found)

    def make_block():
        work = make()

        def rows(block, ids, texts, anchors, answers):
            words = Words(texts)
            gone = removed_words(words, ids, anchors, answers, parts)
            touched = np.bincount(words.doc, gone, len(ids)) > 0
            joined = pc.binary_join(pc.ascii_split_whitespace(texts), " ").cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
            texts = texts.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
            for doc, text, own, start, size, any_ in zip(ids.tolist(), texts, joined, words.starts.tolist(), words.sizes.tolist(), touched.tolist()):
                if (row := work(text, own.strip(b" "), size, gone[start : start + size] if any_ else None)) is not None:
                    yield doc, *row

        return rows

    return B.over_blocks(with_windows(found, parts), make_block, columns, "anchors", "windows")


def digest(text: bytes, joined: bytes, size: int, gone: np.ndarray | None) -> tuple[int, int, str]:
    if gone is None:
        return size, 0, sha256(joined).hexdigest()
    kept = [w for w, g in zip(joined.split(b" "), gone.tolist()) if not g]
    return size, size - len(kept), sha256(b" ".join(kept)).hexdigest()


def alone(text: bytes) -> tuple[int, int, str]:
    words = text.split()
    return len(words), 0, sha256(b" ".join(words)).hexdigest()


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text)."""
    compared = kept_rows(docs, COLUMNS, lambda: digest)
    return compared.unionByName(map_texts(docs.where("doc_id is null"), lambda: lambda _, t: alone(t), COLUMNS))


def without_passages(text: bytes, gone: np.ndarray) -> bytes | None:
    """The text without the removed words and the blanks behind them; None where no word is left."""
    if not gone.any():
        return text
    if gone.all():
        return None
    out, at = [], 0
    for m, g in zip(WORD.finditer(text), gone.tolist()):
        if g:
            out.append(text[at : m.start()])
            at = m.end()
            while at < len(text) and text[at] in b" \t\n\v\f\r":
                at += 1
    return b"".join([*out, text[at:]]).rstrip()


def changed_text(text: bytes, joined: bytes, size: int, gone: np.ndarray | None) -> tuple[str, str | None] | None:
    """For a text that changes: its hash, and what is left."""
    if gone is None:
        return None
    new = without_passages(text, gone)
    return md5(text, usedforsecurity=False).hexdigest(), None if new is None else new.decode()


def cleaned(docs: DataFrame) -> DataFrame:
    """docs without repeated passages, and without documents that are nothing else; the columns stay.

    Rows are told apart by doc_id and text, so that rows that share a doc_id keep their own texts.
    n_chars, where it exists, is counted again for texts that changed.
    """
    changed = kept_rows(docs, [("changed_id", "long"), ("old_text", "string"), ("new_text", "string")], lambda: changed_text).distinct()
    joined = docs.join(changed, (docs.doc_id == changed.changed_id) & (F.md5(docs.text.cast("binary")) == changed.old_text), "left")
    touched, text = changed["changed_id"].isNotNull(), changed["new_text"]  # by table, as docs may have such columns
    kept = joined.where(~touched | text.isNotNull())
    values = {"text": F.when(touched, text).otherwise(docs.text)}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(touched, F.length(text).cast("long")).otherwise(docs.n_chars)
    return kept.select(*(values[c].alias(c) if c in values else docs[c] for c in docs.columns))
