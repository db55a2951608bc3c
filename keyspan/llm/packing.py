"""Packing of token ids into windows by the online sum-of-squares rule.

Each task packs the documents it reads; no row moves between tasks.  A document's ids fill
whole windows of their own first; what is left is placed whole into the fill level for which the
sum of squared counts of partially filled windows becomes least, as the level array tells.
Windows that are still open when the task ends stay as they were packed, but for the emptiest
ones: of these just as many are taken apart as it takes to fill the gaps of all others, and what
then remains, less than a window, is cut at powers of two, which need no padding.  So there is no
padding at all, and of a task with a thousand documents some 2 % of the ids are cut anew.

Defined results: a null or empty text gives the end id alone; very long texts are read whole and
give whole windows; equal texts are packed apart; of equally good levels the fullest is taken;
rows with a null doc_id are packed, their pieces have a null doc_id; an empty table gives no
rows; other columns are not read, whatever their names.  sequence_id is the task's number times
2**40 plus a counter, so a task that runs again gives the same ids.  A task holds the ids of its
open windows, two bytes an id: at most those of its own split, if no two documents fit together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_schema, ddl, sized_slices
from .word_bpe import WordTokenizer

WINDOW = 4096
END_ID = 2
COLUMNS = [("doc_id", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"),
           ("sequence_id", "long"), ("offset", "long")]


class Packer:
    """Pieces are (document, first id, ids, number of ids of the document)."""

    def __init__(self, window: int = WINDOW, first_sequence: int = 0):
        self.window, self.sequence = window, first_sequence
        self.at: list[list[list]] = [[] for _ in range(window)]  # by fill level, the open windows
        self.count = np.zeros(window + 1, np.int64)
        self.done: list[tuple] = []
        self.placed = self.moved = 0  # ids placed by the rule, and of these cut anew in the end

    def close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4")), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def level_for(self, size: int) -> int:
        """The level h (0: a new window) for which the sum of squares grows least when h becomes h + size."""
        count = self.count
        best, least = 0, 2 * int(count[size]) + 1
        levels = np.flatnonzero(count[1 : self.window - size + 1]) + 1
        if len(levels):
            to = 2 * count[levels + size] + 1
            if levels[-1] == self.window - size:
                to[-1] = 0  # a full window is closed and counts no more
            cost = to + 1 - 2 * count[levels]
            k = len(cost) - 1 - int(np.argmin(cost[::-1]))  # of equal ones the fullest
            if cost[k] <= least:
                best = int(levels[k])
        return best

    def add(self, doc, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total // self.window * self.window
        for at in range(0, whole, self.window):
            self.close([(doc, at, ids[at : at + self.window], total)])
        if whole == total:
            return
        size = total - whole
        self.placed += size
        level = self.level_for(size)
        pieces = self.at[level].pop() if level else []
        self.count[level] -= level > 0
        pieces.append((doc, whole, ids[whole:].copy(), total))  # not a view that keeps a whole slice's ids
        level += size
        if level == self.window:
            self.close(pieces)
        else:
            self.at[level].append(pieces)
            self.count[level] += 1

    def finish(self) -> None:
        """Close the open windows: the emptiest fill the gaps of the others, the remainder is cut at powers of two."""
        fills = [(level, pieces) for level in range(1, self.window) for pieces in self.at[level]]
        self.at, self.count = [[] for _ in range(self.window)], np.zeros(self.window + 1, np.int64)
        gaps = sum(self.window - level for level, _ in fills)
        apart = loose = 0
        while apart < len(fills) and loose < gaps:
            loose += fills[apart][0]
            gaps -= self.window - fills[apart][0]
            apart += 1
        self.moved = loose
        rest = [p for _, pieces in fills[:apart] for p in pieces][::-1]

        def taken(room: int) -> Iterator[tuple]:
            while room:
                doc, start, ids, total = rest.pop()
                if len(ids) > room:
                    rest.append((doc, start + room, ids[room:], total))
                    ids = ids[:room]
                room -= len(ids)
                yield doc, start, ids, total

        for level, pieces in fills[apart:]:
            self.close([*pieces, *taken(self.window - level)])
        while left := sum(len(p[2]) for p in rest):
            self.close(list(taken(1 << (left.bit_length() - 1))))

    def taken(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def packed(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text)."""
    schema = arrow_schema(COLUMNS)

    def frames(packer: Packer) -> Iterator[pa.RecordBatch]:
        if rows := packer.taken():
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows)], schema=schema)

    def run(batches):
        tokens, packer = WordTokenizer(tokenizer_path, end_id), Packer(window, TaskContext.get().partitionId() << 40)
        for part in sized_slices(batches):
            ids, sizes = tokens(part.column(1))
            for doc, own in zip(part.column(0).to_pylist(), np.split(ids, np.cumsum(sizes)[:-1])):
                packer.add(doc, own)
            yield from frames(packer)
        packer.finish()
        yield from frames(packer)

    return docs.select("doc_id", "text").mapInArrow(run, ddl(COLUMNS))
