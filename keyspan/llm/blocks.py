"""Blocks of documents, and questions that blocks put to parts of a hash space.

A block is one row with up to BLOCK_DOCS documents, their texts compressed.  A block asks each
part of a hash space once, with all its distinct keys for that part in one binary value; the
part answers each block with one value, in the order of the question.  A key that a third of
all documents hold is so sent once for each block, not once for each document, and questions
and answers are compact arrays instead of rows.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, ddl, raw, slices

BLOCK_DOCS, BLOCK_BYTES = 1024, 4_000_000
COLUMNS = [("block", "long"), ("ids", "binary"), ("sizes", "binary"), ("texts", "binary"), ("words", "long")]
ASKED = [("part", "long"), ("block", "long"), ("body", "binary")]
#: Words of all documents for each part of a hash space.
PART_WORDS = 3_000_000
NULL_ID = -(1 << 63)


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder the cluster names; only where it names none, to one beside the warehouse."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")


def cut(df: DataFrame, forget: bool = False) -> DataFrame:
    """df, computed and stored in the shared folder.

    What df was made from can go then; the driver's collector is asked to notice, as shuffle
    files stay on the executors' disks until it does.  A checkpointed DataFrame still holds the
    plan it came from, and so its shuffle files; with forget the result is made anew from the
    checkpoint's rows alone, so that they go while it lives.
    """
    session = df.sparkSession
    shared_folder(session)
    stored = df.checkpoint()
    if forget:
        java = stored._jdf
        stored = type(df)(session._jsparkSession.internalCreateDataFrame(java.queryExecution().toRdd(), java.schema(), False), session)
        del java
    del df
    gc.collect()
    session._jvm.System.gc()
    return stored


def in_blocks(docs: DataFrame, docs_most: int = BLOCK_DOCS, bytes_most: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of docs (doc_id, text), without a shuffle; NULL_ID stands for a null doc_id."""
    schema = arrow_schema(COLUMNS)

    def run(batches):
        pack = zstandard.ZstdCompressor(level=6).compress
        first, count = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0

        def block():
            nonlocal count
            row = [first + count], [np.array(ids, np.int64).tobytes()], [np.array([len(t) for t in texts], np.int64).tobytes()], [pack(b"".join(texts))], [sum(len(t.split()) for t in texts)]
            count += 1
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        for part in slices(batches):
            for key, text in zip(part.column(0).to_pylist(), raw(part.column(1))):
                ids.append(NULL_ID if key is None else key)
                texts.append(text)
                size += len(text)
                if len(ids) >= docs_most or size >= bytes_most:
                    yield block()
                    ids, texts, size = [], [], 0
        if ids:
            yield block()

    return docs.select("doc_id", "text").mapInArrow(run, ddl(COLUMNS))


def texts_of(sizes: bytes, texts: bytes) -> pa.Array:
    """The texts of a block as one Arrow array."""
    offsets = np.append(0, np.cumsum(np.frombuffer(sizes, np.int64)))
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(unpacked(texts)))


def parts_for(blocks: DataFrame, words: int = PART_WORDS) -> int:
    """How many parts the hash space needs, so that each has a bounded share of all words."""
    total = blocks.agg(F.sum("words")).first()[0] or 0
    return max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // words))


def split_by(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, with the places where it does, in order."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield p, order[edges[p] : edges[p + 1]]


def over_blocks(blocks: DataFrame, make: Callable, columns: list[tuple[str, str]], *more: str) -> DataFrame:
    """Rows (tuples in the order of columns) that make()(block, ids, texts, *more) yields for each block; texts as an Arrow array."""

    def opened():
        work = make()
        return lambda block, ids, sizes, texts, *rest: work(block, np.frombuffer(ids, np.int64), texts_of(sizes, texts), *rest)

    return over_rows(blocks.select("block", "ids", "sizes", "texts", *more), opened, columns)


def given_back() -> None:
    """What a task's buffers took goes back to the system, as the worker lives on beside the next one's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def over_rows(rows: DataFrame, make: Callable, columns: list[tuple[str, str]]) -> DataFrame:
    """Rows (tuples in the order of columns) that make()(*values) yields for each row."""
    schema = arrow_schema(columns)

    def run(batches):
        work = make()
        for part in slices(batches, 1):
            out = list(work(*(c[0].as_py() for c in part.columns)))
            for at in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out[at : at + 1000]), schema)], schema=schema)
        part = out = None
        given_back()

    return rows.mapInArrow(run, ddl(columns))


def answered(asked: DataFrame, parts: int, answer: Callable, columns: list[tuple[str, str]] | None = None) -> DataFrame:
    """answer(part, blocks, bodies) for each part, over all blocks that asked it; yields rows, by default (block, part, answer)."""
    columns = columns or [("block", "long"), ("part", "long"), ("answer", "binary")]
    schema = arrow_schema(columns)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        rows = list(answer(table.column("part")[0].as_py(), table.column("block").to_pylist(), table.column("body").to_pylist()))
        del table
        given_back()
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return asked.repartition(parts, "part").groupBy("part").applyInArrow(run, ddl(columns))


def with_answers(blocks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """blocks with an array `name` of (part, answer), a bounded one: an entry for each part at most."""
    gathered = answers.groupBy("block").agg(F.collect_list(F.struct("part", "answer")).alias(name))
    return blocks.join(gathered, "block", "left")


def in_order(answers: list | None) -> list[bytes]:
    """The answers by part, from the rows of a block's array."""
    return [a["answer"] for a in sorted(answers or [], key=lambda a: a["part"])]


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed_bits(bits: np.ndarray) -> bytes:
    return packed(np.packbits(bits).tobytes())


def bits_of(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(unpacked(data), np.uint8))[:n].astype(bool)


def six_bytes(x: np.ndarray) -> bytes:
    """The lower 48 bits of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def planed(x: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed: upper bytes that are zero cost next to nothing."""
    return packed(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpacked(data), np.uint8).reshape(8, -1).T).reshape(-1).view("<u8").astype(np.int64)
