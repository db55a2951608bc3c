"""What several operators share: reading tables, mapping texts batch by batch, hashing words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
         "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}

#: Rows that are turned into Python objects at once; Arrow batches may be larger.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ddl(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns)


def arrow_schema(columns: list[tuple[str, str]]) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in columns])


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def sized_slices(batches: Iterator[pa.RecordBatch], size: int = 2048, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of up to `size` rows and `most` bytes; a larger row is a slice of its own."""
    todo = []
    for part in slices(batches, size):
        todo.append(part)
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > most:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_batches(docs: DataFrame, make: Callable, columns: list[tuple[str, str]], key: str = "doc_id", text: str = "text", size: int = SLICE) -> DataFrame:
    """Rows made of up to `size` documents at a time, without a shuffle.

    make() runs once in each task and returns a function of (keys, texts as UTF-8 bytes) that
    gives rows of `columns`.  Memory is bounded by one Arrow batch and `size` documents.
    """
    schema = arrow_schema(columns)

    def run(batches):
        work = make()
        for part in slices(batches, size):
            if rows := list(work(part.column(0).to_pylist(), raw(part.column(1)))):
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(key, text).mapInArrow(run, ddl(columns))


def map_texts(docs: DataFrame, make: Callable, columns: list[tuple[str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: make() returns a function of (key, UTF-8 bytes) that gives the values after the key."""

    def make_batch():
        work = make()
        return lambda keys, texts: ((k, *work(k, t)) for k, t in zip(keys, texts))

    return map_batches(docs, make_batch, columns, key, text)


def numbered_words(texts: pa.Array, lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of some texts, the number of each word in its place among them, and how many words each text has.

    Words are runs without ASCII white space; lower: A-Z are lowered first; a null is an empty text.
    """
    texts = texts.fill_null("")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    index, edges = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
    edges = edges - edges[0] if len(edges) else np.zeros(1, np.int64)
    if b"" in distinct:  # before, behind and instead of words
        k = distinct.index(b"")
        real = index != k
        edges = np.append(0, np.cumsum(real))[edges]
        index = index[real]
        index -= index > k
        del distinct[k]
    return distinct, index, np.diff(edges)


def hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hashes."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def hashed_twice(words: list[bytes]) -> np.ndarray:
    """128-bit hashes, as rows of two halves."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").reshape(-1, 2).astype(np.uint64)


def windows(h: np.ndarray, size: int, multiplier: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of `size` consecutive entries of h (unsigned 64-bit, modulo 2**64)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, m = np.zeros(n, np.uint64), np.uint64(multiplier)
    for k in range(size):
        out = out * m + h[k : k + n]
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
