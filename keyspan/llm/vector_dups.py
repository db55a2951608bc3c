"""Near-equal vectors, by randomised-rotation binary codes.

A unit vector is turned by fixed random rotations; the signs of the result are its code, and the
inner product of the turned vector with its code is stored as a correction factor.  The code of
one vector and the turned form of another give an unbiased estimate of their inner product,
with a bound on its error that holds with high confidence.  A pair is computed exactly (cosine,
double precision) only where the upper bound of either estimate reaches the threshold.

Pairs are looked for among vectors that agree in a group of code bits; the number of bits grows
with the logarithm of the number of vectors, and there are as many groups (tables) as it takes
for a pair at the threshold to agree in none of them with a probability of at most MISSED.  A
pair counts in the first table in which it agrees.  Equal vectors are one row from the start,
with their number.  Only buckets and ids are sent until buckets of one vector are gone; then
codes are fetched.  A bucket with more than CHUNK rows is parted, and its parts meet in pairs,
each a task of bounded size; only counts and one link for each row leave a task.  Where bounds
admit a pair, its rows' vectors are fetched, and the pairs that the bounds admit are computed.

Defined results: a vector that is null, empty, zero or holds a null or a component that is not
finite, or has no label, is linked with nothing and is its own component; vectors of different
length are never alike; a cosine of exactly the threshold links; repeated rows are linked, a
cluster of any number of them too; rows that share a vec_id each give a row; a
null vec_id gives a null component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import cut
from .common import arrow_schema, ddl
from .components import connected

THRESHOLD = 0.98
#: Chance that a pair at the threshold is in no common bucket; vectors for each value of a table's bits.
MISSED, PER_BUCKET = 1e-6, 256
#: Width of the confidence interval, in units of its scale.
CONFIDENCE = 3.0
CHUNK = 2048
SEED = 20240517

CODES = [("rep", "long"), ("buckets", "array<long>"), ("keys", "binary"), ("code", "binary"), ("factor", "float"), ("turned", "binary"), ("scale", "float")]


def rotations(size: int, number: int) -> np.ndarray:
    """Random rotations of so many dimensions, one above the other; always the same ones."""
    random = np.random.default_rng([SEED, size])
    return np.concatenate([np.linalg.qr(random.standard_normal((size, size)))[0] for _ in range(number)])


def tables_for(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a table and number of tables for n vectors."""
    bits = min(40, max(4, math.ceil(math.log2(max(n, 1) / PER_BUCKET))) if n > PER_BUCKET else 4)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - same))


class Coder:
    def __init__(self, bits: int, tables: int):
        self.bits, self.tables, self.turns = bits, tables, {}

    def __call__(self, x: np.ndarray):
        """Codes of the rows of x (unit vectors): table keys, first rotation's signs, factors, turned vectors as bytes, their scales."""
        size = x.shape[1]
        if size not in self.turns:
            self.turns[size] = rotations(size, math.ceil(self.bits * self.tables / size))
        y = x @ self.turns[size].T
        signs = y[:, : self.bits * self.tables] > 0
        keys = (signs.reshape(len(x), self.tables, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))).astype(np.int64)
        first = y[:, :size]
        factor = np.abs(first).sum(1) / math.sqrt(size)
        scale = np.abs(first).max(1) / 127
        return keys, signs, first > 0, factor, np.rint(first / scale[:, None]).astype(np.int8), scale


def upper_bounds(code: np.ndarray, factor: np.ndarray, turned: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """For rows i (codes) and j (turned vectors): an upper bound of their inner product, from the estimate and its error."""
    size = code.shape[1]
    signs = np.where(code, 1.0, -1.0).astype(np.float32) / np.float32(math.sqrt(size))
    estimate = signs @ (turned.astype(np.float32) * scale[:, None].astype(np.float32)).T / factor[:, None]
    spread = CONFIDENCE * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(size - 1, 1))
    rounding = math.sqrt(size) * scale / 2
    return estimate + spread[:, None] + rounding[None, :] / factor[:, None]


def grouped(df: DataFrame, names: list[str], work, columns: list[tuple[str, str]]) -> DataFrame:
    """work(columns of a group as a dict of lists) for each group of equal (bucket, i, j), which are small by then."""
    schema = arrow_schema(columns)

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None

        def result():
            table = pa.Table.from_batches(held)
            return work({n: table.column(n).to_pylist() for n in names})

        out = []
        for batch in batches:
            b, i, j = (batch.column(k).to_numpy() for k in range(3))
            edges = np.flatnonzero((b[1:] != b[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if start == end:
                    continue
                key = (b[start], i[start], j[start])
                if held and key != last:
                    out += result()
                    held.clear()
                held.append(batch.slice(start, end - start))
                last = key
            if len(out) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if held:
            out += result()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    dealt = df.select("bucket", "i", "j", *(n for n in names if n not in ("bucket", "i", "j"))).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")
    return dealt.mapInArrow(run, ddl(columns))


def matrix(rows: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def pair_filter(group: dict, bits: int):
    """What a pair of rows must meet to count here: from different parts, if two meet, and in no earlier table together."""
    turn = group["turn"][0]
    signs = np.unpackbits(matrix(group["keys"], np.uint8), axis=1)[:, : turn * bits].reshape(len(group["keys"]), turn, bits)
    keys = signs @ (1 << np.arange(bits, dtype=np.int64))
    part, crossing = np.array(group["part"]), group["i"][0] != group["j"][0]

    def counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fits = ~(keys[a] == keys[b]).any(1)
        return fits & (part[a] != part[b]) if crossing else fits

    return counts


def admitted(group: dict, threshold: float, counts):
    """Pairs of rows, a block at a time, whose bound reaches the threshold and that count here."""
    n, size = len(group["rep"]), len(group["turned"][0])
    code = np.unpackbits(matrix(group["code"], np.uint8), axis=1)[:, :size].astype(bool)
    factor, turned, scale = np.array(group["factor"]), matrix(group["turned"], np.int8), np.array(group["scale"])
    for start in range(0, n, 512):
        own = slice(start, start + 512)
        bound = np.maximum(upper_bounds(code[own], factor[own], turned, scale), upper_bounds(code, factor, turned[own], scale[own]).T)
        a, b = np.nonzero(bound >= threshold)
        a += start
        a, b = a[a < b], b[a < b]
        fits = counts(a, b)
        yield a[fits], b[fits]


def hits(threshold: float, bits: int):
    def work(group: dict):
        """The rows that have a pair whose bound reaches the threshold."""
        n = len(group["rep"])
        if n < 2:
            return []
        found = np.zeros(n, bool)
        for a, b in admitted(group, threshold, pair_filter(group, bits)):
            found[a] = found[b] = True
        return [tuple(group[c][x] for c in HITS) for x in np.flatnonzero(found).tolist()]

    return work


HITS = ["bucket", "i", "j", "rep", "turn", "part", "keys", "code", "factor", "turned", "scale"]


def linked(threshold: float, bits: int):
    def work(group: dict):
        """For each row that has a link here: the copies of what it is linked with, and the smallest vector it reaches here."""
        n = len(group["rep"])
        if n < 2:
            return []
        x = np.array(group["embedding"], np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        rep, copies = np.array(group["rep"]), np.array(group["copies"])
        links, left, right = np.zeros(n, np.int64), [], []
        for a, b in admitted(group, threshold, pair_filter(group, bits)):
            for at in range(0, len(a), 1 << 16):
                i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                left.append(i[near].astype(np.int32))
                right.append(j[near].astype(np.int32))
                np.add.at(links, left[-1], copies[right[-1]])
                np.add.at(links, right[-1], copies[left[-1]])
        a, b = (np.concatenate(v) if v else np.empty(0, np.int32) for v in (left, right))
        reach = np.arange(n)  # rows are sorted by rep
        while len(a):
            before = reach.copy()
            np.minimum.at(reach, a, reach[b])
            np.minimum.at(reach, b, reach[a])
            if (before == reach).all():
                break
        return [(int(rep[k]), int(links[k]), int(rep[reach[k]])) for k in np.flatnonzero(links).tolist()]

    return work


def near_equal(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    good = "label is not null and vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    used = F.coalesce(F.expr(good), F.lit(False))
    key = [F.when(used, F.xxhash64(F.lit(k), "label", "embedding")).alias(f"k{k}") for k in (0, 1)]
    keyed = vectors.select("vec_id", "embedding", "label", *key)
    same = keyed.where("k0 is not null").groupBy("k0", "k1").agg(F.min(F.struct("vec_id", "label", "embedding")).alias("r"), F.count("*").alias("copies"))
    reps = cut(same.select("k0", "k1", F.col("r.vec_id").alias("rep"), F.col("r.label").alias("label"), F.col("r.embedding").alias("embedding"), "copies"))
    bits, tables = tables_for(reps.count(), threshold)
    schema = arrow_schema(CODES)

    def run(batches):
        import xxhash

        coder = Coder(bits, tables)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, labels, rows = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()
                out = []
                for size in {len(r) for r in rows}:
                    own = [k for k, r in enumerate(rows) if len(r) == size]
                    x = np.array([rows[k] for k in own], np.float64)
                    x /= np.abs(x).max(1)[:, None]
                    x /= np.linalg.norm(x, axis=1)[:, None]
                    keys, signs, code, factor, turned, scale = coder(x)
                    for n, k in enumerate(own):
                        buckets = [xxhash.xxh3_64_intdigest(f"{labels[k]} {size} {t} {key}") - (1 << 63) for t, key in enumerate(keys[n].tolist())]
                        out.append((ids[k], buckets, np.packbits(signs[n]).tobytes(), np.packbits(code[n]).tobytes(), float(factor[n]), turned[n].tobytes(), float(scale[n])))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    codes = cut(reps.select("rep", "label", "embedding").mapInArrow(run, ddl(CODES)))
    places = codes.select("rep", F.posexplode("buckets").alias("turn", "bucket"))
    crowded = places.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / CHUNK).cast("int").alias("parts"))
    parted = places.join(crowded, "bucket").withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int")).join(codes.drop("buckets"), "rep")
    meeting = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, "part").cast("int").alias("i"), F.greatest(x, "part").cast("int").alias("j"))))
    dealt = parted.select("*", meeting.alias("m")).select("*", "m.i", "m.j")
    hit_columns = [("bucket", "long"), ("i", "int"), ("j", "int"), ("rep", "long"), ("turn", "int"), ("part", "int"), *CODES[2:]]
    names = ["bucket", "i", "j", "turn", "rep", *(c for c, _ in CODES[2:]), "part"]
    hit = grouped(dealt, names, hits(threshold, bits), hit_columns)
    exact = hit.join(reps.select("rep", "embedding", "copies"), "rep")
    found = cut(grouped(exact, [*names, "embedding", "copies"], linked(threshold, bits), [("rep", "long"), ("links", "long"), ("least", "long")]))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    ends = reps.select("k0", "k1", "rep", "copies").join(links, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
    ends = ends.select("k0", "k1", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    component = F.coalesce("component", "vec_id")
    return keyed.join(ends, ["k0", "k1"], "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
