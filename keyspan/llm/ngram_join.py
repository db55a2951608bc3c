"""Documents whose sets of word n-grams are alike, by adaptive multi-match prefixes.

All sets are sorted by one order: estimated frequency, rarest first, then hash.  The estimate
comes from a sketch of fixed size over all n-grams.  A document's prefix has the n-grams that
some one partner must share, and l - 1 more.  Each document picks its l: a longer prefix costs
more reading, but its pairs then need l - 1 more shared prefix n-grams before they are verified.
Exactly, a pair whose sizes ask for an overlap of o needs o - r of them, where r is the larger
number of n-grams that either document has behind its prefix.  The smaller of two documents must
share more of its own n-grams, so that they meet within a shorter prefix of it, its index.

First, documents only ask which n-grams of their prefixes are in a prefix of another class; the
others are not sent.  Of a pair, the overlap within the prefix that ends first lies in both
prefixes, so that this document's n-grams behind its prefix and its shared ones bound the overlap.
Which one ends first is not known beforehand, so a pair goes by the larger bound: two documents
that are both too low for any partner do not meet.  The others do, pairs of different classes are
counted, and those with enough n-grams are verified by their whole sets.

Prefixes alone say little within a large group whose members are only nearly alike enough: most
of its pairs share many n-grams of them.  So a document goes with a bitmap of its whole set to
the parts where it has a crowded n-gram, one of many documents.  Two sets share at most as many
n-grams as their bitmaps share bits, and as many more as the fuller of them has fallen together;
pairs that this bound excludes are not formed.  Of the others each is given out once, by the part
of the least n-gram at which it meets.

What could be quadratic is linked first, linearly.  Equal sets are one class from the start.
Then documents with equal minimal hashes (four keys of two) are each verified against the
first document of their key, and linked classes are contracted; this repeats with other firsts.  The prefix join only looks for pairs between different classes, so a large
group of near copies, whose members are in one class by then, gives no pairs.  No link is lost
by this, as any two members of a class are connected already.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; a text
of fewer than `size` words has its whole sequence as its only n-gram; texts are read whole, however
long; equal texts are in one class; rows that share a doc_id are rows of their own, each linked by
its own text; rows with a null doc_id are linked with nothing and have no component; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import arrow_schema, ddl, hashed, map_texts, mixed, numbered_words, windows
from .components import connected

SIZE, PERCENT = 4, 85
#: Counters of the sketch, and the pieces in which it is added up.
CELLS, PIECES = 1 << 20, 128
#: Longest prefix extension, and what verifying a pair costs in n-grams read.
MOST_SHARED, VERIFY_COST = 4, 30
#: Pairs that are counted at once, bytes of bitmaps that are compared at once, and sets that are kept meanwhile.
AT_ONCE, BITMAPS_AT_ONCE, KEPT_SETS = 250_000, 8_000_000, 4000
#: An n-gram is crowded if so many blocks have it in prefixes; a block in which HERE documents have it counts as so many.
CROWD, HERE = 64, 8
#: Bits of a set's bitmap for each n-gram, at least.
MARKS = 4
#: Keys of minimal hashes; rounds of linking by them.
KEYS, ROUNDS = 4, 2
#: Pairs of one representative that a task verifies.
SALTED = 500
SEEDS = [0x9E3779B97F4A7C15 * (k + 1) % 2**64 for k in range(2 * KEYS)]

PROFILE = [("kind", "int"), ("doc", "long"), ("id", "long"), ("text_key", "string"), ("block", "long"), ("n", "long"), ("s0", "long"), ("s1", "long"), ("keys", "array<long>"), ("body", "binary")]


class Sets:
    """Sorted distinct n-gram hashes of the documents of a block, one after the other."""

    def __init__(self, texts: pa.Array, size: int):
        distinct, index, sizes = numbered_words(texts, lower=True)
        h = hashed(distinct)[index]
        grams = windows(h, size)
        at, found = 0, []
        for n in sizes.tolist():
            if n >= size:
                found.append(np.unique(grams[at : at + n - size + 1]))
            elif n:
                found.append(mixed(windows(h[at : at + n], n) + np.uint64(n)))
            else:
                found.append(np.empty(0, np.uint64))
            at += n
        self.sets = found


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def least_overlap(n: int, percent: int) -> int:
    """n-grams that a set of n shares with any set it is alike to."""
    return -(-percent * n // 100)


#: Documents of a block, at most; a row's number is its block's times this, plus its place.
PLACES = B.BLOCK_DOCS


def profiles(found: DataFrame, size: int, text_keys: bool = False) -> DataFrame:
    """Kind 0: a row with its set's size, 128-bit hash and minimal-hash keys, and its text's hash if that is wanted; kind 1: a piece of the task's sketch."""
    schema = arrow_schema(PROFILE)

    def run(batches):
        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for k in range(batch.num_rows):
                block, ids, *rest = (c[k].as_py() for c in batch.columns)
                texts, rows = B.texts_of(*rest), []
                sets = Sets(texts, size).sets
                text_key = [md5(t, usedforsecurity=False).hexdigest() for t in texts.cast(pa.binary()).to_numpy(zero_copy_only=False)] if text_keys else [None] * len(sets)
                for place, (doc, s) in enumerate(zip(np.frombuffer(ids, np.int64).tolist(), sets)):
                    whole = xxhash.xxh3_128_intdigest(s.tobytes())
                    keys = []
                    if len(s):
                        low = [int(mixed(s ^ np.uint64(seed)).min()) for seed in SEEDS]
                        keys = [signed(xxhash.xxh3_64_intdigest(f"{j} {low[2 * j]} {low[2 * j + 1]}")) for j in range(KEYS)]
                    rows.append((0, block * PLACES + place, doc, text_key[place], block, len(s), signed(whole & (1 << 64) - 1), signed(whole >> 64), keys, None))
                cells += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=CELLS).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)
        rows = [(1, k, None, None, None, None, None, None, None, B.packed(piece.tobytes())) for k, piece in enumerate(np.split(cells, PIECES))]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    return found.select("block", "ids", "sizes", "texts").mapInArrow(run, ddl(PROFILE))


def sketch(profiled: DataFrame) -> np.ndarray:
    """The counters over all documents: CELLS numbers, whatever the size of the input.

    Each task's pieces are added as they are read, so that memory does not grow with the tasks.
    """

    schema = pa.schema([("doc", pa.int64()), ("body", pa.binary())])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(B.unpacked(body), np.uint32)
                total[piece] = total.get(piece, np.uint64(0)) + counts.astype(np.uint64)
        if total:
            bodies = [np.minimum(t, 2**32 - 1).astype(np.uint32).tobytes() for t in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(bodies, pa.binary())], schema=schema)

    pieces = profiled.where("kind = 1").select("doc", "body").repartition(PIECES, "doc").mapInArrow(add, "doc long, body binary").collect()
    return np.concatenate([np.frombuffer(p["body"], np.uint32) for p in sorted(pieces, key=lambda p: p["doc"])] or [np.zeros(CELLS, np.uint32)])


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are alike, of any pairs of documents of docs (doc, block-wise texts as `text`).

    Pairs are gathered by b; a document b with many pairs is spread over several tasks.
    """
    counted = pairs.groupBy("b").count().where(f"count > {SALTED}").withColumnRenamed("count", "n")
    salted = pairs.join(counted, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / SALTED)), F.lit(0)).cast("long").alias("salt"))
    salted = B.cut(salted)
    members = salted.join(docs, salted.a == docs.doc).select("b", "salt", "a", "text")
    centres = salted.select("b", "salt").distinct().join(docs, F.col("b") == docs.doc).select("b", "salt", F.lit(None).cast("long").alias("a"), "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        centre = None
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                sets = Sets(pa.array([B.unpacked(x) for x in part.column(3).to_pylist()], pa.binary()).cast(pa.string()), size).sets
                rows = []
                for b, a, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), sets):
                    if a is None:
                        centre = s
                        continue
                    both = len(np.intersect1d(centre, s, assume_unique=True))
                    if both and 100 * both >= percent * (len(centre) + len(s) - both):
                        rows.append((a, b))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows)], schema=schema)

    together = centres.unionByName(members).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return together.mapInArrow(run, "a long, b long")


def texts_of(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc and its compressed text for the wanted (doc, block), rows distinct."""
    listed = wanted.groupBy("block").agg(F.collect_set("doc").alias("wanted"))

    def make():
        def work(block, ids, texts, docs):
            for doc in docs:
                yield doc, B.packed(texts[doc % PLACES].as_py().encode())

        return work

    return B.over_blocks(found.join(listed, "block"), make, [("doc", "long"), ("text", "binary")], "wanted")


def spread_join(rows: DataFrame, small: DataFrame, on: list[str], many: str) -> DataFrame:
    """rows (with a column doc) left joined with `small`, whose keys are unique and whose column `many` tells how many rows have each.

    Rows of a key with more than SALTED of them are dealt over all tasks, and the key's one row is copied to each.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = small.where(F.col(many) > SALTED).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    both = rows.withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(tasks)).cast("int")).join(hot, [*on, "_salt"], "left")
    met = both.where(F.col(many).isNotNull()).drop("_salt")
    rest = both.where(F.col(many).isNull()).select(*rows.columns).join(small.where(F.col(many) <= SALTED), on, "left")
    return met.unionByName(rest)


def key_pairs(reps: DataFrame, classes: DataFrame | None, turn: int) -> DataFrame:
    """Each representative with the first one of each of its keys (first by a hash that differs between rounds), if they are of different classes."""
    now = reps if classes is None else reps.join(classes, reps.doc == classes.node, "left").drop("node")
    now = now.select("doc", "n", (F.col("doc") if classes is None else F.coalesce("component", "doc")).alias("class"), F.explode("keys").alias("key"))
    order = F.struct((F.col("doc") if turn == 0 else F.xxhash64(F.lit(turn), "doc")).alias("o"), "doc", "n", "class")
    first = now.groupBy("key").agg(F.min(order).alias("c"), F.min("class").alias("c0"), F.max("class").alias("c1"), F.count("*").alias("many")).where("c0 <> c1").select("key", "many", F.col("c.doc").alias("b"), F.col("c.n").alias("bn"), F.col("c.class").alias("bc"))
    return spread_join(now, first, ["key"], "many").where("class <> bc").select(F.col("doc").alias("a"), "b", "n", "bn").distinct()


def needed_overlap(m, n, percent: int):
    """n-grams that sets of m and n share at least if they are alike."""
    return -(-percent * (m + n) // (100 + percent))


PREFIXES = [("block", "long"), ("docs", "binary"), ("body", "binary"), ("marks", "binary")]


def marks_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the bitmap of a set of n: a power of two."""
    return np.left_shift(1, np.ceil(np.log2(np.maximum(n * MARKS / 64, 1))).astype(np.int64))


def marks(s: np.ndarray) -> bytes:
    """The bitmap of a set: of each n-gram the bit that its lowest bits number, so that half the bitmap is the two halves of it, joined by or."""
    bits = np.zeros(64 * int(marks_words(np.array(len(s)))), bool)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(size: np.ndarray, at: np.ndarray, bitmaps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs (i, j) an upper bound of the n-grams that their sets share; the bitmap of d begins at word at[d], -1: none."""
    bound, words = np.minimum(size[i], size[j]), marks_words(size)
    known = np.flatnonzero((at[i] >= 0) & (at[j] >= 0))
    shape = words[i[known]] * (1 << 32) + words[j[known]]
    for both in np.unique(shape).tolist():
        (wide_i, wide_j), rows = divmod(both, 1 << 32), known[shape == both]
        width, step = min(wide_i, wide_j), max(1, BITMAPS_AT_ONCE // (8 * max(wide_i, wide_j)))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            x, y = (np.bitwise_or.reduce(bitmaps[at[d[part], None] + np.arange(wide)].reshape(len(part), -1, width), axis=1) for d, wide in ((i, wide_i), (j, wide_j)))
            together = [size[d[part]] - np.bitwise_count(z).sum(axis=1, dtype=np.int64) for d, z in ((i, x), (j, y))]
            bound[part] = np.minimum(bound[part], np.bitwise_count(x & y).sum(axis=1, dtype=np.int64) + np.minimum(*together))
    return bound


def prefixes(found: DataFrame, reps: DataFrame, counters: np.ndarray, size: int, percent: int) -> DataFrame:
    """Of each block its documents (rows of id, class, set size, prefix size), the n-grams of their prefixes by document, and their sets' bitmaps."""
    listed = reps.groupBy("block").agg(F.collect_list(F.struct("doc", "class")).alias("reps"))
    shared = found.sparkSession.sparkContext.broadcast(counters)  # CELLS numbers
    usual = float(np.median(counters))

    def make():
        cells = shared.value

        def work(block, ids, texts, reps):
            classes = {r["doc"]: r["class"] for r in reps}
            docs, tokens, bitmaps = [], [], []
            for doc, s in enumerate(Sets(texts, size).sets, block * PLACES):
                if not len(s) or doc not in classes:
                    continue
                n, least = len(s), least_overlap(len(s), percent)
                seen = cells[(s >> np.uint64(44)).astype(np.int64)]
                # the hash breaks ties, and s is sorted by it
                order = np.argsort(seen, kind="stable")[: n - least + MOST_SHARED]
                sums = np.cumsum(np.maximum(seen[order].astype(float) - usual, 0))
                shares = np.arange(1, min(MOST_SHARED, least) + 1)
                end = n - least + shares
                best = int(end[np.argmin(end + sums[end - 1] * (1 + VERIFY_COST / shares))])
                docs.append((doc, classes.pop(doc), n, best))
                tokens.append(s[order[:best]])
                bitmaps.append(marks(s))
            if docs:
                yield block, B.packed(np.array(docs, np.int64).tobytes()), B.six_bytes(np.concatenate(tokens)), B.packed(b"".join(bitmaps))

        return work

    return B.over_blocks(found.join(listed, "block"), make, PREFIXES, "reps")


class Prefixes:
    """The prefixes of a block, as `prefixes` wrote them, dealt to the parts."""

    def __init__(self, docs: bytes, body: bytes, parts: int):
        self.docs = np.frombuffer(B.unpacked(docs), np.int64).reshape(-1, 4)
        self.tokens = B.from_six(body)
        self.which = np.repeat(np.arange(len(self.docs)), self.docs[:, 3])
        self.place = np.arange(len(self.which)) - (np.cumsum(self.docs[:, 3]) - self.docs[:, 3])[self.which]
        self.keys, self.inverse = np.unique(self.tokens, return_inverse=True)
        self.parts = list(B.split_by((mixed(self.keys) >> np.uint64(40)).astype(np.int64) % parts, parts))


def over_prefixes(stored: DataFrame, work, columns: list[tuple[str, str]], *more: str) -> DataFrame:
    """Rows that work(block, docs, body, *more) yields for each stored block."""
    schema = arrow_schema(columns)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows = list(work(*(c[k].as_py() for c in batch.columns)))
                for at in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows[at : at + 1000]), schema)], schema=schema)

    return stored.select("block", "docs", "body", *more).mapInArrow(run, ddl(columns))


def shared_tokens(stored: DataFrame, parts: int) -> DataFrame:
    """Per block and part, bits for each distinct n-gram of its prefixes: whether another class has it too, then whether it is crowded."""

    def ask(block, docs, body):
        p = Prefixes(docs, body, parts)
        classes, index = np.unique(p.docs[:, 1], return_inverse=True)
        low, high = np.full(len(p.keys), len(classes), np.int64), np.full(len(p.keys), -1)
        np.minimum.at(low, p.inverse, index[p.which])
        np.maximum.at(high, p.inverse, index[p.which])
        here = np.bincount(p.inverse, minlength=len(p.keys)) >= HERE
        for part, k in p.parts:
            # of an n-gram that two classes of the block have, any class will do
            own, place = np.unique(low[k], return_inverse=True)
            head = B.packed(classes[own].tobytes() + place.astype(np.uint16).tobytes() + np.packbits(np.append(low[k] < high[k], here[k])).tobytes())
            yield part, block, len(k).to_bytes(4, "little") + len(own).to_bytes(4, "little") + B.six_bytes(p.keys[k]) + head

    def answer(part, blocks, bodies):
        keys, classes, many, here, sizes = [], [], [], [], []
        for body in bodies:
            n, d = int.from_bytes(body[:4], "little"), int.from_bytes(body[4:8], "little")
            keys.append(B.from_six(body[8 : 8 + 6 * n]))
            rest = B.unpacked(body[8 + 6 * n :])
            classes.append(np.frombuffer(rest[: 8 * d], np.int64)[np.frombuffer(rest[8 * d : 8 * d + 2 * n], np.uint16)])
            bits = np.unpackbits(np.frombuffer(rest[8 * d + 2 * n :], np.uint8)).astype(bool)
            many.append(bits[:n])
            here.append(bits[n : 2 * n])
            sizes.append(n)
        keys, classes, many, here = np.concatenate(keys), np.concatenate(classes), np.concatenate(many), np.concatenate(here)
        distinct, inverse = np.unique(keys, return_inverse=True)
        low, high, shared = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min), np.zeros(len(distinct), bool)
        np.minimum.at(low, inverse, classes)
        np.maximum.at(high, inverse, classes)
        shared[inverse[many]] = True
        shared |= low < high
        crowded = shared & (np.bincount(inverse, np.where(here, CROWD, 1)) >= CROWD)
        edges = np.cumsum(sizes)[:-1]
        for block, bits, more in zip(blocks, np.split(shared[inverse], edges), np.split(crowded[inverse], edges)):
            yield block, part, B.packed_bits(np.append(bits, more))

    return B.answered(over_prefixes(stored, ask, B.ASKED), parts, answer)


def prefix_pairs(found: DataFrame, reps: DataFrame, counters: np.ndarray, size: int, percent: int) -> DataFrame:
    """Pairs of documents of different classes whose prefixes share enough; reps has doc, block, class."""
    parts = B.parts_for(found)
    stored = B.cut(prefixes(found, reps, counters, size, percent))
    answered = B.with_answers(stored, B.cut(shared_tokens(stored, parts)), "shared")

    def send(block, docs, body, bitmaps, answers):
        p = Prefixes(docs, body, parts)
        shared, crowded = np.zeros(len(p.keys), bool), np.zeros(len(p.keys), bool)
        for (_, k), bits in zip(p.parts, B.in_order(answers)):
            shared[k], crowded[k] = np.split(B.bits_of(bits, 2 * len(k)), 2)
        n, prefix = p.docs[:, 2], p.docs[:, 3]
        index_size = prefix - (n - -(-percent * n // 100)) + n - needed_overlap(n, n, percent)
        # what can be in an overlap with a document whose prefix does not end before
        able = n - prefix + np.bincount(p.which, shared[p.inverse], len(n)).astype(np.int64)
        goes = shared[p.inverse]
        indexed = p.place < index_size[p.which]
        head = np.concatenate([p.docs, able[:, None], np.bincount(p.which[goes & indexed], minlength=len(n))[:, None]], axis=1)
        lists = [B.six_bytes(x) for x in np.split(p.tokens[goes], np.cumsum(np.bincount(p.which[goes], minlength=len(n)))[:-1])]
        bitmaps, edges = B.unpacked(bitmaps), np.append(0, np.cumsum(8 * marks_words(n))).tolist()
        for part, k in p.parts:
            inside = np.zeros(len(p.keys), bool)
            inside[k] = True
            own = np.flatnonzero(goes & inside[p.inverse])
            if len(own):
                docs_here, index = np.unique(p.which[own], return_inverse=True)
                whole = [lists[d] for d in docs_here.tolist()]
                sizes = np.array([len(x) // 6 for x in whole], np.uint32)
                marked = np.bincount(index, crowded[p.inverse[own]]) > 0
                some = b"".join(bitmaps[edges[d] : edges[d + 1]] for d in docs_here[marked].tolist())
                packed = B.packed(head[docs_here].tobytes() + sizes.tobytes() + marked.tobytes() + index.astype(np.uint16).tobytes() + np.packbits(indexed[own]).tobytes())
                sizes_of = (len(docs_here), len(own), len(packed), len(some))
                yield part, block, b"".join(x.to_bytes(4, "little") for x in sizes_of) + packed + some + B.six_bytes(p.tokens[own]) + b"".join(whole)

    def answer(part, blocks, bodies):
        docs, tokens, index, indexed, whole, sizes, marked, bitmaps, n = [], [], [], [], [], [], [], [], 0
        for body in bodies:
            d, k, h, b = (int.from_bytes(body[x : x + 4], "little") for x in (0, 4, 8, 12))
            rest, at = B.unpacked(body[16 : 16 + h]), 53 * d
            docs.append(np.frombuffer(rest[: 48 * d], np.int64).reshape(d, 6))
            sizes.append(np.frombuffer(rest[48 * d : 52 * d], np.uint32))
            marked.append(np.frombuffer(rest[52 * d : at], bool))
            index.append(np.frombuffer(rest[at : at + 2 * k], np.uint16).astype(np.int64) + n)
            indexed.append(np.unpackbits(np.frombuffer(rest[at + 2 * k :], np.uint8))[:k].astype(bool))
            bitmaps.append(np.frombuffer(body[16 + h : 16 + h + b], np.uint64))
            at = 16 + h + b
            tokens.append(B.from_six(body[at : at + 6 * k]))
            whole.append(body[at + 6 * k :])
            n += d
        docs, marked = np.concatenate(docs).T, np.concatenate(marked)
        words = np.where(marked, marks_words(docs[2]), 0)
        at = np.where(marked, np.cumsum(words) - words, -1)
        yield from candidates(docs, np.concatenate(tokens), np.concatenate(index), np.concatenate(indexed), Lists(b"".join(whole), np.concatenate(sizes)), at, np.concatenate(bitmaps), percent)

    asked = over_prefixes(answered, send, B.ASKED, "marks", "shared")
    return B.answered(asked, parts, answer, [("a", "long"), ("b", "long")]).distinct()


class Lists:
    """Lists of n-grams, as they were sent: six bytes each."""

    def __init__(self, data: bytes, sizes: np.ndarray):
        self.data, self.edges, self.sets = data, np.append(0, 6 * np.cumsum(sizes, dtype=np.int64)).tolist(), {}

    def of(self, k: int) -> np.ndarray:
        return B.from_six(self.data[self.edges[k] : self.edges[k + 1]])

    def set_of(self, k: int) -> frozenset:
        if k not in self.sets:
            if len(self.sets) >= KEPT_SETS:
                self.sets.clear()
            self.sets[k] = frozenset(self.of(k).tolist())
        return self.sets[k]


def candidates(docs: np.ndarray, tokens: np.ndarray, index: np.ndarray, indexed: np.ndarray, whole: Lists, at_word: np.ndarray, bitmaps: np.ndarray, percent: int):
    """Pairs (a, b) of one part whose shared prefixes have enough n-grams in common, each at the least n-gram at which it meets.

    Entries are sorted by n-gram, then those of documents whose bound suffices for some partner,
    then by class.  Each of these meets those of other classes behind it, the smaller document's
    within its index; what is formed at a time is bounded by AT_ONCE.
    """
    doc, kind, size, prefix, able, early = docs
    weak = able * (100 + percent) // percent - size < -(-percent * size // 100)
    order = np.lexsort((kind[index], weak[index], tokens))
    tokens, index, indexed = tokens[order], index[order], indexed[order]
    group = np.append(True, tokens[1:] != tokens[:-1])
    run = group | np.append(True, (kind[index[1:]] != kind[index[:-1]]) | (weak[index[1:]] != weak[index[:-1]]))
    # for each entry, where the next class of its n-gram begins, and where its n-gram ends
    run_ends, group_ends = np.append(np.flatnonzero(run)[1:], len(tokens)), np.append(np.flatnonzero(group)[1:], len(tokens))
    start, end = run_ends[np.cumsum(run) - 1], group_ends[np.cumsum(group) - 1]
    partners = np.where(weak[index], 0, end - start)
    meets = np.cumsum(partners)
    at = 0
    while at < len(tokens):
        to = max(at + 1, int(np.searchsorted(meets, (meets[at - 1] if at else 0) + AT_ONCE, "right")))
        times = partners[at:to]
        left = np.repeat(np.arange(at, to), times)
        right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[at:to], times)
        i, j = index[left], index[right]
        # i becomes the smaller one; of equal ones, the one with the smaller id
        turn = (size[i] > size[j]) | ((size[i] == size[j]) & (doc[i] > doc[j]))
        i, j, known = np.where(turn, j, i), np.where(turn, i, j), np.where(turn, indexed[right], indexed[left])
        known &= kind[i] != kind[j]
        i, j, token = i[known], j[known], tokens[left[known]]
        overlap = needed_overlap(size[i], size[j], percent)
        fits = overlap <= np.minimum(np.maximum(able[i], able[j]), size[i])
        keys, first, inverse = np.unique(i[fits] * len(doc) + j[fits], return_index=True, return_inverse=True)
        i, j, overlap, token = i[fits][first], j[fits][first], overlap[fits][first], token[fits]
        need = np.maximum(overlap - np.maximum(size[i] - prefix[i], size[j] - prefix[j]), 1)
        owner, found = np.zeros(len(keys), np.uint64), np.zeros(len(keys), bool)
        for k in np.flatnonzero(most_shared(size, at_word, bitmaps, i, j) >= overlap).tolist():
            x, y = int(i[k]), int(j[k])
            both = whole.set_of(x) & whole.set_of(y)
            if len(both) >= need[k]:
                found[k], owner[k] = True, min(both.intersection(whole.of(x)[: early[x]].tolist()))
        for k in inverse[found[inverse] & (owner[inverse] == token)].tolist():
            x, y = int(doc[i[k]]), int(doc[j[k]])
            yield min(x, y), max(x, y)
        at = to


def classes_of(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, text_keys: bool = False) -> DataFrame:
    """For each row of docs (doc_id, text): its number doc, its id, n, text_key; component, the smallest id of its class, and first, the number of the class's first row (by id, a null id last)."""
    found = B.cut(B.in_blocks(docs))
    profiled = B.cut(profiles(found, size, text_keys))
    documents = profiled.where("kind = 0").drop("kind", "body", "keys", "block")
    least = F.min(F.struct((F.col("id") == B.NULL_ID).alias("none"), "id", "doc")).alias("least")
    same = profiled.where("kind = 0 and n > 0").groupBy("s0", "s1").agg(F.min(F.struct("doc", "block", "n", "keys")).alias("r"), F.count("*").alias("copies"), least)
    reps = same.select("r.doc", "r.block", "r.n", "r.keys")
    links, classes = None, None
    fits = F.col("bn") * 100 >= F.col("n") * percent
    fits &= F.col("n") * 100 >= F.col("bn") * percent

    def alike(pairs: DataFrame) -> DataFrame:
        pairs = B.cut(pairs)
        wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct().select("doc", F.floor(F.col("doc") / PLACES).alias("block"))
        return B.cut(verified(pairs, B.cut(texts_of(found, wanted)), size, percent))

    for turn in range(ROUNDS):
        new = alike(key_pairs(reps, classes, turn).where(fits).select("a", "b"))
        links = new if links is None else links.union(new)
        classes = B.cut(connected(links))
    with_class = reps.join(classes, reps.doc == classes.node, "left").select("doc", "block", F.coalesce("component", "doc").alias("class"))
    links = links.union(alike(prefix_pairs(found, with_class, sketch(profiled), size, percent)))
    final = connected(links)
    # each set's class, and of each class the first row
    rooted = same.select("s0", "s1", "copies", "least", F.col("r.doc").alias("doc")).join(final, F.col("doc") == F.col("node"), "left").select("s0", "s1", "copies", "least", "doc", F.coalesce("component", "doc").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("sets"))
    known = B.cut(spread_join(rooted, firsts, ["root"], "sets").select("s0", "s1", "copies", "first"))
    members = spread_join(documents, known, ["s0", "s1"], "copies")
    return members.select("doc", "id", "n", "text_key", F.coalesce("first.id", "id").alias("component"), F.coalesce("first.doc", "doc").alias("first"))


def joined(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    compared = classes_of(docs.where("doc_id is not null"), size, percent).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))

    def make():
        return lambda _, text: (len(Sets(pa.array([text], pa.binary()).cast(pa.string()), size).sets[0]), None)

    return compared.unionByName(map_texts(docs.where("doc_id is null"), make, [("doc_id", "long"), ("n_shingles", "long"), ("component_id", "long")]))


def one_of_each(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """docs with one row of each class: the first by doc_id, rows without an id last; of rows that are equal in doc_id and text one.

    Rows with an empty set are in a class of their own.  Rows are told apart by doc_id and text.
    """
    rows = classes_of(docs, size, percent, text_keys=True)
    by_text = rows.groupBy("id", "text_key").agg(F.max((F.col("doc") == F.col("first"))).alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1")
    marked = B.cut(by_text.select(F.nullif("id", F.lit(B.NULL_ID)).alias("_id"), F.col("text_key").alias("_key"), "stays"))
    keyed = docs.withColumn("_text_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))

    def those(mark: DataFrame, how: str) -> DataFrame:
        m = mark.select("_id", "_key")
        return keyed.join(m, keyed["doc_id"].eqNullSafe(m["_id"]) & (keyed["_text_key"] == m["_key"]), how)

    once = those(marked, "left_anti")
    repeated = those(marked.where("stays"), "left_semi").dropDuplicates(["doc_id", "_text_key"])
    return once.unionByName(repeated).select(*docs.columns)
