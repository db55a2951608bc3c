"""Quality rules with an isolation forest over their statistics.

Every text is measured whole: words, characters in words, symbols, repeated lines, words inside
repeated five-word windows.  Two fixed limits fail a document outright.  For the others a forest
of random splits gives the mean path length to isolation; short paths are anomalous.  The cuts of
the trees are drawn uniformly in the range of all labelled rows; how far a path goes is decided by
how many of all good labelled rows are in each node, LEVELS cuts at most.  The threshold
is calibrated on all labelled rows: the lowest score at which at most SPARED of the good rows
would be rejected, if rejecting there catches more bad rows than good ones; scores are told apart
in steps of 1 / STEPS.  Ranges, nodes and scores are counted where the rows are: what comes
to the driver has a fixed size.  Without labels of both kinds nothing but the fixed limits rejects.

Defined results: a null, empty or blank text has no words and fails the limits; nulls in labels
and labels without documents are left out, and a document counts as good only if all its labels
say so; repeated rows are judged alike; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import arrow_schema, ddl, map_texts, slices

COLUMNS = [("doc_id", "long"), ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
           ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("anomaly", "double")]
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
MARKS = b"!?=@^~_{}[]\\/+"
BLANKS = " \t\n\v\f\r"
WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20
MEASURED = [("doc_id", "long"), *((f"m{k}", "long") for k in range(8))]
#: Rows whose features are computed at once.
AT_ONCE = 4096
#: Steps in which scores between 0 and 1 are told apart by the threshold.
STEPS = 1 << 16
TREES, LEVELS, SEED = 100, 8, 7
#: Share of good labelled rows that the calibrated threshold may reject.
SPARED = 0.001


def measures(data: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; then capitals, other marks and distinct words."""
    words = data.split()
    n, text = len(words), data.decode()
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    repeated = 0
    if n > WINDOW:
        grams = list(zip(*(words[k:] for k in range(WINDOW))))
        if len(set(grams)) < len(grams):
            times, end = Counter(grams), 0
            for at, gram in enumerate(grams):
                if times[gram] > 1:
                    repeated += at + WINDOW - max(at, end)
                    end = at + WINDOW
    capitals = len(data) - len(data.translate(None, CAPITALS))
    marks = len(data) - len(data.translate(None, MARKS))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, capitals, marks, len(set(words))


def failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def features(rows: np.ndarray) -> np.ndarray:
    """Statistics that do not grow with the length of a text: rows of measures become rows of rates."""
    n, c = np.maximum(rows[:, 0], 1), np.maximum(rows[:, 1], 1)

    def bounded(x, half):  # rates that are 0 in most texts; half of the range lies below `half`
        return x / (x + half)

    return np.stack([np.log(np.maximum(rows[:, 1] / n, 1)), bounded(rows[:, 2] / n, 0.05), bounded(rows[:, 3] / np.sqrt(n), 0.5), rows[:, 4] / n,
                     bounded(rows[:, 5] / c, 0.05), bounded(rows[:, 6] / n, 0.05), np.log(np.maximum(rows[:, 7], 1)) / np.log(n + 1)], axis=1)


class IsolationForest:
    """Trees of random splits, as arrays: feature (-1: leaf), threshold, left child, path length at a leaf.

    A tree isolates rows by cuts that are uniform in its box, which starts as the range from low
    to high; where a part of the box holds no row, whatever falls there has a short path.  All
    cuts down to the deepest level are drawn first; `counts` tells how many of some rows reach
    each deepest node, and `grow` ends the paths by the counts of all rows.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, rows: int, trees: int = TREES, levels: int = LEVELS, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.rows = rows
        self.expected = max(float(self.mean_path(np.array(rows))), 1e-9)
        self.limit = max(1, min(levels, int(np.ceil(np.log2(max(rows, 2))))))
        self.cuts = [self.drawn(low, high, random) for _ in range(trees)]
        self.trees: list[tuple[np.ndarray, ...]] = []

    @staticmethod
    def mean_path(n: np.ndarray) -> np.ndarray:
        """Mean length of an unsuccessful search among n: what a leaf of n rows adds."""
        m = np.maximum(n, 2)
        return np.where(n < 2, 0.0, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m)

    def drawn(self, low: np.ndarray, high: np.ndarray, random) -> tuple[np.ndarray, np.ndarray]:
        """Feature and threshold of each node above the deepest level; node k has the children 2 k + 1 and 2 k + 2."""
        feature, threshold, boxes = [], [], [(low, high)]
        for at in range(2**self.limit - 1):
            low, high = boxes[at]
            wide = np.flatnonzero(high > low)
            f = int(random.choice(wide)) if len(wide) else 0
            cut, edge = float(random.uniform(low[f], high[f])), np.arange(len(low)) == f
            feature.append(f)
            threshold.append(cut)
            boxes += [(low, np.where(edge, cut, high)), (np.where(edge, cut, low), high)]
        return np.array(feature), np.array(threshold)

    def counts(self, x: np.ndarray) -> np.ndarray:
        """For each tree, how many rows of x reach each node of the deepest level."""
        rows, found = np.arange(len(x)), []
        for feature, threshold in self.cuts:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.limit):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            found.append(np.bincount(at - len(feature), minlength=len(feature) + 1))
        return np.array(found, np.int64)

    def grow(self, counts: np.ndarray) -> None:
        """A node of fewer than 2 rows is a leaf, and so are those of the deepest level."""
        for (feature, threshold), deepest in zip(self.cuts, counts):
            levels = [deepest]
            while len(levels[-1]) > 1:
                levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
            inside = np.concatenate(levels[::-1])
            depth = np.repeat(np.arange(self.limit + 1), 2 ** np.arange(self.limit + 1))
            leaf = (inside < 2) | (depth == self.limit)
            # the nodes that are reached, level by level, numbered anew
            reached, split = [0], []
            for at in reached:
                split.append(not leaf[at])
                if not leaf[at]:
                    reached += [2 * at + 1, 2 * at + 2]
            reached, split = np.array(reached), np.array(split)
            above = np.where(split, reached, 0)
            left = np.where(split, 2 * np.cumsum(split) - 1, -1)
            self.trees.append((np.where(split, feature[above], -1), np.where(split, threshold[above], 0.0), left, depth[reached] + self.mean_path(inside[reached])))
        self.cuts = []

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly between 0 and 1: 2 to the power of minus the mean path, in units of the expected one."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.limit):
                f = feature[at]
                step = left[at] + (x[rows, np.maximum(f, 0)] > threshold[at])
                at = np.where(f < 0, at, step)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.expected)


def calibrated(bad: np.ndarray, good: np.ndarray, spared: float = SPARED) -> float:
    """The lowest step that rejects at most a share `spared` of the good rows and more bad rows than good ones; bad, good: rows by the step of their scores."""
    if not good.any() or not bad.any():
        return np.inf
    rejected, lost = np.cumsum(bad[::-1])[::-1], np.cumsum(good[::-1])[::-1]
    allowed = np.flatnonzero((bad + good > 0) & (lost <= spared * good.sum()) & (rejected > lost))
    return float(allowed[0] / STEPS) if len(allowed) else np.inf


def by_slices(batches):
    """Features and the last column of rows of measures (m0, ..., m7, good)."""
    for part in slices(batches, AT_ONCE):
        columns = [c.to_numpy(zero_copy_only=False) for c in part.columns]
        yield features(np.stack(columns[:8], axis=1).astype(float)), columns[8].astype(bool)


def added_up(rows: DataFrame, count, shape: tuple[int, int]) -> np.ndarray:
    """The sum of count(features, good), whole numbers of this shape, over all rows; each of its lines is added up in one place."""
    schema = pa.schema([("line", pa.int64()), ("body", pa.binary())])

    def lines(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([B.packed(t.tobytes()) for t in total.values()], pa.binary())], schema=schema)

    def counted(batches):
        total = np.zeros(shape, np.int64)
        for x, good in by_slices(batches):
            total += count(x, good)
        yield lines(dict(enumerate(total)))

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for line, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[line] = total.get(line, 0) + np.frombuffer(B.unpacked(body), np.int64)
        if total:
            yield lines(total)

    kind = "line long, body binary"
    found = rows.mapInArrow(counted, kind).repartition(shape[0], "line").mapInArrow(added, kind).collect()
    whole = np.zeros(shape, np.int64)
    for r in found:
        whole[r["line"]] = np.frombuffer(B.unpacked(r["body"]), np.int64)
    return whole


def measured(docs: DataFrame) -> DataFrame:
    """One row of measures for each row of docs."""
    return map_texts(docs, lambda: lambda _, t: measures(t), MEASURED)


def fitted(docs: DataFrame, labels: DataFrame):
    """The forest and the threshold, or None where fewer than two labelled documents pass the fixed limits."""
    return fitted_to(measured(docs), labels)


def fitted_to(rows: DataFrame, labels: DataFrame):
    """What `fitted` gives, from rows of measures."""
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passing = rows.where(f"m0 >= {LEAST_WORDS} and 100 * m4 <= {REPEAT_PERCENT} * m0").distinct().join(quality, "doc_id")
    known = B.cut(passing.select(*(f"m{k}" for k in range(8)), (F.col("quality") > 0).alias("good")))
    width = features(np.ones((1, 8))).shape[1]

    def ranges(batches):
        for x, good in by_slices(batches):
            edges = np.stack([x.min(0), x.max(0)]).T.reshape(-1, 1).tolist()
            yield pa.RecordBatch.from_arrays([*(pa.array(e, pa.float64()) for e in edges), pa.array([len(x)], pa.int64()), pa.array([int(good.sum())], pa.int64())], schema=schema)

    columns = [*((f"{side}{k}", "double") for k in range(width) for side in ("low", "high")), ("n", "long"), ("good", "long")]
    schema = arrow_schema(columns)
    box = known.mapInArrow(ranges, ddl(columns)).agg(*(F.min(f"low{k}").alias(f"low{k}") for k in range(width)), *(F.max(f"high{k}").alias(f"high{k}") for k in range(width)), F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    if (box["n"] or 0) < 2:
        return None
    only_good = box["good"] > 1
    forest = IsolationForest(*(np.array([box[f"{side}{k}"] for k in range(width)]) for side in ("low", "high")), box["good"] if only_good else box["n"])
    forest.grow(added_up(known, lambda x, good: forest.counts(x[good] if only_good else x), (TREES, 2**forest.limit)))

    def by_step(x, good):
        step = (forest.scores(x) * STEPS).astype(np.int64)
        return np.stack([np.bincount(step[~good], minlength=STEPS + 1), np.bincount(step[good], minlength=STEPS + 1)])

    return forest, calibrated(*added_up(known, by_step, (2, STEPS + 1)))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text), with its measures and the verdict."""
    rows = B.cut(measured(docs))
    model = fitted_to(rows, labels)
    schema = arrow_schema(COLUMNS)

    def run(batches):
        for part in slices(batches, AT_ONCE):
            m = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]], axis=1)
            base = np.array([failed(n, r) for n, r in zip(m[:, 0].tolist(), m[:, 4].tolist())], bool)
            scores = model[0].scores(features(m.astype(float))) if model else np.zeros(len(m))
            kept = ~base & (scores < model[1] if model else True)
            score = pa.array(scores, pa.float64()) if model else pa.nulls(len(m), pa.float64())
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[1:6], pa.array(base), pa.array(kept), score], schema=schema)

    return rows.mapInArrow(run, ddl(COLUMNS))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    model = fitted(docs, labels)

    @F.pandas_udf("boolean")
    def keeps(texts: pd.Series) -> pd.Series:
        found = np.array([measures((t or "").encode()) for t in texts], float).reshape(-1, 8)
        base = np.array([failed(m[0], m[4]) for m in found], bool)
        odd = model[0].scores(features(found)) >= model[1] if model and len(found) else np.zeros(len(found), bool)
        return pd.Series(~base & ~odd)

    return docs.where(keeps("text"))
