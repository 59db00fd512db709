"""Hard negatives: for an anchor and each of its positives, the best other-label rows in a score window.

A score is the inner product of two vectors of integers (``floor(scale * x)`` of each component).
The positives of an anchor are its best rows of the same label; a negative of a positive has
another label and a score between ``low`` and ``high`` hundredths of the positive's.

Anchors are the query set and go to the tasks in blocks of bounded size (``BLOCK``); every task
compares its own rows with a block and keeps a bounded list for each anchor and window, and a
window function merges the lists.  Inside a task the anchors of a block hang together in a
minimum spanning tree.  If a row's score with the parent anchor lies in an interval, its score
with the child lies in that interval widened by the edge's distance times the row's norm (the
difference of the two scores is the inner product of the row with the difference of the
anchors).  Only rows whose widened interval overlaps a window that can still change are scored
again, and their interval becomes a point; the others hand their interval on to the next child.
A window's lower edge rises to the last score on its list, so it closes in as rows come by.

Intervals only decide what to score; every reported score is exact.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take
no part.  Vectors of different lengths are compared as if the shorter went on with zeros.  Rows
equal in id, label and vector count once, and rows with the anchor's id are not its positives or
negatives.  Equal scores go by the smaller id.  Empty tables, anchors without positives and
positives without negatives give no rows.  Scores have to fit into 64 bits; a vector for which
this isn't certain is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import scratch

SCALE = 256
POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100
# Anchors that are sent to the tasks at a time, and rows that a task compares at a time.
BLOCK = 1024
TILE = 4096
# Beyond this share of rows to score again, all are: one product instead of a gather.
DENSE = 0.4
_EVERYTHING = (-(1 << 63), (1 << 63) - 1)


# -- spanning tree ------------------------------------------------------------------------

def spanning_tree(vectors: np.ndarray) -> list[tuple[int, int, float]]:
    """``(child, parent, distance)`` in an order in which parents come first; the root has parent -1."""
    n = len(vectors)
    if not n:
        return []
    best, parent = np.full(n, np.inf), np.full(n, -1)
    left = np.ones(n, bool)
    here, edges = 0, [(0, -1, 0.0)]
    for _ in range(n - 1):
        left[here] = False
        gap = np.sqrt(np.square(vectors - vectors[here]).sum(axis=1))
        nearer = left & (gap < best)
        best[nearer], parent[nearer] = gap[nearer], here
        here = int(np.where(left, best, np.inf).argmin())
        edges.append((here, int(parent[here]), float(best[here])))
    return edges


@dataclass
class Anchors:
    """A block of anchors, their windows of scores, and the trees they hang in.

    ``windows[a]`` lists ``(low, high)``; ``same`` asks for rows of the anchor's label instead of
    others.  With ``same`` there is a tree for each label, as only its rows are compared.
    """

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    windows: list[list[tuple[int, int]]]
    keep: int
    same: bool
    trees: list[tuple[int, list[tuple[int, int, float]]]] | None = None

    def __post_init__(self) -> None:
        if self.trees is not None:
            return
        groups = [np.flatnonzero(self.labels == v) for v in np.unique(self.labels)] if self.same else [np.arange(len(self.ids))]
        self.trees = [(int(self.labels[g[0]]), [
            (int(g[child]), -1 if parent < 0 else int(g[parent]), distance)
            for child, parent, distance in spanning_tree(self.vectors[g].astype(np.float64))])
            for g in groups if len(g)]


def exact_type(anchors: np.ndarray, rows: np.ndarray) -> type:
    """The fastest number type in which no partial sum of an inner product is rounded."""
    top = lambda v: max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0))))
    bound = top(anchors) * top(rows) * max(1, anchors.shape[1])
    if bound >= 1 << 62:
        raise OverflowError("inner products of these vectors don't fit into 64 bits")
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


class Lists:
    """The best ``keep`` rows of every window of every anchor, over all tiles of a task."""

    def __init__(self, anchors: Anchors):
        self.anchors = anchors
        self.best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in w] for w in anchors.windows]
        self.floors = [[low for low, _ in w] for w in anchors.windows]
        self.compared = self.scored = 0

    def add(self, anchor: int, ids: np.ndarray, scores: np.ndarray) -> None:
        for k, (_, high) in enumerate(self.anchors.windows[anchor]):
            fits = (scores >= self.floors[anchor][k]) & (scores <= high)
            if not fits.any():
                continue
            old_ids, old_scores = self.best[anchor][k]
            new_ids, new_scores = ids[fits], scores[fits]
            all_ids, all_scores = np.concatenate((old_ids, new_ids)), np.concatenate((old_scores, new_scores))
            order = np.lexsort((all_ids, -all_scores))
            all_ids, all_scores = all_ids[order], all_scores[order]
            once = np.ones(len(order), bool)
            once[1:] = (all_ids[1:] != all_ids[:-1]) | (all_scores[1:] != all_scores[:-1])
            all_ids, all_scores = all_ids[once][:self.anchors.keep], all_scores[once][:self.anchors.keep]
            self.best[anchor][k] = all_ids, all_scores
            if len(all_ids) == self.anchors.keep:
                self.floors[anchor][k] = int(all_scores[-1])

    def compare(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Take in a tile of rows."""
        for label, tree in self.anchors.trees:
            if self.anchors.same:
                mine = labels == label
                if mine.any():
                    self._walk(tree, ids[mine], labels[mine], vectors[mine])
            else:
                self._walk(tree, ids, labels, vectors)

    def _walk(self, tree: list[tuple[int, int, float]], ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        kind = exact_type(self.anchors.vectors, vectors)
        rows, queries = vectors.astype(kind), self.anchors.vectors.astype(kind)
        # A little more than the norm, so that rounding can't shut a row out.
        norms = np.sqrt(np.square(vectors.astype(np.float64)).sum(axis=1)) * (1 + 1e-9)
        waiting: dict[int, int] = {}
        for _, parent, _ in tree:
            waiting[parent] = waiting.get(parent, 0) + 1
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for child, parent, distance in tree:
            if parent < 0:
                low = high = None
                open_ = np.ones(len(ids), bool)
            else:
                slack = norms * (distance * (1 + 1e-9)) + 1
                low, high = bounds[parent][0] - slack, bounds[parent][1] + slack
                open_ = np.zeros(len(ids), bool)
                for floor, (_, top) in zip(self.floors[child], self.anchors.windows[child], strict=True):
                    open_ |= (high >= floor) & (low <= top)
            waiting[parent] -= 1
            if not waiting[parent]:
                bounds.pop(parent, None)
            apart = ids != self.anchors.ids[child]
            if not self.anchors.same:
                apart &= labels != self.anchors.labels[child]
            self.compared += int(apart.sum())
            self.scored += int((open_ & apart).sum())
            if parent < 0 or open_.mean() > DENSE:
                scores = rows @ queries[child]
                low = high = scores.astype(np.float64)
                at = np.flatnonzero(apart)
                self.add(child, ids[at], scores[at].astype(np.int64))
            else:
                at = np.flatnonzero(open_)
                scores = rows[at] @ queries[child]
                low[at] = high[at] = scores
                counts = apart[at]
                self.add(child, ids[at][counts], scores[counts].astype(np.int64))
            if waiting.get(child):
                bounds[child] = low, high


# -- the job ------------------------------------------------------------------------------

def prepared(rows: DataFrame, vec_id: Column, label: Column, vector: Column, scale: int = SCALE) -> DataFrame:
    """``id, label, v`` of the rows that take part; ``v`` are whole numbers of one length."""
    taken = rows.select(vec_id.cast("long").alias("id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = taken.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite).select(
        "id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    whole = scratch(whole, "vectors")
    width = whole.agg(F.max(F.size("v"))).first()[0] or 0
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))
    return whole.withColumn("v", F.when(F.size("v") < width, F.concat("v", zeros)).otherwise(F.col("v")))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def _best_rows(rows: DataFrame, anchors: Anchors, keys: list[int]) -> DataFrame:
    """``anchor, window, id, score``: the lists of every task, merged."""
    # Plain values: a broadcast object of this class would ask the workers for the package.
    sent = rows.sparkSession.sparkContext.broadcast(([getattr(anchors, f.name) for f in fields(Anchors)], keys))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names = sent.value
        lists = Lists(Anchors(*block))
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                lists.compare(ids, labels, _matrix(part.column(2), part.num_rows))
        out = [(names[a], k, int(i), int(s)) for a, windows in enumerate(lists.best)
               for k, (found, scores) in enumerate(windows) for i, s in zip(found, scores, strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
            ["anchor", "window", "id", "score"])

    found = rows.select("id", "label", "v").mapInArrow(search, "anchor bigint, window int, id bigint, score bigint").distinct()
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= anchors.keep)


def mine(rows: DataFrame, vec_id: Column, label: Column, vector: Column, anchor: Column, positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` is a condition on the given rows' id; each anchor meets all rows.
    """
    spark = rows.sparkSession
    whole = prepared(rows, vec_id, label, vector, scale)
    queries = whole.filter(anchor).distinct()
    n_blocks = max(1, -(-queries.count() // block))
    queries = scratch(queries.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(n_blocks))), "anchors")
    parts = []
    for number in range(n_blocks):
        held = queries.filter(F.col("block") == number).drop("block").orderBy("id", "label", "v").toArrow()
        # A block by hash may be somewhat larger than the rest; what is sent at a time is not.
        for at in range(0, held.num_rows, block):
            parts.append(_mined(whole, held.slice(at, block), positives, negatives, low, high))
    if not parts:
        return spark.createDataFrame([], (
            "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _mined(whole: DataFrame, held: pa.Table, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The negatives of one block of anchors."""
    spark = whole.sparkSession
    ids, labels = held["id"].to_numpy(), held["label"].to_numpy()
    vectors = _matrix(held["v"].combine_chunks(), held.num_rows)
    keys = list(range(held.num_rows))
    first = _best_rows(whole, Anchors(ids, labels, vectors, [[_EVERYTHING]] * len(ids), positives, True), keys)
    pairs = scratch(first.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
                                 (F.col("rank") - 1).alias("window")), "positives")
    windows: dict[int, list[tuple[int, int]]] = {}
    for r in pairs.orderBy("anchor", "window").collect():  # bounded: positives of one block
        score = r["positive_score"]
        # A negative positive's window is empty (low above high).
        windows.setdefault(r["anchor"], []).append((-(-low * score // 100), high * score // 100))
    asked = sorted(windows)
    second = _best_rows(
        whole, Anchors(ids[asked], labels[asked], vectors[asked], [windows[a] for a in asked], negatives, False), asked)
    names = spark.createDataFrame([(k, int(i)) for k, i in enumerate(ids.tolist())], "anchor long, anchor_id long")
    return scratch(
        second.join(F.broadcast(pairs), ["anchor", "window"]).join(F.broadcast(names), "anchor").select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")), "negatives")
