"""Hard negatives by lists that a cluster of anchors shares.

Anchors of one direction form a cluster around its mean. By the triangle inequality of angles
no member's inner product with a candidate exceeds both norms times the cosine of the
candidate's angle to the mean less the cluster's widest angle. Candidates are sorted by that
bound once per cluster, and every member walks the list until the bound is below the worst of
the rows it still needs: its walk has then ended for certain.

Two walks are made: for the positives, and, once their scores are known for all anchors, for
the negatives whose score lies in the window that a positive's score opens. Candidates are cut
into segments of bounded size that tasks hold in memory while anchors stream past, a cluster
at a time; a segment returns at most k rows for an anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridemill.llm import spans
from ridemill.session import stage

SAMPLE, CELLS, PER_CELL = 4096, 256, 16  # anchors the directions are fitted on, most directions, sampled anchors per direction
SEGMENT = 1 << 24  # components of the candidates in a segment, about
LEAST_SEGMENT, SEGMENTS = 2048, 24  # smaller segments, while there are so few of them
PART = 1 << 17  # anchors that pass one task's segment
CLUSTER = 512  # anchors of a direction that share a list
STEP = 2048  # candidates of a list that members take at once
EXACT = 1 << 53  # integers below are exact in doubles
NONE, LAST = -(1 << 63) + 1, (1 << 63) - 1  # score and id of a free place


class Shape(NamedTuple):
    dim: int
    kind: str  # of the stored components
    exact: bool  # whether every inner product is exact in doubles
    n: int
    anchors: int


def valid(vectors: DataFrame, vec_id: str, label: str, vector: str, scale: float) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, components as floor(scale * x)."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    top = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    whole = F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("bigint"))
    rows = rows.where(F.size("v") == (top["dim"] if top else -1)).select("vec_id", "label", whole.alias("v"))
    least = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row"))  # one row an id
    return least.select("vec_id", "row.label", "row.v")


def _shape(rows: DataFrame, is_anchor: Column) -> Shape:
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    norm2, largest, dim, n, anchors = rows.agg(F.max(norm2), F.max(largest), F.max(F.size("v")), F.count("*"), F.count_if(is_anchor)).first()
    return Shape(dim or 1, "<i2" if (largest or 0) < 1 << 15 else "<i8", (norm2 or 0) < EXACT, n, anchors or 0)


def _directions(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(1)), 1e-300)[:, None]


def fit(rows: DataFrame, is_anchor: Column, shape: Shape, seed: int = 7, rounds: int = 8) -> np.ndarray:
    """Directions of at most ``SAMPLE`` anchors, those with the lowest hash of their id, by spherical k-means."""
    share = 2.0 * SAMPLE / max(shape.anchors, 1)  # about twice the wanted anchors go into the choice
    some = rows.where(is_anchor & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 32)) / F.lit(float(1 << 32)) < share))
    taken = some.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("v").collect()
    x = _directions(np.array([r["v"] for r in taken], float).reshape(len(taken), shape.dim))
    random = np.random.default_rng(seed)
    centroids = x[random.permutation(len(x))[: max(1, min(CELLS, len(x) // PER_CELL))]] if len(x) else np.zeros((1, shape.dim))
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(1) if len(x) else np.zeros(0, np.int64)
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        filled = (total * total).sum(1) > 0
        centroids = np.where(filled[:, None], _directions(total), centroids)
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray, shape: Shape) -> DataFrame:
    """(vec_id, label, cell, v): every row with its nearest direction, components in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(-1, shape.dim)
            packed = np.ascontiguousarray(v.astype(shape.kind)).view(np.uint8)
            ends = np.arange(len(v) + 1) * shape.dim * np.dtype(shape.kind).itemsize
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array((v.astype(float) @ centroids.T).argmax(1)), spans.strings(packed.ravel(), ends, pa.binary())],
                names=["vec_id", "label", "cell", "v"])

    return rows.mapInArrow(run, "vec_id bigint, label bigint, cell bigint, v binary")


class Segment:
    """Candidates that a task holds."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, shape: Shape):
        self.ids, self.labels, self.vectors, self.shape = ids, labels, vectors, shape
        self.norm = np.concatenate([np.sqrt((part * part).sum(1)) for part in self._parts()]) if len(ids) else np.zeros(0)

    def _parts(self) -> Iterator[np.ndarray]:
        return (self.vectors[i : i + STEP].astype(float) for i in range(0, len(self.ids), STEP))

    def shared_list(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates by falling bound, and the bound (for a member of norm 1) of each."""
        directions = _directions(members.astype(float))
        mean = _directions(directions.sum(0)[None])[0]
        widest = np.arccos(np.clip(directions @ mean, -1, 1)).max()
        cosine = np.concatenate([part @ mean for part in self._parts()]) / np.maximum(self.norm, 1e-300)
        angle = np.maximum(np.arccos(np.clip(cosine, -1, 1)) - widest, 0)
        bound = self.norm * (np.cos(angle) + 1e-7)  # more than the angles' rounding
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]

    def products(self, members: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Integer inner products."""
        if self.shape.exact:
            return (members.astype(float) @ self.vectors[candidates].astype(float).T).astype(np.int64)
        return members.astype(np.int64) @ self.vectors[candidates].astype(np.int64).T


class Best:
    """The ``k`` best (score, candidate id) of each of ``n`` askers within [low, high]."""

    def __init__(self, n: int, k: int, low: np.ndarray, high: np.ndarray):
        self.k, self.low, self.high = k, low, high
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), LAST)

    def needed(self) -> np.ndarray:
        """The least score that may still change an asker's rows."""
        return np.maximum(self.low, self.score[:, -1])

    def add(self, asker: np.ndarray, scores: np.ndarray, eligible: np.ndarray, ids: np.ndarray) -> None:
        """One row of ``scores`` per asker, one column per candidate."""
        ok = eligible & (scores >= self.needed()[asker][:, None]) & (scores <= self.high[asker][:, None])
        some = np.flatnonzero(ok.any(1))
        if not len(some):
            return
        asker, scores, ok = asker[some], np.where(ok[some], scores[some], NONE), ok[some]
        if scores.shape[1] > self.k:  # nothing below an asker's own k-th in this step
            ok &= scores >= np.partition(scores, -self.k, axis=1)[:, [-self.k]]
        row, at = np.nonzero(ok)
        place = np.concatenate([np.repeat(np.arange(len(asker)), self.k), row])
        score = np.concatenate([self.score[asker].ravel(), scores[row, at]])
        found = np.concatenate([self.id[asker].ravel(), ids[at]])
        order = np.lexsort((found, -score, place))
        first = np.searchsorted(place[order], np.arange(len(asker)))
        best = order[first[:, None] + np.arange(self.k)]
        self.score[asker], self.id[asker] = score[best], found[best]


def walk_positives(segment: Segment, ids: np.ndarray, labels: np.ndarray, members: np.ndarray, k: int) -> Best:
    """The nearest candidates of each member's own label, itself left out."""
    best = Best(len(ids), k, np.full(len(ids), NONE + 1), np.full(len(ids), LAST))
    order, bound = segment.shared_list(members)
    norm = np.sqrt((members.astype(float) ** 2).sum(1))
    for label in np.unique(labels):
        own, same = np.flatnonzero(labels == label), np.flatnonzero(segment.labels[order] == label)
        for start in range(0, len(same), STEP):
            alive = own[_reaches(norm[own], bound[same[start]], best.needed()[own])]
            if not len(alive):
                break
            step = order[same[start : start + STEP]]
            best.add(alive, segment.products(members[alive], step), segment.ids[step] != ids[alive][:, None], segment.ids[step])
    return best


def walk_negatives(segment: Segment, labels: np.ndarray, members: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[Best]:
    """For each window (a column of ``low`` and ``high``) the best candidates of other labels in it."""
    windows = [Best(len(labels), k, low[:, w], high[:, w]) for w in range(low.shape[1])]
    order, bound = segment.shared_list(members)
    norm = np.sqrt((members.astype(float) ** 2).sum(1))
    for start in range(0, len(order), STEP):
        reaches = [_reaches(norm, bound[start], best.needed()) & (best.low <= best.high) for best in windows]
        alive = np.flatnonzero(np.logical_or.reduce(reaches))
        if not len(alive):
            break
        step = order[start : start + STEP]
        scores = segment.products(members[alive], step)
        other = segment.labels[step] != labels[alive][:, None]
        for best, reach in zip(windows, reaches):
            still = reach[alive]
            best.add(alive[still], scores[still], other[still], segment.ids[step])
    return windows


def _reaches(norm: np.ndarray, bound: float, needed: np.ndarray) -> np.ndarray:
    return norm * bound * (1 + 1e-9) + 1e-6 >= needed


def _walk(candidates: DataFrame, anchors: DataFrame, shape: Shape, extra: str, walk: Callable[[Segment, list[np.ndarray]], tuple[list[np.ndarray], list[str]]], schema: str) -> DataFrame:
    """Anchors stream past every segment of the candidates; ``extra`` is a binary column of the anchors, or null.

    One shuffle by (part of the anchors, segment): a candidate is sent once per part, an anchor
    once per segment. The rows of a segment come first, then the anchors, a direction at a time.
    """
    per_segment = max(1, SEGMENT // shape.dim)
    segments = max(-(-shape.n // per_segment), min(-(-shape.n // LEAST_SEGMENT), SEGMENTS), 1)
    parts = max(1, -(-shape.anchors // PART))
    sizes = np.zeros(int(candidates.agg(F.max("cell")).first()[0] or 0) + 1, np.int64)
    for cell, n in candidates.groupBy("cell").count().collect():  # one row per direction
        sizes[cell] = n
    numbers = lambda values: F.element_at(F.array(*(F.lit(int(x)) for x in values)), (F.col("cell") + 1).cast("int"))
    within = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    place = (numbers(np.cumsum(sizes) - sizes) + within * numbers(sizes)) * segments / max(shape.n, 1)
    fields = ["vec_id", "label", "cell", "v"]
    held = candidates.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.least(F.floor(place), F.lit(segments - 1)).cast("int").alias("segment"),
        F.lit(0).alias("turn"), *fields, F.lit(None).cast("binary").alias("extra"))
    asking = anchors.select(
        F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"),
        F.lit(1).alias("turn"), *fields, F.expr(extra).alias("extra"))
    dealt = held.union(asking).repartition(segments * parts, "part", "segment").sortWithinPartitions("part", "segment", "turn", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, runs in groupby(_runs(batches), key=lambda x: x[0][:2]):
            segment = Segment(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, shape.dim), shape.kind), shape)
            for turn, cells in groupby(runs, key=lambda x: x[0][2]):
                if turn == 0:
                    segment = Segment(*_columns([part for _, part in cells], shape)[:3], shape)
                    continue
                for _, cell in groupby(cells, key=lambda x: x[0][3]):
                    for cluster in _clusters(part for _, part in cell):
                        if len(segment.ids):
                            columns, names = walk(segment, _columns(cluster, shape))
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return dealt.mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int, int], pa.RecordBatch]]:
    """Rows of one part, segment, turn and cell; a cell may come in several runs."""
    for batch in batches:
        keys = np.stack([batch.column(name).to_numpy().astype(np.int64) for name in ("part", "segment", "turn", "cell")], 1)
        edges = [0, *(1 + np.flatnonzero((keys[1:] != keys[:-1]).any(1))).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield tuple(keys[a].tolist()), batch.slice(a, b - a)


def _clusters(runs: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Runs of one direction in clusters of at most ``CLUSTER`` rows."""
    waiting, n = [], 0
    for part in runs:
        while part.num_rows:
            take = min(CLUSTER - n, part.num_rows)
            waiting.append(part.slice(0, take))
            part, n = part.slice(take), n + take
            if n == CLUSTER:
                yield waiting
                waiting, n = [], 0
    if waiting:
        yield waiting


def _columns(parts: list[pa.RecordBatch], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """Ids, labels, vectors and the further values of some rows."""
    ids, labels = (np.concatenate([p.column(name).to_numpy() for p in parts]) for name in ("vec_id", "label"))
    raw = np.concatenate([spans.flat(p.column("v"))[0] for p in parts])
    return ids, labels, raw.view(shape.kind).reshape(-1, shape.dim), [x for p in parts for x in p.column("extra").to_pylist()]


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor.

    A component x becomes floor(scale * x), and a score is the integer inner product with the
    anchor; higher scores come first, then smaller ids. An anchor (``is_anchor``, a condition on
    vec_id) has its first ``positives`` other rows of its label, and for each of them the first
    ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high
    * positive_score; all there are, if fewer, and none if the positive's score is negative.

    Rows with a null id, label or vector, an empty vector, a null or non-finite component, or of
    another dimension than most take no part. Of rows that repeat an id the one with the least
    (label, vector) counts. A vector of zeros takes part: its scores are 0. Equal scores and
    copies are ranked by id like any rows. Empty tables give no rows. Scores are 64-bit integers.
    """
    spark = vectors.sparkSession
    rows = stage(valid(vectors, vec_id, label, vector, scale), "vectors")
    is_anchor = F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor
    shape = _shape(rows, is_anchor)
    if not shape.anchors:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    cells = stage(assign(rows, fit(rows, is_anchor, shape), shape), "cells")
    asking = cells.where(is_anchor)

    def nearest(segment: Segment, anchors: list[np.ndarray]):
        ids, labels, members, _ = anchors
        best = walk_positives(segment, ids, labels, members, positives)
        row, at = np.nonzero(best.score > NONE)
        return [ids[row], best.id[row, at], best.score[row, at]], ["anchor_id", "positive_id", "positive_score"]

    found = _walk(cells, asking, shape, "CAST(NULL AS BINARY)", nearest, "anchor_id bigint, positive_id bigint, positive_score bigint")
    rank = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    pairs = stage(found.withColumn("rank", rank).where(F.col("rank") <= positives), "positives")

    # an anchor's positives travel with it as (id, score) in one binary value; their windows are never empty of meaning
    opened = pairs.where("positive_score >= 0").groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("own"))
    both = F.concat(*(F.aggregate(f"own.{name}", F.lit("").cast("binary"), lambda a, x: F.concat(a, F.unhex(F.lpad(F.hex(x), 16, "0")))) for name in ("positive_id", "positive_score")))
    asking = asking.join(opened.select(F.col("anchor_id").alias("vec_id"), both.alias("extra")), "vec_id")

    def between(segment: Segment, anchors: list[np.ndarray]):
        ids, labels, members, extra = anchors
        positive, score = np.zeros((len(ids), positives), np.int64), np.full((len(ids), positives), -1)
        for i, raw in enumerate(extra):
            own = np.frombuffer(raw, ">i8").reshape(2, -1)
            positive[i, : own.shape[1]], score[i, : own.shape[1]] = own
        whole, rest = np.divmod(score, 100)  # a share of a score without leaving 64 bits
        least, most = low * whole - (-low * rest // 100), high * whole + high * rest // 100
        closed = score < 0
        least[closed], most[closed] = 1, 0
        out = []
        for w, best in enumerate(walk_negatives(segment, labels, members, least, most, negatives)):
            row, at = np.nonzero(best.score > NONE)
            out.append([ids[row], positive[row, w], best.id[row, at], score[row, w], best.score[row, at]])
        return [np.concatenate(x) for x in zip(*out)], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]

    found = _walk(cells, asking, shape, "extra", between, "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint")
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
