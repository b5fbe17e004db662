"""Approximate nearest neighbours: inverted lists scanned by adaptive dimension sampling.

Largest inner product is turned into smallest distance by one more coordinate, which brings
every vector to the largest norm. Vectors are turned by a random rotation and lie in about
sqrt(n) lists around centroids fitted on a bounded sample. How many lists a query probes is
measured on each index: a few calibration queries are compared with all vectors, and as many
of the nearest lists are probed as hold the wanted share of their true neighbours. In a list,
the distance grows over blocks of rotated coordinates, and after each block a hypothesis
test drops the candidates whose partial distance is too large for them to be among the
nearest. The survivors are scored exactly on the original vectors. The nearest lists are
scanned first, until they hold k candidates; what they give bounds the scan of the others.
Lists are cut into chunks of bounded size, so a list with a third of all vectors is many
tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridemill.session import stage

SAMPLE = 65536  # vectors the index is fitted on, at most
SAMPLE_CELLS = 1 << 22  # and their coordinates
PER_LIST = 16  # sample vectors a list, so lists are at most SAMPLE / PER_LIST
CALIBRATION, SHARE = 64, 0.97  # calibration queries, and the share of their neighbours that probed lists must hold
FIRST = 256  # candidates that the first scan looks at, at least
CHUNK = 4096  # vectors of a list in a chunk, queries of a list in a block, about
COLUMNS = 16  # coordinates in a column block
QUERIES = 256  # queries that are compared with a chunk at once
EPSILON = 2.1  # slack of the hypothesis test, in the unit of its standard deviation


class Index(NamedTuple):
    dim: int
    rotation: np.ndarray
    centroids: np.ndarray  # of rotated vectors
    norm2: float  # largest squared norm
    asked_ids: np.ndarray  # calibration queries
    asked: np.ndarray


def valid(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: an id, all components finite, not all zero, and of the most frequent dimension."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    top = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    return rows.where(F.size("v") == (top["dim"] if top else -1))


def _augmented(v: np.ndarray, norm2: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm2 - (v * v).sum(1), 0))
    return np.concatenate([v, rest[:, None]], 1)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids * centroids).sum(1) / 2
    return np.concatenate([(x[i : i + CHUNK] @ centroids.T - half).argmax(1) for i in range(0, max(len(x), 1), CHUNK)])


def fit(rows: DataFrame, seed: int = 7, rounds: int = 12) -> Index:
    """Rotation and centroids from at most ``SAMPLE`` vectors, those with the lowest hash of their id."""
    head = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2"), F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
    dim = head["dim"] or 1
    lists = max(1, round(head["n"] ** 0.5))
    most = max(CALIBRATION, min(SAMPLE, SAMPLE_CELLS // dim, PER_LIST * lists))
    share = 2.0 * most / max(head["n"], 1)  # about twice the wanted rows go into the choice
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 32)) / F.lit(float(1 << 32)) < share)
    taken = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()
    ids = np.array([r["vec_id"] for r in taken], np.int64)
    sample = np.array([r["v"] for r in taken], float).reshape(len(taken), dim)
    norm2 = head["norm2"] or 1.0
    random = np.random.default_rng(seed)
    rotation = np.linalg.qr(random.standard_normal((dim + 1, dim + 1)))[0]
    x = _augmented(sample, norm2) @ rotation
    k = min(lists, max(1, most // PER_LIST), max(len(x), 1))
    centroids = x[random.permutation(len(x))[:k]] if len(x) else np.zeros((1, dim + 1))
    for _ in range(rounds):
        own = _nearest(x, centroids) if len(x) else np.zeros(0, np.int64)
        size = np.bincount(own, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centroids)
    return Index(dim, rotation, centroids, norm2, ids[:CALIBRATION], sample[:CALIBRATION])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def assign(rows: DataFrame, index: Index) -> DataFrame:
    """(list, vec_id, v) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _nearest(_augmented(_matrix(batch.column("v"), index.dim), index.norm2) @ index.rotation, index.centroids)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), batch.column("vec_id"), batch.column("v")], names=["list", "vec_id", "v"])

    return rows.mapInArrow(run, "list bigint, vec_id bigint, v array<double>")


def _ranked(queries: np.ndarray, index: Index) -> np.ndarray:
    """All lists for each query, nearest centroid first."""
    turned = np.concatenate([queries, np.zeros((len(queries), 1))], 1) @ index.rotation
    return np.argsort((index.centroids**2).sum(1) - 2 * turned @ index.centroids.T, axis=1, kind="stable")


def calibrate(lists: DataFrame, index: Index, k: int) -> int:
    """How many of its nearest lists a query must probe for ``SHARE`` of its k true neighbours, from the calibration queries against all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(index.asked), k), -np.inf)
        where = np.full((len(index.asked), k), -1, np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                score = index.asked @ _matrix(batch.column("v"), index.dim).T
                score[index.asked_ids[:, None] == batch.column("vec_id").to_numpy()] = -np.inf
                score = np.concatenate([best, score], 1)
                own = np.concatenate([where, np.broadcast_to(batch.column("list").to_numpy(), (len(where), batch.num_rows))], 1)
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                best, where = np.take_along_axis(score, top, 1), np.take_along_axis(own, top, 1)
        row, at = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(where[row, at]), pa.array(best[row, at])], names=["asked", "list", "score"])

    found = lists.mapInArrow(run, "asked bigint, list bigint, score double")
    rank = F.row_number().over(W.partitionBy("asked").orderBy(F.desc("score"), "list"))
    true = found.withColumn("rank", rank).where(F.col("rank") <= k).select("asked", "list").collect()  # k rows a calibration query
    if not true:
        return 1
    place = np.argsort(_ranked(index.asked, index), axis=1)
    places = np.sort([place[r["asked"], r["list"]] for r in true])
    return int(places[int(np.ceil(SHARE * len(places))) - 1]) + 1


def probes(queries: DataFrame, index: Index, sizes: np.ndarray, wanted: int, least: int, first: bool) -> DataFrame:
    """(list, query_id, q, bound) for each list that a query probes.

    The first scan takes the nearest lists until they hold ``least`` vectors, the second one the
    others of the ``wanted`` nearest lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(start, QUERIES)
                order = _ranked(_matrix(batch.column("v"), index.dim), index)
                early = np.cumsum(sizes[order], axis=1) - sizes[order] < least
                chosen = (early if first else ~early & (np.arange(order.shape[1]) < wanted)) & (sizes[order] > 0)
                row, at = np.nonzero(chosen)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(order[row, at].astype(np.int64)), *(taken.column(c) for c in ("vec_id", "v", "bound"))], names=["list", "query_id", "q", "bound"])

    return queries.select("vec_id", "v", "bound").mapInArrow(run, "list bigint, query_id bigint, q array<double>, bound double")


def scan_block(index: Index, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one chunk for each query: query id, vector id and exact inner product."""
    turned = _augmented(vectors, index.norm2) @ index.rotation
    wide = np.concatenate([queries, np.zeros((len(queries), 1))], 1) @ index.rotation
    dim = turned.shape[1]
    edges = [*range(COLUMNS, dim, COLUMNS), dim]
    blocks = [np.ascontiguousarray(turned[:, a:b]) for a, b in zip([0, *edges], edges)]
    out = []
    for begin in range(0, len(query_ids), QUERIES):
        q, flat, own, bound = (x[begin : begin + QUERIES] for x in (wide, queries, query_ids, bounds))
        first = q[:, : edges[0]]
        partial = (first * first).sum(1)[:, None] + (blocks[0] * blocks[0]).sum(1) - 2 * first @ blocks[0].T
        row, at = np.nonzero((partial <= _limit(bound, edges[0], dim)[:, None]) & (own[:, None] != ids))
        partial = partial[row, at]
        for block, start, end in zip(blocks[1:], edges, edges[1:]):  # the pairs that are left, block after block
            difference = block[at] - q[row, start:end]
            partial = partial + np.einsum("ij,ij->i", difference, difference)
            keep = partial <= _limit(bound, end, dim)[row]
            row, at, partial = row[keep], at[keep], partial[keep]
        score = (vectors[at] * flat[row]).sum(1)
        order = np.lexsort((ids[at], -score, row))
        row, at, score = row[order], at[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top = place < k
        out.append((own[row[top]], ids[at[top]], score[top]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _limit(bound: np.ndarray, end: int, dim: int) -> np.ndarray:
    """The largest partial distance over ``end`` coordinates at which a candidate stays.

    Under the hypothesis that a vector is as near as the bound, the scaled partial distance
    exceeds it by this slack with a small, fixed probability only.
    """
    return bound * end / dim * (1 + EPSILON / np.sqrt(end)) ** 2 if end < dim else bound * (1 + 1e-9) + 1e-9


def scan(chunks: DataFrame, asked: DataFrame, index: Index, k: int, n_blocks: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of every probed chunk within the query's bound."""

    def gather(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"list": [key[0]], "query_ids": [group["query_id"].to_numpy().tobytes()], "queries": [np.stack(group["q"].to_numpy()).tobytes()], "bounds": [group["bound"].to_numpy().tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                raw = {name: row.column(name)[0].as_buffer() for name in ("ids", "vectors", "query_ids", "queries", "bounds")}
                numbers = lambda name, kind: np.frombuffer(raw[name], kind)
                found = scan_block(index, numbers("ids", np.int64), numbers("vectors", float).reshape(-1, index.dim),
                                   numbers("query_ids", np.int64), numbers("queries", float).reshape(-1, index.dim), numbers("bounds", float), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    blocks = dealt.groupBy("list", "block").applyInPandas(gather, "list bigint, query_ids binary, queries binary, bounds binary")
    pairs = chunks.join(blocks, "list").select("ids", "vectors", "query_ids", "queries", "bounds")
    return pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query, by largest inner product.

    Queries are the rows for which ``is_query`` (a condition on vec_id) holds; candidates are
    all rows but the query's own id. Rank counts from 1, equal scores by smaller vec_id. A
    query gets k rows, or all candidates, if fewer: its first scan ends after k candidates.
    Vectors that are null, zero, of another dimension than most, or hold null or non-finite
    components take no part, nor do rows without an id; rows that repeat an id count
    once (identical repeats; of differing ones any one counts). Empty tables give no rows. Every
    vector is in the index; centroids come from a sample.
    """
    rows = stage(valid(vectors, vec_id, vector).dropDuplicates(["vec_id"]), "vectors")
    index = fit(rows)
    lists = stage(assign(rows, index), "lists")
    sizes = np.zeros(len(index.centroids), np.int64)
    for row in lists.groupBy("list").count().collect():  # one row per list
        sizes[row["list"]] = row["count"]
    pieces = F.create_map(*(F.lit(int(x)) for i, n in enumerate(sizes) for x in (i, max(1, -(-int(n) // CHUNK)))))
    dealt = lists.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), pieces[F.col("list").cast("int")]).cast("bigint"))
    kinds = "list bigint, chunk bigint, ids binary, vectors binary"

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        return pd.DataFrame({"list": [key[0]], "chunk": [key[1]], "ids": [group["vec_id"].to_numpy().tobytes()], "vectors": [np.stack(group["v"].to_numpy()).tobytes()]})

    chunks = stage(dealt.groupBy("list", "chunk").applyInPandas(pack, kinds), "chunks")
    queries = rows.where(is_query)
    n_blocks = max(1, -(-queries.count() // CHUNK))
    wanted, least = calibrate(lists, index, k), max(FIRST, k + 1)  # a query's own vector may be among the first
    early = probes(queries.withColumn("bound", F.lit(float("inf"))), index, sizes, wanted, least, first=True)
    near = stage(_best(scan(chunks, early, index, k, n_blocks), k), "near")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    kth = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "score")
    bounded = queries.join(kth, "vec_id", "left").withColumn("bound", F.coalesce(norm + F.lit(index.norm2) - 2 * F.col("score"), F.lit(float("inf"))))
    late = scan(chunks, probes(bounded, index, sizes, wanted, least, first=False), index, k, n_blocks)
    return _best(near.select("query_id", "vec_id", "score").union(late), k)
