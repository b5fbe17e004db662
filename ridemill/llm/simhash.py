"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact check.

A fingerprint's segments are mapped to their bit counts. The Manhattan distance of two such
vectors is at most the Hamming distance of the fingerprints, so vectors farther apart than
the limit can be left out. Vectors within distance 2 share a grid point at distance 1 from
both: each vector is put into its own cell and into those one step away, and the join is an
equality of cells. The coarse grid (3-bit segments, one of 4) drops fingerprints that are alone in all
their cells. Those that are left meet again in the finest grid of the same kind (1-bit
segments, where the bound is the distance itself): a cell then holds at most 65 different
fingerprints whatever the data, and each is linked to the least one of its cell after the
exact bit count. So the work grows in proportion to the number of different fingerprints,
and a dense cluster of near copies costs no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridemill.llm import spans
from ridemill.llm.components import components
from ridemill.session import stage

SLICE = 1 << 20  # bytes of text that are hashed at once
WIDTHS = (3,) * 20 + (4,)  # bits of the coarse segments


def fingerprints_of(texts: pa.Array, shingle: int, seed: int) -> np.ndarray:
    """64-bit SimHash of each text, over all its word shingles, repeats included."""
    data, offsets = spans.flat(texts)
    lower = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    starts, ends, counts = spans.words(lower, offsets)
    # one buffer with each text's words joined by single spaces, so that a shingle is a range of it
    sizes = ends - starts + 1
    joined = np.full(int(sizes.sum()), 32, np.uint8)
    at = np.cumsum(sizes) - sizes
    solid = spans.places(at, sizes - 1)
    joined[solid] = lower[spans.places(starts, sizes - 1)]
    per_text = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    first_word = np.cumsum(counts) - counts
    first = spans.places(first_word, per_text)
    last = np.minimum(first + shingle - 1, np.repeat(first_word + counts - 1, per_text))
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], seed) for a, b in zip(at[first].tolist(), (at[last] + sizes[last] - 1).tolist())), np.uint64, len(first))
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    votes = np.zeros((len(counts), 64), np.int64)
    filled = np.flatnonzero(per_text)
    if len(filled):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes[filled] = np.add.reduceat(bits, bounds[filled], axis=0, dtype=np.int64)
    return np.packbits(2 * votes > per_text[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the signed 64-bit fp of every row; a null text has no words and so fingerprint 0."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "text", SLICE):
                found = fingerprints_of(part.column("text"), shingle, seed)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _coarse_cells(fp: Column) -> Column:
    """The cells of the segment-popcount vector and of its neighbours one step away, as packed longs.

    Three bits hold a segment's count, moved up by one so that a step down from 0 has a place
    (0 to 4 become 1 to 5, or 0 to 6 with a step); neighbouring fields never mix.
    """
    cell, low = F.lit(0).cast("bigint"), 0
    for k, width in enumerate(WIDTHS):
        segment = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        cell = cell + F.shiftleft((F.bit_count(segment) + 1).cast("bigint"), 3 * k)
        low += width
    steps = [0] + [sign * (1 << (3 * k)) for k in range(len(WIDTHS)) for sign in (1, -1)]
    return F.transform(F.array(*(F.lit(s).cast("bigint") for s in steps)), lambda s: cell + s)


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints that connect exactly those within 2 bits of each other.

    ``distinct`` has one row per fingerprint, in column fp. Every pair within the limit is
    joined through the least fingerprint of a cell that both are in.
    """
    cells = distinct.select("fp", F.explode(_coarse_cells(F.col("fp"))).alias("cell"))
    shared = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    close = cells.join(shared, "cell", "left_semi").select("fp").distinct()
    near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("bigint")) for k in range(64)]
    points = close.select("fp", F.explode(F.array(*near)).alias("point"))
    least = points.withColumn("least", F.min("fp").over(W.partitionBy("point")))
    return least.where((F.col("fp") != F.col("least")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= 2)).select(
        F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``.

    Rows are linked when their fingerprints differ in at most 2 bits; component_id is the
    smallest doc_id reachable, the row's own included. Null and empty texts, and texts of
    white space alone, share fingerprint 0. Rows with a null doc_id are linked as others but
    never name a component. Repeated rows stay; other columns are left out; an empty table
    gives no rows.
    """
    hashed = stage(fingerprints(docs, shingle, seed, text, doc_id), "fingerprints")
    distinct = stage(hashed.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(links(distinct)).select(F.col("a").alias("fp"), "root")
    placed = stage(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return hashed.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    A row without an id stands behind all others of its component, under a number made from
    its text. Of repeated rows with the smallest id one stays. Ids are whole numbers below
    2 to the power 62.
    """
    stand_in = F.xxhash64(text).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    rows = docs.withColumn("__id", F.coalesce(F.col(doc_id).cast("bigint"), stand_in))
    own = near_duplicates(rows, shingle, seed, text, "__id")
    kept = own.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    order = [F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    first = F.row_number().over(W.partitionBy("__id").orderBy(*order))
    return rows.join(kept, "__id", "left_semi").withColumn("__n", first).where("__n = 1").select(*(F.col(f"`{c}`") for c in docs.columns))
