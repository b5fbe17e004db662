"""Sum-of-squares packing of documents into sequences of a fixed number of tokens.

Tokenising is one pass without a shuffle. The pieces, now a few numbers each, are dealt into
groups of bounded size by a hash of document and piece; each group is packed by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridemill.llm import pretokens, spans
from ridemill.llm.repair import with_end
from ridemill.session import stage

SLICE = 1 << 20  # bytes of text encoded at once
GROUP = 100_000  # pieces that are packed together, about
PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, number, start and length of each piece; only the first piece of a document may be short."""
    pieces = -(-sizes // capacity)
    doc = np.repeat(np.arange(len(sizes)), pieces)
    number = spans.places(np.zeros(len(sizes), np.int64), pieces)
    first = sizes - (pieces - 1) * capacity
    length = np.where(number == 0, first[doc], capacity)
    start = np.where(number == 0, 0, first[doc] + (number - 1) * capacity)
    return doc, number, start, length


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pieces of all documents with the CRC-32 of their ids. A null text is empty: one piece of the end id."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pretokens.encoder(path)
        for batch in batches:
            for part in spans.slices(batch, "text", SLICE):
                ids, sizes = with_end(*own.encode(part.column("text")), end_id)
                doc, number, start, length = cut(sizes, capacity)
                raw = memoryview(ids.astype("<u4")).cast("B")
                ends = np.cumsum(length)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, PIECE_SCHEMA)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order.

    With n(g) open bins of gap g, a length goes into the open bin after which the sum over g
    of n(g) squared is smallest; a new bin is opened only when no open one has room, since
    the aim is few bins. Of equal choices the smallest gap wins, and within a gap the bin
    that reached it last.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)  # count[0] stays 0: a full bin has no gap
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made, never = 0, 4 * len(lengths) + 4
    for i, length in enumerate(lengths.tolist()):
        change = 2 * (count[: capacity + 1 - length] - count[length:])  # of the sum, less 2, by the gap after
        change[0] -= 1
        change[count[length:] == 0] = never
        after = int(np.argmin(change))
        if change[after] == never:
            after, bins[i], made = capacity - length, made, made + 1
        else:
            bins[i] = open_bins[after + length].pop()
            count[after + length] -= 1
        offsets[i] = capacity - after - length
        if after:
            open_bins[after].append(int(bins[i]))
            count[after] += 1
    return bins, offsets


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece.

    Every sequence holds at most ``capacity`` tokens without gaps. Repeated rows are packed
    as often as they occur; null ids are kept; other columns are left out; an empty table
    gives no rows. Within a group the longest pieces are placed first.
    """
    table = stage(pieces(docs, path, capacity, end_id, text, doc_id), "pieces")
    groups = max(1, -(-table.count() // GROUP))
    # by their place in the staged table as well, so that equal rows spread over the groups
    dealt = table.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], na_position="first", ignore_index=True)
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.drop(columns="group").assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    return dealt.groupBy("group").applyInPandas(run, f"{PIECE_SCHEMA}, sequence_id bigint, offset bigint")
