"""Token-id files: Re-Pair grammars per shard, with random access to every document.

A file set is a Parquet folder with one row per shard: the document ids, the tokens and
symbols of each document, the symbol sequence, the rules (pairs of symbols, in the order in
which they were made) and the expansion length of each rule. Ids below ``base`` stand for
themselves, ``base + k`` for rule ``k``. No rule crosses the end of a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridemill.llm import pretokens, spans

SLICE = 4 << 20  # bytes of text encoded at once
SHARD_TOKENS = 1 << 20  # a shard ends with the document that reaches so many ids
LEAST_COUNT = 16  # a pair must occur so often to become a rule
FILE_SCHEMA = ("part bigint, part_start bigint, base bigint, width int, doc_ids array<bigint>, doc_tokens array<bigint>, "
               "doc_symbols array<bigint>, rules binary, rule_lengths binary, symbols binary")


def compress(ids: np.ndarray, sizes: np.ndarray, base: int, most_rules: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, symbols per document and rules for the documents of ``sizes`` ids each.

    Each round gives a nonterminal to every pair that still occurs ``LEAST_COUNT`` times,
    most frequent first, and replaces its occurrences, of overlapping ones every other one
    from the left. A pair that keeps under half of that count waits for the next round. All
    other occurrences overlap replaced ones, so only pairs with a new symbol and pairs that
    wait can be frequent in the next round. Rounds end when no pair is, or with ``most_rules`` rules.
    """
    seq = ids.astype(np.int64)
    last = np.zeros(len(seq), bool)
    filled = sizes[sizes > 0]
    last[np.cumsum(filled) - 1] = True
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    rules, n_rules = [np.zeros((0, 2), np.int64)], 0
    at = np.flatnonzero(~last[:-1])
    while len(at) >= LEAST_COUNT and n_rules < most_rules:
        pair, place = _sorted_pairs(seq[at], seq[at + 1], at, (base + n_rules).bit_length())
        start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        count = np.diff(start, append=len(pair))
        often = np.flatnonzero(count >= LEAST_COUNT)
        if not len(often):
            break
        often = often[np.argsort(-count[often], kind="stable")][: most_rules - n_rules]
        start, count = start[often], count[often]
        found = place[start]
        new = np.stack([seq[found], seq[found + 1]], 1)
        number = np.zeros(len(seq) + 1, np.int32)  # 1 is the most frequent pair, 0 none
        number[place[spans.places(start, count)]] = np.repeat(np.arange(1, len(often) + 1, dtype=np.int32), count)
        chosen = _without_overlap(number)
        uses = np.bincount(number[chosen], minlength=len(new) + 1)
        good = uses >= LEAST_COUNT // 2
        good |= not good.any()  # no round is without a replacement
        waits = chosen[~good[number[chosen]]]
        chosen = chosen[good[number[chosen]]]
        symbol = base + n_rules - 1 + np.cumsum(good[1:])
        rules.append(new[good[1:]])
        n_rules += len(rules[-1])
        seq[chosen] = symbol[number[chosen] - 1]
        last[chosen] |= last[chosen + 1]
        fresh, keep = np.zeros(len(seq), bool), np.ones(len(seq), bool)
        fresh[chosen], fresh[waits], fresh[waits + 1], keep[chosen + 1] = True, True, True, False
        seq, last, doc, fresh = seq[keep], last[keep], doc[keep], fresh[keep]
        at = np.flatnonzero(~last[:-1] & (fresh[:-1] | fresh[1:]))
    return seq, np.bincount(doc, minlength=len(sizes)), np.concatenate(rules)


def _sorted_pairs(left: np.ndarray, right: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs as sorted numbers, and the place of each; places ascend among equal pairs."""
    pair = left << bits | right
    place_bits = int(at[-1]).bit_length()
    if 2 * bits + place_bits < 64:  # both fit into one number, which sorts faster than an order of pairs
        both = np.sort(pair << place_bits | at)
        return both >> place_bits, both & ((1 << place_bits) - 1)
    order = np.argsort(pair, kind="stable")
    return pair[order], at[order]


def _without_overlap(number: np.ndarray) -> np.ndarray:
    """Places that hold a number, every other one of a run of adjacent places."""
    at = np.flatnonzero(number)
    run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    turn = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    return at[turn % 2 == 0]


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rules written out: ids, and start and length of each rule in them."""
    lengths = np.ones(len(rules), np.int64)
    depth = np.zeros(len(rules), np.int64)
    done = 0
    while done < len(rules):  # a run of rules whose parts are all known
        end = done + int(np.argmax((rules[done:] >= base + done).any(1))) if (rules[done:] >= base + done).any() else len(rules)
        own = rules[done:end] - base
        lengths[done:end] = np.where(own >= 0, lengths[np.maximum(own, 0)], 1).sum(1)
        depth[done:end] = done
        done = end
    starts = np.cumsum(lengths) - lengths
    ids = np.empty(int(lengths.sum()), np.int64)
    for begin in np.unique(depth):
        group = np.flatnonzero(depth == begin)
        offset = starts[group]
        for side in (0, 1):
            part = rules[group, side]
            plain = part < base
            ids[offset[plain]] = part[plain]
            inner = part[~plain] - base
            size = lengths[inner]
            ids[spans.places(offset[~plain], size)] = ids[spans.places(starts[inner], size)]
            offset = offset + np.where(plain, 1, lengths[np.where(plain, 0, part - base)])
    return ids, starts, lengths


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids behind ``symbols``."""
    ids, starts, lengths = expansions(rules, base)
    place = np.concatenate([np.arange(base), base + starts])  # ids below base stand before the written-out rules
    size = np.concatenate([np.ones(base, np.int64), lengths])
    both = np.concatenate([np.arange(base), ids]).astype(np.uint32)
    return both[spans.places(place[symbols], size[symbols])]


def token_at(symbols: np.ndarray, rules: np.ndarray, rule_lengths: np.ndarray, base: int, index: int) -> int:
    """The id at one place, by the expansion lengths alone."""
    ends = np.cumsum(np.where(symbols < base, 1, rule_lengths[np.maximum(symbols - base, 0)] if len(rule_lengths) else 1))
    k = int(np.searchsorted(ends, index, side="right"))
    symbol, index = int(symbols[k]), index - int(ends[k - 1] if k else 0)
    while symbol >= base:
        left, right = (int(x) for x in rules[symbol - base])
        size = int(rule_lengths[left - base]) if left >= base else 1
        symbol, index = (left, index) if index < size else (right, index - size)
    return symbol


def write_files(docs: DataFrame, out: str, path: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode every text with ``path`` (no added special tokens), append ``end_id`` and write the file set ``out``.

    Documents lie in ascending order of ``doc_id`` (nulls first, equal ids by text) over the
    rows ordered by ``part`` and ``part_start``. A null text is empty: its ids are the end
    id alone. Repeated rows are written as often as they occur; other columns are left out;
    an empty table gives an empty file set. The texts are shuffled once, into ranges of ids,
    and each is encoded once.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    numbered = rows.withColumn("part", F.spark_partition_id().cast("bigint"))

    def shard(parts: list[tuple[pa.Array, np.ndarray, np.ndarray]], part: int, start: int, base: int) -> tuple[dict, int]:
        ids = np.concatenate([p[1] for p in parts])
        sizes = np.concatenate([p[2] for p in parts])
        symbols, per_doc, rules = compress(ids, sizes, base)
        narrow = base + len(rules) <= 1 << 16
        row = {
            "part": part, "part_start": start, "base": base, "width": 2 if narrow else 4,
            "doc_ids": [i for p in parts for i in p[0].to_pylist()], "doc_tokens": sizes, "doc_symbols": per_doc,
            "rules": rules.astype("<u4").tobytes(), "rule_lengths": expansions(rules, base)[2].astype("<u4").tobytes(),
            "symbols": symbols.astype("<u2" if narrow else "<u4").tobytes(),
        }
        return row, start + len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pretokens.encoder(path)
        base = max(own.tokenizer.get_vocab_size(), end_id + 1)
        kinds = pa.schema([("part", pa.int64()), ("part_start", pa.int64()), ("base", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                           ("doc_tokens", pa.list_(pa.int64())), ("doc_symbols", pa.list_(pa.int64())), ("rules", pa.binary()), ("rule_lengths", pa.binary()), ("symbols", pa.binary())])
        held, size, start, part = [], 0, 0, 0
        for batch in batches:
            for piece in spans.slices(batch, "text", SLICE):
                ids, sizes = with_end(*own.encode(piece.column("text")), end_id)
                part = piece.column("part")[0].as_py()
                held.append((piece.column("doc_id"), ids, sizes))
                size += len(ids)
                if size >= SHARD_TOKENS:
                    row, start = shard(held, part, start, base)
                    yield pa.RecordBatch.from_pylist([row], kinds)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([shard(held, part, start, base)[0]], kinds)

    numbered.mapInArrow(run, FILE_SCHEMA).write.mode("errorifexists").parquet(out)


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each document."""
    ends = np.cumsum(sizes + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.uint32)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = ids
    return out, sizes + 1


def read_files(spark: SparkSession, out: str, of_ids: Callable[[bytes], object] | None = None, name: str = "ids", kind: str = "binary") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the ids of each document of a file set.

    The ids come as little-endian unsigned 32-bit integers, or as what ``of_ids`` makes of
    these bytes. Only one row per part is summed up to find the starts.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(out)
    totals = files.groupBy("part").agg(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("total"))
    before = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                symbols = np.frombuffer(row["symbols"], f"<u{row['width']}").astype(np.int64)
                ids = expand(symbols, np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2), row["base"]).astype("<u4")
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(ids).cast("B")
                values = [raw[4 * (e - s) : 4 * e] for e, s in zip(ends.tolist(), sizes.tolist())]
                values = [of_ids(v) if of_ids else bytes(v) for v in values]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(sizes), pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["part_start"] + ends - sizes),
                     pa.array(sizes), pa.array(values, pa.binary() if kind == "binary" else pa.int64())], names=["part", "doc_id", "place", "n_tokens", name])

    docs = files.mapInArrow(run, f"part bigint, doc_id bigint, place bigint, n_tokens bigint, {name} {kind}")
    return docs.join(before, "part").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", name)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
