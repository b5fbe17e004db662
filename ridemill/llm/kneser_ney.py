"""Quality by an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Counts, context sums and the interpolated probabilities of each order are Spark tables that
are joined on n-grams. The finished table (log probability of each n-gram, log weight of each
context) is sharded by n-gram. Documents are worked on in blocks of a few MB: a block asks
each shard once for its different n-grams, the answers and the block's texts meet in one
task, and every document gets its perplexity. Only packed n-grams and compressed texts are
shuffled; no table is broadcast, and shards are repeated over as many tasks as there are
shuffle partitions.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridemill.functions import tails
from ridemill.llm import spans
from ridemill.llm.decontaminate import _filter, _in_filter
from ridemill.session import stage

ORDER = 5
BITS = 12  # of a character in an n-gram; rarer characters share places
START_SIGN, END_SIGN = 0, 1
BLOCK, SLICE = 12 << 20, 1 << 20  # bytes of text in a block, and worked on at once
SHARD = 65_536  # n-grams in a shard, about
PRIME = 1_000_003
STEP, NONE = 2.0**-16, 1 << 30  # of a stored logarithm, and the sign for none


def _mask(k: int) -> int:
    return (1 << (BITS * k)) - 1


def fixed(logs: np.ndarray) -> np.ndarray:
    """Logarithms as whole STEPs; null becomes NONE."""
    return np.where(np.isnan(logs.astype(float)), NONE, np.round(logs.astype(float) / STEP)).astype(np.int32)


def loose(steps: np.ndarray) -> np.ndarray:
    """The logarithms that ``fixed`` stored, to half a STEP; NONE becomes NaN."""
    return np.where(steps == NONE, np.nan, steps * STEP)


def squeeze(numbers: np.ndarray) -> bytes:
    """Compressed numbers: their lowest bytes, then the next ones, and so on."""
    return pa.compress(np.ascontiguousarray(numbers.reshape(-1).view(np.uint8).reshape(-1, numbers.itemsize).T), "zstd", asbytes=True)


def swell(content: pa.Buffer, kind: type, n: int) -> np.ndarray:
    """The ``n`` numbers that ``squeeze`` stored."""
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(content, size * n, "zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def signs(points: np.ndarray) -> np.ndarray:
    """Characters as numbers of BITS bits: their code point, or one of 1024 shared places above it."""
    return np.where(points < 3072, np.maximum(points, 2), 3072 + points % 1024).astype(np.int64)


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each character and at each text's end, and the number per text."""
    data, offsets = spans.flat(texts)
    points, at = spans.code_points(data)
    sizes = np.diff(np.searchsorted(at, offsets))
    pad = ORDER - 1
    begins = np.cumsum(sizes + pad + 1) - (sizes + pad + 1)
    padded = np.full(int((sizes + pad + 1).sum()), START_SIGN, np.int64)
    padded[spans.places(begins + pad, sizes)] = signs(points)
    padded[begins + pad + sizes] = END_SIGN
    where = spans.places(begins + pad, sizes + 1)
    code = np.zeros(len(where), np.int64)
    for k in range(ORDER):
        code |= padded[where - k] << (BITS * k)
    return code, sizes + 1


def counts(texts: DataFrame) -> DataFrame:
    """(code, n) of the ORDER-grams of all rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "text", 2 * SLICE):
                code, n = np.unique(ngrams(part.column("text"))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    return texts.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def discounts(table: DataFrame) -> tuple[float, float, float]:
    """The three discounts of one order, from the numbers of n-grams that occur once to four times."""
    n = [x or 0 for x in table.agg(*(F.sum((F.col("n") == k).cast("bigint")) for k in (1, 2, 3, 4))).first()]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2, 0.1 * k), 0.95 * k) for k in (1, 2, 3))


def train(texts: DataFrame) -> tuple[DataFrame, float]:
    """(key, logp, weight) for all orders, and the log probability of a character never seen.

    ``key`` is the n-gram with its order in the bits above; ``weight`` is the log of what a
    context leaves to the lower order. An n-gram that is also a context has a row for each.
    An empty ``texts`` gives an empty table.
    """
    tables = {ORDER: stage(counts(texts), "ngrams")}
    for k in range(ORDER - 1, 0, -1):  # lower orders count the different characters before an n-gram
        tables[k] = stage(tables[k + 1].groupBy(F.col("code").bitwiseAND(_mask(k)).alias("code")).agg(F.count("*").alias("n")), "ngrams")
    key = lambda k, code: code + F.lit(k << (BITS * ORDER))
    out, lower, unseen = [], None, float("-inf")
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(tables[k])
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        if k == 1:
            top = tables[1].agg(F.sum("n").alias("total"), F.sum(discount).alias("left"), F.count("*").alias("kinds")).first()
            if not top["kinds"]:
                break
            rest = top["left"] / top["total"] / (top["kinds"] + 1)
            unseen = float(np.log(rest))
            table = tables[1].select("code", ((F.col("n") - discount) / F.lit(float(top["total"])) + F.lit(rest)).alias("p"))
        else:
            same = W.partitionBy("context")  # at most 2 ** BITS n-grams
            parts = stage(tables[k].withColumn("context", F.shiftright("code", BITS)).select(
                "code", "context", F.sum("n").over(same).alias("total"), (F.col("n") - discount).alias("own"),
                F.sum(discount).over(same).alias("left"), (F.min("code").over(same) == F.col("code")).alias("first")), "contexts")
            gamma = F.col("left") / F.col("total")
            table = (parts.withColumn("suffix", F.col("code").bitwiseAND(_mask(k - 1)))
                     .join(lower.select(F.col("code").alias("suffix"), F.col("p").alias("below")), "suffix")
                     .select("code", (F.col("own") / F.col("total") + gamma * F.col("below")).alias("p")))
            out.append(parts.where("first").select(key(k - 1, F.col("context")).alias("key"), F.lit(None).cast("double").alias("logp"), F.log(gamma).alias("weight")))
        lower = stage(table, "probabilities")
        out.append(lower.select(key(k, F.col("code")).alias("key"), F.log("p").alias("logp"), F.lit(None).cast("double").alias("weight")))
    if not out:
        return tables[ORDER].select(F.col("code").alias("key"), F.lit(0.0).alias("logp"), F.lit(0.0).alias("weight")), unseen
    union = out[0]
    for table in out[1:]:
        union = union.union(table)
    return stage(union, "model"), unseen


def _asked(grams: np.ndarray) -> np.ndarray:
    """The keys, ascending, that the probabilities of different ORDER-grams need."""
    keys = [(k << BITS * ORDER) + np.unique(grams & _mask(k)) for k in range(1, ORDER + 1)]
    contexts = np.unique(grams >> BITS)
    keys += [(k << BITS * ORDER) + np.unique(contexts & _mask(k)) for k in range(1, ORDER)]
    return np.unique(np.concatenate(keys))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Blocks of rows, each with a number that depends on its texts alone."""
    for batch in batches:
        for part in spans.slices(batch, "text", BLOCK):
            data, offsets = spans.flat(part.column("text"))
            yield xxhash.xxh64_intdigest(data.tobytes() + offsets.tobytes()) >> 1, part


def _distinct(part: pa.RecordBatch) -> np.ndarray:
    return np.unique(np.concatenate([np.unique(ngrams(x.column("text"))[0]) for x in spans.slices(part, "text", SLICE)]))


def log_probabilities(grams: np.ndarray, keys: np.ndarray, logp: np.ndarray, weight: np.ndarray, unseen: float) -> np.ndarray:
    """Natural log probability of the last character of each ORDER-gram, given those before it."""

    def get(values: np.ndarray, k: int, codes: np.ndarray) -> np.ndarray:
        return values[np.searchsorted(keys, (k << BITS * ORDER) + codes)]

    total = get(logp, 1, grams & _mask(1))
    total = np.where(np.isnan(total), unseen, total)
    for k in range(2, ORDER + 1):
        left = get(weight, k - 1, (grams >> BITS) & _mask(k - 1))
        own = get(logp, k, grams & _mask(k))
        total = np.where(np.isnan(own), np.where(np.isnan(left), 0, left) + total, own)
    return total


def perplexities(docs: DataFrame, model: DataFrame, unseen: float, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys`` and the per-character perplexity of every row's whole text; a null text is empty.

    The end of a text counts as a character. Repeated rows stay; other columns are left out.
    """
    spark = docs.sparkSession
    shards = max(1, -(-model.count() // SHARD))
    copies = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    rows = docs.select(*keys, F.col(text).alias("text"))

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.groupby("key", as_index=False)[["logp", "weight"]].max()  # by key, ascending
        return pd.DataFrame({"shard": [key[0]], "keys": [group["key"].to_numpy(np.int64).tobytes()], "logp": [fixed(group["logp"].to_numpy()).tobytes()], "weight": [fixed(group["weight"].to_numpy()).tobytes()]})

    packed = model.groupBy((F.col("key") % PRIME % shards).alias("shard")).applyInPandas(pack, "shard bigint, keys binary, logp binary, weight binary")
    tables = packed.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).cast("bigint").alias("block"), F.lit(0).alias("kind"), "keys", "logp", "weight")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in _blocks(batches):
            wanted = _asked(_distinct(part))
            shard = wanted % PRIME % shards
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            some = np.flatnonzero(np.diff(bounds))
            packs = [squeeze(np.diff(wanted[order[bounds[s] : bounds[s + 1]]], prepend=0)) for s in some]
            n = np.diff(bounds)[some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array((np.full(len(some), block) % copies).astype(np.int32)), pa.array(np.full(len(some), block)), pa.array(n.astype(np.int32)), pa.array(packs, pa.binary())],
                names=["shard", "copy", "block", "kind", "keys"])

    asked = rows.mapInArrow(ask, "shard bigint, copy int, block bigint, kind int, keys binary").withColumns({"logp": F.lit(None).cast("binary"), "weight": F.lit(None).cast("binary")})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None  # the shard at hand; its table comes before what is asked of it
        for batch in batches:
            for k in range(batch.num_rows):
                shard, kind, block = (batch.column(c)[k].as_py() for c in ("shard", "kind", "block"))
                if kind == 0:
                    own = shard, *(np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("keys", np.int64), ("logp", np.int32), ("weight", np.int32)))
                    continue
                wanted = np.cumsum(swell(batch.column("keys")[k].as_buffer(), np.int64, kind))
                values = np.full((2, kind), NONE, np.int32)
                if own and own[0] == shard:
                    at = np.minimum(np.searchsorted(own[1], wanted), len(own[1]) - 1)
                    hit = own[1][at] == wanted
                    values[:, hit] = own[2][at[hit]], own[3][at[hit]]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([shard]), pa.array([kind], pa.int32()), pa.array([squeeze(values)], pa.binary())],
                                                 names=["block", "shard", "kind", "content"])

    met = tables.union(asked).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    answers = met.select("shard", "block", "kind", "keys", "logp", "weight").mapInArrow(answer, "block bigint, shard bigint, kind int, content binary")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in _blocks(batches):
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as writer:
                writer.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([1 << 62]), pa.array([0], pa.int32()), pa.array([sink.getvalue()], pa.binary())], names=["block", "shard", "kind", "content"])

    texts = rows.mapInArrow(carry, "block bigint, shard bigint, kind int, content binary")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                block, shard, n = (batch.column(c)[k].as_py() for c in ("block", "shard", "kind"))
                content = batch.column("content")[k].as_buffer()
                if block != current:
                    current, held = block, {}
                if shard < 1 << 62:
                    held[shard] = swell(content, np.int32, 2 * n).reshape(2, n)
                    continue
                for part in pa.ipc.open_stream(content):
                    grams = _distinct(part)
                    wanted = _asked(grams)
                    place = wanted % PRIME % shards
                    values = np.empty((2, len(wanted)))
                    for s in np.unique(place):  # every shard has answered, or the run is not whole
                        values[:, place == s] = loose(held[int(s)])
                    logs = log_probabilities(grams, wanted, values[0], values[1], unseen)
                    for small in spans.slices(part, "text", SLICE):
                        code, sizes = ngrams(small.column("text"))
                        ends = np.concatenate([[0.0], np.cumsum(logs[np.searchsorted(grams, code)])])
                        bounds = np.concatenate([[0], np.cumsum(sizes)])
                        yield pa.RecordBatch.from_arrays([*(small.column(c) for c in keys), pa.array(np.exp(-np.diff(ends[bounds]) / sizes))], names=[*keys, "perplexity"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return answers.union(texts).repartition("block").sortWithinPartitions("block", "shard").mapInArrow(score, f"{schema}, perplexity double")


def quality(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.99, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep) for every row of ``docs``.

    The model is trained on the texts of ``trusted_ids`` (doc_id) but for the quarter whose
    CRC-32 leaves 2 when divided by 4; on that quarter the threshold of each language is
    the ``quantile`` of its perplexities. Where they are too few to show it (fewer than
    1 / (1 - quantile)), it is the upper prediction bound of that level for their logarithms
    (Student's t), at least the largest seen. A language with fewer than two such documents
    gets the threshold of all of them; a null language is one of its own. With fewer than two
    in all nothing can be judged: the threshold is null and every row is kept; without trusted
    text to learn from the perplexity is null, too.
    Null and empty texts are judged by their end alone. Repeated rows stay, other columns are
    left out, an empty table gives no rows.
    """
    own = trusted_ids.select(F.col(doc_id).alias("__id")).where("__id IS NOT NULL").distinct()
    apart: Column = F.crc32(F.col("__id").cast("string").cast("binary")) % 4 == 2
    bits = _filter(F.xxhash64("__id"), own)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in_filter(bits, batch.column("h").to_numpy()))).select(["__id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    some = rows.select(F.col("doc_id").alias("__id"), "text", F.xxhash64("doc_id").alias("h")).where("text IS NOT NULL").mapInArrow(may, f"__id {kind}, text string")
    model, unseen = train(some.join(own.where(~apart), "__id", "left_semi").select("text"))
    if not np.isfinite(unseen):
        return rows.select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"))
    scored = stage(perplexities(rows, model, unseen, ("doc_id", "lang")), "perplexities")
    judged = scored.join(own.where(apart), scored["doc_id"] == F.col("__id"), "left_semi")
    logs = F.ln("perplexity")
    parts = [F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("seen"), F.count("*").alias("n"), F.mean(logs).alias("mean"), F.stddev(logs).alias("sd")]
    t = tails.student_critical(F.col("n") - 1, 2 * (1 - quantile))
    bound = F.when(F.col("n") > 1, F.greatest(F.col("seen"), F.exp(F.col("mean") + t * F.col("sd") * F.sqrt(1 + 1 / F.col("n")))))
    level = F.when(F.col("n") * F.lit(1 - quantile) >= 1 - 1e-9, F.col("seen")).otherwise(bound)
    limits = stage(judged.groupBy(F.col("lang").alias("__lang")).agg(*parts).select("__lang", level.alias("own")), "limits")  # one row per language
    everywhere = judged.agg(*parts).select(level.alias("all")).first()["all"]
    joined = scored.join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left").withColumn("threshold", F.coalesce("own", F.lit(everywhere).cast("double")))
    return joined.select("doc_id", "lang", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"))
