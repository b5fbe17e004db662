"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared in lower case without punctuation, of any script; where a script sets no
spaces (Han, kana, Thai, Lao, Khmer, Myanmar) every character is a word. An alignment scores
2 for a match, -1 for a mismatch and -2 for a word left out or put in; its similarity to an
item of L words is 1 - (2 L - score) / (3 L), the share of words that were not replaced when
nothing else was done, so a copy at similarity s may lose 3 (1 - s) L of its score. An edit
that costs c destroys at most c of the item's word trigrams, 2 c / 3 of its bigrams and c / 2
of its words. Seeds are trigrams where every such copy keeps one, or else bigrams, or else
words. Of each item those are seeds that are rarest in the whole corpus: so many that at
least half of what any such copy must keep are among them. Regions of documents with fewer
seeds cannot be such copies; the others are aligned. Nothing that reaches the similarity is
lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridemill.llm import spans
from ridemill.session import stage

SEED_WORDS = 3
DESTROYED = {3: 1.0, 2: 2 / 3, 1: 1 / 2}  # runs of so many words that an edit destroys, at most, per point of its cost
LEAST_EDIT = 2  # what the cheapest edit costs
BETWEEN = r"[^\pL\pN\pM]+"
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
SLICE = 1 << 20  # bytes of text that are hashed at once
FILTER_BITS = 23  # a filter of one megabyte, whatever the number of seeds or documents
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


class Words:
    """Word ranges and word hashes of the texts of a column, in lower case."""

    def __init__(self, texts: pa.Array):
        lower = pc.utf8_lower(texts)
        data, _ = spans.flat(lower)
        if (data >= 0x80).any():  # only then can there be marks or letters that bytes don't tell
            lower = pc.replace_substring_regex(lower, BETWEEN, " ")
            if ((data >= 0xE0) & (data != 0xE2)).any():  # first bytes of scripts without spaces
                lower = pc.replace_substring_regex(lower, UNSPACED, r" \1 ")
        self.data, self.offsets = spans.flat(lower)
        data = self.data
        solid = (data >= 0x80) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
        self.starts, self.ends, self.counts = spans.words(np.where(solid, data, 32).astype(np.uint8), self.offsets)
        n = len(data) + 1
        prefix = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + 1) * _powers(int(BASE), n)[:-1], out=prefix[1:])
        inverse = _powers(pow(int(BASE), -1, 1 << 64), n)
        self.hashes = _mix((prefix[self.ends] - prefix[self.starts]) * inverse[self.starts])

    def seeds(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and hash of each run of ``length`` words."""
        first = np.cumsum(self.counts) - self.counts
        per_text = np.maximum(self.counts - length + 1, 0)
        at = spans.places(first, per_text)
        value = np.full(len(at), SEED_WORDS - length, np.uint64)
        for k in range(length):
            value = value * np.uint64(0xD6E8FEB86659FD93) + self.hashes[at + k]
        text = np.repeat(np.arange(len(per_text)), per_text)
        return text, at - first[text], _mix(value).view(np.int64)


def _seed_rows(rows: DataFrame, lengths: list[int], bits: np.ndarray | None) -> DataFrame:
    """(id, n_words, seed_words, pos, seed) of each row (id, text); with a filter, of seeds that may be in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans.release()
        for batch in batches:
            for part in spans.slices(batch, "text", SLICE):
                words = Words(part.column("text"))
                for length in lengths:
                    text, pos, seed = words.seeds(length)
                    if bits is not None:
                        hit = _in_filter(bits, seed)
                        text, pos, seed = text[hit], pos[hit], seed[hit]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(text)), pa.array(words.counts[text], pa.int64()), pa.array(np.full(len(text), length)), pa.array(pos, pa.int64()), pa.array(seed)],
                        names=["id", "n_words", "seed_words", "pos", "seed"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, seed_words bigint, pos bigint, seed bigint")


def _lost(similarity: float, length: int) -> Column:
    """How many of an item's runs of ``length`` words a copy at the similarity can lack."""
    cost = 3 * (1 - similarity) * F.col("n_words") + 1e-9
    return F.when(cost < LEAST_EDIT, 0).otherwise(F.floor(cost * DESTROYED[length]))


def _filter(hashes: Column, rows: DataFrame) -> np.ndarray:
    """A bit set over the low bits of ``hashes``; its size does not depend on the number of rows."""
    spot = F.pmod(hashes, F.lit(1 << FILTER_BITS))
    words = rows.select(spot.alias("s")).selectExpr("s div 64 AS word", "shiftleft(1L, cast(s % 64 AS int)) AS bit")
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        out[row["word"]] = row["bits"]
    return out


def _in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spot = hashes & ((1 << FILTER_BITS) - 1)
    return (bits[spot >> 6] >> (spot & 63)) & 1 == 1


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of pairs of word-hash arrays, and the passage word after the alignment's last."""
    n, length, width = len(items), max(map(len, items), default=0), max(map(len, passages), default=0)
    left = np.zeros((n, length), np.uint64)
    right = np.ones((n, width), np.uint64)  # no word has hash 0 or 1, as good as never
    for k, (a, b) in enumerate(zip(items, passages)):
        left[k, : len(a)], right[k, : len(b)] = a, b
    score, step = np.zeros((n, width + 1), np.int32), 2 * np.arange(width + 1, dtype=np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(length):
        now = np.maximum(score - 2, 0)
        np.maximum(now[:, 1:], score[:, :-1] + np.where(right == left[:, i : i + 1], 2, -1), out=now[:, 1:])
        score = np.maximum.accumulate(now + step, axis=1) - step
        at = score.argmax(1)
        top = score[np.arange(n), at]
        end = np.where(top > best, at, end)
        best = np.maximum(best, top)
    return best, end


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, last_word) of each document that holds a copy of a benchmark item.

    One row per pair, for its best alignment; word numbers count the document's words from
    0. Items of fewer than three words, null or empty texts and rows without an id give
    nothing; repeated rows give no more than one; other columns are ignored; empty tables
    give no rows.
    """
    loss = 3 * (1 - similarity)
    items = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["id", "text"])
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    kept = {k: F.col("n_words") - (k - 1) - _lost(similarity, k) for k in DESTROYED}  # of an item's runs of k words, at least
    fit = F.coalesce(*(F.when(kept[k] >= 1, F.lit(k)) for k in (3, 2)), F.lit(1))
    own = stage(_seed_rows(items, [3, 2, 1], None).where((F.col("n_words") >= SEED_WORDS) & (F.col("seed_words") == fit)), "item-seeds")
    lengths = sorted(r[0] for r in own.select("seed_words").distinct().collect())  # of 3, 2, 1
    hits = stage(_seed_rows(rows, lengths, _filter(F.col("seed"), own)).select("id", "pos", "seed"), "hits")

    # the rarest seeds of each item, so many that ``need`` of them outlive every allowed edit
    chosen = lambda by_length: F.coalesce(*(F.when(F.col("seed_words") == k, by_length(k)) for k in DESTROYED))
    lost = chosen(lambda k: _lost(similarity, k))
    need = F.greatest(F.lit(1), F.ceil(chosen(kept.get) / 2))
    frequency = hits.groupBy("seed").agg(F.count("*").alias("n"))
    ranked = own.join(frequency, "seed").withColumn("k", F.row_number().over(W.partitionBy("id", "n_words").orderBy("n", "pos")))
    absent = own.join(frequency, "seed", "left_anti").groupBy("id", "n_words").agg(F.count("*").alias("absent"))
    rare = (ranked.join(absent, ["id", "n_words"], "left")
            .where(F.col("k") + F.coalesce("absent", F.lit(0)) <= lost + need)
            .select(F.col("id").alias("item"), "seed", need.alias("need"), F.ceil(F.col("n_words") * (1 + loss / 2)).cast("bigint").alias("reach")).distinct())
    rare = stage(rare, "rare-seeds")

    # regions of twice the longest alignment, each overlapping the next by half
    found = hits.join(rare, "seed").select("id", "item", "need", "reach", "pos", F.explode(F.array(F.lit(0), F.lit(1))).alias("back"))
    regions = (found.withColumn("region", F.floor(F.col("pos") / F.col("reach")) - F.col("back"))
               .groupBy("id", "item", "reach", "region").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need"))
    regions = stage(regions.select("id", "item", (F.col("region") * F.col("reach")).alias("low"), ((F.col("region") + 2) * F.col("reach") + SEED_WORDS).alias("high")), "regions")
    bits = _filter(F.xxhash64("id"), regions)

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in_filter(bits, batch.column("h").to_numpy()))).select(["id", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    # staged, as the pieces are: a task runs one Python worker at a time, not three
    texts = stage(rows.withColumn("h", F.xxhash64("id")).mapInArrow(may, f"id {kind}, text string"), "texts")
    per_doc = regions.groupBy("id").agg(F.collect_list(F.struct("item", "low", "high")).alias("regions"))  # bounded by the document's own words
    item_kind = items.schema["id"].dataType.simpleString()

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "text", SLICE):
                words = Words(part.column("text"))
                first = np.cumsum(words.counts) - words.counts
                ids, ranges = part.column("id").to_pylist(), part.column("regions").to_pylist()
                out = [(ids[k], r["item"], max(r["low"], 0), words.hashes[first[k] + max(r["low"], 0) : first[k] + min(r["high"], words.counts[k])].tobytes())
                       for k in range(part.num_rows) for r in ranges[k]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (part.schema.field("id").type, None, pa.int64(), pa.binary()))],
                                                     names=["id", "item", "low", "passage"])

    pieces = stage(texts.join(per_doc, "id").mapInArrow(passages, f"id {kind}, item {item_kind}, low bigint, passage binary"), "pieces")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column("text"))
            ends = np.cumsum(words.counts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([words.hashes[e - c : e].tobytes() for e, c in zip(ends, words.counts)], pa.binary())], names=["item", "words"])

    both = pieces.join(stage(items.mapInArrow(hashed, f"item {item_kind}, words binary"), "item-words"), "item")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                left = [np.frombuffer(x, np.uint64) for x in part.column("words").to_pylist()]
                right = [np.frombuffer(x, np.uint64) for x in part.column("passage").to_pylist()]
                size = np.array([len(x) for x in left])
                best, end = align(left, right)
                alike = 1 - (2 * size - best) / (3 * np.maximum(size, 1))
                good = np.flatnonzero((alike >= similarity - 1e-9) & (size >= SEED_WORDS))
                if not len(good):
                    continue
                ends = end[good]
                _, back = align([left[k][::-1] for k in good], [right[k][:e][::-1] for k, e in zip(good, ends)])
                taken = part.take(pa.array(good))
                low = taken.column("low").to_numpy()
                yield pa.RecordBatch.from_arrays([taken.column("id"), taken.column("item"), pa.array(alike[good]), pa.array(low + ends - back), pa.array(low + ends - 1)],
                                                 names=["id", "item", "similarity", "first_word", "last_word"])

    scored = both.select("id", "item", "low", "passage", "words").mapInArrow(score, f"id {kind}, item {item_kind}, similarity double, first_word bigint, last_word bigint")
    best = scored.groupBy("id", "item").agg(F.max(F.struct("similarity", -F.col("first_word"), -F.col("last_word"))).alias("b"))
    return best.select(F.col("id").alias(doc_id), F.col("item").alias(item_id), F.col("b.similarity").alias("similarity"),
                       (-F.col("b.col2")).alias("first_word"), (-F.col("b.col3")).alias("last_word"))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold a copy of a benchmark item. Rows without an id stay."""
    bad = leaks(docs, benchmark, similarity, text, doc_id).select(F.col(doc_id).alias("__id")).distinct()
    return docs.join(stage(bad, "leaks"), F.col(doc_id) == F.col("__id"), "left_anti")
