"""Ranked lexical search over FP-trees of documents.

A document is restricted to the terms that the items ask for, most frequent term first, so
documents with the same frequent terms share a path from the root of a trie. Every subtree
knows the largest tf of each term and the least m beneath it; since a score grows with tf and
falls with m, both together bound what any document of the subtree can reach. The trie is
walked depth first, and an item leaves a subtree whose bound is below its present k-th score.

Scores are 64-bit integers. Tries are built of bounded runs of documents inside a task and an
item's best documents are carried from one to the next; a task returns k rows per item at most.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridemill.llm import spans
from ridemill.session import stage

SLICE = 4 << 20  # bytes of text that are cut into terms at once
ITEM_BYTES = 4 << 20  # bytes of item texts in a block of items, about (one item may exceed it)
TREE_DOCS, TREE_TERMS = 4096, 1 << 20  # documents, and their distinct terms, in a trie
LEAF = 32  # documents that are scored together
RESULT = "item_id bigint, rank int, doc_id bigint, score bigint"
#: Bytes of a term: digits, letters, and everything beyond ASCII.
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Items(NamedTuple):
    """A block of items; an entry is one term of one item with its number of occurrences."""

    ids: list[int | None]
    vocabulary: pa.Array
    item: np.ndarray  # of each entry, ascending
    term: np.ndarray  # its place in the vocabulary
    count: np.ndarray


class Found(NamedTuple):
    """The best documents of each item so far; free places have score 0."""

    score: np.ndarray
    missing: np.ndarray  # whether the doc_id is null
    doc_id: np.ndarray

    @classmethod
    def none(cls, items: int, k: int) -> Found:
        return cls(np.zeros((items, k), np.int64), np.ones((items, k), bool), np.full((items, k), np.iinfo(np.int64).max))


def item_block(rows: list[tuple[int | None, str]]) -> Items:
    """Items of the given (item_id, text) rows, one row an item."""
    counts = {item_id: Counter(re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode().lower())) for item_id, text in rows}
    ids = [i for i, terms in counts.items() if terms]
    vocabulary = sorted({t for i in ids for t in counts[i]})
    place = {t: n for n, t in enumerate(vocabulary)}
    entries = [(n, place[t], c) for n, i in enumerate(ids) for t, c in counts[i].items()]
    item, term, count = (np.array(x, np.int64) for x in zip(*entries)) if entries else (np.zeros(0, np.int64),) * 3
    return Items(ids, pa.array(vocabulary, pa.binary()), item, term, count)


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Text number and lower-cased bytes of every term."""
    inside = IN_TERM[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    start[cut] = inside[cut]
    starts = np.flatnonzero(start)
    kept = LOWER[data[inside]]
    place = np.cumsum(inside) - inside  # of a byte among the kept ones
    return np.searchsorted(offsets, starts, side="right") - 1, spans.strings(kept, np.append(place[starts], len(kept)), pa.binary())


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in runs of about ``SLICE`` bytes, cut where no term is cut."""
    start = 0
    while start < len(data):
        end = min(start + SLICE, len(data))
        while end < len(data) and IN_TERM[data[end]]:
            end += 1
        yield data[start:end]
        start = end


def term_counts(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms per text with repeats; and of the terms in the vocabulary: text, place in it, occurrences."""
    data, offsets = spans.flat(texts)
    if len(texts) == 1:
        pieces = [_terms(part, np.array([0, len(part)])) for part in _parts(data)]
    else:
        pieces = [_terms(data, offsets)]
    n, width = np.zeros(len(texts), np.int64), max(len(vocabulary), 1)
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for text, words in pieces:
        n += np.bincount(text, minlength=len(texts))
        known = pc.index_in(words, value_set=vocabulary)
        at = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
        key, count = np.unique(text[at] * width + known.drop_null().to_numpy(), return_counts=True)
        keys.append(key)
        counts.append(count)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.zeros(len(key), np.int64)
    np.add.at(count, back, np.concatenate(counts))
    return n, key // width, key % width, count


def _ragged(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return spans.strings(np.ascontiguousarray(values, "<i4").view(np.uint8), 4 * bounds, pa.large_binary()).cast(pa.binary())


def vectors(docs: DataFrame, items: Items, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: all terms' number, and those of the vocabulary as 32-bit integers."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    vocabulary = items.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "__text", SLICE):
                n, row, term, count = term_counts(part.column("__text"), vocabulary)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), _ragged(term, bounds), _ragged(count, bounds)], names=["doc_id", "n", "terms", "tfs"])

    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms binary, tfs binary").where("n > 0")


def document_frequencies(rows: DataFrame, width: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary; partial counts per task, one row per term to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(spans.flat(batch.column("terms"))[0].view("<i4"), minlength=width)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["term", "df"])

    df = np.zeros(width, np.int64)
    for term, count in rows.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df")).collect():
        df[term] = count
    return df


def part_scores(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score; 0 where tf is 0."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Tree:
    """Documents in the order of a trie over their term ranks, with the length of the path that neighbours share."""

    def __init__(self, doc_id: np.ndarray, missing: np.ndarray, m: np.ndarray, bounds: np.ndarray, rank: np.ndarray, tf: np.ndarray):
        raw = rank.astype(">u4").tobytes()
        paths = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1], bounds[1:])]
        order = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        sizes = np.diff(bounds)[order]
        take = spans.places(bounds[:-1][order], sizes)
        self.doc_id, self.missing, self.m = doc_id[order], missing[order], m[order]
        self.rank, self.tf = rank[take], tf[take]
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.shared = np.array([self._shared(i) for i in range(len(order) - 1)], np.int64)

    def _shared(self, i: int) -> int:
        a, b, c = self.bounds[i : i + 3]
        both = min(b - a, c - b)
        differ = np.flatnonzero(self.rank[a : a + both] != self.rank[b : b + both])
        return int(differ[0]) if len(differ) else both

    def children(self, start: int, end: int) -> list[tuple[int, int]]:
        """Subtrees where the common path of the documents from ``start`` to ``end`` parts; small neighbours in one."""
        inner = self.shared[start : end - 1]
        edges = [start, *(start + 1 + np.flatnonzero(inner == inner.min())).tolist(), end]
        out = [(edges[0], edges[1])]
        for a, b in zip(edges[1:], edges[2:]):
            if b - out[-1][0] <= LEAF:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def bound(self, start: int, end: int, weight: np.ndarray) -> np.ndarray:
        """The most that each term can add to the score of a document of the subtree."""
        a, b = self.bounds[start], self.bounds[end]
        most = np.zeros(len(weight), np.int64)
        np.maximum.at(most, self.rank[a:b], self.tf[a:b])
        return part_scores(weight, most, self.m[start:end].min())


class Search:
    """Branch and bound of one block of items over tries, ``k`` documents an item."""

    def __init__(self, items: Items, rank_of: np.ndarray, weight: np.ndarray, k: int):
        self.n, self.k, self.weight = len(items.ids), k, weight
        self.item, self.rank, self.count = items.item, rank_of[items.term], items.count
        self.first = np.searchsorted(self.item, np.arange(self.n))  # every item has a term
        self.found = Found.none(self.n, k)

    def run(self, tree: Tree) -> None:
        waiting = [(0, len(tree.doc_id), self._bounds(tree, 0, len(tree.doc_id)))]
        while waiting:
            start, end, bounds = waiting.pop()
            alive = bounds >= np.maximum(self.found.score[:, -1], 1)  # an equal score may have the smaller id
            if not alive.any():
                continue
            if end - start <= LEAF:
                self._leaf(tree, start, end, alive)
            else:
                waiting += [(a, b, np.minimum(bounds, self._bounds(tree, a, b))) for a, b in reversed(tree.children(start, end))]

    def _bounds(self, tree: Tree, start: int, end: int) -> np.ndarray:
        return np.add.reduceat(self.count * tree.bound(start, end, self.weight)[self.rank], self.first)

    def _leaf(self, tree: Tree, start: int, end: int, alive: np.ndarray) -> None:
        """Exact scores of the documents for the items that are alive."""
        a, b = tree.bounds[start], tree.bounds[end]
        rank, place = np.unique(tree.rank[a:b], return_inverse=True)
        doc = np.repeat(np.arange(end - start), np.diff(tree.bounds[start : end + 1]))
        parts = np.zeros((len(rank), end - start), np.int64)
        parts[place, doc] = part_scores(self.weight[tree.rank[a:b]], tree.tf[a:b], tree.m[start:end][doc])
        local = np.full(len(self.weight), -1)
        local[rank] = np.arange(len(rank))
        use = np.flatnonzero(alive[self.item] & (local[self.rank] >= 0))
        if not len(use):
            return
        item = self.item[use]
        first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        scores = np.add.reduceat(self.count[use][:, None] * parts[local[self.rank[use]]], first, axis=0)
        for i, score in zip(item[first], scores):
            keep = np.flatnonzero(score >= max(self.found.score[i, -1], 1))
            if len(keep):
                self._add(i, score[keep], tree.missing[start:end][keep], tree.doc_id[start:end][keep])

    def _add(self, i: int, *more: np.ndarray) -> None:
        score, missing, doc_id = (np.concatenate([old[i], new]) for old, new in zip(self.found, more))
        best = np.lexsort((doc_id, missing, -score))[: self.k]
        for old, new in zip(self.found, (score, missing, doc_id)):
            old[i] = new[best]


def _best(rows: DataFrame, items: Items, width: int, rank_of: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): each task's best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, rank_of, weight, k)
        for batch in batches:
            ends = spans.flat(batch.column("terms"))[1] // 4
            start = 0
            while start < batch.num_rows:
                end = min(start + TREE_DOCS, int(np.searchsorted(ends, ends[start] + TREE_TERMS, side="right")) - 1, batch.num_rows)
                end = max(end, start + 1)
                search.run(_tree(batch.slice(start, end - start)))
                start = end
        item, place = np.nonzero(search.found.score)
        score, missing, doc_id = (x[item, place] for x in search.found)
        ids = pa.array([items.ids[i] for i in item.tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array(doc_id, mask=missing), pa.array(score)], names=["item_id", "doc_id", "score"])

    def _tree(part: pa.RecordBatch) -> Tree:
        terms, ends = spans.flat(part.column("terms"))
        rank, tf, bounds = rank_of[terms.view("<i4")], spans.flat(part.column("tfs"))[0].view("<i4").astype(np.int64), ends // 4
        doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))
        order = np.argsort(doc * width + rank)
        doc_id = part.column("doc_id")
        missing = doc_id.is_null().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(doc_id, np.iinfo(np.int64).max).to_numpy()
        m = 75 + (25 * part.column("n").to_numpy() * n_docs) // n_terms
        return Tree(ids, missing, m, bounds, rank[order], tf[order])

    return rows.where(F.octet_length("terms") > 0).mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item, scores above 0 only.

    Equal scores go by ascending doc_id, a null doc_id last; repeated document rows each count
    and rank. Null texts and texts without a term take no part, on either side. Of several
    texts under one item_id the first in byte order is the item, and a null item_id is an id
    like others. Empty tables give no rows; other columns are not read. Long texts are cut into
    terms a few MB at a time.

    Items come to the driver in blocks of about ``ITEM_BYTES`` of their texts, and each block
    is one pass over the documents, so neither side's size is bounded by a worker's memory.
    """
    spark = docs.sparkSession
    asked = stage(items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).groupBy("item_id").agg(F.min("text").alias("text")), "items")
    n_bytes = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-n_bytes // ITEM_BYTES))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    out = None
    for number in range(n_blocks):
        items_ = item_block([tuple(r) for r in asked.where(block == number).collect()])
        if not items_.ids:
            continue
        width = len(items_.vocabulary)
        rows = stage(vectors(docs, items_, doc_id, text), "term-vectors")
        n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_frequencies(rows, width)
        rank_of = np.empty(width, np.int64)
        rank_of[np.argsort(-df, kind="stable")] = np.arange(width)
        weight = np.empty(width, np.int64)
        weight[rank_of] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df]
        found = _best(rows, items_, width, rank_of, weight, n_docs, n_terms, k)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], RESULT)
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
