"""Language ID by string kernels.

A text is the set of its letter n-grams of one to three characters (runs of anything but
letters count as one boundary). The kernel of two texts is the number of n-grams that both
have, over the geometric mean of their own numbers. Nystroem features on landmark texts turn
it into a finite space, where one ridge regression per language is solved in closed form.
The composed map from n-gram presence to scores is linear, so a batch of texts is scored by
one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridemill.llm import spans

SYMBOLS = 128
GRAMS = SYMBOLS**3 + SYMBOLS**2 + SYMBOLS  # codes of trigrams, then bigrams, then single letters
SLICE = 1 << 17  # bytes of text that are scored at once
CELLS = 1 << 20  # entries of a presence matrix, about
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    grams: np.ndarray  # codes that the landmarks have, ascending
    weights: np.ndarray  # one row per gram, one column per language


@cache
def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 for all but letters, a to z and the Latin-1 letters their own, others by remainder."""
    table = np.zeros(0x110000, np.int32)
    for point in np.flatnonzero(spans.letters()).tolist():
        low = ord(chr(point).lower()[0])
        table[point] = low - 96 if 97 <= low <= 122 else low - 0xDF + 27 if 0xDF <= low <= 0xFF else 60 + low % (SYMBOLS - 60)
    return table


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram codes of all texts with their row, repeats included, and whether each text has a letter."""
    data, offsets = spans.flat(texts)
    points, at = spans.code_points(data)
    symbol = _symbols()[points]
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, offsets)))
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] > 0) | (symbol[:-1] > 0) | (row[1:] != row[:-1])
    symbol, row = symbol[keep], row[keep]
    lettered = np.zeros(len(texts), bool)
    lettered[row[symbol > 0]] = True
    one = symbol > 0
    same2 = row[1:] == row[:-1]
    pair = symbol[:-1] * SYMBOLS + symbol[1:]
    same3 = same2[1:] & same2[:-1]
    codes = np.concatenate([(pair[:-1] * SYMBOLS + symbol[2:])[same3], SYMBOLS**3 + pair[same2], SYMBOLS**3 + SYMBOLS**2 + symbol[one]])
    rows = np.concatenate([row[2:][same3], row[1:][same2], row[one]])
    return codes, rows, lettered


def _presence(codes: np.ndarray, rows: np.ndarray, n_rows: int, place: np.ndarray, width: int) -> np.ndarray:
    column = place[codes]
    known = column >= 0
    out = np.zeros((n_rows, width), np.float32)
    out[rows[known], column[known]] = 1
    return out


def _places(grams_: np.ndarray) -> np.ndarray:
    place = np.full(GRAMS, -1, np.int32)
    place[grams_] = np.arange(len(grams_), dtype=np.int32)
    return place


def train(docs: DataFrame, per_language: int = 300, landmarks: int = 64, ridge: float = 1e-2, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Fit on a bounded sample: ``per_language`` labelled texts of each language, those with the lowest hash of ``doc_id``.

    ``landmarks`` of them per language span the Nystroem features. Rows without text,
    language or id, or with a text without letters, teach nothing; of rows that repeat an id
    and language one teaches. Only the codes of the sampled texts' n-grams come to the driver.
    """
    place = F.pmod(F.xxhash64(doc_id), F.lit(1 << 32)) / F.lit(float(1 << 32))  # of a row in the sampling order, 0 to 1
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull()).withColumn("__h", place)
    totals = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}  # one row per language
    if not totals:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    by_lang = lambda values: F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col(lang)]
    # about twice the wanted rows of each language, so that ranking them is little work at any size
    some = known.select(lang, "__h").where(F.col("__h") < by_lang({k: 2.0 * per_language / n for k, n in totals.items()})).distinct()
    ranked = some.withColumn("__n", F.row_number().over(W.partitionBy(lang).orderBy("__h"))).where(F.col("__n") <= per_language)
    edges = {r[0]: r[1] for r in ranked.groupBy(lang).agg(F.max("__h")).collect()}
    if not edges:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    rows = known.where(F.col("__h") <= by_lang(edges)).dropDuplicates([lang, "__h"]).select(F.col(lang).alias("lang"), F.col("__h").alias("h"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "text", SLICE):
                codes, row, _ = grams(part.column("text"))
                both = np.unique(row.astype(np.int64) * GRAMS + codes)
                bounds = np.searchsorted(both, np.arange(part.num_rows + 1) * GRAMS)
                found = [(both[a:b] % GRAMS).astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array(found, pa.binary())], names=["lang", "h", "grams"])

    sample = sorted((r["lang"], r["h"], bytes(r["grams"])) for r in rows.mapInArrow(run, "lang string, h double, grams binary").collect() if len(r["grams"]))
    return fit([(lang_, np.frombuffer(g, "<u4").astype(np.int64)) for lang_, _, g in sample], landmarks, ridge)


def fit(sample: list[tuple[str, np.ndarray]], landmarks: int, ridge: float) -> Model:
    """Nystroem features and one-versus-rest kernel ridge regression on n-gram sets."""
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    chosen = [i for lang in languages for i in [k for k, (x, _) in enumerate(sample) if x == lang][:landmarks]]
    vocabulary = np.unique(np.concatenate([sample[i][1] for i in chosen]))
    place = _places(vocabulary)
    rows = np.repeat(np.arange(len(sample)), [len(g) for _, g in sample])
    features = _presence(np.concatenate([g for _, g in sample]), rows, len(sample), place, len(vocabulary)).astype(np.float64)
    features /= np.sqrt(np.maximum(features.sum(1, keepdims=True), 1))
    marks = features[chosen]
    values, vectors = np.linalg.eigh(marks @ marks.T)
    solid = values > 1e-6 * values.max()
    root = vectors[:, solid] / np.sqrt(values[solid])  # landmark kernel to the power -1/2
    phi = features @ marks.T @ root
    target = (np.array([lang for lang, _ in sample])[:, None] == np.array(languages)).astype(float)
    solved = np.linalg.solve(phi.T @ phi + ridge * len(sample) / 100 * np.eye(phi.shape[1]), phi.T @ target)
    return Model(languages, vocabulary, (marks.T @ (root @ solved)).astype(np.float32))


def predict(docs: DataFrame, model: Model, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, lang_pred and score (0 to 1) for every row, from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0, as is every text under a
    model that has seen no language. Equal scores go to the first language in alphabetic
    order. Repeated rows and null keys are kept; other columns are left out. No shuffle. A
    text that is among the keys is sent to the workers once.
    """
    own = text if text in keys else "__text"
    rows = docs.select(*keys) if text in keys else docs.select(*keys, F.col(text).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans.release()
        place = _places(model.grams)
        width = len(model.grams)
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for whole in spans.slices(batch, own, SLICE):
                step = max(1, CELLS // max(width, 1))
                for start in range(0, whole.num_rows, step):
                    part = whole.slice(start, step)
                    codes, row, lettered = grams(part.column(own))
                    best, score = np.full(part.num_rows, len(model.languages)), np.zeros(part.num_rows)
                    if model.languages:
                        present = _presence(codes, row, part.num_rows, place, width)
                        size = np.sqrt(np.maximum(present.sum(1), 1))
                        scores = present @ model.weights / size[:, None]
                        best = np.where(lettered, scores.argmax(1), best)
                        score = np.where(lettered, np.clip(scores.max(1), 0, 1), 0)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(k) for k in keys), pa.array(names[best], pa.string()), pa.array(score.astype(float))], names=[*keys, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
