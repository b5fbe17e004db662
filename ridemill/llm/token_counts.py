"""Token counts by the whole-token shortcut.

Most pre-tokens of ordinary text are vocabulary strings of their own. Which of these encode
alone as exactly one token is proven once, against the library; such pre-tokens count one
each and only the others are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridemill.llm import pretokens, spans

SLICE = 4 << 20  # bytes of text that are worked on at once


@cache
def whole_tokens(path: str) -> pa.Array:
    """The vocabulary strings that are one pre-token and that the library encodes as their own id.

    Bounded by the vocabulary. Empty for tokenizers whose pre-tokens ``pretokens.split`` does
    not know.
    """
    own = pretokens.encoder(path)
    if not own.known:
        return pa.array([], pa.binary())
    back = {sign: byte for byte, sign in pretokens.BYTE_SIGNS.items()}
    strings, numbers = [], []
    for sign_text, number in own.tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(back[s] for s in sign_text).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        strings.append(text)
        numbers.append(number)
    single = own._single([s.encode() for s in strings])
    ids = [e.ids for e in own.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
    return pa.array([s.encode() for s, n, one, i in zip(strings, numbers, single, ids) if one and i == [n]], pa.binary())


@cache
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_texts(texts: pa.Array, path: str, whole: pa.Array) -> np.ndarray:
    """Tokens of each text; null counts as empty."""
    if path.endswith(".model"):
        return np.array([len(ids) for ids in _pieces(path).encode([t or "" for t in texts.to_pylist()], num_threads=1)], np.int64)
    own = pretokens.encoder(path)
    per_text, distinct, which = own.pieces(texts)
    count = np.ones(len(distinct), np.int64)
    rest = pc.invert(pc.is_in(distinct, value_set=whole))
    count[rest.to_numpy(zero_copy_only=False)] = own.look_up(distinct.filter(rest))[0]
    ends = np.concatenate([[0], np.cumsum(count[which])])
    return np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, n_bytes, n_tokens and over_limit for each row of ``docs``.

    ``path`` is a ``.json`` file of the tokenizers library or a ``.model`` file of
    sentencepiece. No begin, end or other special tokens are added; special strings inside
    texts follow the library's default. Null and empty texts have 0 bytes and 0 tokens,
    repeated rows and null keys are kept as they are, other columns are left out. One pass,
    no shuffle; whole texts, a few MB of them at a time.
    """
    whole = whole_tokens(path) if path.endswith(".json") else pa.array([], pa.binary())
    rows = docs.select(*keys, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "__text", SLICE):
                texts = part.column("__text")
                tokens = count_texts(texts, path, whole)
                n_bytes = np.diff(spans.flat(texts)[1])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keys), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)],
                    names=[*keys, "n_bytes", "n_tokens", "over_limit"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, n_bytes bigint, n_tokens bigint, over_limit boolean")
