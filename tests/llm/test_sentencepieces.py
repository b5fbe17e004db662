"""SentencePiece codec against the library, with and without a compiled character map."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from ridemill.llm import sentencepieces
from ridemill.llm.catalog import PIECES

RAW = open(PIECES, "rb").read()


def with_normaliser(rule: str) -> bytes:
    """The same pieces behind one of the library's own character maps."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
    out = b"".join(RAW[a:b] for n, _, a, b in sentencepieces._fields(RAW) if n != sentencepieces.NORMALIZER)
    size, length = len(spec), b""
    while size >= 128:
        length += bytes([size & 127 | 128])
        size >>= 7
    return out + bytes([sentencepieces.NORMALIZER << 3 | 2]) + length + bytes([size]) + spec


def texts(n: int) -> list[str | None]:
    rng = random.Random(3)
    signs = [*"abcdeéñ ß  \t\n▁▁1２ｱｶﾞ한국어ﬁé①㌔ 　​̈\x00👩‍👧", "the ", "ing", "<0x0A>", "</s>", "<s>", "<unk>", "  ", "ﷺ", "가", "ẹ́"]
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return ["", None, " ", "   ", "a", "  a  b  ", "▁", "▁▁a▁b", *made]


@pytest.mark.parametrize("rule", [None, "nmt_nfkc", "nfkc_cf"])
def test_ids_spans_and_decoding_are_the_librarys(rule):
    proto = with_normaliser(rule) if rule else RAW
    own, library = sentencepieces.Model(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    column = texts(800)
    (ids, starts, ends), per_text, decoded = sentencepieces.encode_batch(own, pa.array(column, pa.string()))
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    for i, text in enumerate(t or "" for t in column):
        a, b = bounds[i], bounds[i + 1]
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids[a:b].tolist() == want and decoded[i].as_py() == library.decode(want)
        spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(starts[a + 1 : b - 1].tolist(), ends[a + 1 : b - 1].tolist())) == spans
        assert (ends[b - 1], starts[a]) == (len(text.encode()), 0)


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    text = pa.array([" ".join(t or "" for t in texts(400))])
    whole = sentencepieces.encode_batch(sentencepieces.model(PIECES), text)
    monkeypatch.setattr(sentencepieces, "SLICE", 100)
    cut = sentencepieces.encode_batch(sentencepieces.model(PIECES), text)
    assert len(list(sentencepieces._parts(sentencepieces.model(PIECES), np.frombuffer(text[0].as_buffer(), np.uint8)))) > 10
    assert all(np.array_equal(a, b) for a, b in zip(whole[0], cut[0])) and whole[2] == cut[2]


def test_decoding_of_any_ids():
    own = sentencepieces.model(PIECES)
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(0, 12, 6)
        ids = rng.choice([0, 1, 2, *range(3, 259), 29871, 259, 260, *rng.integers(259, 32000, 200).tolist()], int(sizes.sum()))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        assert own.decode(ids, sizes).to_pylist() == [own.library.decode(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]


def test_rows_of_a_table(spark):
    rows = [(1, "Hola  señor", 5), (1, "Hola  señor", 5), (None, None, 6), (2, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    found = sentencepieces.encode(docs, PIECES).orderBy("doc_id").collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in found] == [
        (None, [1, 2], ""), *[(1, library.encode("Hola  señor", add_bos=True, add_eos=True), "Hola  señor")] * 2, (2, [1, 2], "")]
    assert np.frombuffer(found[1]["ends"], "<u4")[-1] == len("Hola  señor".encode())
    assert sentencepieces.encode(docs.limit(0), PIECES).collect() == []


def test_query(spark):
    from ridemill.llm import catalog

    folder = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {r["doc_id"]: r for r in catalog.op11_sentencepieces(spark, folder).collect()}
    docs = catalog.read(spark, folder, "documents").collect()
    assert len(found) == len(docs)
    for doc in docs:
        ids = library.encode(doc["text"] or "", add_bos=True, add_eos=True)
        digest = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), library.decode(ids).encode())]
        got = found[doc["doc_id"]]
        assert [got["n_tokens"], got["ids_sha256"], got["decoded_sha256"]] == [len(ids), *digest]


def test_other_models_are_refused():
    fallback = sentencepieces.TRAINER
    stripped = b"".join(RAW[a:b] for n, _, a, b in sentencepieces._fields(RAW) if n != fallback)
    with pytest.raises(ValueError, match="byte fallback"):
        sentencepieces.Model(stripped)
