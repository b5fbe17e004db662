import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ridemill.llm import packing, repair, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [(3, "Hello the the the world. " * 300), (1, None), (2, ""), (7, "a<|endoftext|>b"), (7, "a<|endoftext|>b"), (5, "x" * 9_000), (None, "no id"), (0, "don't 'll 12½ …\n\n  "), (9, "the cat sat " * 4_000), (4, "漢字 🙂 ok")]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(numbers):
    return zlib.crc32(np.array(numbers, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, 0, 1) for t in TEXTS], "doc_id bigint, text string, part int, n_tokens int").repartition(3)


@pytest.mark.parametrize("sizes", [[5000, 0, 1, 3000], [1], [], [0, 0], [40_000]])
@pytest.mark.parametrize("kinds", [3, 50, 5000])
def test_grammar_round_trip(sizes, kinds):
    rng = np.random.default_rng(kinds)
    sizes = np.array(sizes, np.int64)
    given = np.minimum(rng.geometric(3 / kinds, int(sizes.sum())), kinds).astype(np.uint32)
    base = kinds + 1
    symbols, per_doc, rules = repair.compress(given, sizes, base)
    assert repair.expand(symbols, rules, base).tolist() == given.tolist()
    assert per_doc.sum() == len(symbols) and len(symbols) <= len(given)
    lengths = repair.expansions(rules, base)[2]
    ends = np.cumsum(per_doc)
    for k, (end, size) in enumerate(zip(ends, sizes)):
        own = symbols[end - per_doc[k] : end]
        assert len(repair.expand(own, rules, base)) == size  # no rule crosses a document's end
        for spot in rng.integers(0, size, 5) if size else []:
            assert repair.token_at(own, rules, lengths, base, int(spot)) == given[int(sizes[:k].sum()) + spot]
    if kinds == 3 and len(given) > 1000:
        assert len(rules) and len(symbols) < 0.5 * len(given)


@pytest.mark.parametrize("seed", range(6))
def test_no_frequent_pair_is_left(seed):
    rng = np.random.default_rng(seed)
    passages = [rng.integers(0, 300, rng.integers(2, 400)) for _ in range(4)]
    parts = [np.tile(rng.integers(0, 3, 2), 40), np.zeros(333, np.int64)]
    parts += [p if rng.random() < 0.5 else np.concatenate([p, rng.integers(0, 300, 9)]) for p in (passages[k] for k in rng.integers(0, 4, 200))]
    sizes, given = np.array([len(p) for p in parts]), np.concatenate(parts).astype(np.uint32)
    symbols, per_doc, rules = repair.compress(given, sizes, 300)
    assert repair.expand(symbols, rules, 300).tolist() == given.tolist()
    pairs, ends = Counter(), np.cumsum(per_doc)
    for end, size in zip(ends, per_doc):
        pairs.update(zip(symbols[end - size : end - 1].tolist(), symbols[end - size + 1 : end].tolist()))
    assert max(pairs.values(), default=0) < repair.LEAST_COUNT
    assert repair.expansions(rules, 300)[2].max() >= min(max(map(len, passages)), 200)  # whole copies become one symbol, not just 64 ids
    assert len({tuple(r) for r in rules.tolist()}) == len(rules)


def test_rule_budget():
    given = np.tile(np.arange(40, dtype=np.uint32), 500)
    symbols, _, rules = repair.compress(given, np.array([len(given)]), 40, most_rules=7)
    assert len(rules) <= 7 and repair.expand(symbols, rules, 40).tolist() == given.tolist()


def test_files(spark, docs, tmp_path):
    out = str(tmp_path / "ids")
    repair.write_files(docs, out, PATH, end_id=2)
    back = repair.read_files(spark, out).collect()
    order = sorted(TEXTS, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or ""))
    expected, start = [], 0
    for doc, text in order:
        numbers = [*ids(text), 2]
        expected.append((doc, start, len(numbers), np.array(numbers, "<u4").tobytes()))
        start += len(numbers)
    assert sorted(map(tuple, back), key=lambda r: r[1]) == [(d, s, n, bytearray(b)) for d, s, n, b in expected]
    digest = repair.read_files(spark, out, repair.crc32, "ids_crc32", "bigint").collect()
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in digest} == {(d, s, n, zlib.crc32(b)) for d, s, n, b in expected}
    stored = spark.read.parquet(out).agg({"width": "max", "base": "max"}).first()
    assert tuple(stored) in ((2, 50257), (50257, 2))


def test_many_shards(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "SLICE", 2_000)
    out = str(tmp_path / "many")
    repair.write_files(docs.repartition(1), out, PATH)
    assert [r.n_tokens for r in repair.read_files(spark, out).orderBy("start").collect()] == [len(ids(t)) + 1 for _, t in sorted(TEXTS, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or ""))]


def test_empty_file_set(spark, docs, tmp_path):
    out = str(tmp_path / "none")
    repair.write_files(docs.limit(0), out, PATH)
    assert repair.read_files(spark, out).count() == 0


def test_packing(docs):
    rows = packing.pack(docs, PATH, capacity=100, end_id=2).collect()
    expected = []
    for doc, text in TEXTS:
        numbers = [*ids(text), 2]
        first = len(numbers) - (-(-len(numbers) // 100) - 1) * 100
        cuts = [0, *range(first, len(numbers) + 1, 100)]
        expected += [(doc, k, a, b - a, crc(numbers[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: (r[0] is not None, r)
    assert sorted([tuple(r)[:5] for r in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1:])) == sorted(expected, key=lambda r: (r[0] is not None, r[0] or 0, r[1:])) and key
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 100
    assert len(sequences) <= -(-sum(r.length for r in rows) // 100) + 2
    assert packing.pack(docs.limit(0), PATH).count() == 0


def plain_sum_of_squares(lengths, capacity):
    bins = []
    for n in lengths:
        best = None
        for b in {x: i for i, x in reversed(list(enumerate(bins))) if x >= n}.values():
            gaps = np.bincount([g for i, g in enumerate(bins) if i != b and g] + ([bins[b] - n] if bins[b] > n else []), minlength=1)
            cost = (int((gaps.astype(int) ** 2).sum()), bins[b])
            best = min(best or (cost, b), (cost, b))
        if best:
            bins[best[1]] -= n
        else:
            bins.append(capacity - n)
    return bins


@pytest.mark.parametrize("seed", range(4))
def test_rule_against_plain_version(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.integers(1, 21, 70))[::-1]
    bins, _ = packing.sum_of_squares(lengths, 20)
    gaps = 20 - np.bincount(bins, weights=lengths).astype(int)
    assert sorted(gaps) == sorted(plain_sum_of_squares(lengths.tolist(), 20))


def test_close_to_the_least_number_of_sequences():
    lengths = np.sort(np.random.default_rng(0).integers(1, 1025, 20_000))[::-1]
    bins, _ = packing.sum_of_squares(lengths, 1024)
    assert bins.max() + 1 < 1.01 * -(-lengths.sum() // 1024)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(docs, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rows = token_counts.count_tokens(docs, path, limit=100).collect()
    expected = [(d, len((t or "").encode()), count(t or ""), count(t or "") > 100) for d, t in TEXTS]
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_whole_tokens_are_proven():
    whole = [w.as_py() for w in token_counts.whole_tokens(PATH)]
    assert len(whole) > 40_000
    assert all(len(LIBRARY.encode(w.decode(), add_special_tokens=False).ids) == 1 for w in whole[::97])
