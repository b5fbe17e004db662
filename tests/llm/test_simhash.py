import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ridemill.llm import simhash
from ridemill.llm.components import components

WHITE = " \t\n\x0b\x0c\r"


def plain(text, shingle=3, seed=42):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in WHITE:
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d is not None, d or 0), p, least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def found(df):
    return sorted(((r.doc_id is not None, r.doc_id or 0), r.fp & (1 << 64) - 1, r.component_id) for r in df.collect())


TEXTS = [None, "", " \n ", "One", "one two", "one TWO three", "Één twee drie Ä", "a b c d " * 400, "x" * 50_000, "a b c d", "tab\tsep\x0bd\r\nx y"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert int(simhash.fingerprints_of(pa.array([text, "p q r s", text]), 3, 42)[2]) == plain(text)


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([12, 60, 400]))]
        for copy in range(6):
            near = list(text)
            for _ in range(copy // 2):
                near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((100 + 10 * base + copy, " ".join(near)))
    rows += [(None, "one two"), (3, "One"), (3, "One"), (None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, fp int, root string")
    assert found(simhash.near_duplicates(df)) == brute(rows)
    assert found(simhash.near_duplicates(df.limit(0))) == []


def test_links_connect_exactly_the_near_ones(spark):
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1]
    prints = set(seeds)
    for fp in seeds:
        for _ in range(30):
            prints.add(fp ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"))
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links.collect())
    roots = {r.a: r.root for r in components(links).collect()}
    own = [roots.get(p, p) for p in signed]
    rows = [(i, p) for i, p in enumerate(prints)]
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, p in rows:
        for j, q in rows[:i]:
            if (p ^ q).bit_count() <= 2:
                root[find(i)] = find(j)
    mine = {}
    assert all(mine.setdefault(find(i), o) == o for i, o in enumerate(own)) and len(set(mine.values())) == len(mine)


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (3, 2)], "a bigint, b bigint")
    assert {(r.a, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100)}
    assert components(edges.limit(0)).count() == 0


def test_keep_one(spark):
    rows = [(5, "a b c d e", "x"), (2, "a b c d e", "y"), (2, "a b c d e", "y"), (9, "other words in here", None), (None, "alone without id", "z"), (None, "a b c d e", "z")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, component_id string"))
    assert sorted(kept.collect(), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
