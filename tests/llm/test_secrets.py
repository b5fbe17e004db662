import hashlib
import random
import re

import pytest

from ridemill.llm import secret_scan


@pytest.fixture(scope="module")
def model(spark):
    return secret_scan.train(secret_scan.labelled_findings(spark))


def hexes(rng, n):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def cases(seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and thing ensch pour ción elle report sees value".split())
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 30)))
    real, other = [], []
    for i in range(60):
        secret = rng.choice([hexes(rng, 40), hexes(rng, 32), "AKIA" + hexes(rng, 16).upper(), "ghp_" + "".join(rng.choice("abcXYZ0189") for _ in range(36))])
        real.append((f'{prose()} {rng.choice(["token", "api_key", "password"])} = "{secret}" {prose()}', secret))
        other.append(f'{prose()} {rng.choice([str(rng.randrange(10**15, 10**16)), "commit " + hexes(rng, 40), "https://a.org/assets/images/report-" + str(rng.randrange(10**6)) + "/page", "sectionconfigcontent-2024"])} {prose()}')
    return real, other


def test_finds_secrets_and_leaves_the_rest(spark, model):
    real, other = cases()
    rows = [(i, t, 1.0) for i, (t, _) in enumerate(real)] + [(1000 + i, t, 1.0) for i, t in enumerate(other)]
    found = secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string, score double"), model).collect()
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r.doc_id][r.start : r.start + r.length] == r.secret and r.score >= 0.5 for r in found)
    caught = {(r.doc_id, r.secret) for r in found}
    assert len(caught & {(i, s) for i, (_, s) in enumerate(real)}) >= 57
    assert sum(r.doc_id >= 1000 for r in found) <= 2


def test_held_out_findings(spark, model):
    table = secret_scan.labelled_findings(spark, 9_000).subtract(secret_scan.labelled_findings(spark))
    scored = model.transform(secret_scan.VectorAssembler(inputCols=list(secret_scan.FEATURES), outputCol="features").transform(secret_scan.features(table)))
    right = scored.selectExpr("avg(CAST(prediction = label AS INT)) AS a", "count(*) AS n").first()
    assert right.n > 1500 and right.a > 0.97


def test_candidates_against_plain_regex(spark):
    rng = random.Random(1)
    texts = [None, "", "none here", "a1" * 9, "x " + "b2c3" * 5 + "== y " + "d4" * 10, "-----BEGIN RSA PRIVATE KEY-----\nabc", "é🙂 " + "e5" * 20 + "\n" + "f6" * 40_000,
             "-".join(["word"] * 9) + " " + "-".join(["w0rd"] * 9)]
    texts += [" ".join(rng.choice(["w", "k9" * rng.randint(5, 12), "q=" + "7z" * 10, "."]) for _ in range(20)) for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = sorted((r.doc_id, r.start, r.candidate, r.before, r.after) for r in secret_scan.candidates(df).collect())
    expected = []
    for i, t in enumerate(texts):
        spans = [m.span() for m in re.finditer(secret_scan.CANDIDATE, t or "")]
        for k, (a, b) in enumerate(spans):
            low = spans[k - 1][1] if k else 0
            high = spans[k + 1][0] if k + 1 < len(spans) else len(t)
            expected.append((i, a, t[a:b], t[max(low, a - secret_scan.BEFORE) : a], t[b : min(high, b + secret_scan.AFTER)]))
    assert found == sorted(expected)


def test_redaction(spark, model):
    key = hashlib.sha1(b"a").hexdigest()
    text = f'the thing token = "{key}" and again token = "{key}" end'
    rows = [(1, text, "x"), (1, text, "x"), (None, text, None), (2, None, "x"), (3, "", "x"), (4, "order 1234567890123456 x", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, secret string")
    out = secret_scan.redact(df, model, mark="[S]")
    assert out.columns == df.columns
    clean = 'the thing token = "[S]" and again token = "[S]" end'
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, clean, "x"), (1, clean, "x"), (None, clean, None), *rows[3:]], key=str)
    assert secret_scan.redact(df.limit(0), model).count() == 0


def test_no_python_on_the_main_path(spark, model):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = secret_scan.scan(df, model)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(Eval|Map|In)", plan)


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_query_against_planted_secrets(spark, scale):
    """Every announced 40-digit key of the given documents, and nothing else, at its place."""
    from ridemill.llm import catalog

    folder = f"/root/testdata/sf{scale}"
    planted = re.compile("(?:token = \"(?=[0-9a-f]{40}\")|TOKEN = \"(?=[0-9A-F]{40}\"))(.{40})")
    expected = []
    for doc in catalog.read(spark, folder, "documents").collect():
        for m in planted.finditer(doc["text"] or ""):
            expected.append((doc["doc_id"], m.start(1), 40, hashlib.sha256(m[1].encode()).hexdigest()))
    found = catalog.op7_secret_scan(spark, folder)
    assert found.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("secret_sha256", "string"), ("score", "double")]
    rows = found.collect()
    assert sorted(tuple(r)[:4] for r in rows) == sorted(expected) and all(0.5 <= r.score <= 1 for r in rows)
    assert expected or scale == "0.001"
