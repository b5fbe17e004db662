"""Secret scans: wide candidates, then a random forest that takes out false positives.

All of it is DataFrame expressions and Spark's own forest. Candidates are unbroken runs of
key characters with a digit, and private-key headers. The features are length, character
classes and transitions, coverage by dictionary words, signs of a path or address, and the
neighbouring words.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A candidate: sixteen or more key characters, one of them a digit, or the first line of a private key.
CANDIDATE = (r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
             r"|(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]{0,200}[0-9])[A-Za-z0-9+/_\-]{16,}={0,2}")
BEFORE, AFTER = 64, 32  # characters of context
#: Words that announce a secret, and words that announce something else.
KEYWORDS = ("token", "secret", "password", "passwd", "pwd", "api[_-]?key", "access[_-]?key", "private[_-]?key", "auth", "authorization", "bearer", "credential", "credentials", "client[_-]?secret")
HARMLESS = ("commit", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "id", "isbn", "order", "card", "phone", "build", "version", "revision", "etag", "example")
DICTIONARY = ("example", "sample", "test", "placeholder", "changeme", "your", "token", "secret", "password", "key", "value", "name", "user", "index", "image", "file", "page", "data", "report", "article", "section",
              "chapter", "version", "release", "static", "assets", "content", "upload", "download", "docs", "library", "module", "class", "function", "config", "default", "public", "private", "home", "the", "and", "for", "with", "from")
FEATURES = ("length", "digits", "lower", "upper", "signs", "digit_letter", "letter_digit", "lower_upper", "vowel_consonant", "distinct", "repeated", "hex", "numeric", "uuid", "prefix", "key_block", "dictionary",
            "slashes", "address", "extension", "assigned", "keyword", "harmless", "quoted", "word_before")
TRAINING_ROWS = 6_000  # labelled findings that a forest is fitted on, at most
THRESHOLD = 0.5


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, candidate, before, after) of every candidate; ``start`` counts characters from 0.

    Null and empty texts have none. The text itself is left behind: only the context of each
    candidate goes on.
    """
    body = F.col("__text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")).where(body.rlike(CANDIDATE))
    rows = rows.select("doc_id", F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)).alias("found"),
                       F.transform(F.split(body, CANDIDATE, -1), lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(BEFORE)).alias("tail"), F.left(p, F.lit(AFTER)).alias("head"))).alias("rest"))
    rows = rows.select("doc_id", "rest", F.posexplode("found").alias("k", "candidate"), "found")
    gone = F.aggregate(F.slice("rest", 1, F.col("k") + 1), F.lit(0), lambda n, p: n + p["n"]) + F.aggregate(F.slice("found", 1, F.col("k")), F.lit(0), lambda n, c: n + F.length(c))
    return rows.select("doc_id", gone.cast("bigint").alias("start"), "candidate", F.col("rest")[F.col("k")]["tail"].alias("before"), F.col("rest")[F.col("k") + 1]["head"].alias("after"))


def features(findings: DataFrame) -> DataFrame:
    """``findings`` (candidate, before, after, ...) with one double column per feature. Nulls count as empty."""
    c, before, after = (F.coalesce(F.col(x), F.lit("")) for x in ("candidate", "before", "after"))
    size = F.greatest(F.length(c), F.lit(1)).cast("double")
    words = "|".join(KEYWORDS)
    flag = lambda condition: condition.cast("double")
    return findings.withColumns({
        "length": F.least(F.length(c), F.lit(512)).cast("double"),
        "digits": _count(c, "[0-9]") / size, "lower": _count(c, "[a-z]") / size, "upper": _count(c, "[A-Z]") / size, "signs": _count(c, "[^A-Za-z0-9]") / size,
        "digit_letter": _count(c, "[0-9](?=[A-Za-z])") / size, "letter_digit": _count(c, "[A-Za-z](?=[0-9])") / size,
        "lower_upper": (_count(c, "[a-z](?=[A-Z])") + _count(c, "[A-Z](?=[a-z])")) / size, "vowel_consonant": _count(F.lower(c), "[aeiou](?=[b-df-hj-np-tv-z])") / size,
        "distinct": F.size(F.array_distinct(F.split(F.left(c, F.lit(64)), ""))) / F.least(size, F.lit(64.0)), "repeated": flag(c.rlike(r"(.)\1{4,}")),
        "hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "numeric": flag(c.rlike(r"^[0-9\-]+$")), "uuid": flag(c.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
        "prefix": flag(c.rlike("^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|sk-|xox[abp]-|AIza|eyJ|npm_|pypi-)")), "key_block": flag(c.startswith("-----BEGIN")),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(c), "|".join(DICTIONARY), "")) / size,
        "slashes": _count(c, "/") / size, "address": flag(before.rlike(r"(?i)(https?://|ftp://|file:|www\.|[./~])\S*$")), "extension": flag(after.rlike(r"^\.[A-Za-z]{2,5}\b")),
        "assigned": flag(before.rlike(f"(?i)(^|[^a-z])({words})[\"']?\\s*(:|=|=>|is)\\s*[\"']?$") | before.rlike("(?i)bearer\\s+$")), "keyword": flag(before.rlike(f"(?i)(^|[^a-z])({words})([^a-z]|$)")),
        "harmless": flag(before.rlike(f"(?i)(^|[^a-z])({'|'.join(HARMLESS)})[^a-z0-9]{{0,4}}$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")), "word_before": flag(before.rlike(r"[A-Za-z]{2,}[,.]?\s$")),
    })


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """Labelled findings for training where no reviewed ones are at hand: (candidate, before, after, label).

    They are made by rule from row numbers: keys of the usual kinds under a name that
    announces them, against hashes, numbers, identifiers, paths, joined words and
    placeholders in their usual surroundings. ``rows`` bounds them.
    """
    n = F.col("id")
    salt = lambda k: F.sha2(F.concat(F.lit(f"{k}-"), n.cast("string")), 256)
    pick = lambda k, *values: F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (F.pmod(F.xxhash64(n, F.lit(k)), F.lit(len(values))) + 1).cast("int"))
    mixed = lambda k: F.regexp_replace(F.base64(F.unhex(salt(k))), "[=+/]", "x")
    digits = lambda k, size: F.left(F.translate(salt(k), "abcdef", "012345"), F.lit(size))
    word = lambda k: pick(k, "the", "und", "pour", "los", "with", "ensch", "the thing", "ereinung", "value", "see", "in", "from", "nicht", "que")
    sign = lambda k: pick(k, ".", ",", "", "!!", " |", "***", "&&&", ";", "###")
    name = lambda k: pick(k, "token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "apikey", "passwd", "TOKEN", "PASSWORD", "Secret", "API_KEY")
    joint = lambda k: pick(k, " = \"", ": \"", "=\"", "='", " = '", "=", ": ", " = ")
    text = lambda k: F.concat(word(k), sign(k + "s"), F.lit(" "), word(k + "w"), F.lit(" "))
    secret = pick("kind", F.left(salt("a"), F.lit(40)), F.left(salt("b"), F.lit(32)), salt("c"), mixed("d"), F.left(mixed("e"), F.lit(24)), F.upper(F.left(salt("f"), F.lit(40))), F.left(mixed("g"), F.lit(20)))
    known = pick("known", F.concat(F.lit("AKIA"), F.upper(F.left(mixed("h"), F.lit(16)))), F.concat(F.lit("ghp_"), F.left(mixed("i"), F.lit(36))), F.concat(F.lit("sk_live_"), F.left(mixed("j"), F.lit(24))),
                 F.concat(F.lit("xoxb-"), digits("k", 12), F.lit("-"), F.left(mixed("k"), F.lit(24))), F.lit("-----BEGIN RSA PRIVATE KEY-----"))
    closing = F.regexp_extract("joint", "[\"']$", 0)
    h = salt("u")
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    plain = pick("plain", F.left(salt("l"), F.lit(40)), salt("m"), F.left(salt("n"), F.lit(32)), uuid, digits("o", 16), digits("o2", 16), F.concat(digits("p", 4), F.lit("-"), digits("q", 4), F.lit("-"), digits("r", 4), F.lit("-"), digits("s", 4)))
    path = F.concat(pick("p1", "static/", "assets/images/", "docs/library/", "home/user/", "content/upload/"), pick("p2", "report-", "article_", "index", "image"), digits("t", 6), pick("p3", "", "/page", "_final", "-section2"))
    joined = F.concat(pick("j1", "chapter", "section", "version", "release", "module"), pick("j2", "-", "_", ""), pick("j3", "default", "config", "function", "content"), pick("j4", "-", "_", ""), digits("v", 3))
    dummy = pick("d1", F.concat(F.lit("your_api_key_here_"), digits("w", 2)), F.lit("xxxxxxxxxxxxxxxxxxxxxxxx1"), F.lit("example_token_12345"), F.lit("00000000000000000000000000000000"), F.lit("placeholder-secret-0001"), F.lit("changeme_password_123"), F.lit("test_token_value_1234"))
    shape = F.pmod(n, F.lit(10))
    own = spark.range(rows).withColumn("joint", joint("joint")).withColumn("shape", shape)
    assigned = F.concat(text("t"), name("name"), F.col("joint"))
    when = lambda *pairs: F.coalesce(*(F.when(F.col("shape").isin(*k), v) for k, v in pairs))
    return own.select(
        when(((0, 1, 2), secret), ((3,), known), ((4, 5), plain), ((6,), path), ((7,), joined), ((8,), dummy), ((9,), plain)).alias("candidate"),
        when(((0, 1, 2), assigned), ((3,), pick("x", assigned, text("y"))), ((4,), text("z")), ((5,), F.concat(text("z2"), pick("hw", "commit ", "sha256:", "md5 ", "id=", "order ", "card ", "uuid: ", "checksum "))),
             ((6,), F.concat(text("z3"), pick("pw", "https://www.site.org/", "/", "see ", "./", "path: "))), ((7,), text("z4")), ((8,), assigned), ((9,), text("z5"))).alias("before"),
        F.concat(F.when(F.col("shape").isin(0, 1, 2, 3, 8), closing).otherwise(F.when(F.col("shape") == 6, pick("ext", ".png", ".html", "", " ")).otherwise("")), sign("after"), F.lit(" "), word("aw")).alias("after"),
        F.col("shape").isin(0, 1, 2, 3).cast("double").alias("label"))


def train(findings: DataFrame, rows: int = TRAINING_ROWS, trees: int = 24, depth: int = 7, seed: int = 7) -> RandomForestClassificationModel:
    """A forest on at most ``rows`` labelled findings (candidate, before, after, label), those with the lowest hash."""
    some = findings.where("label IS NOT NULL").orderBy(F.xxhash64("candidate", "before", "after"), "candidate", "before", "after").limit(rows)
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(some)).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(table)


def scan(docs: DataFrame, model: RandomForestClassificationModel | PipelineModel, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, length, secret, score) of every secret: candidates that the forest gives ``threshold`` or more.

    Repeated rows and rows with a null id give their findings each; null, empty and
    secret-free texts and empty tables give none; other columns are ignored. No shuffle.
    """
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(candidates(docs, text, doc_id)))
    scored = model.transform(table.select("doc_id", "start", "candidate", "features")).withColumn("score", vector_to_array("probability")[1])
    return scored.where(F.col("score") >= threshold).select(F.col("doc_id").alias(doc_id), "start", F.length("candidate").cast("bigint").alias("length"), F.col("candidate").alias("secret"), "score")


def redact(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = THRESHOLD, mark: str = "[SECRET]", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with every secret replaced by ``mark`` and nothing else changed.

    Rows are told apart by id and text hash, so a null id or a repeated row does no harm.
    """
    key = docs.withColumn("__key", F.xxhash64(doc_id, text))
    found = scan(key, model, threshold, text, "__key").groupBy("__key").agg(F.collect_set("secret").alias("__secrets"))  # bounded by the text itself
    longest = F.array_sort("__secrets", lambda a, b: F.length(b) - F.length(a))
    joined = key.join(found, "__key", "left")
    return joined.withColumn(text, F.when(F.col("__secrets").isNull(), F.col(text)).otherwise(F.aggregate(longest, F.col(text), lambda t, s: F.replace(t, s, F.lit(mark))))).select(*docs.columns)
