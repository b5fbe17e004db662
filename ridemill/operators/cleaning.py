"""Row cleaning: typed columns, suspicion flags, keep-first de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ridemill import schema as S
from ridemill.functions import parsing as P
from ridemill.session import stage
from ridemill.sources.delimited import FILE, PATH, position

POSITION = "_position"
DAILY_KEY = ["fecha", "modo", "nombre_empresa", "linea"]
MONTH = ["year", "month"]
PART_ROWS, BUCKETS = 250_000, 256


def normalize_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trim and upper-case those of ``columns`` that exist."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: P.clean_text(F.col(c)) for c in present})


def add_date_parts(df: DataFrame, ds: str = "fecha") -> DataFrame:
    """year, month and day_of_week (0 = Monday)."""
    return df.withColumns({
        "year": F.year(ds), "month": F.month(ds), "day_of_week": F.weekday(ds),
    })


def parse_daily(raw: DataFrame) -> DataFrame:
    """Scanned text rows to typed rows with their file position; rows without a readable
    date or count are dropped.

    Position and parsing share one projection, which the filter uses: being non-deterministic
    it can neither lose the position nor be passed by the filter, which would parse again below.
    """
    text = [c for c in S.ENRICHMENT_DEFAULTS if c in raw.columns]
    typed = raw.withColumn("fecha", P.date_text(F.col("fecha"))).select(
        P.parse_date(F.col("fecha"), ready=True).alias("fecha"),
        P.clean_text(F.col("modo")).alias("modo"),
        P.parse_count(F.col("cantidad_usos")).alias("cantidad_usos"),
        *[P.clean_text(F.col(c)).alias(c) for c in text],
        FILE, *([PATH] if PATH in raw.columns else []), position().alias(POSITION))
    known = F.col("fecha").isNotNull() & F.col("cantidad_usos").isNotNull() & (F.col(POSITION)["row"] >= 0)
    return add_date_parts(typed.filter(known))


def zero_on_weekday(quantity: str = "cantidad_usos", day_of_week: str = "day_of_week"):
    return (F.col(quantity) == 0) & (F.col(day_of_week) < 5)


def group_spread(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation per group, combined map-side before the shuffle."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_std"))


def flag_outliers(
    df: DataFrame, value: str = "cantidad_usos",
    keys: Sequence[str] = ("source_file", "modo"), sigmas: float = 4.0,
    flag: str = "is_outlier", spread: DataFrame | None = None,
) -> DataFrame:
    """Mark values outside mean ± ``sigmas``·std of their group.

    A window over the group would pull one hot file and mode into a single task, so the
    statistics are aggregated first and staged; the join back is broadcast when the
    staged file is small enough and a skew-split shuffle join otherwise. ``spread``: the stored
    :func:`group_spread`, where it is there already; rows of a group without one stay unmarked.
    """
    stats = stage(group_spread(df, value, keys), "spread") if spread is None else spread
    renamed = stats.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_mean", "_std")
    condition = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        condition = same if condition is None else condition & same
    far = F.abs(F.col(value).cast("double") - F.col("_mean")) > F.lit(float(sigmas)) * F.col("_std")
    joined = df.join(renamed, condition, "left")
    return (joined.withColumn(flag, F.coalesce((F.col("_std") > 0) & far, F.lit(False)))
            .drop("_mean", "_std", *[f"_k{i}" for i in range(len(keys))]))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], by: Sequence[str] = (), part_rows: int = PART_ROWS) -> DataFrame:
    """One row per key, the first by ``order``; NULL keys are equal to each other.

    Rows are sorted after the shuffle only, in partitions whose size the shuffle settles: a sort
    before it takes as much memory as an input split has rows, and spills. Only where counts by
    hash show a key with a large part of all rows, the rows of its hash are first cut to one per
    key and input partition, by the group limit that ``row_number() = 1`` is planned with.

    ``by``: columns that follow from the keys, to be written by. The one shuffle then deals each
    of their values in parts of about ``part_rows`` rows, so that no other is needed for few files.
    ``df`` is read twice, its keys and ``by`` for the counts.

    The sort goes by one number first, half of it from the part and half from the key: nearly
    all comparisons end there, without a look at the rows, and a part's rows stay together.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    counted = df.select(*by, bucket.alias("_bucket")).groupingSets([[*by], ["_bucket"]] if by else [["_bucket"]], *by, "_bucket")
    counts = counted.agg(F.grouping("_bucket").alias("_whole"), F.count("*").alias("n")).collect()  # a row per bucket and value of ``by``
    sizes = {row["_bucket"]: row["n"] for row in counts if not row["_whole"]}
    large = [b for b, n in sizes.items() if n > 16 * sum(sizes.values()) // BUCKETS]
    rows = df
    if large:
        ranked = Window.partitionBy("_hash", *keys).orderBy(*order)
        some = (df.filter(bucket.isin(large)).withColumn("_hash", F.xxhash64(*keys)).withColumn("_rank", F.row_number().over(ranked))
                .filter(F.col("_rank") == 1).drop("_hash", "_rank"))
        rows = df.filter(~bucket.isin(large)).union(some)
    dealt = [*by, "_part"] if by else []
    if by:
        rows = in_parts(rows, keys, by, [row for row in counts if row["_whole"]], part_rows)
    place = F.xxhash64(*keys)
    if by:
        place = F.xxhash64(*dealt).bitwiseAND(-1 << 32).bitwiseOR(F.shiftrightunsigned(place, 32))
    first = Window.partitionBy("_place", *dealt, *keys).orderBy(*order)
    return (rows.withColumn("_place", place)
            .withColumn("_later", F.lag(F.lit(True)).over(first))
            .filter(F.col("_later").isNull()).drop("_place", "_later", "_part"))


def in_parts(df: DataFrame, keys: Sequence[str], by: Sequence[str], counts: Sequence[Row], part_rows: int = PART_ROWS) -> DataFrame:
    """Rows dealt by ``by`` and ``_part``: each value of ``by`` in parts of about ``part_rows`` rows, a key in one of them.

    ``counts``: a row with ``by`` and ``n`` per value.
    """
    sizes = {"-".join(str(row[c]) for c in by if row[c] is not None): row["n"] for row in counts}
    several = [x for value, n in sizes.items() if n > part_rows for x in (F.lit(value), F.lit(-(-n // part_rows)))]
    parts = F.coalesce(F.try_element_at(F.create_map(*several), F.concat_ws("-", *by)), F.lit(1)) if several else F.lit(1)
    return df.withColumn("_part", F.pmod(F.xxhash64(*keys), parts)).repartition(*by, "_part")


def with_defaults(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The declared daily schema: absent or NULL enrichment gets its default, types are cast. ``keep``: further columns."""
    columns = []
    for field in S.DAILY:
        default = S.ENRICHMENT_DEFAULTS.get(field.name)
        if default is None:
            c = F.col(field.name)
        elif field.name in df.columns:
            c = F.coalesce(F.col(field.name), F.lit(default))
        else:
            c = F.lit(default)
        columns.append(c.cast(field.dataType).alias(field.name))
    return df.select(*columns, *keep)


def _file(df: DataFrame) -> str:
    """What tells files apart: the full path where it is known, since two folders may hold the same name."""
    return PATH if PATH in df.columns else FILE


def clean_daily(parsed: DataFrame, order: Sequence[str]) -> DataFrame:
    """Parsed rows to the daily fact: flags, keep-first across all files, defaults.

    Keeping the first row by (file, position) in one pass equals de-duplicating inside
    every file and then across files in name order, with one shuffle instead of two.
    ``parsed`` is read twice (statistics, then flags): pass a staged table.
    """
    keys = [k for k in DAILY_KEY if k in parsed.columns]
    flagged = flag_outliers(parsed, keys=(_file(parsed), "modo")).withColumn(
        "is_suspicious", zero_on_weekday() | F.col("is_outlier")).drop("is_outlier")
    return with_defaults(keep_first(flagged, keys, [*dict.fromkeys([FILE, _file(parsed)]), *order], by=MONTH))
