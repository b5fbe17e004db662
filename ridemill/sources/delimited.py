"""Delimited text of unknown dialect: separator, encoding and header found per file.

One job over all files finds each file's header line and whether a quoted field goes on
over several lines. Files sharing a header line are then read in one scan as splittable text
lines, whose encoding is settled per line (a line that is not valid UTF-8 is Latin-1).

Where records span lines the file is still read in splits. A line without quotes leaves the
state, inside or outside of a quoted field, as it is; another one exchanges the two states or
leads to one of them whatever came before. These effects compose, so a block's effect is known
from its own lines, in one scan; the state at its start follows from the blocks before, and then
the state at each of its lines. A second scan joins lines where they are read; only what goes
on over a block's end is brought together.
"""

from __future__ import annotations

import csv
import itertools
import logging
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridemill.session import stage

log = logging.getLogger(__name__)

FILE, PATH, BLOCK, ROW, NUMBER = "source_file", "_path", "_block", "_row", "_number"
OUTSIDE, INSIDE, CLOSED, FIELD_START = range(4)
# The state after a quote that follows another or starts the line, follows a separator, or follows other text: from outside, inside, closed.
AFTER_QUOTE = np.array([[OUTSIDE, CLOSED, INSIDE], [INSIDE, CLOSED, INSIDE], [OUTSIDE, CLOSED, OUTSIDE]])
MANY_QUOTES = 64
PRIME = 2**31 - 1


@dataclass(frozen=True)
class QuoteScan:
    """Of the blocks of files that are read together, (path, block): whether a block begins inside of a quoted field."""

    starts: dict[tuple[str, int], int]
    ends: dict[str, int]
    opens: dict[str, bool]


@dataclass(frozen=True)
class Header:
    path: str
    line: str
    is_utf8: bool
    separator: str
    columns: tuple[str, ...]
    spans_lines: bool = False
    scan: QuoteScan | None = field(default=None, compare=False)


def list_files(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """Path, length and modification time of the matching files; contents are not read."""
    return (spark.read.format("binaryFile").load(pattern)
            .select(F.col("_metadata.file_path").alias("path"), "length", "modificationTime"))


def readable(path: str) -> str:
    """A path as readers take it, from the escaped form of file metadata."""
    return unquote(path)


def decoded(value: Column) -> Column:
    """The line as text. The reader has already removed line ends and a byte-order mark."""
    return F.when(F.is_valid_utf8(value), value).otherwise(F.decode(value.cast("binary"), "ISO-8859-1"))


def pick_separator(line: str, separators: Sequence[str]) -> str:
    """The first separator that yields two or more columns."""
    for sep in separators:
        if len(next(csv.reader([line], delimiter=sep), [])) >= 2:
            return sep
    raise ValueError(f"no separator of {list(separators)} splits the header {line[:200]!r}")


def dominant_separator(line: str, separators: Sequence[str] = (",", ";")) -> str:
    return ";" if line.count(";") > line.count(",") else ","


def ends_inside(line: Column, separator: str, inside: bool) -> Column:
    """Whether a line ends inside a quoted field, if it starts inside of one or not.

    A quote opens a field only at the field's start, and is text elsewhere outside; inside, a
    doubled quote is text. One pass over the pieces between the quotes. The rule as a column;
    scans apply it by :func:`line_effects`.
    """
    pieces = F.split(line, '"')

    def text(state: Column, piece: Column) -> Column:
        return (F.when((state == INSIDE) | (piece == ""), state)
                .when(F.endswith(piece, F.lit(separator)), FIELD_START).otherwise(OUTSIDE))

    def quote(state: Column) -> Column:
        return F.when(state.isin(FIELD_START, CLOSED), INSIDE).when(state == INSIDE, CLOSED).otherwise(OUTSIDE)

    first = text(F.lit(INSIDE if inside else FIELD_START), pieces[0])
    last = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), first, lambda state, piece: text(quote(state), piece))
    return F.when(F.contains(line, F.lit('"')), last == INSIDE).otherwise(F.lit(inside))


def profile(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per file block, from one pass: what headers and content hashes are made of.

    The first line that is not blank, whether there is a quote, the number of lines and
    order-aware sums of their hashes: two halves of each hash, alone and times the line's number
    in the block's task, from which its number in the file follows once the blocks before are
    counted. The products are taken modulo a prime, so that whole numbers of 64 bits hold them.
    """
    value = F.col("value")
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"),
        "value", F.xxhash64("value").alias("hash"))
    filled = F.trim(value) != ""
    half = {"low": F.col("hash").bitwiseAND(0x7FFFFFFF), "high": F.shiftrightunsigned("hash", 33)}
    # a set of a few values, with which Spark aggregates by hash: the head alone would have every line sorted
    seen = F.collect_set(F.contains(value, F.lit('"')))
    return lines.groupBy("path", "block").agg(
        F.count("*").alias("n"), F.min("row").alias("first"),
        F.min_by(F.when(filled, F.struct(decoded(value).alias("line"), F.is_valid_utf8(value).alias("is_utf8"))), F.when(filled, F.col("row"))).alias("head"),
        F.array_contains(seen, F.lit(True)).alias("quoted"),
        *[F.sum(h).alias(f"sum_{name}") for name, h in half.items()],
        *[F.sum(h * (F.col("row") % PRIME) % PRIME).alias(f"placed_{name}") for name, h in half.items()])


def read_headers(
    spark: SparkSession,
    paths: Sequence[str],
    separators: Sequence[str] = (",", ";"),
    choose: Callable[[str, Sequence[str]], str] = pick_separator,
    strict: bool = False,
    blocks: DataFrame | None = None,
) -> list[Header]:
    """Headers of all files under ``paths`` that have a line, in path order, by one job.

    A file whose header cannot be split, or whose last quoted field is never closed, is
    skipped, or an error if ``strict``. ``blocks``: their :func:`profile`, where it is there
    already; it may hold more files. Only files with a quote are read once more.
    """
    known = profile(spark, paths) if blocks is None else blocks
    found = known.filter(F.col("head").isNotNull()).groupBy("path").agg(F.min_by("head", "block").alias("head"), F.bool_or("quoted").alias("quoted"))
    headers = []
    for row in found.orderBy("path").collect():  # one row per file, as the file listing itself
        if blocks is not None and readable(row["path"]) not in paths:
            continue
        try:
            sep = choose(row["head"]["line"], separators)
        except ValueError as error:
            if strict:
                raise
            log.warning("skipping %s: %s", row["path"], error)
            continue
        names = next(csv.reader([row["head"]["line"]], delimiter=sep))
        # for now, that it may have records over several lines
        headers.append(Header(readable(row["path"]), row["head"]["line"], row["head"]["is_utf8"], sep, tuple(n.strip().lower() for n in names), row["quoted"]))
    scans = {h.path: scan for group in by_header([h for h in headers if h.spans_lines]) for scan in [scan_quotes(spark, group[0].separator, [h.path for h in group])] for h in group}
    headers = [replace(h, spans_lines=scans[h.path].opens[h.path], scan=scans[h.path]) if h.spans_lines else h for h in headers]
    never_closed = [h.path for h in headers if h.spans_lines and h.scan.ends[h.path] == INSIDE]
    for path in never_closed:
        if strict:
            raise ValueError(f"{path}: a quoted field is never closed")
        log.warning("skipping %s: a quoted field is never closed", path)
    headers = [h for h in headers if h.path not in never_closed]
    if strict and not headers:
        raise ValueError(f"{list(paths)}: no line to read")
    return headers


def _names(spark: SparkSession, paths: Sequence[str]) -> tuple[Column, dict[int, tuple[str, str]]]:
    """A number for each file, as a column of a scan, and its path and name by it: a line is sent to Python with the number alone."""
    files = spark.read.format("binaryFile").load(list(paths)).select("_metadata.file_path", "_metadata.file_name")
    for seed in itertools.count():
        number = F.xxhash64("_metadata.file_path", F.lit(seed)).alias(NUMBER)
        rows = files.select("file_path", "file_name", F.xxhash64("file_path", F.lit(seed)).alias(NUMBER)).collect()  # at most the files
        names = {row[NUMBER]: (row["file_path"], row["file_name"]) for row in rows}
        if len(names) == len({row["file_path"] for row in rows}):
            return number, names
    raise AssertionError


def line_effects(lines: pa.Array, separator: str) -> tuple[np.ndarray, np.ndarray]:
    """:func:`ends_inside` of every line, from outside and from inside, by arrays over the quotes of all lines."""
    _, ends, text = lines.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_string(lines.type) else np.int32)[lines.offset:lines.offset + len(lines) + 1].astype(np.int64)
    data = np.frombuffer(text or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    quotes = np.flatnonzero(data == ord('"'))
    place = np.searchsorted(quotes, ends)
    first, counts = place[:-1], np.diff(place)
    start = np.repeat(ends[:-1], counts)
    mark = np.frombuffer(separator.encode(), np.uint8)
    separated = quotes - start >= len(mark)
    for i, byte in enumerate(mark):
        separated &= data[quotes - len(mark) + i] == byte
    kind = np.where((quotes == start) | (data[quotes - 1] == ord('"')), 0, np.where(separated, 1, 2))
    states = np.repeat(np.array([[CLOSED], [INSIDE]]), len(lines), axis=1)  # a field's start acts on a quote as a closed field does
    done, left = 0, np.flatnonzero(counts)
    while left.size and done < MANY_QUOTES:
        states[:, left] = AFTER_QUOTE[kind[first[left] + done], states[:, left]]
        done += 1
        left = left[counts[left] > done]
    for line in left.tolist():  # the effects of the others are composed in pairs
        effects = AFTER_QUOTE[kind[first[line] + done:first[line] + counts[line]]]
        while len(effects) > 1:
            even = np.concatenate((effects, [[OUTSIDE, INSIDE, CLOSED]])) if len(effects) % 2 else effects
            effects = np.take_along_axis(even[1::2], even[::2], axis=1)
        states[:, line] = effects[0][states[:, line]]
    return tuple((states == INSIDE).astype(np.int64))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """The lines of each file block in a batch, from and to; a task reads a block's lines one after the other."""
    if not batch.num_rows:
        return
    number, block = (batch.column(name).to_numpy() for name in (NUMBER, BLOCK))
    new = np.flatnonzero((np.diff(number) != 0) | (np.diff(block) != 0)) + 1
    for a, b in itertools.pairwise([0, *new.tolist(), batch.num_rows]):
        yield (int(number[a]), int(block[a])), a, b


def _after(outside: np.ndarray, inside: np.ndarray, start: int) -> np.ndarray:
    """The state after each line, from the lines' effects and the state before the first.

    The last line that leads to one state, whatever came before it, settles the state, and the
    exchanges since then turn it; without one, ``start`` is turned.
    """
    turns = np.cumsum(outside > inside)
    settled = np.maximum.accumulate(np.where(outside == inside, np.arange(len(outside)), -1))
    return np.where(settled >= 0, outside[settled] + turns - turns[settled], start + turns) % 2


def _block_effects(separator: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per file block: the state its lines lead to from outside, and from inside, and whether one leads from outside to inside."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        effects: dict[tuple[int, int], tuple[int, int, bool]] = {}
        for batch in batches:
            outside, inside = line_effects(batch.column("line"), separator)
            for key, a, b in _runs(batch):
                states = [int(_after(outside[a:b], inside[a:b], start)[-1]) for start in (OUTSIDE, INSIDE)]
                before = effects.get(key, (OUTSIDE, INSIDE, False))
                effects[key] = states[before[0]], states[before[1]], before[2] or bool(outside[a:b].any())
        if effects:
            columns = zip(*((*key, *effect) for key, effect in effects.items()), strict=True)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [NUMBER, BLOCK, "from_outside", "from_inside", "opens"])

    return found


def scan_quotes(spark: SparkSession, separator: str, paths: Sequence[str]) -> QuoteScan:
    """The state at the start of each block, and at the end of each file, in one scan of the files; the driver holds a row per block."""
    number, names = _names(spark, paths)
    value = F.col("value")
    lines = spark.read.text(list(paths)).select(number, F.col("_metadata.file_block_start").alias(BLOCK), F.when(F.contains(value, F.lit('"')), decoded(value)).alias("line"))
    rows = lines.mapInArrow(_block_effects(separator), f"{NUMBER} bigint, {BLOCK} bigint, from_outside int, from_inside int, opens boolean").collect()
    starts, ends, opens = {}, {}, {}
    for row in sorted(rows, key=lambda r: (r[NUMBER], r[BLOCK])):
        path = readable(names[row[NUMBER]][0])
        starts[path, row[BLOCK]] = state = ends.get(path, OUTSIDE)
        ends[path] = row["from_inside"] if state == INSIDE else row["from_outside"]
        opens[path] = opens.get(path, False) or row["opens"]
    return QuoteScan(starts, ends, opens)


RECORDS = pa.schema([("line", pa.string()), (FILE, pa.string()), (PATH, pa.string()), (BLOCK, pa.int64()), (ROW, pa.int64()), ("opens", pa.int32())])


def _joined_lines(separator: str, names: dict[int, tuple[str, str]], begun: dict[tuple[int, int], int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Joins the lines of each record of a block, whose state at the start is given by ``begun``.

    ``opens`` is null for a whole record. Of a record that goes on over a block's end there is a
    piece in each block: 1 for its first, 0 for a further one. A task holds a batch and a record.
    """
    def rows(lines, key, places, opens=None) -> pa.RecordBatch:
        n, (path, file) = len(lines), names[key[0]]
        constant = [pa.repeat(pa.scalar(v, t), n) for v, t in ((file, pa.string()), (path, pa.string()), (key[1], pa.int64()))]
        return pa.RecordBatch.from_arrays([lines, *constant, places, pa.repeat(pa.scalar(opens, pa.int32()), n)], schema=RECORDS)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, held = None, OUTSIDE, None  # held: lines, place and kind of the record that goes on

        def ended(whole: bool) -> pa.RecordBatch:
            lines, place, opens = held
            return rows(pa.array(["\n".join(lines)], pa.string()), key, pa.array([place], pa.int64()), None if whole and opens else opens)

        for batch in batches:
            effects = line_effects(batch.column("line"), separator)
            for found, a, b in _runs(batch):
                if found != key:
                    if held:
                        yield ended(False)
                    if found not in begun:
                        raise RuntimeError(f"{names[found[0]][0]} is not split as it was when its quotes were looked at: no block at {found[1]}")
                    key, state, held = found, begun[found], None
                line, place = (batch.column(name).slice(a, b - a) for name in ("line", ROW))
                after = _after(*(effect[a:b] for effect in effects), state)
                starts = np.flatnonzero(np.concatenate(([state], after[:-1])) == OUTSIDE)
                state = int(after[-1])
                head = int(starts[0]) if len(starts) else len(line)
                if head:  # the rest of the record that goes on; from the block before, if none is held
                    held = held or ([], place[0].as_py(), 0)
                    held[0].extend(line.slice(0, head).to_pylist())
                if held and (len(starts) or state == OUTSIDE):
                    yield ended(True)
                    held = None
                end = len(line)
                if len(starts) and state == INSIDE:
                    end = int(starts[-1])
                    held = (line.slice(end).to_pylist(), place[end].as_py(), 1)
                    starts = starts[:-1]
                if len(starts):
                    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, end), pa.int32()), line)
                    yield rows(pc.binary_join(lists, "\n"), key, place.take(pa.array(starts)))
        if held:
            yield ended(False)

    return joined


def _records(spark: SparkSession, head: Header, paths: Sequence[str]) -> DataFrame:
    """(line, file, path, block, row) of every record; the lines of one that goes on are joined by line feeds.

    Lines are joined in the task that reads them, in order; only the pieces of records that go on
    over a block's end, two a block at most, are brought together. Files are split by what is
    read together: the header's scan holds for the same files only.
    """
    known = head.scan is not None and head.scan.ends.keys() == set(paths)
    scan = head.scan if known else scan_quotes(spark, head.separator, paths)
    number, names = _names(spark, paths)
    numbers = {readable(path): n for n, (path, _) in names.items()}
    begun = {(numbers[path], block): state for (path, block), state in scan.starts.items()}
    lines = spark.read.text(list(paths)).select(
        number, F.col("_metadata.file_block_start").alias(BLOCK), F.monotonically_increasing_id().alias(ROW), decoded(F.col("value")).alias("line"))
    rows = stage(lines.mapInArrow(_joined_lines(head.separator, names, begun), f"line string, {FILE} string, {PATH} string, {BLOCK} bigint, {ROW} bigint, opens int"), "records")
    whole = rows.filter("opens IS NULL").drop("opens")
    so_far = Window.partitionBy(PATH).orderBy(BLOCK, ROW).rowsBetween(Window.unboundedPreceding, 0)
    pieces = rows.filter("opens IS NOT NULL").withColumn("record", F.sum("opens").over(so_far))
    ordered = F.array_sort(F.collect_list(F.struct(BLOCK, ROW, "line")))
    joined = pieces.groupBy(FILE, PATH, "record").agg(ordered.alias("all"))
    text = F.array_join(F.transform("all", lambda part: part["line"]), "\n")
    return whole.union(joined.select(text, FILE, PATH, F.col("all")[0][BLOCK], F.col("all")[0][ROW]))


def read_rows(spark: SparkSession, headers: Sequence[Header]) -> DataFrame:
    """One scan of files that share a header line: all columns as text, plus the file's
    name and path, the offset of the file block a row comes from and, where records span
    lines, the row's place in the block."""
    head, paths = headers[0], [h.path for h in headers]
    fields = ", ".join(f"c{i} string" for i in range(len(head.columns)))
    options = {"sep": head.separator, "escape": '"', "multiLine": head.spans_lines}
    named = [F.col(f"r.c{i}").alias(name) for i, name in enumerate(head.columns)]
    if head.spans_lines:
        lines = _records(spark, head, paths).filter((F.trim("line") != "") & (F.col("line") != F.lit(head.line)))
    else:
        # compared before decoding where possible: a filter on decoded text would decode twice
        value = F.col("value") if head.is_utf8 else decoded(F.col("value"))
        lines = (
            spark.read.text(paths)
            .filter((F.trim("value") != "") & (value != F.lit(head.line)))
            .select(decoded(F.col("value")).alias("line"), F.col("_metadata.file_name").alias(FILE), F.col("_metadata.file_path").alias(PATH),
                    F.col("_metadata.file_block_start").alias(BLOCK), F.lit(None).cast("bigint").alias(ROW))
        )
    return lines.select(F.from_csv(F.col("line"), fields, options).alias("r"), FILE, PATH, BLOCK, ROW).select(*named, FILE, PATH, BLOCK, ROW)


def read_files(spark: SparkSession, headers: Sequence[Header]) -> DataFrame:
    """All rows of files with the same columns, one scan per group of equal header lines."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_rows(spark, group) for group in by_header(headers)])


def position() -> Column:
    """Sorts rows of a file in file order; valid until the first shuffle after the scan."""
    return F.struct(F.col(BLOCK).alias("block"), F.coalesce(ROW, F.monotonically_increasing_id()).alias("row"))


def by_header(headers: Sequence[Header]) -> list[list[Header]]:
    groups: dict[tuple[str, bool, bool], list[Header]] = {}
    for header in headers:
        groups.setdefault((header.line, header.is_utf8, header.spans_lines), []).append(header)
    return list(groups.values())
