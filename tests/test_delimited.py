"""Records over several lines, read in splits, against Python's csv module."""

import csv
import io
import random
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridemill.operators import cleaning as C
from ridemill.sources import daily as SD
from ridemill.sources import delimited as D


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def made(seed, separator):
    """Rows of three fields: quoted ones with separators, doubled quotes, line feeds and blank lines; stray quotes in plain ones."""
    rng = random.Random(seed)
    quoted = ["two\nlines", "a\n\n\nb", f"x{separator}y", 'say ""hi""', "", '""', f'""{separator}\n""', "plain", "\n", f"end{separator}"]
    plain = ["x", "", 'stray " quote', '5"', "long " * 12, "ñandú"]
    lines = []
    for i in range(120):
        fields = [str(i)] + [f'"{rng.choice(quoted)}"' if rng.random() < 0.4 else rng.choice(plain) for _ in range(2)]
        lines.append(separator.join(fields))
    return separator.join(["id", "one", "two"]) + "\n" + "\n".join(lines) + "\n"


@pytest.mark.parametrize(("seed", "separator"), [(1, ","), (2, ","), (3, ";")])
def test_same_records_as_the_csv_module(spark, tmp_path, small_splits, seed, separator):
    text = made(seed, separator)
    path = write(tmp_path, "a.csv", text)
    headers = D.read_headers(spark, [path])
    assert headers[0].spans_lines and spark.read.text(path).rdd.getNumPartitions() > 10
    got = D.read_files(spark, headers).orderBy(D.BLOCK, D.ROW).select("id", "one", "two").collect()
    want = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=separator) if r][1:]
    assert [[x or "" for x in r] for r in got] == want


@pytest.mark.parametrize("line", ['a,"b', 'a,"b"', '"a""', '"a"""', 'a"b,"c', '"",""', '"","', 'b",c', 'b","c', 'b""', 'b"",', '"', '""', 'x"', '"a,b\t', 'a,b"', 'b"x"y,"z'])
def test_effect_of_a_line(spark, line):
    """The state after a line, from either state, as the csv module has it: a further line is a record of its own or not."""
    row = spark.range(1).select(D.ends_inside(F.lit(line), ",", False), D.ends_inside(F.lit(line), ",", True)).first()

    def goes_on(text):
        return len(list(csv.reader(io.StringIO(text + "\nEND,1\n", newline="")))) < len(text.split("\n")) - (text.startswith('"OPEN')) + 1

    assert (row[0], row[1]) == (goes_on(line), goes_on('"OPEN\n' + line))


def test_only_the_lines_of_long_records_are_brought_together(spark, tmp_path, small_splits):
    text = "fecha,modo,cantidad_usos,nombre_empresa,linea\n" + "".join(
        f'2024-01-02,TREN,{i},{"X" if i != 50 else chr(34) + "Sur" + chr(10) + "Norte" + chr(34)},{i}\n' for i in range(1, 101))
    scanned = SD.scan_csv(spark, write(tmp_path, "one.csv", text))
    out = C.clean_daily(C.parse_daily(scanned), [C.POSITION])
    assert out.count() == 100 and [r.nombre_empresa for r in out.filter("linea = '50'").collect()] == ["SUR\nNORTE"]


def test_position_follows_the_file(spark, tmp_path, small_splits, rows):
    body = "".join(f'2024-01-02,TREN,{i},"X{chr(10)}Y",{i % 7}\n' for i in range(1, 200))
    parsed = C.parse_daily(SD.scan_csv(spark, write(tmp_path, "p.csv", "fecha,modo,cantidad_usos,nombre_empresa,linea\n" + body)))
    assert rows(C.clean_daily(parsed, [C.POSITION]), "linea", "cantidad_usos") == sorted((str(i % 7), i) for i in range(1, 8))


def test_encodings_and_line_ends(spark, tmp_path, small_splits):
    text = 'id,one,two\r\n1,"Línea\r\nUno",x\r\n2,ñ,"é"\r\n'
    for name, encoding in (("u.csv", "utf-8"), ("b.csv", "utf-8-sig"), ("l.csv", "latin-1")):
        headers = D.read_headers(spark, [write(tmp_path, name, text, encoding)])
        assert sorted(tuple(r) for r in D.read_files(spark, headers).select("id", "one", "two").collect()) == [("1", "Línea\nUno", "x"), ("2", "ñ", "é")]


def test_a_quote_that_is_never_closed(spark, tmp_path, small_splits):
    good = write(tmp_path, "good.csv", 'fecha,modo,cantidad_usos\n2024-01-02,"TR\nEN",5\n')
    bad = write(tmp_path, "bad.csv", "fecha,modo,cantidad_usos\n" + "2024-01-02,TREN,5\n" * 40 + '2024-01-03,"TREN,5\n' + "2024-01-04,TREN,5\n" * 40)
    assert {r.source_file for r in SD.scan_paths(spark, [good, bad]).collect()} == {"good.csv"}
    with pytest.raises(ValueError, match="never closed"):
        SD.scan_csv(spark, bad)
    with pytest.raises(SD.NoUsableFile):
        SD.scan_paths(spark, [bad])


def test_stray_quotes_leave_the_plain_scan(spark, tmp_path):
    headers = D.read_headers(spark, [write(tmp_path, "s.csv", 'id,one\n1,5" pipe\n2,a"b"c\n')])
    assert not headers[0].spans_lines
    assert [r.one for r in D.read_files(spark, headers).orderBy("id").collect()] == ['5" pipe', 'a"b"c']


def test_lines_are_joined_without_a_shuffle(spark, tmp_path, small_splits):
    """Only pieces of records that go on over a block's end are dealt out; here one record covers several blocks."""
    long = "\n".join(f"part {i} of a long field" for i in range(40))
    body = "".join(f'{i},"a\n{long if i == 20 else i}",x\n' for i in range(40))
    path = write(tmp_path, "long.csv", "id,one,two\n" + body)
    headers = D.read_headers(spark, [path])
    lines = D._records(spark, headers[0], [path])
    assert "collect_list" in str(lines._jdf.queryExecution().optimizedPlan())
    staged = spark.read.parquet(lines.inputFiles()[0].rsplit("/", 1)[0])
    assert staged.filter("opens IS NULL").count() > 20 and staged.filter("opens = 0").count() > 5
    assert {r.id: r.one for r in D.read_files(spark, headers).collect()} == {str(i): f"a\n{long if i == 20 else i}" for i in range(40)}


def test_profile_is_not_sorted(spark, tmp_path):
    """Head lines and sums are made by hash, so a task's memory does not grow with its lines."""
    plan = str(D.profile(spark, write(tmp_path, "p.csv", "a,b\n1,2\n"))._jdf.queryExecution().executedPlan())
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("separator", [",", ";", "¦"])
def test_effects_of_many_lines_at_once(spark, separator):
    """The arrays over all quotes give what the column expression gives line by line, also for a line of very many quotes."""
    rng = random.Random(5)
    parts = ['"', '""', separator, "x", "ñ", f'{separator}"', f'"{separator}', "long text"]
    lines = [None, "", *("".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(400)), *("".join(rng.choices(parts, k=k)) for k in (300, 301, 999))]
    df = spark.createDataFrame([(i, line or "") for i, line in enumerate(lines)], "i int, line string")
    want = df.orderBy("i").select(D.ends_inside(F.col("line"), separator, False), D.ends_inside(F.col("line"), separator, True)).collect()
    for array in (pa.array(lines), pa.array(["before", *lines])[1:], pa.array(lines, pa.large_string())):
        outside, inside = D.line_effects(array, separator)
        assert [(bool(a), bool(b)) for a, b in zip(outside, inside, strict=True)] == [tuple(r) for r in want]


def test_quotes_are_looked_at_in_one_scan(spark, tmp_path, small_splits, monkeypatch):
    """The scan that finds whether records span lines also says in which state each block begins; no column expression walks over quotes."""
    path = write(tmp_path, "a.csv", made(4, ","))
    scans = []
    monkeypatch.setattr(D, "scan_quotes", lambda *args, f=D.scan_quotes: (scans.append(args[2]), f(*args))[1])
    monkeypatch.setattr(D, "ends_inside", None)
    headers = D.read_headers(spark, [path])
    assert D.read_files(spark, headers).count() == 120 and scans == [[headers[0].path]]
    with pytest.raises(Exception, match="is not split as it was"):
        D._records(spark, replace(headers[0], scan=replace(headers[0].scan, starts={(headers[0].path, 0): 0})), [headers[0].path])
