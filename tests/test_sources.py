import datetime
import decimal
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.errors import AnalysisError, RunError
from ledgerloom.relation import Relation
from ledgerloom.sources import contract as K
from ledgerloom.sources import exports as X
from ledgerloom.sources import readers as R


def test_contract_lists_rejects(spark):
    raw = spark.createDataFrame([(1, "1", "12.00", "2024-01-05", " yes "), (2, "2", "1.5", "05/01/2024", "maybe"), (3, "3", "  ", "2024-01-05 10:00", "N")], "row long, id string, n string, day string, ok string")
    d = [K.Declared("id", "int"), K.Declared("n", "int", True), K.Declared("day", "date", True, ("%d/%m/%Y",)), K.Declared("ok", "bool", True)]
    s = K.typed(raw, d, row="row", identity=("id",))
    assert [tuple(r) for r in s.relation.df.orderBy("id").collect()] == [(1, 12, datetime.date(2024, 1, 5), True), (2, None, datetime.date(2024, 1, 5), None), (3, None, None, False)]
    assert sorted((r.row, r.column) for r in s.rejects.collect()) == [(2, "n"), (2, "ok"), (3, "day")]
    K.enforce(s, d)
    with pytest.raises(RunError) as e:
        K.enforce(s, [K.Declared("n", "int")])
    assert e.value.code == "L210"
    two = K.typed(spark.createDataFrame([("1.234",), ("2",)], "m string"), [K.Declared("m", "decimal(10,2)")])
    assert [tuple(r) for r in two.rounded.collect()] == [("m", 1)]


def test_inference(spark):
    raw = spark.createDataFrame([("007", "1", "1.50", "2024-02-29", "2024-01-01 10:00:00", "1e5", "x"), ("12", "-3", "20", "2024-01-01", "2024-01-01T11:00", "2", None)], "code string, n string, m string, d string, ts string, f string, s string")
    assert {x.name: x.type for x in K.infer(raw)} == {"code": "string", "n": "int", "m": "decimal(18,2)", "d": "date", "ts": "timestamp", "f": "float", "s": "string"}


def test_headers_and_sections(spark):
    assert R.header_names(["id", "Amount", "amount", "", "amount_2", "a  b"]) == ["id", "Amount", "amount_3", "column_4", "amount_2", "a b"]
    text = 'Harvest of, 2031\nfield:,north\n\nrow;weight;remark\n1;"2;5";tall by 3" or so\n2;3;"two\nlines"\n\nsum;3\n'
    df = R.csv_section(spark, text, section=2, delimiter=";", row_number="n")
    assert [tuple(r) for r in df.orderBy("n").collect()] == [(1, "1", "2;5", 'tall by 3" or so'), (2, "2", "3", "two\nlines")]
    assert R.guess_delimiter("a;b;c\n1;2,5;3\n4;5;6\n") == ";"
    with pytest.raises(RunError):
        R.csv_section(spark, "a,b\n1\n")
    assert R.csv_section(spark, "a,b\n1\n", ragged=True).collect()[0].b is None
    with pytest.raises(RunError):
        R.csv_section(spark, text, section=9, delimiter=";")


def test_csv_in_parallel(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,name\n1,"x, y"\n,,\n2," z"\n'.replace(",,", ","))
    assert sorted(map(tuple, R.csv(spark, str(p)).collect())) == [("1", "x, y"), ("2", " z")]
    p.write_text("id,name\n1,x,y\n")
    with pytest.raises(Exception, match="L212"):
        R.csv(spark, str(p)).collect()


def test_csv_rows_are_numbered_in_splits(spark, tmp_path):
    """The splits' rows get the numbers of the file's order; a record of several lines is met wherever it is."""
    lines = [f'{i},"v {i}",{"" if i % 7 else "x"}' for i in range(1, 4001)]
    p = tmp_path / "a.csv"
    p.write_text("\ufeffid,name,tag\n" + "\n\t\n".join(lines) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = R.csv(spark, str(p), row_number="n")
        assert spark.read.text(str(p)).rdd.getNumPartitions() > 4
        assert [tuple(r) for r in df.orderBy("n").collect()] == [(i, str(i), f"v {i}", None if i % 7 else "x") for i in range(1, 4001)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    p.write_text('id,name\n1,"a\nb"\n2,c "d\n3,"e ""f"" g"\n')
    assert [tuple(r) for r in R.csv(spark, str(p), row_number="n").orderBy("n").collect()] == [(1, "1", "a\nb"), (2, "2", 'c "d'), (3, "3", 'e "f" g')]
    assert [R.ends_open(x, ",") for x in ('a,"b', 'a,"b"', 'a 3" b,c', '"a""', '"a"",b"', 'a,"b"x,"c')] == [True, False, False, True, False, True]
    p.write_text("id,name\n1\n")
    assert [tuple(r) for r in R.csv(spark, str(p), ragged=True, row_number="n").collect()] == [(1, "1", None)]
    with pytest.raises(Exception, match="L212"):
        R.csv(spark, str(p), row_number="n").collect()


def test_database_files_keep_numbers_and_nulls(spark, tmp_path, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    path = f"{tmp_path}/a.duckdb"
    con = duckdb.connect(path)
    con.execute("create table t as select * from (values (9007199254740993, 1234567890123456.78::decimal(18,2), date '2024-02-29', 7::utinyint, 'x'), (null, null, null, null, null), (3, 4.5, null, 255, 'y')) v(id, m, d, u, s)")
    con.close()
    want = {(9007199254740993, decimal.Decimal("1234567890123456.78"), datetime.date(2024, 2, 29), 7, "x"), (None,) * 5, (3, decimal.Decimal("4.50"), None, 255, "y")}
    assert set(map(tuple, R.database_file(spark, path, "select * from t").collect())) == want
    monkeypatch.setattr(R, "BATCH", 1)
    assert set(map(tuple, R.database_file(spark, path, "select * from t").collect())) == want
    assert R.database_file(spark, path, "select * from t where id < 0").dtypes[:2] == [("id", "bigint"), ("m", "decimal(18,2)")]
    r = Relation(R.database_file(spark, path, "select * from t"), "t")
    X.export({f"{tmp_path}/b.duckdb": {"t": r, "none": Relation(r.df.limit(0), "none")}})
    con = duckdb.connect(f"{tmp_path}/b.duckdb")
    assert set(con.execute("select * from t").fetchall()) == want and con.execute("select count(*) from \"none\"").fetchone() == (0,)
    assert con.execute("select column_type from (describe t)").fetchall()[:2] == [("BIGINT",), ("DECIMAL(18,2)",)]


def test_sheet_titles_differ():
    assert X._sheet_titles(["a" * 40, "A" * 50, "b"]) == ["a" * 31, "A" * 27 + " (2)", "b"]


def test_csv_guesses_from_the_first_megabyte(spark, tmp_path):
    """Over the first 250 lines , and ; are as good as each other."""
    text = "price, net;name\n" + "1,5;x\n" * 250 + "2;y\n" * 300
    (tmp_path / "a.csv").write_text(text)
    got, whole = R.csv(spark, str(tmp_path / "a.csv")), R.csv_section(spark, text)
    assert got.columns == whole.columns and sorted(got.collect()) == sorted(whole.collect()) and got.filter("name = 'y'").count() == 300


def test_fixed_width(spark, tmp_path):
    p = tmp_path / "roll.txt"
    p.write_bytes(b"A01    720240105001234A02  12a00000000-00050")
    layout = [("rec", 1, 3, "A"), ("id", 4, 5, "N"), ("day", 9, 8, "D"), ("amt", 17, 6, "M")]
    df = R.fixed_width(spark, str(p), layout, record_length=22, row_number="n")
    s = K.typed(df, [K.Declared(n, R.LAYOUT_TYPES[c], True) for n, _, _, c in layout], row="n")
    assert [tuple(r) for r in s.relation.df.orderBy("rec").collect()] == [("A01", 7, datetime.date(2024, 1, 5), decimal.Decimal("12.34")), ("A02", None, None, decimal.Decimal("-0.50"))]
    assert s.rejects.count() == 1


def test_fill_down_spans(spark):
    df = spark.createDataFrame([(1, " "), (2, "a"), (3, ""), (200_001, None), (200_002, "b"), (900_000, None)], "n long, v string")
    assert [r.v for r in K.fill_down(df, ["v"], "n").orderBy("n").collect()] == [None, "a", "a", "a", "b", "b"]


def test_exports_read_back(spark, tmp_path):
    rows = [(2, "é,\"x\"", decimal.Decimal("1.50"), datetime.date(2024, 1, 5), True), (1, None, None, None, False)]
    r = Relation(spark.createDataFrame(rows, "id long, s string, m decimal(10,2), d date, b boolean"), "r", sort=(("id", True),))
    paths = {f"{tmp_path}/o.{x}": r for x in ("csv", "json", "jsonl", "parquet", "xlsx")}
    X.export(paths)
    first = {p: open(p, "rb").read() for p in paths if not p.endswith("parquet")}
    X.export(paths)
    assert all(open(p, "rb").read() == b for p, b in first.items())
    assert R.csv(spark, f"{tmp_path}/o.csv").count() == 2
    assert [x.id for x in spark.read.parquet(f"{tmp_path}/o.parquet").collect()] == [2, 1]
    x = R.excel(spark, f"{tmp_path}/o.xlsx", row_number="n")
    assert [tuple(v) for v in x.orderBy("n").collect()] == [(1, "2", 'é,"x"', "1.5", "2024-01-05", "true"), (2, "1", None, None, None, "false")]
    with pytest.raises(AnalysisError):
        X.export({f"{tmp_path}/o.csv": r, f"{tmp_path}/./o.csv": r})
    X.export({f"{tmp_path}/c.svg": r}, kind="bar", x="id", y="m")
    assert "<rect" in open(f"{tmp_path}/c.svg").read()
    X.export({f"{tmp_path}/x.duckdb": {"t": r}})
    assert R.database_file(spark, f"{tmp_path}/x.duckdb", "select id from t;").count() == 2


def test_failed_export_changes_nothing(spark, tmp_path):
    good = Relation(spark.range(2).toDF("id"), "g")
    X.export({f"{tmp_path}/a.csv": good})
    before = open(f"{tmp_path}/a.csv").read()
    bad = Relation(spark.range(1).select(F.raise_error(F.lit("no")).alias("id")), "b")
    with pytest.raises(Exception):
        X.export({f"{tmp_path}/a.csv": Relation(spark.range(9).toDF("id"), "g"), f"{tmp_path}/b.csv": bad})
    assert open(f"{tmp_path}/a.csv").read() == before and sorted(x.name for x in tmp_path.iterdir()) == ["a.csv"]


def test_charts(spark, tmp_path):
    D = datetime.date
    rows = [(D(2024, 1, 1), 5.0, "a", False), (D(2024, 1, 3), None, "a", False), (D(2024, 2, 1), 2.0, "a", False), (D(2024, 1, 1), 1.0, "b", False), (None, 1.0, "b", False)]
    r = Relation(spark.createDataFrame(rows, "day date, n double, kind string, t boolean"), "r")
    path = f"{tmp_path}/c.svg"
    assert X.write_svg(r, path, "line", "day", "n", series="kind", width=800, height=300) == ["1 rows without a value are not in the chart"]
    svg = open(path).read()
    assert 'viewBox="0 0 800 300"' in svg and svg.count("<polyline") == 3  # a gap cuts the first series
    steps = Relation(spark.createDataFrame([(1, "start", 10.0, False), (2, "loss", -4.0, False), (3, "end", None, True)], "i int, step string, n double, t boolean"), "s", sort=(("i", False),))
    assert X.write_svg(steps, path, "waterfall", "step", "n", total="t") == []
    tall = [float(x) for x in re.findall(r'<rect [^>]*height="([0-9.]+)"', open(path).read())]
    assert len(tall) == 3 and abs(tall[2] - tall[0] * 0.6) < 0.1 and abs(tall[1] - tall[0] * 0.4) < 0.1
    assert X.write_svg(r, path, "bar", "day", "n", series="kind") and open(path).read().count("<rect") == 3
    for bad in (dict(kind="pie", series="kind"), dict(kind="bar", width=10), dict(kind="bar", total="t"), dict(kind="bar", y="kind"), dict(kind="dots")):
        with pytest.raises(AnalysisError, match="L508"):
            X.write_svg(r, path, **{"x": "day", "y": "n", **bad})
    with pytest.raises(RunError, match="L509"):
        X.write_svg(r, path, "bar", "day", "n")


def test_rows_of_several_files_are_numbered_by_name(spark, tmp_path):
    """Larger files are read first, blank lines and each file's header don't count; the orders' files are written by several tasks."""
    import glob
    from ledgerloom.queries import language

    at = 0
    for i, n in enumerate((3, 5000, 0, 40)):
        (tmp_path / f"part-{i}.csv").write_text("id,_file\n" + "".join(f"{k},x\n\n" for k in range(at, at + n)))
        at += n
    got = R.csv(spark, str(tmp_path), row_number="line").collect()
    assert len(got) == 5043 and all(r.line == int(r.id) + 1 and r._file == "x" for r in got)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        path = language._as_text(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset(key)
    assert len(glob.glob(f"{path}/part-*")) > 1
    assert all(r.line == int(r.o_orderkey) + 1 for r in R.csv(spark, path, row_number="line").collect())
