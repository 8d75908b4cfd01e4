import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import types as L
from ledgerloom.errors import AnalysisError
from ledgerloom.functions import scalar as S


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_text(spark):
    lit = F.lit
    assert one(spark, S.strip_accents(lit("Éàçñ ß æ ø ł"))) == "Eacn ß æ ø ł"
    assert one(spark, S.concat(lit("a"), lit(None), lit(1))) == "a1"
    assert one(spark, S.substr(lit("hello"), lit(0), lit(2))) == "h"
    assert one(spark, S.substr(lit("hello"), lit(2), lit(3))) == "ell"
    assert one(spark, S.substr(lit("hello"), lit(-3))) == "llo"
    assert one(spark, S.substr(lit("hello"), lit(2), lit(-1))) == "h"
    assert one(spark, S.regexp_replace(lit("ab ab"), "(a)(b)", r"\2\1$")) == "ba$ ba$"
    assert one(spark, S.regexp_extract(lit("abc"), "x(.)", 1)) is None
    assert one(spark, S.replace_words(lit(" big   red dog"), {"red": "blue", ("dog", "cat"): "pet"})) == "big blue pet"


def test_numbers(spark):
    lit = F.lit
    assert one(spark, S.parse_number(lit(" 1,234.5 "))) == decimal.Decimal("1234.500000")
    assert one(spark, S.parse_number(lit("1,23"))) is None
    assert [one(spark, S.to_int(lit(x))) for x in ("2.5", "-2.5", "abc")] == [3, -3, None]
    assert one(spark, S.to_int(lit(decimal.Decimal("2.5")))) == 3
    assert one(spark, S.divide(lit(1), lit(0))) is None and one(spark, S.modulo(lit(5), lit(0))) is None
    assert one(spark, S.floor(lit((1 << 53) + 1), "int")) == (1 << 53) + 1


def test_dates(spark):
    lit = F.lit
    assert one(spark, S.date(lit(2024), lit(2), lit(30))) is None
    assert one(spark, S.date(lit(2024), lit(2), lit(29))) == datetime.date(2024, 2, 29)
    assert one(spark, S.parse_date(lit(" 25/12/2026 "), "%Y-%m-%d", "%d/%m/%Y")) == datetime.date(2026, 12, 25)
    a, b = lit(datetime.date(2024, 1, 31)), lit(datetime.date(2024, 1, 1))
    assert one(spark, S.date_diff(a, b)) == -30 and one(spark, S.days_between(a, b)) == 30
    assert one(spark, S.REGISTRY["day_of_week"](lit(datetime.date(2024, 1, 1)))) == 1
    with pytest.raises(AnalysisError):
        S.java_format("%Q")


def test_similarity(spark):
    assert S.jaro_winkler(b"martha", b"marhta") == pytest.approx(0.961111, abs=1e-6)
    assert one(spark, S.similarity(F.lit(" A  b "), F.lit("a B"))) == 1.0
    assert one(spark, S.similarity(F.lit("  "), F.lit("a"))) is None
    assert one(spark, S.token_similarity(F.lit("a b c"), F.lit("c b d"))) == 0.5
    assert one(spark, S.levenshtein(F.lit("é"), F.lit("e"))) == 2


def test_types():
    dec = L.parse_type
    assert L.unify(L.INT, dec("decimal(10,2)")) == dec("decimal(20,2)")
    assert L.unify(dec("decimal(10,2)"), dec("decimal(12,5)")) == dec("decimal(13,5)")
    assert L.arithmetic("/", L.INT, L.INT) == L.FLOAT
    with pytest.raises(AnalysisError):
        L.unify(L.STRING, L.INT)
    with pytest.raises(AnalysisError):
        dec("decimal(39,2)")


def test_many_similarities_are_the_single_ones():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.choice([1, 2, 5, 9, 20, 70, 150]))).encode()
    xs = [word() for _ in range(600)]
    ys = [x if rnd.random() < 0.1 else (x[: len(x) // 2] + word()) if rnd.random() < 0.5 else word() for x in xs]
    assert S.jaro_winkler_many(xs, ys).tolist() == [S.jaro_winkler(x, y) for x, y in zip(xs, ys)]
    assert S.jaro_winkler_many([], []).tolist() == []


def test_pairs_of_large_groups_are_split(spark, tmp_path, monkeypatch):
    """Every pair of a group comes once, whichever task makes it; nothing waits for one table in each executor."""
    from ledgerloom.queries import relational as R

    parts = [(k, ("red bolt", "blue nut", None)[k % 3], "b", k % 2) for k in range(90)] + [(90, "red bolt", None, 0), (91, "ring", "c", 0)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(R, "PAIRS", 200)
    monkeypatch.setattr(R, "KEYS", 4)
    got = R.token_similarity(spark, str(tmp_path))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and got.rdd.getNumPartitions() > 8
    want = {(x[0], y[0]): None if None in (x[1], y[1]) else float(x[1] == y[1]) for x in parts for y in parts if x[2] and x[2:] == y[2:] and x[0] < y[0]}
    rows = got.collect()
    assert len(rows) == len(want) and {(r.x, r.y): r.s for r in rows} == want
