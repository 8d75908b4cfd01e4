"""Queries that go through the language, the file readers, the sinks and the commands, each with its SQL on the tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog import query
from ledgerloom.errors import RunError
from ledgerloom.lang.program import Program
from ledgerloom.plans import compare
from ledgerloom.plans.scratch import Scratch
from ledgerloom.relation import Relation
from ledgerloom.sources import exports as X
from ledgerloom.sources import readers as R


def _program(spark: SparkSession, text: str, **paths: str) -> Program:
    for name, path in paths.items():
        text = text.replace(f"${name}", path)
    return Program.from_text(spark, text)


def _written(spark: SparkSession, df: DataFrame, how: str = "csv") -> str:
    """A folder with the rows as files of text, written by Spark's tasks."""
    path = f"{Scratch(spark, 'files').root}/{how}"
    getattr(df.write.option("header", True) if how == "csv" else df.write, how)(path)
    return path


def _folder(spark: SparkSession) -> str:
    """A shared folder that this process can write, for the sinks that make one file."""
    path = Scratch(spark, "exports").root
    path = path[path.index(":") + 1 :] if path.startswith("file:") else path
    if "://" in path:
        raise RunError("L200", "single files are written to a mounted folder")
    path = "/" + path.lstrip("/")
    os.makedirs(path, exist_ok=True)
    return path


_ORDERS = """
source orders = parquet("$d/orders.parquet") { identity o_orderkey }
source customers = parquet("$d/customer.parquet") { identity c_custkey }
dataset priced = orders |> derive { price = to_decimal(o_totalprice, 18, 2)  y = year(o_orderdate) }
"""


@query("lang_pipeline", """
SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total, count(DISTINCT o_custkey) AS customers
FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) > 100000 AND o_orderstatus IN ('F', 'O') GROUP BY ALL
""")
def lang_pipeline(spark, d) -> DataFrame:
    text = _ORDERS + 'dataset out = priced |> filter price > 100000 and o_orderstatus in ["F", "O"] |> group by y, o_orderstatus |> aggregate { n = count()  total = sum(price)  customers = count_distinct(o_custkey) }'
    return _program(spark, text, d=d).relation("out").df


@query("lang_join_alias", """
SELECT o_orderkey, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000
""")
def lang_join_alias(spark, d) -> DataFrame:
    text = _ORDERS + "dataset rich = customers |> filter c_acctbal > 5000.0\ndataset out = orders |> left join rich as c on orders.o_custkey == c.c_custkey |> select o_orderkey, segment = c_mktsegment"
    return _program(spark, text, d=d).relation("out").df


@query("lang_window_sort_limit", """
SELECT o_custkey, o_orderkey, row_number() OVER w AS line, sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (w ROWS UNBOUNDED PRECEDING)::DECIMAL(38,2) AS so_far, lag(o_orderkey) OVER w AS before
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey) ORDER BY o_orderkey DESC LIMIT 500
""")
def lang_window_sort_limit(spark, d) -> DataFrame:
    text = _ORDERS + "dataset out = priced |> window partition by o_custkey order by o_orderkey { line = row_number()  so_far = running_sum(price)  before = lag(o_orderkey) } |> select o_custkey, o_orderkey, line, so_far, before |> sort o_orderkey desc |> limit 500"
    out = _program(spark, text, d=d).relation("out").df
    return out.withColumn("so_far", F.col("so_far").cast("decimal(38,2)"))


@query("lang_mapping_case", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'soon' ELSE 'later' END AS pace, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS said,
       CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, CAST(o_orderkey AS VARCHAR) AS shown, CAST(o_orderdate AS DATE) >= DATE '1997-01-01' AS late, CAST(o_totalprice AS DECIMAL(12,1)) AS rounded
FROM orders
""")
def lang_mapping_case(spark, d) -> DataFrame:
    text = _ORDERS + """mapping states { "F" => "done"  "O" => "open"  otherwise => original }
    dataset out = orders |> derive { said = map(o_orderstatus, states)  pace = case { o_orderpriority in ["1-URGENT", "2-HIGH"] => "soon"  otherwise => "later" }  parity = if(o_custkey % 2 == 0, "even", "odd")
        shown = to_string(o_orderkey)  late = to_date(o_orderdate) >= date("1997-01-01")  rounded = to_decimal(o_totalprice, 12, 1) }
        |> normalize o_orderstatus with states |> select o_orderkey, o_orderstatus, pace, said, parity, shown, late, rounded"""
    return _program(spark, text, d=d).relation("out").df


@query("lang_native_sql", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def lang_native_sql(spark, d) -> DataFrame:
    text = _ORDERS + 'dataset out = native_sql { inputs: [orders]  query: "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1" }'
    return _program(spark, text, d=d).relation("out").df


_CSV = """
source o = csv("$f") { row_number: line  identity [o_orderkey]  schema { o_orderkey: int, o_custkey: int, day: date("%d.%m.%Y")?, price: decimal(18,2), note: string? } }
dataset out = o |> select o_orderkey, line, o_custkey, day, price, note
"""


def _as_text(spark, d) -> str:
    """Orders as CSV files that follow each other in the order of keys; every seventh has a day that is none, notes hold quotes and commas."""
    o = spark.read.parquet(f"{d}/orders.parquet").orderBy("o_orderkey")
    day = F.when(F.col("o_orderkey") % 7 == 0, F.lit("31.02.2024")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('say "'), "o_orderstatus", F.lit('", twice')))
    rows = o.select("o_orderkey", "o_custkey", day.alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), note.alias("note"))
    path = f"{Scratch(spark, 'files').root}/csv"
    rows.write.option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)
    return path


@query("lang_csv_typed", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS line, o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS price,
       CASE WHEN o_orderkey % 3 = 0 THEN 'say "' || o_orderstatus || '", twice' END AS note FROM orders
""")
def lang_csv_typed(spark, d) -> DataFrame:
    return _program(spark, _CSV, f=_as_text(spark, d)).relation("out").df


@query("lang_csv_rejects", """
SELECT line AS row, 'day' AS "column", 'date' AS expected, '31.02.2024' AS value FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS line FROM orders) WHERE o_orderkey % 7 = 0
""")
def lang_csv_rejects(spark, d) -> DataFrame:
    return _program(spark, _CSV, f=_as_text(spark, d)).relation("o.rejects").df


@query("lang_csv_inferred", "SELECT c_custkey AS id, c_name AS name, c_nationkey::BIGINT AS nation, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer")
def lang_csv_inferred(spark, d) -> DataFrame:
    """Several files of one folder, types from the text."""
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").cast("decimal(18,2)").alias("balance"))
    return _program(spark, 'source c = csv("$f")', f=_written(spark, rows.repartition(4))).relation("c").df


@query("lang_csv_section", "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def lang_csv_section(spark, d) -> DataFrame:
    """The second table of a file, behind a title and before a footer."""
    rows = spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").select(F.concat_ws(";", "n_nationkey", F.concat(F.lit('"'), "n_name", F.lit('"'))).alias("value"))
    make = lambda *lines: spark.createDataFrame([(x,) for x in lines], "value string")
    path = _written(spark, make("Nations; all of them", "", "id;name").coalesce(1).unionByName(rows.coalesce(1)).unionByName(make("", "end;0").coalesce(1)).coalesce(1), "text")
    return _program(spark, 'source n = csv("$f") { section: 2  delimiter: ";" }', f=path).relation("n").df


@query("source_fixed_width", "SELECT o_orderkey AS id, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders")
def source_fixed_width(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("decimal(18,0)").cast("string")
    lines = o.select(F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.rpad("o_orderstatus", 3, " "), F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(cents, 14, "0")).alias("value"))
    layout = [("id", 1, 12, "N"), ("status", 13, 3, "A"), ("day", 16, 8, "D"), ("price", 24, 14, "M")]
    raw = R.fixed_width(spark, _written(spark, lines, "text"), layout)
    return raw.select(F.col("id").cast("long").alias("id"), "status", F.col("day").cast("date").alias("day"), F.col("price").cast("decimal(18,2)").alias("price"))


def _nations(spark, d) -> Relation:
    n = spark.read.parquet(f"{d}/nation.parquet")
    rows = n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 > 0, F.col("n_regionkey") / F.lit(4)).cast("decimal(10,2)").alias("share"), F.date_add(F.lit("2024-02-28").cast("date"), F.col("n_nationkey").cast("int")).alias("day"))
    return Relation(rows, "nations", ("id",), (("id", True),))


_NATIONS = "SELECT n_nationkey::BIGINT AS id, n_name AS name, CASE WHEN n_nationkey % 4 > 0 THEN CAST(n_regionkey / 4.0 AS DECIMAL(10,2)) END AS share, CAST(DATE '2024-02-28' + n_nationkey AS DATE) AS day FROM nation"


def _typed(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("id"), "name", F.nullif(F.col("share").cast("string"), F.lit("")).cast("decimal(10,2)").alias("share"), F.col("day").cast("date").alias("day"))


@query("sink_csv", _NATIONS)
def sink_csv(spark, d) -> DataFrame:
    path = f"{_folder(spark)}/n.csv"
    X.export({path: _nations(spark, d)})
    return _typed(R.csv(spark, path))


@query("sink_json", _NATIONS)
def sink_json(spark, d) -> DataFrame:
    path = f"{_folder(spark)}/n.json"
    X.export({path: _nations(spark, d)})
    return _typed(spark.read.json(path, multiLine=True))


@query("sink_jsonl", _NATIONS)
def sink_jsonl(spark, d) -> DataFrame:
    path = f"{_folder(spark)}/n.jsonl"
    X.export({path: _nations(spark, d)})
    return _typed(spark.read.json(path))


@query("sink_parquet", _NATIONS)
def sink_parquet(spark, d) -> DataFrame:
    path = f"{_folder(spark)}/n.parquet"
    X.export({path: _nations(spark, d)})
    return R.parquet(spark, path)


@query("sink_database", _NATIONS)
def sink_database(spark, d) -> DataFrame:
    path = f"{_folder(spark)}/n.duckdb"
    X.export({path: {"nations": _nations(spark, d)}})
    return R.database_file(spark, path, "SELECT * FROM nations")


@query("sink_spreadsheet", _NATIONS)
def sink_spreadsheet(spark, d) -> DataFrame:
    path = f"{_folder(spark)}/n.xlsx"
    X.export({path: {"Nations": _nations(spark, d)}})
    return _typed(R.excel(spark, path, "Nations"))


@query("lang_exports", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def lang_exports(spark, d) -> DataFrame:
    """A program's run: checks, then its files; one is read back."""
    folder = _folder(spark)
    text = _ORDERS + """dataset per = orders |> group by o_orderstatus |> aggregate { n = count() } |> sort n desc
    validate per { require n > 0  require o_orderstatus not null }
    chart c = per { kind: bar  x: o_orderstatus  y: n }
    export per to "$f/per.csv"
    export per to "$f/per.xlsx" { sheet: "P" }
    export c to "$f/per.svg" """
    program = _program(spark, text, d=d, f=folder)
    failed = program.run()
    if any(failed.values()) or sorted(os.listdir(folder)) != ["per.csv", "per.svg", "per.xlsx"]:
        raise RunError("L500", "the run did not write its files")
    return R.csv(spark, f"{folder}/per.csv").select("o_orderstatus", F.col("n").cast("long").alias("n"))


_CHECKS = _ORDERS + 'validate priced { require price > 0 as "paid"  expect unique(o_custkey) as "single"  warn count() < 10 as "small" }'


@query("lang_checks", """
SELECT 'paid' AS "check", 'require' AS severity, CASE WHEN f = 0 THEN 'pass' ELSE 'fail' END AS status, f AS failing_rows, n AS total_rows, NULL::VARCHAR AS measured FROM (SELECT count(*) FILTER (CAST(o_totalprice AS DECIMAL(18,2)) <= 0) AS f, count(*) AS n FROM orders)
UNION ALL SELECT 'single', 'expect', CASE WHEN coalesce(sum(k) FILTER (k > 1), 0) = 0 THEN 'pass' ELSE 'fail' END, coalesce(sum(k) FILTER (k > 1), 0)::BIGINT, sum(k)::BIGINT, NULL FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey)
UNION ALL SELECT 'small', 'warn', CASE WHEN count(*) < 10 THEN 'pass' ELSE 'fail' END, NULL, count(*), count(*)::VARCHAR FROM orders
""")
def lang_checks(spark, d) -> DataFrame:
    return _program(spark, _CHECKS, d=d).relation("priced.checks").df


@query("lang_failures", "SELECT o_orderkey, 'single' AS \"check\", 'expect' AS severity FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def lang_failures(spark, d) -> DataFrame:
    return _program(spark, _CHECKS, d=d).relation("priced.failures").df.select("o_orderkey", "check", "severity")


_BOOKS = """
source orders = parquet("$d/orders.parquet") { identity o_orderkey }
source lines = parquet("$d/lineitem.parquet")
dataset bank = orders |> derive { amount = to_decimal(o_totalprice, 18, 2) }
dataset book = lines |> group by l_orderkey |> aggregate { n = count() }
reconcile rec = bank as bank with book as book {
    identity book: [l_orderkey]
    block by bank.o_orderkey == book.l_orderkey
    evidence { n = book.n }
    flag many when book.n > 4
    tier large { require bank.amount >= 200000 }
    tier rest { }
}
"""
_LINES = "(SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)"
_BIG = "CAST(o_totalprice AS DECIMAL(18,2)) >= 200000"


@query("lang_reconcile_matches", f"""
SELECT CASE WHEN {_BIG} THEN 'large' ELSE 'rest' END AS tier, o_orderkey AS bank_o_orderkey, l_orderkey AS book_l_orderkey, n, n > 4 AS many, CASE WHEN n > 4 THEN 'many' ELSE '' END AS flags,
       1::BIGINT AS candidates_a, 1::BIGINT AS candidates_b, CAST(o_totalprice AS DECIMAL(18,2)) AS bank_amount, n AS book_n FROM orders JOIN {_LINES} ON o_orderkey = l_orderkey
""")
def lang_reconcile_matches(spark, d) -> DataFrame:
    out = _program(spark, _BOOKS, d=d).relation("rec.matches").df
    return out.select("tier", "bank_o_orderkey", "book_l_orderkey", "n", "many", "flags", F.col("candidates_a").cast("long").alias("candidates_a"), F.col("candidates_b").cast("long").alias("candidates_b"), "bank_amount", "book_n")


@query("lang_reconcile_unmatched", "SELECT 'unmatched' AS match_status, NULL::VARCHAR AS duplicate_of, o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
def lang_reconcile_unmatched(spark, d) -> DataFrame:
    return _program(spark, _BOOKS, d=d).relation("rec.unmatched_a").df.select("match_status", "duplicate_of", "o_orderkey")


@query("lang_reconcile_summary", f"""
WITH m AS (SELECT {_BIG} AS big FROM orders JOIN {_LINES} ON o_orderkey = l_orderkey), a AS (SELECT count(*) AS n FROM orders), b AS (SELECT count(*) AS n FROM {_LINES})
SELECT 1::BIGINT AS position, 'large' AS step, 0::BIGINT AS tier_index, count(*) AS pairs, count(*) AS a_rows, count(*) AS b_rows FROM m WHERE big
UNION ALL SELECT 2, 'rest', 1, count(*), count(*), count(*) FROM m WHERE NOT big
UNION ALL SELECT 3, 'ambiguous', NULL, 0, 0, 0 UNION ALL SELECT 4, 'duplicate', NULL, 0, 0, 0
UNION ALL SELECT 5, 'unmatched', NULL, 0, a.n - (SELECT count(*) FROM m), b.n - (SELECT count(*) FROM m) FROM a, b
UNION ALL SELECT 6, 'total', NULL, (SELECT count(*) FROM m), a.n, b.n FROM a, b
""")
def lang_reconcile_summary(spark, d) -> DataFrame:
    return _program(spark, _BOOKS, d=d).relation("rec.summary").df


_TIES = """
source region = parquet("$d/region.parquet") { identity r_regionkey }
source nation = parquet("$d/nation.parquet") { identity n_nationkey }
reconcile rec = region as r with nation as n { tier same { require r.r_regionkey == n.n_regionkey and n.n_name is not null  rank by n.n_regionkey } }
"""


@query("lang_reconcile_ambiguous", """
WITH k AS (SELECT r_regionkey, r_regionkey AS r_r_regionkey, n_nationkey AS n_n_nationkey, n_name AS n_n_name, count(*) OVER (PARTITION BY r_regionkey) AS c FROM region JOIN nation ON r_regionkey = n_regionkey)
SELECT dense_rank() OVER (ORDER BY r_regionkey) AS ambiguity_id, r_r_regionkey::BIGINT AS r_r_regionkey, n_n_nationkey::BIGINT AS n_n_nationkey, n_n_name, 1::BIGINT AS candidate_rank FROM k WHERE c > 1
""")
def lang_reconcile_ambiguous(spark, d) -> DataFrame:
    out = _program(spark, _TIES, d=d).relation("rec.ambiguous").df
    return out.select("ambiguity_id", "r_r_regionkey", "n_n_nationkey", "n_n_name", F.col("candidate_rank").cast("long").alias("candidate_rank"))


@query("lang_reconcile_candidates", """
WITH k AS (SELECT r_regionkey, n_nationkey, count(*) OVER (PARTITION BY r_regionkey) AS c FROM region JOIN nation ON r_regionkey = n_regionkey)
SELECT r_regionkey::BIGINT AS r_r_regionkey, n_nationkey::BIGINT AS n_n_nationkey, CASE WHEN c > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome, c AS candidates_a, 1::BIGINT AS candidates_b FROM k
""")
def lang_reconcile_candidates(spark, d) -> DataFrame:
    out = _program(spark, _TIES, d=d).relation("rec.candidates").df
    return out.select("r_r_regionkey", "n_n_nationkey", "outcome", *[F.col(c).cast("long").alias(c) for c in ("candidates_a", "candidates_b")])


@query("lang_trace", "SELECT * FROM (VALUES (1, 'out.total'), (2, '  priced.price'), (3, '    orders.o_totalprice')) t(line, node)")
def lang_trace(spark, d) -> DataFrame:
    program = _program(spark, _ORDERS + "dataset out = priced |> group by y |> aggregate { total = sum(price) }", d=d)
    return spark.createDataFrame([(i, x) for i, x in enumerate(program.trace("out", "total"), 1)], "line int, node string")


@query("lang_schema", """
SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'), ('o_totalprice', 'double'), ('o_orderdate', 'timestamp_ntz'), ('o_orderpriority', 'string'), ('price', 'decimal(18,2)'), ('y', 'bigint')) t(name, type)
""")
def lang_schema(spark, d) -> DataFrame:
    return spark.createDataFrame(_program(spark, _ORDERS, d=d).relation("priced").df.dtypes, "name string, type string")


@query("snapshot_diff", """
WITH a AS (SELECT o_custkey, o_orderstatus FROM orders), b AS (SELECT o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders),
n AS (SELECT o_custkey, o_orderstatus, sum(w) AS n FROM (SELECT *, -1 AS w FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY ALL)
SELECT 'orders' AS relation, coalesce(sum(n) FILTER (n > 0), 0)::BIGINT AS added, coalesce(sum(-n) FILTER (n < 0), 0)::BIGINT AS removed FROM n
""")
def snapshot_diff(spark, d) -> DataFrame:
    """Two snapshots of one program's relation, the second after a change in the data."""
    root = Scratch(spark, "snapshots").root
    o = spark.read.parquet(f"{d}/orders.parquet")
    compare.snapshot(spark, f"{root}/1", {"orders": Relation(o.select("o_custkey", "o_orderstatus"), "orders")})
    compare.snapshot(spark, f"{root}/2", {"orders": Relation(o.select("o_custkey", F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")), "orders")})
    found = compare.diff_snapshots(spark, f"{root}/1", f"{root}/2")
    return spark.createDataFrame([(n, x["added"], x["removed"]) for n, x in found.items()], "relation string, added long, removed long")
