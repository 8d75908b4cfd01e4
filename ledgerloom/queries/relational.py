"""Queries for steps, joins, aggregates, windows and functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.catalog import query
from ledgerloom.functions import aggregate as A
from ledgerloom.functions import scalar as S
from ledgerloom.operators import steps as P
from ledgerloom.relation import Relation

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str, identity: tuple[str, ...] = ()) -> Relation:
    """A source table; the language's int is 64 bits wide."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wide = {f.name: F.col(f.name).cast("long") for f in df.schema if f.dataType.simpleString() in ("int", "smallint", "tinyint")}
    return Relation(df.withColumns(wide) if wide else df, name=name, identity=identity)


@query("filter_project_derive", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_quantity AS BIGINT) AS DECIMAL(38,2)) AS gross,
       CAST(l_quantity AS BIGINT) > 25 AS big
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_discount IS NOT NULL
""")
def filter_project_derive(spark, d) -> DataFrame:
    r = P.filter_(table(spark, d, "lineitem"), (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & F.col("l_discount").isNotNull())
    r = P.derive(r, qty=F.col("l_quantity").cast("long"), gross=(F.col("l_extendedprice").cast(MONEY) * F.col("qty")).cast("decimal(38,2)"), big=F.col("qty") > 25)
    return P.select(r, "l_orderkey", "l_linenumber", "gross", "big").df


@query("rename_drop_select", "SELECT n_nationkey::BIGINT AS id, n_name AS nation FROM nation")
def rename_drop_select(spark, d) -> DataFrame:
    return P.drop(P.rename(table(spark, d, "nation", ("n_nationkey",)), n_nationkey="id", n_name="nation"), "n_regionkey").df


@query("group_aggregate_all", """
SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total, min(o_orderdate) AS first_day, max(o_orderkey) AS last_key,
       count(*) AS n, count(DISTINCT o_custkey) AS customers, bool_or(o_orderstatus = 'F') AS any_f, bool_and(o_totalprice > 0) AS all_positive,
       avg(CASE WHEN o_orderstatus IS NULL OR trim(o_orderstatus) = '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS gone, avg(CAST(o_custkey AS DOUBLE)) AS mean_key
FROM orders GROUP BY 1
""")
def group_aggregate_all(spark, d) -> DataFrame:
    r = P.derive(table(spark, d, "orders"), price=F.col("o_totalprice").cast(MONEY))
    return P.aggregate(
        r, ("o_orderpriority",), total=A.sum_(F.col("price"), r.type_of("price")), first_day=F.min("o_orderdate"), last_key=F.max("o_orderkey"), n=A.count(),
        customers=A.count_distinct(F.col("o_custkey")), any_f=A.any_(F.col("o_orderstatus") == "F"), all_positive=A.all_(F.col("o_totalprice") > 0),
        gone=A.missing(F.col("o_orderstatus")), mean_key=A.mean(F.col("o_custkey")),
    ).df


@query("having_via_filter", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 3")
def having_via_filter(spark, d) -> DataFrame:
    return P.filter_(P.aggregate(table(spark, d, "orders"), ("o_custkey",), n=A.count()), F.col("n") > 3).df


@query("global_aggregate", "SELECT count(*) AS n, count(o_custkey) AS keyed, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders")
def global_aggregate(spark, d) -> DataFrame:
    r = table(spark, d, "orders")
    return P.aggregate(r, n=A.count(), keyed=A.count(F.col("o_custkey")), keys=A.sum_(F.col("o_custkey"), r.type_of("o_custkey"))).df


@query("aggregate_arithmetic", """
SELECT l_returnflag, CASE WHEN sum(CAST(l_quantity AS BIGINT)) = 0 THEN NULL ELSE CAST(count(*) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) END AS per_unit
FROM lineitem GROUP BY 1
""")
def aggregate_arithmetic(spark, d) -> DataFrame:
    return P.aggregate(table(spark, d, "lineitem"), ("l_returnflag",), per_unit=S.divide(F.count("*"), F.sum(F.col("l_quantity").cast("long")))).df


@query("sort_limit_topk", """
SELECT c_custkey, c_name, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer
ORDER BY balance DESC NULLS LAST, c_custkey NULLS LAST, c_name NULLS LAST LIMIT 25
""")
def sort_limit_topk(spark, d) -> DataFrame:
    r = P.select(table(spark, d, "customer"), "c_custkey", "c_name", balance=F.col("c_acctbal").cast(MONEY))
    return P.limit(P.sort(r, "-balance"), 25).df


@query("distinct_rows", "SELECT DISTINCT p_brand, CAST(p_size AS BIGINT) AS p_size FROM part")
def distinct_rows(spark, d) -> DataFrame:
    return P.distinct(P.select(table(spark, d, "part"), "p_brand", "p_size")).df


@query("union_by_name", """
SELECT CAST(n_nationkey AS DECIMAL(20,2)) AS k, n_name AS name FROM nation UNION ALL SELECT CAST(r_regionkey + 0.25 AS DECIMAL(20,2)), r_name FROM region
""")
def union_by_name(spark, d) -> DataFrame:
    a = P.select(table(spark, d, "nation"), k="n_nationkey", name="n_name")
    b = P.select(table(spark, d, "region"), NAME="r_name", K=(F.col("r_regionkey") + F.lit(0.25).cast("decimal(3,2)")).cast("decimal(12,2)"))
    return P.union(a, b).df


@query("normalize_mapping", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE o_orderpriority END AS o_orderpriority,
       CASE WHEN o_orderstatus IN ('F') THEN 'final' END AS status FROM orders
""")
def normalize_mapping(spark, d) -> DataFrame:
    r = P.normalize(table(spark, d, "orders"), "o_orderpriority", {("1-URGENT", "2-HIGH"): "high", "5-LOW": "low"}, keep_original=True)
    return P.select(r, "o_orderkey", "o_orderpriority", status=S.mapped(F.col("o_orderstatus"), {"F": "final"})).df


@query("join_inner_using", "SELECT n.n_nationkey::BIGINT AS key, n_name, r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def join_inner_using(spark, d) -> DataFrame:
    n = P.rename(table(spark, d, "nation"), n_regionkey="region")
    j = P.join(n, P.rename(table(spark, d, "region"), r_regionkey="region"), ("region",))
    return P.select(j, "n_name", "r_name", key="n_nationkey").df


_ORDERS = "(SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 7 = 0)"


def _some_orders(spark, d) -> Relation:
    return P.filter_(P.select(table(spark, d, "orders"), "o_custkey", "o_orderkey"), F.col("o_orderkey") % 7 == 0)


def _customers(spark, d) -> Relation:
    return P.filter_(P.select(table(spark, d, "customer"), "c_custkey", "c_name"), F.col("c_custkey") % 3 == 0)


for _how in ("left", "right", "full"):
    @query(f"join_{_how}", f"""
    SELECT coalesce({'o_custkey, c_custkey' if _how == 'right' else 'c_custkey, o_custkey'}) AS cust, c_name, o_orderkey
    FROM (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0) c {_how.upper()} JOIN {_ORDERS} o ON c_custkey = o_custkey
    """)
    def _join(spark, d, how=_how) -> DataFrame:
        return P.join(P.rename(_customers(spark, d), c_custkey="cust"), P.rename(_some_orders(spark, d), o_custkey="cust"), ("cust",), how).df


@query("join_theta", """
SELECT a.n_name AS nation_n_name, b.n_name AS o_n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
""")
def join_theta(spark, d) -> DataFrame:
    n = table(spark, d, "nation")
    j = P.join(n, n, (F.col("nation.n_regionkey") == F.col("o.n_regionkey")) & (F.col("nation.n_nationkey") < F.col("o.n_nationkey")), alias="o")
    return P.select(j, "nation_n_name", "o_n_name").df


@query("join_cross_totals", """
SELECT r_name, n FROM region, (SELECT count(*) AS n FROM nation) t
""")
def join_cross_totals(spark, d) -> DataFrame:
    totals = Relation(P.aggregate(table(spark, d, "nation"), n=A.count()).df, name="totals")
    return P.select(P.join(table(spark, d, "region"), totals, True), "r_name", "n").df


@query("join_semi", f"SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {_ORDERS})")
def join_semi(spark, d) -> DataFrame:
    return P.semi(P.select(table(spark, d, "customer"), "c_custkey"), P.rename(_some_orders(spark, d), o_custkey="c_custkey"), ("c_custkey",)).df


@query("join_anti", f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM {_ORDERS})")
def join_anti(spark, d) -> DataFrame:
    return P.semi(P.select(table(spark, d, "customer"), "c_custkey"), P.rename(_some_orders(spark, d), o_custkey="c_custkey"), ("c_custkey",), anti=True).df


def _asof_sides(spark, d) -> tuple[Relation, Relation]:
    e = table(spark, d, "events", ("event_id",))
    probes = P.select(P.filter_(e, F.col("event_id") % 5 == 0), "event_id", "user_id", "ts")
    facts = e.df.filter(F.col("event_id") % 5 != 0).groupBy("user_id", F.col("ts").alias("at")).agg(F.min("event_id").alias("seen"))
    return probes, Relation(facts, name="facts", identity=("user_id", "at"))


_FACTS = "(SELECT user_id, ts AS at, min(event_id) AS seen FROM events WHERE event_id % 5 <> 0 GROUP BY ALL)"
_PROBES = "(SELECT event_id, user_id, ts FROM events WHERE event_id % 5 = 0 AND ts IS NOT NULL)"
for _name, _op, _left in (("asof_join", ">=", False), ("asof_strict", ">", False), ("asof_forward", "<=", False), ("asof_left_join", ">=", True)):
    @query(_name, f"SELECT p.event_id, p.ts, f.at, f.seen FROM {_PROBES} p ASOF {'LEFT ' if _left else ''}JOIN {_FACTS} f ON p.user_id = f.user_id AND p.ts {_op} f.at")
    def _asof(spark, d, op=_op, left=_left) -> DataFrame:
        probes, facts = _asof_sides(spark, d)
        return P.select(P.asof(probes, facts, (("user_id", "user_id"),), ("ts", op, "at"), left), "event_id", "ts", "at", "seen").df


# the same over whole tables; every order has its customer, so semi and anti joins ask for orders with and without lines
for _how in ("left", "right", "full"):
    @query(f"join_{_how}_whole", f"""
    SELECT coalesce({'o_custkey, c_custkey' if _how == 'right' else 'c_custkey, o_custkey'}) AS cust, c_name, o_orderkey FROM customer {_how.upper()} JOIN orders ON c_custkey = o_custkey
    """)
    def _join_whole(spark, d, how=_how) -> DataFrame:
        c = P.select(table(spark, d, "customer"), "c_name", cust="c_custkey")
        return P.join(c, P.select(table(spark, d, "orders"), "o_orderkey", cust="o_custkey"), ("cust",), how).df


for _kind, _not in (("semi", ""), ("anti", "NOT ")):
    @query(f"join_{_kind}_whole", f"SELECT o_orderkey FROM orders WHERE {_not}EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
    def _semi_whole(spark, d, anti=_kind == "anti") -> DataFrame:
        return P.semi(P.select(table(spark, d, "orders"), "o_orderkey"), P.select(table(spark, d, "lineitem"), o_orderkey="l_orderkey"), ("o_orderkey",), anti=anti).df


for _name, _op, _left in (("asof_join", ">=", False), ("asof_strict", ">", False), ("asof_forward", "<=", False), ("asof_left_join", ">", True)):
    @query(f"{_name}_whole", f"""
    SELECT p.event_id, p.ts, f.at, f.seen FROM events p ASOF {'LEFT ' if _left else ''}JOIN (SELECT user_id, ts AS at, min(event_id) AS seen FROM events GROUP BY ALL) f
    ON p.user_id = f.user_id AND p.ts {_op} f.at
    """)
    def _asof_whole(spark, d, op=_op, left=_left) -> DataFrame:
        e = table(spark, d, "events", ("event_id",))
        facts = Relation(e.df.groupBy("user_id", F.col("ts").alias("at")).agg(F.min("event_id").alias("seen")), name="facts", identity=("user_id", "at"))
        return P.select(P.asof(P.select(e, "event_id", "user_id", "ts"), facts, (("user_id", "user_id"),), ("ts", op, "at"), left), "event_id", "ts", "at", "seen").df


_TIES = "o_orderkey NULLS LAST, o_orderstatus NULLS LAST, price NULLS LAST, o_orderdate NULLS LAST"


@query("window_ordered", f"""
SELECT o_orderkey, row_number() OVER w AS n, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST) AS r,
       dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST) AS dr, lag(price) OVER w AS before, lead(price, 2) OVER w AS after2,
       CAST(sum(price) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, {_TIES} ROWS UNBOUNDED PRECEDING) AS DECIMAL(28,2)) AS so_far
FROM (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderdate FROM orders)
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, {_TIES})
""")
def window_ordered(spark, d) -> DataFrame:
    r = P.select(table(spark, d, "orders"), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", price=F.col("o_totalprice").cast(MONEY))
    r = P.window(r, ("o_custkey",), ("-o_orderdate",), n=("row_number",), r=("rank",), dr=("dense_rank",), before=("lag", "price"), after2=("lead", "price", 2), so_far=("running_sum", "price"))
    return P.select(r, "o_orderkey", "n", "r", "dr", "before", "after2", "so_far").df


@query("window_whole_partition", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS total, avg(CAST(l_quantity AS DOUBLE)) OVER w AS average,
       min(l_shipdate) OVER w AS first_ship, max(l_shipdate) OVER w AS last_ship, count(*) OVER w AS n
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)
""")
def window_whole_partition(spark, d) -> DataFrame:
    r = P.derive(table(spark, d, "lineitem"), q=F.col("l_quantity").cast("long"))
    r = P.window(r, ("l_orderkey",), total=("sum", "q"), average=("mean", "q"), first_ship=("min", "l_shipdate"), last_ship=("max", "l_shipdate"), n=("count",))
    return P.select(r, "l_orderkey", "l_linenumber", "total", "average", "first_ship", "last_ship", "n").df


@query("text_functions", r"""
SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, trim(concat('  ', p_name, ' ')) AS tr, strip_accents(concat(p_name, ' éÜñçø')) AS plain, replace(p_name, 'e', '_') AS rep,
       concat(p_brand, NULL, '/', p_size) AS cat, contains(p_name, 'al') AS has, starts_with(p_name, 'a') AS st, suffix(p_name, 'n') AS en, length(p_name) AS len,
       substring(p_name, 2, 3) AS sub, substring(p_name, -3) AS tail, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 4, '*') AS rp,
       regexp_replace(p_name, '([aeiou])([a-z])', '\2\1', 'g') AS swapped, nullif(regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2), '') AS second, regexp_matches(p_type, '[A-Z]') AS caps
FROM part
""")
def text_functions(spark, d) -> DataFrame:
    c, r = F.col, table(spark, d, "part")
    return P.select(
        r, "p_partkey", lo=F.lower("p_name"), up=F.upper("p_name"), tr=F.trim(S.concat(F.lit("  "), c("p_name"), F.lit(" "))), plain=S.strip_accents(S.concat(c("p_name"), F.lit(" éÜñçø"))),
        rep=F.replace("p_name", F.lit("e"), F.lit("_")), cat=S.concat(c("p_brand"), F.lit(None), F.lit("/"), c("p_size")), has=F.contains("p_name", F.lit("al")),
        st=F.startswith("p_name", F.lit("a")), en=F.endswith("p_name", F.lit("n")), len=F.length("p_name").cast("long"), sub=S.substr(c("p_name"), F.lit(2), F.lit(3)),
        tail=S.substr(c("p_name"), F.lit(-3)), lp=F.lpad("p_brand", 12, "*"), rp=F.rpad("p_brand", 4, "*"), swapped=S.regexp_replace(c("p_name"), "([aeiou])([a-z])", r"\2\1"),
        second=S.regexp_extract(c("p_name"), "([a-z]+) ([a-z]+)", 2), caps=F.regexp_like("p_type", F.lit("[A-Z]")),
    ).df


@query("date_functions", """
SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, quarter(o_orderdate) AS q, isodow(o_orderdate) AS dow,
       date_diff('day', CAST(o_orderdate AS DATE), DATE '1995-06-17') AS signed, abs(date_diff('day', CAST(o_orderdate AS DATE), DATE '1995-06-17')) AS apart,
       CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS later, TRY_CAST(concat(year(o_orderdate), '-02-', 26 + o_orderkey % 5) AS DATE) AS made,
       CAST(try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS parsed
FROM orders
""")
def date_functions(spark, d) -> DataFrame:
    c, r = F.col("o_orderdate"), table(spark, d, "orders")
    day = c.cast("date")
    pivot = F.lit("1995-06-17").cast("date")
    fn = S.REGISTRY
    return P.select(
        r, "o_orderkey", y=fn["year"](c), m=fn["month"](c), dd=fn["day"](c), q=fn["quarter"](c), dow=fn["day_of_week"](c), signed=S.date_diff(day, pivot), apart=S.days_between(day, pivot),
        later=S.add_days(day, F.lit(30)), made=S.date(F.year(c), F.lit(2), 26 + F.col("o_orderkey") % 5), parsed=S.parse_date(F.date_format(c, "dd/MM/yyyy"), "%Y-%m-%d", "%d/%m/%Y"),
    ).df


@query("number_functions", r"""
SELECT c_custkey, abs(b) AS ab, CAST(round(b, 1) AS DECIMAL(18,1)) AS r1, CAST(floor(b) AS DECIMAL(17,0)) AS fl, CAST(ceil(b) AS DECIMAL(17,0)) AS ce,
       CAST(round(CAST(b AS DECIMAL(38,10))) AS BIGINT) AS i, TRY_CAST(CAST(b AS VARCHAR) AS DOUBLE) AS f, least(c_custkey, 50) AS lo, greatest(c_custkey, 50, NULL) AS hi,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey AS DOUBLE) / (c_custkey % 4) END AS q, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 17 % (c_custkey % 4) END AS md,
       CAST(replace(printf('%,.2f', CAST(b AS DOUBLE)), ',', '') AS DECIMAL(38,6)) AS back
FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) AS b FROM customer)
""")
def number_functions(spark, d) -> DataFrame:
    r = P.select(table(spark, d, "customer"), "c_custkey", b=F.col("c_acctbal").cast(MONEY))
    b, k = F.col("b"), F.col("c_custkey")
    return P.select(
        r, "c_custkey", ab=F.abs(b), r1=F.round(b, 1).cast("decimal(18,1)"), fl=S.floor(b, "decimal").cast("decimal(17,0)"), ce=S.ceil(b, "decimal").cast("decimal(17,0)"), i=S.to_int(b),
        f=S.to_float(S.to_string(b)), lo=S.least(k, F.lit(50).cast("long")), hi=S.greatest(k, F.lit(50).cast("long"), F.lit(None)), q=S.divide(k, k % 4), md=S.modulo(F.lit(17).cast("long"), k % 4),
        back=S.parse_number(F.format_number(b, 2)),
    ).df


@query("case_in_null", """
SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' WHEN o_totalprice > 20000 THEN 'middle' ELSE 'small' END AS size, o_orderstatus IN ('F', 'O') AS closed,
       o_orderstatus NOT IN ('F', NULL) AS unknown, nullif(o_orderstatus, 'F') AS no_f, coalesce(nullif(o_orderstatus, 'F'), 'was F') AS filled, nullif(o_orderstatus, 'F') IS NULL AS gone
FROM orders
""")
def case_in_null(spark, d) -> DataFrame:
    s, fn = F.col("o_orderstatus"), S.REGISTRY
    size = F.when(F.col("o_totalprice") > 100000, "large").when(F.col("o_totalprice") > 20000, "middle").otherwise("small")
    no_f = fn["nullif"](s, F.lit("F"))
    return P.select(table(spark, d, "orders"), "o_orderkey", size=size, closed=s.isin("F", "O"), unknown=~s.isin("F", None), no_f=no_f, filled=F.coalesce(no_f, F.lit("was F")), gone=fn["is_null"](no_f)).df


_PAIRS = "FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey"


#: Keys of one name that are a row of their own, and pairs of keys that a task makes.
KEYS, PAIRS = 512, 1 << 22


def _pairs(spark, d, value, name: str) -> DataFrame:
    """x, y and, as ``name``, the value of their names. It is computed once for each two names of a brand and size, with the keys of either in
    arrays; these are dealt out by the pairs that they make, as the table is small and its pairs are not. Large groups are split."""
    g = ["p_brand", "p_size"]
    p = table(spark, d, "part").df.select(*g, "p_name", "p_partkey").dropna(subset=[*g, "p_partkey"])
    made = p.groupBy(*g).count().agg(F.sum(F.col("count").cast("double") ** 2)).first()[0] or 0
    tasks = max(int(made / PAIRS) + 1, spark.sparkContext.defaultParallelism)
    at = F.row_number().over(Window.partitionBy(*g, "p_name").orderBy("p_partkey"))
    rows = p.withColumn("at", F.floor((at - 1) / KEYS)).groupBy(*g, "p_name", "at").agg(F.sort_array(F.collect_list("p_partkey")).alias("keys"))
    n = F.sum(F.size("keys")).over(Window.partitionBy(*g)).cast("double")
    rows = rows.withColumn("parts", F.ceil(n * n / PAIRS).cast("int"))
    a = rows.withColumn("part", F.pmod(F.hash("p_name", "at"), "parts")).drop("parts", "at").repartition(tasks, *g, "part").alias("a")
    b = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "at").repartition(tasks, *g, "part").alias("b")
    met = a.join(b.hint("merge"), [*g, "part"]).filter(F.col("a.keys")[0] < F.element_at("b.keys", -1))
    met = met.select(value(F.col("a.p_name"), F.col("b.p_name")).alias(name), F.explode("a.keys").alias("x"), F.col("b.keys").alias("ys"))
    return met.select("x", F.explode(F.filter("ys", lambda y: y > F.col("x"))).alias("y"), name)


@query("similarity_jaro_winkler", f"SELECT a.p_partkey AS x, b.p_partkey AS y, CAST(round(jaro_winkler_similarity(lower(a.p_name), lower(b.p_name)), 9) AS DECIMAL(12,9)) AS s {_PAIRS}")
def similarity_jaro_winkler(spark, d) -> DataFrame:
    return _pairs(spark, d, lambda a, b: F.round(S.similarity(a, b), 9).cast("decimal(12,9)"), "s")


@query("token_similarity", f"""
SELECT a.p_partkey AS x, b.p_partkey AS y, CAST(len(list_intersect(string_split(lower(a.p_name), ' '), string_split(lower(b.p_name), ' '))) AS DOUBLE)
       / len(list_distinct(list_concat(string_split(lower(a.p_name), ' '), string_split(lower(b.p_name), ' ')))) AS s {_PAIRS}
""")
def token_similarity(spark, d) -> DataFrame:
    return _pairs(spark, d, S.token_similarity, "s")


@query("levenshtein_bytes", f"SELECT a.p_partkey AS x, b.p_partkey AS y, levenshtein(concat(a.p_name, 'é'), b.p_name) AS n {_PAIRS}")
def levenshtein_bytes(spark, d) -> DataFrame:
    return _pairs(spark, d, lambda a, b: S.levenshtein(S.concat(a, F.lit("é")), b), "n")


@query("replace_words", """
SELECT p_partkey, array_to_string(list_transform(string_split(trim(regexp_replace(p_type, '\\s+', ' ', 'g')), ' '), lambda w: CASE WHEN w IN ('STEEL', 'TIN') THEN 'metal' ELSE w END), ' ') AS t FROM part
""".replace("\\\\", "\\"))
def replace_words(spark, d) -> DataFrame:
    return P.select(table(spark, d, "part"), "p_partkey", t=S.replace_words(F.col("p_type"), {("STEEL", "TIN"): "metal"})).df


@query("native_sql", "SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1")
def native_sql(spark, d) -> DataFrame:
    return P.native_sql(spark, "SELECT o_custkey, max(o_orderkey) AS last FROM {orders} GROUP BY 1", orders=table(spark, d, "orders")).df


@query("fill_down", """
SELECT event_id, last_value(CASE WHEN event_id % 7 = 0 THEN event_type END IGNORE NULLS) OVER (ORDER BY event_id) AS label FROM events
""")
def fill_down(spark, d) -> DataFrame:
    from ledgerloom.sources.contract import fill_down as fill

    e = table(spark, d, "events").df.select("event_id", F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise("  ").alias("label"))
    return fill(e, ["label"], "event_id")
