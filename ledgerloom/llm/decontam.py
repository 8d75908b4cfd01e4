"""Benchmark decontamination, in DataFrame functions only.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A window is n consecutive words of
a benchmark item; an item of fewer words, but not none, is one window. The benchmark's windows travel to the executors as hash
sets: first of one rare word per window (its longest), which says where a document's window can match at all, then of the
windows' whole text, so that every hit is verified by equality. Their number is checked; a larger benchmark is joined by
shuffle. Document words inside any occurrence are hit.

Defined cases: null texts have no words; repeated document rows give a row each; repeated items count once by id;
items with equal windows are all counted; an empty benchmark hits nothing; texts of any length are searched whole; find() replaces the
caller's columns n_words, spans, n_hit and items by its own, remove() keeps columns of any name.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: What separates words before upper case is folded, for Java's regular expressions.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
N = 10
#: The most distinct windows that are sent to every executor (under 10 MB of text).
SET_WINDOWS = 100_000
_SPANS = "array<struct<a:int,b:int>>"


def words(text: Column) -> Column:
    """The words of a text, A-Z folded. lower() is only right, and only fast, where a word is ASCII."""

    def fold(w: Column) -> Column:
        return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, ascii_uppercase, ascii_lowercase))

    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), lambda w: w != ""), fold)


def _key(w: Column, at: Column, size: int) -> Column:
    """The window of ``size`` words at the 0-based place ``at``. get() takes constant time, slice() would copy the array."""
    return F.concat_ws(" ", *[F.get(w, at + k) for k in range(size)])


def _windows(w: Column, size: int) -> Column:
    """(at, key, size) of every window of ``size`` words."""
    starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), _key(w, i, size).alias("key"), F.lit(size).alias("size")))


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", n: int = N) -> DataFrame:
    """key, size and items of the distinct windows."""
    b = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    short = b.filter(F.size("w") < n).select("item", F.array_join("w", " ").alias("key"), F.size("w").alias("size"))
    full = b.filter(F.size("w") >= n).select("item", F.explode(_windows(F.col("w"), n)).alias("x")).select("item", "x.key", "x.size")
    return full.unionByName(short).groupBy("key", "size").agg(F.collect_set("item").alias("items"))


def _hits_by_set(w: Column, windows: list[tuple[str, int]]) -> Column:
    """(at, key, size) of the occurrences of the given windows."""
    out = []
    for size in sorted({s for _, s in windows}):
        keys = [k for k, s in windows if s == size]
        rare = sorted({max(k.split(" "), key=lambda x: (len(x), x)) for k in keys})
        places = F.filter(F.transform(w, lambda x, i: F.when(x.isin(rare), i)), lambda i: i.isNotNull())
        last = F.size(w) - F.lit(size)

        def around(i: Column, size=size, last=last) -> Column:
            a, b = F.greatest(i - (size - 1), F.lit(0)), F.least(i, last)
            return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

        starts = F.array_distinct(F.flatten(F.transform(places, lambda i: around(i))))
        found = F.transform(starts, lambda i: F.struct(i.alias("at"), _key(w, i, size).alias("key"), F.lit(size).alias("size")))
        out.append(F.filter(found, lambda x: x["key"].isin(keys)))
    return F.concat(*out) if len(out) > 1 else out[0]


def _merge(hits: Column) -> Column:
    """Merged ranges [a, b) of the places that hits cover."""
    ranges = F.array_sort(F.transform(hits, lambda x: F.struct(x["at"].alias("a"), (x["at"] + x["size"]).alias("b"))))
    start = F.struct(F.array().cast(_SPANS).alias("done"), F.lit(0).alias("a"), F.lit(0).alias("b"))

    def closed(acc: Column) -> Column:
        return F.when(acc["b"] > acc["a"], F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b"))))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        joins = (x["a"] <= acc["b"]) & (acc["b"] > acc["a"])
        return F.struct(
            F.when(joins, acc["done"]).otherwise(closed(acc)).alias("done"),
            F.when(joins, acc["a"]).otherwise(x["a"]).alias("a"),
            F.when(joins, F.greatest(acc["b"], x["b"])).otherwise(x["b"]).alias("b"),
        )

    return F.aggregate(ranges, start, step, closed)


_NO_HITS = "array<struct<at:int,key:string,size:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once. As it is no column, no rule of the optimizer can put its expression into a lambda, where it
    would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(w: Column, hits: Column) -> Column:
    return _let(hits, lambda h: F.struct(F.size(w).alias("n_words"), h.alias("hits"), _merge(h).alias("spans")))


def _with_hits(docs: DataFrame, windows: DataFrame, text: str) -> tuple[DataFrame, str]:
    """docs with one column more, and its name: struct of n_words, hits and spans (merged ranges of hit words)."""
    few = windows.select("key", "size").limit(SET_WINDOWS + 1).collect()
    name = C.free_name(docs.columns, "found")
    nothing = F.array().cast(_NO_HITS)
    if len(few) <= SET_WINDOWS:
        hits = (lambda w: _hits_by_set(w, [(r["key"], r["size"]) for r in few])) if few else (lambda w: nothing)
        return docs.withColumn(name, _let(words(F.col(text)), lambda w: _found(w, hits(w)))), name
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # at most n
    mark, seen = C.free_name([*docs.columns, name], "mark"), C.free_name([*docs.columns, name, "mark"], "seen")
    marked = docs.withColumn(mark, C.text_print(F.col(text)))
    at = marked.select(F.col(mark).alias("p"), F.explode(_let(words(F.col(text)), lambda w: F.concat(*[_windows(w, s) for s in sizes]))).alias("x")).select("p", "x.*")
    at = at.join(windows.select("key", "size"), ["key", "size"], "left_semi").groupBy("p").agg(F.collect_set(F.struct("at", "key", "size")).alias(seen))
    rows = marked.join(at.withColumnRenamed("p", mark), mark, "left")
    found = _let(words(F.col(text)), lambda w: _found(w, F.coalesce(F.col(seen), nothing)))
    return rows.withColumn(name, found).drop(mark, seen), name


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = N) -> DataFrame:
    """docs without the text, with n_words, spans (merged hit ranges [a, b) of 0-based words), n_hit, items (sorted ids as text)."""
    scratch = C.Scratch(docs.sparkSession, "decontam")
    windows = scratch.keep(benchmark_windows(benchmark, n=n), "windows")
    rows, found = _with_hits(docs, windows, text)
    row = C.free_name([*rows.columns, "x", "item"], "row")
    rows = scratch.keep(rows.drop(text, "n_words", "spans", "n_hit", "items").withColumn(row, F.monotonically_increasing_id()), "rows")
    # few rows have hits; each hit is one of a window's occurrences, told apart by row before its items are gathered
    items = (
        rows.filter(F.size(f"{found}.hits") > 0).select(F.col(row).alias("r"), F.explode(F.array_distinct(F.transform(f"{found}.hits", lambda x: F.struct(x["key"], x["size"])))).alias("x")).select("r", "x.key", "x.size")
        .join(windows, ["key", "size"]).select("r", F.explode("items").alias("item")).distinct()
        .groupBy("r").agg(F.sort_array(F.collect_list("item")).alias("items")).withColumnRenamed("r", row)
    )
    out = rows.join(items, row, "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    out = out.withColumn("n_words", F.col(f"{found}.n_words")).withColumn("spans", F.col(f"{found}.spans")).drop(found, row)
    return out.withColumn("n_hit", F.aggregate("spans", F.lit(0), lambda s, x: s + x["b"] - x["a"]))


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", most: float = 0.5, n: int = N) -> DataFrame:
    """docs without the hit words, which go with the separators before them; a document of which more than the share ``most`` is hit goes whole."""
    scratch = C.Scratch(docs.sparkSession, "decontam")
    windows = scratch.keep(benchmark_windows(benchmark, n=n), "windows")
    rows, found = _with_hits(docs, windows, text)
    # a text splits behind each word, so that piece i ends with word i
    pieces = F.split(F.col(text), r"(?<=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", -1)

    def kept(f: Column) -> Column:
        """The document's text, or nothing."""
        hit = F.aggregate(f["spans"], F.lit(0), lambda s, x: s + x["b"] - x["a"])
        cut = F.array_join(F.filter(pieces, lambda p, i: ~F.exists(f["spans"], lambda s: (i >= s["a"]) & (i < s["b"]))), "")
        new = F.struct(F.when(hit > 0, cut).otherwise(F.col(text)).alias("left"))
        return F.when(hit <= F.lit(most) * f["n_words"], F.array(new)).otherwise(F.array().cast("array<struct<left:string>>"))

    left = C.free_name(rows.columns, "left")
    out = rows.withColumn(left, F.explode(_let(F.col(found), kept)))
    return out.select(*[F.col(f"{left}.left").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
