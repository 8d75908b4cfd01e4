"""Approximate nearest neighbours by inner product: a permutation index.

Every vector's direction is represented by the order of its nearest pivots, a bounded sample of the directions. In each block of the index
a pivot has an inverted file of the vectors that count it among their DEPTH nearest, with its place in their order. A query
adds up, over the inverted files of its own nearest pivots, the differences of places (footrule distance, an absent
pivot has place DEPTH). As the measure is the inner product, what a vector's places have in common with the query's counts by its
length: candidates are the SHARE of the block with the largest length times root of footrule similarity, which for vectors of one
length is the order of footrule distance. They are ranked by the exact inner product in double precision.

Blocks of BLOCK index vectors meet parts of QUERY_BLOCK queries at most, so that no task holds more of either. Measured recall at 20 over blocks
of 16,384 vectors in 64 dimensions: 0.94 for random directions of one length, 0.97 for clustered ones, 0.96 and more for lognormal lengths.

Equal vectors are one entry with the ``top + 1`` smallest ids, which is all that a query can return of them.
Defined cases: vectors that are null, zero, empty or have null or non-finite components take no part; of several
lengths only the commonest takes part; ties go to smaller ids; with fewer candidates all are returned; repeated ids count as separate rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

PIVOTS, DEPTH, SHARE, LEAST = 256, 64, 0.07, 400
BLOCK, QUERY_BLOCK = 16384, 32768


def _matrix(col) -> np.ndarray:
    return np.array(list(col), dtype=np.float64)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Directions; the scaling by the largest component keeps squares from overflow."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def places(vectors: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` nearest pivots of each vector, nearest first (larger inner product, then smaller number)."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :depth].astype(np.int16)


class Block:
    """Inverted files of one block."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, depth: int):
        self.vectors, self.depth, self.length = vectors, depth, np.linalg.norm(vectors, axis=1)
        order = places(unit(vectors), pivots, depth)
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.who = (by // depth).astype(np.int32)
        self.place = (by % depth).astype(np.int16)
        self.start = np.searchsorted(flat[by], np.arange(len(pivots) + 1))

    def candidates(self, order: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` vectors with the least footrule distance to the query's order, longer ones before shorter ones."""
        if count >= len(self.vectors):
            return np.arange(len(self.vectors))
        total = np.zeros(len(self.vectors), dtype=np.int32)  # less the distance of a vector that shares no pivot
        for i, p in enumerate(order):
            a, b = self.start[p], self.start[p + 1]
            who, place = self.who[a:b], self.place[a:b]
            total[who] += np.abs(place - i) - (self.depth - i) - (self.depth - place)
        return np.argpartition(-np.sqrt(-total.astype(np.float64)) * self.length, count - 1)[:count]


def clean(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.filter(~bad & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (common["d"] if common else 0))


def search(df: DataFrame, is_query: Column, top: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each query row; is_query is a condition on vec_id."""
    spark = df.sparkSession
    rows = clean(df, vec_id, vector)
    scratch = C.Scratch(spark, "ann")
    w = Window.partitionBy("v").orderBy("vec_id")
    entries = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= top + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = scratch.keep(entries.withColumn("h", F.xxhash64(F.col("ids")[0])), "entries")
    pivots = _matrix([r["v"] for r in entries.select("v", "h").orderBy("h").limit(PIVOTS).collect()])
    n = entries.count()
    if n:
        pivots = unit(pivots)
    else:
        return scratch.result(rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0))
    n_blocks, depth = -(-n // BLOCK), min(DEPTH, len(pivots))
    base = entries.withColumn("block", F.pmod("h", F.lit(n_blocks)).cast("int"))
    queries = rows.filter(is_query).groupBy("v").agg(F.min("vec_id").alias("q"))
    n_parts = -(-queries.count() // QUERY_BLOCK)
    asked = queries.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(max(1, n_parts))).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    base = base.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_parts - 1)))))

    def meet(key, b, q):
        import pandas as pd

        out = []
        if len(b) and len(q):
            vectors, ids = _matrix(b["v"]), [np.asarray(x) for x in b["ids"]]
            first = np.array([x[0] for x in ids])
            block = Block(vectors, pivots, depth)
            count = max(LEAST, int(SHARE * len(b)))
            asking = _matrix(q["v"])
            for name, x, order in zip(q["q"], asking, places(unit(asking), pivots, depth)):
                c = block.candidates(order, count)
                score = (vectors[c] * x).sum(axis=1)
                best = np.lexsort((first[c], -score))[: top + 1]
                found = [(-score[i], v) for i in best for v in ids[c[i]]]
                out += [(name, v, -s) for s, v in sorted(found)[: top + 1]]
        return pd.DataFrame(out, columns=["q", "vec_id", "score"])

    near = base.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(meet, "q long, vec_id long, score double")
    by = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= top + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    named = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v")).join(queries, "v").select("query_id", "q").join(near, "q")
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    out = named.select("query_id", F.posexplode(own).alias("i", "x")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
    return scratch.result(out)
