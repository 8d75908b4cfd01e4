"""Training-order materialisation: token-id sequences in fixed-stride shards, in a keyed random order.

Documents are cut into sequences of ``length`` tokens. Sequences are counted in the order of document ids; a keyed Feistel
network over the least even number of bits, with cycle-walking back into 0..n-1, gives each its global slot. Shards are
ranges of slots. A shard is a file of records of one size in slot order, so that record s is found at (s - first slot) * stride:
reading is sequential and can be resumed at any slot.

A record is doc_id (8 bytes), part (4), tokens used (4), the tokens padded with zeros, and one line end, all little-endian.
Tokens are bytes here unless ``ids`` gives another binary column and ``width`` its bytes a token.

Defined cases: null and empty texts have no sequence; rows with equal id and text are stored once; a null id is stored as
the smallest 64-bit number; an empty table gives no shard.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LENGTH, SHARD_BYTES, ROUNDS = 512, 8 << 20, 6
HEAD = 16
#: Documents whose places are sent to every executor (24 bytes each); beyond it they are joined by shuffle.
BROADCAST_DOCS = 1_000_000


def round_keys(key: bytes) -> np.ndarray:
    return np.frombuffer(hashlib.sha256(key).digest() + hashlib.sha256(key + b"2").digest(), dtype="<u8")[:ROUNDS].copy()


def slots(index: np.ndarray, n: int, key: bytes) -> np.ndarray:
    """The slot of each index in 0..n-1, a permutation of 0..n-1."""
    if n < 2:
        return np.zeros(len(index), dtype=np.int64)
    half = (max(1, (n - 1).bit_length()) + 1) // 2
    mask, keys = C.U((1 << half) - 1), round_keys(key)

    def walk(x: np.ndarray) -> np.ndarray:
        left, right = x >> C.U(half), x & mask
        for k in keys:
            left, right = right, left ^ (C.mix(right + k) & mask)
        return (left << C.U(half)) | right

    x = walk(np.asarray(index).astype(C.U))
    while (out := np.flatnonzero(x >= C.U(n))).size:
        x[out] = walk(x[out])
    return x.astype(np.int64)


def _places(scratch: C.Scratch, rows: DataFrame, length: int) -> tuple[DataFrame, int]:
    """id, print, first: the index of each document's first sequence, in the order of ids; and the number of all sequences."""
    spark = rows.sparkSession
    sizes = rows.select("id", "print", F.ceil(F.col("size") / F.lit(length)).cast("long").alias("k")).filter("k > 0").distinct()
    ordered = sizes.repartitionByRange(C.tasks_for(spark, sizes), "id", "print").sortWithinPartitions("id", "print").withColumn("p", F.spark_partition_id())
    ordered = scratch.keep(ordered, "sizes")
    totals = sorted((r["p"], r["k"]) for r in ordered.groupBy("p").agg(F.sum("k").alias("k")).collect())  # a row for each partition
    base, n = [], 0
    for p, k in totals:
        base.append((p, n))
        n += k
    from pyspark.sql import Window

    w = Window.partitionBy("p").orderBy("id", "print").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = spark.createDataFrame(base or [(0, 0)], "p int, base long")
    out = ordered.withColumn("upto", F.sum("k").over(w)).join(F.broadcast(starts), "p").select("id", "print", (F.col("base") + F.col("upto") - F.col("k")).alias("first"))
    return out, n


def write(docs: DataFrame, path: str, key: bytes, doc_id: str = "doc_id", ids: Column | None = None, width: int = 1, length: int = LENGTH) -> dict:
    """Write shards under ``path``; returns what reading needs."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "shards")
    data = ids if ids is not None else F.col("text").cast("binary")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(data, F.lit(b"")).alias("data"))
    rows = rows.withColumns({"size": F.octet_length("data"), "print": F.xxhash64("data")})
    step = length * width
    places, n = _places(scratch, rows.select("id", "print", "size"), step)
    stride = HEAD + step + 1
    per_shard = max(1, SHARD_BYTES // stride)
    placed = scratch.keep(places, "places")
    side = F.broadcast(placed) if placed.count() <= BROADCAST_DOCS else placed
    rows = rows.filter("size > 0").join(side, ["id", "print"]).select("id", "first", "data")

    def cut(batches):
        """Records dealt to their shards; a shard's share of a batch travels compressed."""
        import zlib

        import pyarrow as pa

        for batch in batches:
            col = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
            raw = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
            id_, first = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in C.slices(offsets, 4 << 20):
                size = np.diff(offsets[a : b + 1])
                parts = -(-size // step)
                row = np.repeat(np.arange(a, b), parts)
                part = C.spans(np.zeros(b - a, dtype=np.int64), parts)
                begin = offsets[row] + part * step
                used = np.minimum(step, offsets[row + 1] - begin)
                slot = slots(first[row] + part, n, key)
                order = np.argsort(slot)
                shard = slot[order] // per_shard
                for w in np.split(order, np.flatnonzero(np.diff(shard)) + 1):
                    rec = np.zeros((len(w), stride), dtype=np.uint8)
                    rec[:, :8] = id_[row[w]].astype("<i8").view(np.uint8).reshape(-1, 8)
                    rec[:, 8:12] = part[w].astype("<u4").view(np.uint8).reshape(-1, 4)
                    rec[:, 12:16] = (used[w] // width).astype("<u4").view(np.uint8).reshape(-1, 4)
                    rec[:, -1] = 10
                    at = np.repeat(np.arange(len(w)) * stride + HEAD, used[w]) + C.spans(np.zeros(len(w), dtype=np.int64), used[w])
                    rec.ravel()[at] = raw[C.spans(begin[w], used[w])]
                    blob = zlib.compress(rec.tobytes(), 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(slot[w[0]] // per_shard)], pa.int64()), pa.array([slot[w].astype("<i8").tobytes()], pa.binary()), pa.array([blob], pa.binary())], ["shard", "slot", "records"]
                    )

    def lay(key_, pdf):
        """The records of a shard in slot order, without their line ends."""
        import zlib

        import pandas as pd

        slot = np.frombuffer(b"".join(pdf["slot"]), dtype="<i8")
        rec = np.concatenate([np.frombuffer(zlib.decompress(x), dtype=np.uint8).reshape(-1, stride) for x in pdf["records"]])
        slot, order = np.unique(slot, return_index=True)  # equal rows were stored twice, with equal records
        raw, size = rec[order, :-1].tobytes(), stride - 1
        return pd.DataFrame({"shard": key_[0], "slot": slot, "body": [raw[i * size : (i + 1) * size] for i in range(len(order))]})

    with C.batches_of(spark, 2000):
        dealt = rows.mapInArrow(cut, "shard long, slot binary, records binary")
        laid = dealt.groupBy("shard").applyInPandas(lay, "shard long, slot long, body binary").sortWithinPartitions("shard", "slot")
        laid.select("shard", F.col("body").cast("string").alias("value")).write.option("maxRecordsPerFile", 0).partitionBy("shard").text(path)
    scratch.drop_all()
    return {"n": n, "stride": stride, "per_shard": per_shard, "step": step, "width": width}


def read(spark: SparkSession, path: str, layout: dict, from_slot: int = 0) -> DataFrame:
    """slot, doc_id, part, n_tokens, shard, at (byte in its shard), tokens (binary) of each record from ``from_slot`` on."""
    stride, per_shard, width = layout["stride"], layout["per_shard"], layout["width"]

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rec = np.frombuffer(content.as_py(), dtype=np.uint8).reshape(-1, stride)
                slot = shard * per_shard + np.arange(len(rec))
                keep = slot >= from_slot
                rec, slot = rec[keep], slot[keep]
                field = lambda a, b, t: np.ascontiguousarray(rec[:, a:b]).view(t).ravel()  # noqa: E731, B023
                used = field(12, 16, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array(field(0, 8, "<i8")), pa.array(field(8, 12, "<u4").astype(np.int64)), pa.array(used), pa.array(np.full(len(rec), shard, dtype=np.int64)), pa.array((slot - shard * per_shard) * stride), pa.array([r[HEAD : HEAD + u * width].tobytes() for r, u in zip(rec, used)], pa.binary())],
                    ["slot", "doc_id", "part", "n_tokens", "shard", "at", "tokens"],
                )

    if not layout["n"]:
        return spark.createDataFrame([], "slot long, doc_id long, part long, n_tokens long, shard long, at long, tokens binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.regexp_extract("path", r"shard=(\d+)/", 1).cast("long").alias("shard"), "content").filter(F.col("shard") >= from_slot // per_shard)
    return files.mapInArrow(parse, "slot long, doc_id long, part long, n_tokens long, shard long, at long, tokens binary")


def record(doc_id: int, part: int, tokens: bytes, layout: dict) -> bytes:
    """One record as write() lays it down."""
    return struct.pack("<qII", doc_id, part, len(tokens) // layout["width"]) + tokens.ljust(layout["step"], b"\0") + b"\n"
