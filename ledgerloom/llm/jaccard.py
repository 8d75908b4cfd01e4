"""Exact n-gram Jaccard self-join with token-combination prefixes, and the groups that its links form.

Tokens are 64-bit hashes of word shingles, ordered by document frequency (counted over all texts) and then by hash, so that a
prefix holds a set's rarest tokens. Tokens are in classes by frequency: under RARE documents, under COMMON, and the rest. Class
k is indexed in combinations of k tokens; tokens of the classes 2 and 3 are dealt to g groups by hash, and combined within
a group only, which keeps the combinations of a set in proportion to its size. A set of n tokens that may miss e tokens of a similar set
extends its prefix until sum(max(0, c - k + 1)) over all classes' groups exceeds e, c being the prefix's tokens in a group: whichever
e tokens are missing, k common ones of some group are left. The smaller set of a pair may miss n - ceil(2 * pct * n / (100 + pct))
tokens (its index signatures), the larger one n - ceil(pct * n / 100) (its probe signatures).

1. Packs of documents send their distinct tokens to 256 buckets by hash, once for equal sets. A bucket counts the documents of each
   token and sends back those in two documents at least, with their frequency. A set with more than e tokens of its own
   is settled: its prefix meets nobody's. The others are open; tokens that count in an overlap are all there.
2. Equal sets are one representative. Signatures of open representatives make posting lists. Candidates are first pairs of each list's
   members with one centre; links merge components; lists whose members are in one component are settled. Lists that are left
   get another centre and, at last, all untried pairs of an index and a probe signature between different components, so
   that no link between components is lost while a dense group of m sets costs m pairs and not m * m.
3. Counts of a set's tokens by frequency and hash bound the overlap of two sets; candidates that pass are verified on whole sets.

Frequencies only order tokens: copies that a pack has already merged count once, and any order gives the same links. Rows between the steps follow the
number of tokens; a bucket holds 1/256 of them, as packed bytes.

Defined cases: null and empty texts have no shingles and no links; texts of fewer words than a shingle are one shingle; repeated
rows have equal ids and group as one; rows with a null id have no group (null) and don't link; an empty table gives no rows; other
columns of the caller are not read. A text of any length is one set; the memory for it bounds its length. Documents are read in the order
of their table's files, so that a task that runs again makes the same packs; a table that is computed is to be written first.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

RARE, COMMON, STARS = 32, 1024, 2
BUCKETS, PACK_BYTES, PACK_ROWS = 256, 4 << 20, 50_000
#: A key with so many rows, and a thousandth of all, is hot; at most a thousand keys are.
HOT = 10_000
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4"), ("fa", "<u8"), ("fb", "<u8")])


def flat_sets(col, k: int, limit: int = 1 << 19):
    """Sorted distinct shingle hashes of the texts of an Arrow column: (rows, bytes, hashes, ends) of one slice after another."""
    data, offsets = C.text_bytes(col)
    inside = np.ones(256, dtype=bool)
    inside[[9, 10, 11, 12, 13, 32]] = False
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    for a, b in C.slices(offsets, limit):
        d, o = fold[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        s, e, rows = C.words_of(d, o, inside)
        w = C.RollingHash(d).ranges(s, e) if len(s) else np.zeros(0, dtype=C.U)
        count = np.bincount(rows, minlength=b - a)
        full = np.flatnonzero(rows[k - 1 :] == rows[: len(rows) - k + 1]) if len(rows) >= k else np.zeros(0, dtype=np.int64)
        h = np.zeros(len(full), dtype=C.U)
        for j in range(k):
            h = C.mix(h + w[full + j] * C.U(2 * j + 1))
        short = np.flatnonzero((count > 0) & (count < k))  # the few texts of fewer words
        first = (np.cumsum(count) - count)[short]
        extra = count[short].astype(C.U)
        for j in range(k - 1):
            has = count[short] > j
            extra[has] = C.mix(extra[has] + w[first[has] + j])
        h, r = np.concatenate([h, extra]), np.concatenate([rows[full], short])
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        h, r = h[new], r[new]
        yield b - a, int(offsets[b] - offsets[a]), h, np.searchsorted(r, np.arange(1, b - a + 1))


def shingle_sets(col, k: int):
    """Sorted distinct shingle hashes of each text of an Arrow column, in order."""
    for _, _, h, ends in flat_sets(col, k):
        yield from np.split(h, ends[:-1])


def _packed(counts: np.ndarray, tokens: np.ndarray, levels: np.ndarray | None = None) -> bytes:
    """Tokens (48 bits) of documents side by side: their counts by document, byte by byte, which compress well, then the tokens."""
    wide = np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    planes = np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return np.array([len(counts), len(tokens)], dtype="<u4").tobytes() + planes + wide + (b"" if levels is None else levels.astype(np.uint8).tobytes())


def _unpacked(raw: bytes, levels: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Documents and tokens, and levels if it has them, of _packed()."""
    d, k = np.frombuffer(raw, dtype="<u4", count=2).astype(np.int64)
    b = np.frombuffer(raw, dtype=np.uint8, offset=8)
    counts = np.ascontiguousarray(b[: 4 * d].reshape(4, d).T).view("<u4").ravel()
    t = np.zeros((k, 8), dtype=np.uint8)
    t[:, :6] = b[4 * d : 4 * d + 6 * k].reshape(k, 6)
    return np.repeat(np.arange(d), counts), t.view("<u8").ravel(), b[4 * d + 6 * k :] if levels else None


def level(df: np.ndarray) -> np.ndarray:
    """A document frequency's octave and three bits more: 8 at two documents, 40 at 32, 80 at 1024."""
    b = np.frexp(df.astype(np.float64))[1].astype(np.int64) - 1
    return 8 * b + (((df.astype(np.int64) << 3) >> b) & 7)


def _tokens(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """bucket, pack, blob: the tokens of each pack's different sets by bucket; the pack's documents are in a bucket from BUCKETS on."""

    def pack(number: int, held: list):
        import pyarrow as pa

        ids, nulls, n, h = (np.concatenate(x) for x in zip(*held))
        ends = np.cumsum(n)
        total = lambda x: np.diff(np.concatenate([np.zeros(1, dtype=C.U), np.cumsum(x, dtype=C.U)])[np.append(0, ends)])
        fa, fb = total(C.mix(h)), total(C.mix(h ^ C.U(0x5851F42D4C957F2D)))
        order = np.lexsort((n, fb, fa))
        new = np.append(True, (fa[order][1:] != fa[order][:-1]) | (fb[order][1:] != fb[order][:-1]) | (n[order][1:] != n[order][:-1]))
        same = np.cumsum(new) - 1
        table = np.zeros(len(n), dtype=_DOC)
        table["id"], table["null"], table["n"], table["fa"], table["fb"] = ids, nulls, n, fa, fb
        idle = nulls | (n == 0)
        order = order[np.lexsort((idle[order], same))]  # of equal sets a document with an id comes first and sends the tokens
        sends = np.zeros(len(n), dtype=bool)
        sends[order[new]] = ~idle[order[new]]
        doc = np.repeat(np.arange(len(n)), n)
        h, doc = h[sends[doc]], doc[sends[doc]]
        bucket = (h >> C.U(56)).astype(np.uint8)
        order = np.argsort(bucket, kind="stable")
        h, doc = (h[order] >> C.U(8)) & C.U((1 << 48) - 1), doc[order]
        edge = np.searchsorted(bucket[order], np.arange(257))
        at = [b for b in range(BUCKETS) if edge[b] < edge[b + 1]]
        blobs = [_packed(np.bincount(doc[edge[b] : edge[b + 1]], minlength=len(n)), h[edge[b] : edge[b + 1]]) for b in at]
        return pa.RecordBatch.from_arrays(
            [pa.array([*at, BUCKETS + number % BUCKETS], pa.int32()), pa.array([number] * (len(at) + 1), pa.int64()), pa.array([*blobs, table.tobytes()], pa.binary())], ["bucket", "pack", "blob"]
        )

    def make(batches):
        from pyspark import TaskContext

        number, held, rows, size = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            ids, at = batch.column(0), 0
            for d, n_bytes, h, ends in flat_sets(batch.column(1), k):
                some = ids.slice(at, d)
                held.append((some.fill_null(0).to_numpy(zero_copy_only=False), some.is_null().to_numpy(zero_copy_only=False), np.diff(ends, prepend=0), h))
                at, rows, size = at + d, rows + d, size + n_bytes
                if size >= PACK_BYTES or rows >= PACK_ROWS:
                    yield pack(number, held)
                    number, held, rows, size = number + 1, [], 0, 0
                    C.give_back()
        if held:
            yield pack(number, held)
        held.clear()
        C.give_back()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(make, "bucket int, pack long, blob binary")


def _counted(tokens: DataFrame) -> DataFrame:
    """pack, bucket, blob: the tokens in two documents at least, with their levels; documents pass through."""

    @C.giving_back
    def one(table):
        import pyarrow as pa

        bucket, out = table.column("bucket")[0].as_py(), []
        if bucket < BUCKETS:
            packs = [_unpacked(x) for x in table.column("blob").to_pylist()]
            t = np.concatenate([x[1] for x in packs])
            order = np.argsort(t)
            s = t[order]
            group = np.cumsum(np.append(True, s[1:] != s[:-1])) - 1
            df = np.empty(len(t), dtype=np.int64)
            df[order] = np.bincount(group)[group]
            sizes = np.cumsum([0, *(len(x[1]) for x in packs)])
            for i, (doc, mine, _) in enumerate(packs):
                f = df[sizes[i] : sizes[i + 1]]
                some = np.flatnonzero(f > 1)
                out.append(_packed(np.bincount(doc[some], minlength=int(doc[-1]) + 1), mine[some], level(f[some])) if len(some) else None)
        else:
            out = table.column("blob").to_pylist()
        keep = [i for i, x in enumerate(out) if x is not None]
        return pa.table({"pack": table.column("pack").take(pa.array(keep, pa.int64())), "bucket": pa.array([bucket] * len(keep), pa.int32()), "blob": pa.array([out[i] for i in keep], pa.binary())})

    return tokens.groupBy("bucket").applyInArrow(one, "pack long, bucket int, blob binary")


def _signed(counted: DataFrame, pct: int) -> DataFrame:
    """doc_id, n, two fingerprints of the set and, for open sets, keys: the tokens in other documents, too, as level and 56 bits of hash, in order."""

    @C.giving_back
    def one(table):
        import pyarrow as pa

        rows = dict(zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist()))
        at = max(rows)  # the documents' bucket is the largest
        docs = np.frombuffer(rows.pop(at), dtype=_DOC)
        who, keys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=C.U)]
        for bucket, raw in rows.items():
            doc, t, lv = _unpacked(raw, levels=True)
            who.append(doc)
            keys.append((lv.astype(C.U) << C.U(56)) | C.U(bucket << 48) | t)
        who, keys = np.concatenate(who), np.concatenate(keys)
        n = docs["n"].astype(np.int64)
        met = np.bincount(who, minlength=len(docs))
        is_open = (met > 0) & (n - met <= n - -(-pct * n // 100))
        some = is_open[who]
        who, keys = who[some], keys[some]
        order = np.lexsort((keys, who))
        who, keys = who[order], keys[order]
        edge = np.searchsorted(who, np.arange(len(docs) + 1))
        return pa.table(
            {
                "doc_id": pa.array(docs["id"].copy(), pa.int64(), mask=docs["null"].astype(bool)),
                "n": pa.array(n, pa.int64()),
                "fa": pa.array(docs["fa"].copy().view("<i8"), pa.int64()),
                "fb": pa.array(docs["fb"].copy().view("<i8"), pa.int64()),
                "keys": pa.array([keys[edge[i] : edge[i + 1]].tobytes() if is_open[i] else None for i in range(len(docs))], pa.binary()),
            }
        )

    return counted.groupBy("pack").applyInArrow(one, "doc_id long, n long, fa long, fb long, keys binary")


def _missing(n: int, pct: int) -> int:
    """A set of n tokens has at most so many that a similar set lacks."""
    return n - -(-pct * n // 100)


def _groups_of(n: int, pct: int) -> int:
    """Groups of class 2 for a set of n tokens; class 3 has twice as many, from two on."""
    return 1 << max(0, ((_missing(n, pct) + 1) // 8).bit_length() - 1)


@lru_cache(maxsize=256)
def _choices(m: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(m), k)), dtype=np.int64).reshape(-1, k)


def _signatures(keys: np.ndarray, alone: int, missing: int, g: int, pct: int) -> np.ndarray:
    """The signatures of a prefix that tolerates ``missing`` tokens; ``alone`` tokens are in no other set."""
    need = missing + 1 - alone
    if need <= 0:
        return np.zeros(0, dtype=C.U)
    g3 = 2 * g if missing >= 7 else 1
    head = keys[: need + g + 2 * g3]
    lv = (head >> C.U(56)).astype(np.int64)
    classes = 1 + (lv >= level(np.array([RARE]))[0]) + (lv >= level(np.array([COMMON]))[0])
    classes = np.minimum(classes, 3 if pct > 75 else 2 if pct > 50 else 1)
    token = head & C.U((1 << 56) - 1)
    group = np.where(classes == 1, -1, classes * (1 << 40) + np.where(classes == 2, token & C.U(g - 1), token & C.U(g3 - 1)).astype(np.int64))
    order = np.argsort(group, kind="stable")
    start = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
    rank = np.empty(len(head), dtype=np.int64)
    rank[order] = np.arange(len(head)) - np.repeat(start, np.diff(np.append(start, len(head)))) + 1
    gain = np.cumsum(rank >= classes)
    p = int(np.searchsorted(gain, need)) + 1
    token, group, classes = token[:p], group[:p], classes[:p]
    out = [C.mix(token[classes == 1])]
    for one in np.unique(group[classes > 1]).tolist():
        t = token[group == one]
        k = one >> 40
        if len(t) >= k:
            x = t[_choices(len(t), k)]
            s = np.full(len(x), C.U(k), dtype=C.U)
            for i in range(k):
                s = C.mix(s + x[:, i])
            out.append(s)
    return np.concatenate(out)


def coarse(keys: np.ndarray) -> tuple[list[int], int]:
    """Counts of tokens in 32 cells of frequency and hash, eight to a 64-bit number, and how many low bits were rounded up and left out of each."""
    cell = C.mix((keys >> C.U(56)) * C.U(4) + (keys & C.U(3))) >> C.U(59)
    count = np.bincount(cell.astype(np.int64), minlength=32)
    shift = max(0, int(count.max()).bit_length() - 7)
    return (-(-count >> shift)).astype(np.uint8).view(np.int64).tolist(), shift


def coarse_bound(x: str, y: str) -> Column:
    """At most so many tokens are in both sets, from their coarse counts in the columns x0..x3, xs and y0..y3, ys."""
    one = lambda c, i, j: F.shiftright(F.col(f"{c}{i}"), 8 * j).bitwiseAND(F.lit(255)) * F.col(f"{c}s")
    terms = [F.least(one(x, i, j), one(y, i, j)) for i in range(4) for j in range(8)]
    return reduce(lambda a, b: a + b, terms)


def _posts(reps: DataFrame, pct: int) -> DataFrame:
    """key, id, n, whether it is an index and a probe signature, and the coarse counts p0..p3, ps."""

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            key, at, role, counts = [], [], [], []
            for i, (n, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                keys = np.frombuffer(raw, dtype="<u8")
                alone, most = n - len(keys), _missing(n, pct)
                index = np.unique(_signatures(keys, alone, n - -(-2 * pct * n // (100 + pct)), _groups_of(n, pct), pct))
                sizes = {_groups_of(n, pct), _groups_of(-(-pct * n // 100), pct)}
                probe = np.unique(np.concatenate([_signatures(keys, alone, most, g, pct) for g in sizes]))
                both = np.union1d(index, probe)
                key.append(both)
                role.append(np.isin(both, index) + 2 * np.isin(both, probe))
                at.append(np.full(len(both), i))
                w, shift = coarse(keys)
                counts.append([*w, 1 << shift])
            at, counts, role = np.concatenate(at), np.array(counts, dtype=np.int64), np.concatenate(role).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(key).view(np.int64)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array((role & 1) > 0), pa.array((role & 2) > 0), *[pa.array(counts[at, j]) for j in range(5)]],
                ["key", "id", "n", "index", "probe", "p0", "p1", "p2", "p3", "ps"],
            )
        C.give_back()

    return reps.select("id", "n", "keys").mapInArrow(make, "key long, id long, n long, index boolean, probe boolean, p0 long, p1 long, p2 long, p3 long, ps long")


def _verified(pairs: DataFrame, reps: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    import pyarrow as pa

    def alike(x: pa.Array, y: pa.Array, nx: pa.Array, ny: pa.Array) -> pa.Array:
        out = []
        for p, q, m, n in zip(x, y, nx.to_pylist(), ny.to_pylist()):
            both = len(np.intersect1d(np.frombuffer(p.as_buffer(), dtype=C.U), np.frombuffer(q.as_buffer(), dtype=C.U), assume_unique=True))
            out.append(100 * both >= pct * (m + n - both))
        return pa.array(out, pa.bool_())

    alike.__annotations__ = {"x": pa.Array, "y": pa.Array, "nx": pa.Array, "ny": pa.Array, "return": pa.Array}
    test = F.arrow_udf(alike, "boolean")
    a, b = (reps.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("keys").alias(f"k{s}")) for s in "ab")
    return pairs.join(a, "a").join(b, "b").filter(test("ka", "kb", "na", "nb")).select("a", "b")


def hot_join(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with one row for each key, whose column "c" counts the rows of that key (dropped).

    Keys that hold HOT rows and a thousandth of all are at most a thousand, so they are broadcast and their rows stay where they are.
    """
    total = small.agg(F.sum("c")).first()[0] or 0
    hot = F.broadcast(small.filter(F.col("c") >= max(HOT, total // 1000)).drop("c"))
    cold = small.filter(F.col("c") < max(HOT, total // 1000)).drop("c")
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on, how))


def components(scratch: C.Scratch, links: DataFrame) -> DataFrame:
    """id and the smallest id it reaches over links (a, b), for ids with links (alternating large and small stars)."""
    edges = scratch.keep(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("c")).withColumn("m", F.least("m", "u"))
        large = hot_join(both.filter("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.keep(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = hot_join(large, low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = scratch.keep(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
        mark = now


def _met(scratch: C.Scratch, posts: DataFrame, turn: int, pct: int) -> DataFrame:
    """Pairs (a, b) in different components ("comp") that meet in a posting list and that their sizes and counts don't rule out: each
    member with the list's centre or, in the last turn, all with each other."""
    marks = {"x": "id", "nx": "n", "compx": "comp", "other_probe": "probe", **{f"q{i}": f"p{i}" for i in "0123s"}}
    other = [F.col(c).alias(m) for m, c in marks.items()]
    rank = F.xxhash64(F.lit(turn), F.col("id")) if turn else F.col("id")
    lists = posts.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.min(F.struct(rank.alias("r"), *other)).alias("o")).filter("lo < hi")
    lists = scratch.keep(lists.select("key", "c", F.col("c").alias("members"), "o"), "lists")
    fits = (F.col("comp") != F.col("compx")) & (F.least("n", "nx") * 100 >= F.greatest("n", "nx") * pct)
    fits = fits & (coarse_bound("p", "q") * (100 + pct) >= (F.col("n") + F.col("nx")) * pct)
    if turn < STARS:
        met = hot_join(posts, lists.select("key", "c", "o.*"), ["key"]).filter(fits)
    else:
        # similar sizes are in one size class or in neighbouring ones; the smaller set's index signature meets the larger one's
        # probe; the members of a long list are dealt to many tasks, and their partners sent to each of these
        live = scratch.keep(hot_join(posts, lists.select("key", "c", "members"), ["key"]).withColumn("deals", F.floor(F.col("members") / 4096)), "live")
        step = math.log(100 / pct) * 1.0001 if pct < 100 else 1e-9
        size = lambda c: F.floor(F.log(F.col(c).cast("double")) / step).cast("long")
        left = live.filter("index").select("key", "id", "n", "comp", "p0", "p1", "p2", "p3", "ps", size("n").alias("size"), F.pmod(F.xxhash64("id"), F.col("deals") + 1).alias("deal"))
        right = live.filter("probe").select("key", "deals", *other).withColumn("size", F.explode(F.array(size("nx") - 1, size("nx")))).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals")))).drop("deals")
        smaller = (F.col("n") < F.col("nx")) | ((F.col("n") == F.col("nx")) & (F.col("id") < F.col("x")))
        met = left.join(right, ["key", "size", "deal"]).filter(fits & smaller)
    return met.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, pct: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable over links) for each row of docs."""
    if not 0 < pct <= 100:
        raise ValueError("pct is from 1 to 100")
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "jaccard")
    with C.batches_of(spark, 256):
        signed = scratch.keep(_signed(_counted(_tokens(docs, doc_id, text, k)), pct), "signed")
        scratch.free()
        same = signed.filter("n > 0 and doc_id is not null").groupBy("fa", "fb", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("c"), F.first("keys", ignorenulls=True).alias("keys"))
        same = scratch.keep(same.filter("c > 1 or keys is not null"), "reps")
        reps = same.filter("keys is not null").select("id", "n", "keys")
        posts = scratch.keep(_posts(reps, pct), "posts")
        comp = _linked(scratch, posts, reps, pct)
    out = hot_join(signed.select("doc_id", "n", "fa", "fb"), same.filter("c > 1").select("fa", "fb", "n", "id", "c"), ["fa", "fb", "n"], "left")
    out = out.withColumn("id", F.coalesce("id", "doc_id"))
    out = out.join(comp, "id", "left") if comp is not None else out.withColumn("component", F.lit(None).cast("long"))
    return scratch.result(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("doc_id"))).alias("component_id")))


def _linked(scratch: C.Scratch, posts: DataFrame, reps: DataFrame, pct: int) -> DataFrame | None:
    """id and component of the representatives with links, or None without any."""
    links = tried = comp = None
    for turn in range(STARS + 1):
        now = posts.withColumn("comp", F.col("id"))
        if comp is not None:
            now = scratch.keep(posts.join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), "now")
        met = _met(scratch, now, turn, pct)
        if tried is not None:
            met = met.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.keep(met, "pairs")
        if pairs.isEmpty():  # another centre, or the last turn, may still give some
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        fresh = scratch.keep(_verified(pairs, reps, pct), "links")
        if not fresh.isEmpty():
            links = fresh if links is None else links.unionByName(fresh)
            comp = scratch.keep(components(scratch, links), "components")
    return comp


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, pct: int = 80) -> DataFrame:
    """docs without those whose group has a smaller doc_id; rows with a null id or without shingles stay, and so do columns of any name.

    A bitmap of 2**24 hashed ids (2 MB at any size) says which rows may have to go; only these are joined, the other texts stay where they are.
    """
    gone = groups(docs, doc_id, text, k, pct).filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("gone")).distinct()
    may_go = C.hashed_bitmap(gone, "gone")
    names = docs.columns
    flag, gone_id = C.free_name(names, "may_go"), C.free_name(names, "gone")
    marked = docs.withColumn(flag, may_go(F.col(doc_id).cast("long")))
    join = marked.filter(F.col(flag)).join(gone.withColumnRenamed("gone", gone_id), F.col(doc_id).cast("long") == F.col(gone_id), "left_anti")
    return marked.filter(~F.col(flag)).unionByName(join).drop(flag)
