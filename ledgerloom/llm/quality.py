"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives and unlabelled web text train a linear scorer that minimises

    prior * E_pos[loss(f)] + max(0, E_unl[loss(-f)] - prior * E_pos[loss(-f)])

with the logistic loss (Kiryo et al., 2017). The class prior is the share of positives among the labelled rows, from 0.05 to 0.95.
A score depends on the text alone: frequencies of byte-class pairs, and how much of the text repeats itself.

Defined cases: null and empty texts have the features of an empty text and get a score as any other; a document with
contradicting labels counts as unlabelled; repeated rows are scored alike, and an id gives one row to learn from: the one whose text has the
smallest hash; without any positive label every score is one half; texts of any length are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Byte classes: 0 lower case, 1 upper case, 2 digit, 3 blank, 4 line end, 5 other control, 6 beyond ASCII, 7 . , 8 ,;: ,
#: 9 ! ?, 10 quotes, 11 brackets, 12 #*, 13 $%&@, 14 |\\/~^_=+<>, 15 hyphen.
_CLASSES = (
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", "", "", ".", ",;:", "!?", "\"'`", "()[]{}", "#*", "$%&@", "|\\/~^_=+<>", "-",
)
N_CLASSES = len(_CLASSES)
N_FEATURES = N_CLASSES * N_CLASSES + 5


def _class_table() -> np.ndarray:
    t = np.full(256, 6, dtype=np.int64)
    t[:128] = 5
    for i, chars in enumerate(_CLASSES):
        for ch in chars:
            t[ord(ch)] = i
    return t


def _distinct_share(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """For each row, 1 - distinct keys / keys."""
    count = np.bincount(rows, minlength=n)
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return 1 - np.bincount(r[new], minlength=n) / np.maximum(count, 1) * (count > 0) - (count == 0)


def features(col, limit: int = 1 << 19) -> np.ndarray:
    """One row of N_FEATURES numbers for each text of an Arrow column."""
    data, offsets = C.text_bytes(col)
    table = _class_table()
    blank = np.ones(256, dtype=bool)
    blank[[9, 10, 11, 12, 13, 32]] = False
    not_line = np.ones(256, dtype=bool)
    not_line[[10, 13]] = False
    out = np.zeros((len(offsets) - 1, N_FEATURES), dtype=np.float32)
    for a, b in C.slices(offsets, limit):
        d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        n = b - a
        if not len(d):
            continue
        rows = np.repeat(np.arange(n), np.diff(o))
        c = table[d]
        same = rows[1:] == rows[:-1]
        pair = (rows[1:] * N_CLASSES + c[:-1]) * N_CLASSES + c[1:]
        f = np.bincount(pair[same], minlength=n * N_CLASSES**2).reshape(n, -1)
        out[a:b, : N_CLASSES**2] = np.sqrt(f / np.maximum(np.diff(o) - 1, 1)[:, None])
        h = C.RollingHash(d)
        s, e, r = C.words_of(d, o, blank)
        w = h.ranges(s, e)
        triple = np.flatnonzero(r[2:] == r[:-2])
        key = C.mix(w[triple] + C.mix(w[triple + 1] + C.mix(w[triple + 2])))
        again = np.bincount(r[1:][(w[1:] == w[:-1]) & (r[1:] == r[:-1])], minlength=n)
        ls, le, lr = C.words_of(d, o, not_line)
        k = N_CLASSES**2
        out[a:b, k] = _distinct_share(r[triple], key, n)
        out[a:b, k + 1] = _distinct_share(lr, h.ranges(ls, le), n)
        out[a:b, k + 2] = again / np.maximum(np.bincount(r, minlength=n), 1)
        out[a:b, k + 3] = np.log1p(np.diff(o)) / 10
        out[a:b, k + 4] = np.bincount(r, minlength=n) / np.maximum(np.diff(o), 1)
    return out


def learn(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3, beta: float = 0.0) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, bias, mean and scale of the linear scorer with the least non-negative risk (Adam on all rows).

    Where the estimated risk of negatives falls under -beta, a step goes against it, as the estimator asks.
    """
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = np.clip((positive - mean) / scale, -8, 8), np.clip((unlabelled - mean) / scale, -8, 8)
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for t in range(1, steps + 1):
        fp, fu = p @ w + b, u @ w + b
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        up, uu = sig(fp) / len(fp), sig(fu) / len(fu)  # slopes of loss(-f)
        gp, gu = prior * (sig(fp) - 1) / len(fp) - prior * up, uu
        if negative < -beta:
            gp, gu = prior * up, -uu
        g = np.append(gp @ p + gu @ u + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b), mean, scale


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sample_features(docs: DataFrame, ids: DataFrame, text: str, doc_id: str) -> np.ndarray:
    """Features of the documents with the given ids; ids are few by a documented bound, so they are broadcast."""
    import pyarrow as pa

    @C.arrow_udf("array<float>")
    def vector(col):
        return pa.array(list(features(col)), type=pa.list_(pa.float32()))

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(ids.select(F.col(doc_id).alias("id"))), "id", "left_semi")
    rows = rows.groupBy("id").agg(F.min_by("t", F.xxhash64("t")).alias("t")).select(vector(F.col("t")).alias("x"))
    return np.array([r for r in rows.toPandas()["x"]], dtype=np.float64).reshape(-1, N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame, training: Column, text: str = "text", doc_id: str = "doc_id", max_positive: int = 3000, max_unlabelled: int = 6000) -> QualityModel:
    """Learn from rows for which ``training`` holds.

    At most ``max_positive`` positives and ``max_unlabelled`` unlabelled documents are gathered, those with the smallest hashes
    of their ids. ``labels`` has the columns doc_id and quality (1: trusted positive).
    """
    known = (
        labels.filter(training & F.col("quality").isNotNull())
        .groupBy(doc_id).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
        .filter(F.col("lo") == F.col("hi"))
    )
    share = known.agg(F.avg((F.col("lo") == 1).cast("double"))).first()[0]
    if not share:
        return QualityModel(np.zeros(N_FEATURES), 0.0, np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.5)
    prior = float(min(max(share, 0.05), 0.95))
    by_hash = lambda df, n: df.select(doc_id).distinct().orderBy(F.xxhash64(F.lit("quality"), F.col(doc_id)), doc_id).limit(n)
    p = _sample_features(docs, by_hash(known.filter("lo = 1"), max_positive), text, doc_id)
    u = _sample_features(docs, by_hash(docs.filter(training & F.col(doc_id).isNotNull()), max_unlabelled), text, doc_id)
    if not len(p) or not len(u):
        return QualityModel(np.zeros(N_FEATURES), float(np.log(prior / (1 - prior))), np.zeros(N_FEATURES), np.ones(N_FEATURES), prior)
    return QualityModel(*learn(p, u, prior), prior)


def score(model: QualityModel, text: Column) -> Column:
    """A score in 0..1 for each text."""
    import pyarrow as pa

    @C.arrow_udf("double")
    def quality(col):
        return pa.array(model.score(features(col)))

    return quality(text)
