"""Scalar functions of the language as Column builders; everything but Jaro-Winkler runs in the JVM."""

from __future__ import annotations

import datetime
import unicodedata

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.errors import AnalysisError

# text


def strip_accents(s: Column) -> Column:
    """Letters of the Latin ranges without their marks; letters that are no composition (as ß, ø) stay."""
    pairs = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(unicodedata.normalize("NFD", chr(c))) > 1}
    pairs = {k: v for k, v in pairs.items() if v.isascii()}
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return F.translate(F.translate(s, "".join(pairs), "".join(pairs.values())), marks, "")


def concat(*xs: Column) -> Column:
    """Nulls are skipped."""
    return F.concat_ws("", *[x.cast("string") for x in xs])


def substr(s: Column, start: Column, count: Column | None = None) -> Column:
    """1-based; a start before the text uses up its part of the count, a negative count reads leftwards."""
    n = F.length(s)
    at = F.when(start < 0, F.greatest(n + start, F.lit(0)) + 1).otherwise(start)
    if count is None:
        return F.substring(s, F.greatest(at, F.lit(1)), n)
    a, b = F.when(count < 0, at + count).otherwise(at), F.when(count < 0, at).otherwise(at + count)
    a = F.greatest(a, F.lit(1))
    return F.substring(s, a.cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))


def regexp_replace(s: Column, pattern: str, replacement: str) -> Column:
    r"""Every match; ``\1`` in the replacement is the first group."""
    java = replacement.replace("$", "\\$")
    for i in range(10):
        java = java.replace(f"\\{i}", f"${i}")
    return F.regexp_replace(s, pattern, java)


def regexp_extract(s: Column, pattern: str, group: int = 0) -> Column:
    """Null without a match, also where the match is empty."""
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


def _words(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def mapped(x: Column, mapping: dict, otherwise=None) -> Column:
    """The value of ``x`` in a mapping from values (or tuples of values) to values; ``otherwise`` is a value, or ``x`` itself, or null."""
    out = None
    for k, v in mapping.items():
        hit = x.isin(list(k) if isinstance(k, tuple) else [k])
        out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    rest = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return rest if out is None else out.otherwise(rest)


def replace_words(s: Column, mapping: dict) -> Column:
    """Whole words replaced; white space becomes single blanks."""
    return F.array_join(F.transform(F.split(_words(s), " "), lambda w: mapped(w, mapping, w)), " ")


# logic


def least(*xs: Column) -> Column:
    return F.least(*xs) if len(xs) > 1 else xs[0]


def greatest(*xs: Column) -> Column:
    return F.greatest(*xs) if len(xs) > 1 else xs[0]


def divide(a: Column, b: Column) -> Column:
    """Always a float; null for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


# numbers


def floor(x: Column, kind: str) -> Column:
    """Of kind int, float or decimal; decimals get scale 0."""
    return x if kind == "int" else F.floor(x).cast("double") if kind == "float" else F.floor(x)


def ceil(x: Column, kind: str) -> Column:
    return x if kind == "int" else F.ceil(x).cast("double") if kind == "float" else F.ceil(x)


def parse_number(s: Column) -> Column:
    """decimal(38,6); commas only as thousands separators; null if unreadable."""
    t = F.trim(s)
    grouped = t.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$")
    return F.when(grouped, F.regexp_replace(t, ",", "")).otherwise(t).try_cast("decimal(38,6)")


def to_decimal(x: Column, p: int, s: int) -> Column:
    if not 1 <= p <= 38 or s > p:
        raise AnalysisError("L101", f"decimal({p},{s}) is out of range")
    return x.try_cast(f"decimal({p},{s})")


def to_int(x: Column) -> Column:
    """Halves away from zero; null for text that is no number."""
    return F.round(x.try_cast("decimal(38,10)")).try_cast("bigint")


def to_float(x: Column) -> Column:
    return x.try_cast("double")


def to_bool(x: Column) -> Column:
    return x.try_cast("boolean")


def to_string(x: Column) -> Column:
    return x.cast("string")


# dates

#: What each sign of a date format is in Java's patterns.
_SIGNS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "b": "MMM", "B": "MMMM", "p": "a", "j": "DDD", "z": "xx", "%": "%"}


def java_format(fmt: str) -> str:
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%":
            if i + 1 == len(fmt) or fmt[i + 1] not in _SIGNS:
                raise AnalysisError("L101", f"date format {fmt} has an unknown sign")
            out += _SIGNS[fmt[i + 1]]
            i += 2
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return out


def parse_timestamp(s: Column, *formats: str) -> Column:
    """The first format that reads the text; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(s), F.lit(java_format(f))) for f in formats]).cast("timestamp_ntz")


def parse_date(s: Column, *formats: str) -> Column:
    return parse_timestamp(s, *formats).cast("date")


def to_date(x: Column) -> Column:
    return x.try_cast("date")


def date(y: Column, m: Column, d: Column) -> Column:
    """Null for a day that does not exist."""
    text = F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int"))
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), text.try_cast("date"))


def today(pinned: datetime.date | None = None) -> Column:
    return F.lit(pinned or datetime.date.today())


def _long(f):
    return lambda x: f(x).cast("long")


def date_diff(a: Column, b: Column) -> Column:
    """Signed days from a to b."""
    return F.datediff(b, a).cast("long")


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(b, a)).cast("long")


def add_days(d: Column, n: Column, kind: str = "date") -> Column:
    return F.date_add(d, n.cast("int")) if kind == "date" else d + F.make_dt_interval(n.cast("int"))


# similarity


def _normal(s: Column) -> Column:
    return F.lower(_words(s))


def jaro_winkler(a: bytes, b: bytes) -> float:
    """Jaro-Winkler on bytes: boost above 0.7 for up to four common first bytes, 0.1 each."""
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = bytearray(len(b)), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = 1
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [y for j, y in enumerate(b) if used[j]]
    swapped = sum(x != y for x, y in zip(left, right)) // 2
    score = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if score > 0.7:
        same = 0
        while same < min(4, len(a), len(b)) and a[same] == b[same]:
            same += 1
        score += 0.1 * same * (1 - score)
    return score


def jaro_winkler_many(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """jaro_winkler() of many pairs, those of about one length side by side."""
    out = np.empty(len(xs))
    la, lb = (np.fromiter(map(len, v), dtype=np.int64, count=len(v)) for v in (xs, ys))
    width = np.maximum(8, 1 << np.ceil(np.log2(np.maximum(np.maximum(la, lb), 1))).astype(np.int64))
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w > 128:  # long texts are few
            out[rows] = [jaro_winkler(xs[i], ys[i]) for i in rows]
            continue
        a, b = (np.frombuffer(b"".join(v[i].ljust(w, b"\0") for i in rows), dtype=np.uint8).reshape(-1, w) for v in (xs, ys))
        na, nb, n = la[rows], lb[rows], len(rows)
        reach = np.maximum(np.maximum(na, nb) // 2 - 1, 0)
        at, used, left = np.arange(w), np.zeros((n, w), dtype=bool), np.zeros((n, w), dtype=bool)
        for i in range(int(na.max())):
            fits = (b == a[:, i : i + 1]) & ~used & (np.abs(at - i) <= reach[:, None]) & (at < nb[:, None]) & (i < na)[:, None]
            hit = np.flatnonzero(fits.any(axis=1))
            used[hit, fits[hit].argmax(axis=1)] = left[hit, i] = True
        m = left.sum(axis=1)
        pair = np.repeat(np.arange(n), m)
        swapped = np.bincount(pair, weights=a[left] != b[used], minlength=n).astype(np.int64) // 2
        some = np.maximum(m, 1)
        score = np.where(m > 0, (m / np.maximum(na, 1) + m / np.maximum(nb, 1) + (m - swapped) / some) / 3, 0.0)
        same = np.zeros(n, dtype=np.int64)
        for i in range(4):
            same += (same == i) & (i < na) & (i < nb) & (a[:, i] == b[:, i])
        score = np.where(score > 0.7, score + 0.1 * same * (1 - score), score)
        out[rows] = np.where((na == nb) & (a == b).all(axis=1), 1.0, score)
    return out


def similarity(a: Column, b: Column) -> Column:
    """Jaro-Winkler of texts without regard to case and white space; null if either is blank."""
    import pandas as pd

    def both(x: pd.Series, y: pd.Series) -> pd.Series:
        known = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        out[known] = jaro_winkler_many([v.encode() for v in x[known]], [v.encode() for v in y[known]])
        return pd.Series(out).where(known).astype("Float64")

    both.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    blank = lambda s: F.nullif(_normal(s), F.lit(""))
    return F.pandas_udf(both, "double")(blank(a), blank(b))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of words; null if either is blank."""
    x, y = (F.array_distinct(F.split(_normal(s), " ")) for s in (a, b))
    share = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when((_words(a) != "") & (_words(b) != ""), share.cast("double"))


def levenshtein(a: Column, b: Column) -> Column:
    """Edits between the UTF-8 bytes."""
    as_bytes = lambda s: F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(as_bytes(a), as_bytes(b)).cast("long")


def native(name: str, *xs: Column) -> Column:
    """Any scalar function of Spark: the way out of the portable language."""
    return F.call_function(name, *xs)


#: The language's function names.
REGISTRY = {
    "lower": F.lower, "upper": F.upper, "trim": F.trim, "strip_accents": strip_accents, "replace": F.replace, "concat": concat, "contains": F.contains,
    "starts_with": F.startswith, "ends_with": F.endswith, "length": _long(F.length), "substr": substr, "lpad": F.lpad, "rpad": F.rpad,
    "regexp_replace": regexp_replace, "regexp_extract": regexp_extract, "regexp_matches": F.regexp_like, "replace_words": replace_words,
    "coalesce": F.coalesce, "if": lambda c, a, b: F.when(c, a).otherwise(b), "nullif": F.nullif, "is_null": F.isnull, "least": least, "greatest": greatest,
    "abs": F.abs, "round": F.round, "floor": floor, "ceil": ceil, "parse_number": parse_number, "to_decimal": to_decimal, "to_int": to_int, "to_float": to_float,
    "to_string": to_string, "to_bool": to_bool, "to_date": to_date, "date": date, "today": today, "parse_date": parse_date, "parse_timestamp": parse_timestamp,
    "year": _long(F.year), "month": _long(F.month), "day": _long(F.day), "quarter": _long(F.quarter), "day_of_week": lambda d: (F.weekday(d) + 1).cast("long"),
    "days_between": days_between, "date_diff": date_diff, "add_days": add_days, "similarity": similarity, "token_similarity": token_similarity,
    "levenshtein": levenshtein, "map": mapped, "native": native,
}
