"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed against it: from each point the longest
string that occurs in the language's text is one phrase, the next phrase begins after it. The language that needs the
fewest phrases, normalised by the logarithm of its text's length, wins (Ziv and Merhav, 1993; Helmer, 2007).

Whole texts are parsed. To do this for many places at once, a text is cut into pieces that are first parsed as if a phrase began with
each; then the automaton's state at the end of a piece is carried into the next one, which is parsed again until a phrase begins where
one began before - from there on the two parses are one - and so on until no state changes.

Letters are lower-cased, every run of other characters is one blank; every letter of the learned texts is a symbol of its own, and a letter
that a language's text lacks is a phrase. Each language keeps all of its learned text. Defined cases: null texts and texts
without a letter are ``und`` with score 0; ties go to the language that comes first by name; repeated rows get equal answers; texts of any
length are parsed whole; with nothing to learn from every text is ``und``; other columns of the caller are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

UND = "und"
PIECE = 256


def _codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, and the offsets of the texts."""
    low = [t.lower() for t in texts]
    data = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return data, np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)


def _letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Automaton:
    """The transitions of a suffix automaton in an open-addressing hash table: state + symbol -> state, states in steps of the alphabet's size."""

    EMPTY = C.U((1 << 64) - 1)

    def __init__(self, seq: np.ndarray, n_symbols: int):
        nxt = suffix_automaton(seq)
        self.start = C.U(len(nxt) * n_symbols)  # in this state any symbol begins a phrase
        self.first = np.full(n_symbols, self.start, dtype=C.U)
        for c, state in nxt[0].items():
            self.first[c] = state * n_symbols
        key = np.array([i * n_symbols + c for i, t in enumerate(nxt) for c in t], dtype=C.U)
        value = np.array([x * n_symbols for t in nxt for x in t.values()], dtype=C.U)
        bits = max(4, (4 * len(key)).bit_length())
        self.shift, self.mask = C.U(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, self.EMPTY, dtype=C.U), np.zeros(1 << bits, dtype=C.U)
        left, at = np.arange(len(key)), self._slot(key)
        while len(left):
            free = np.flatnonzero(self.keys[at[left]] == self.EMPTY)
            winners = left[free][np.unique(at[left[free]], return_index=True)[1]]
            self.keys[at[winners]], self.values[at[winners]] = key[winners], value[winners]
            left = left[self.keys[at[left]] != key[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * C.U(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether a phrase begins with the symbol."""
        key = state + symbol
        at = self._slot(key)
        got = self.keys[at]
        out = self.values[at]
        new = got != key
        missed = np.flatnonzero(new)
        if len(missed):
            open_ = missed[got[missed] != self.EMPTY]
            while len(open_):  # another key's place: the next one
                at[open_] = (at[open_] + 1) & self.mask
                here = self.keys[at[open_]]
                hit = here == key[open_]
                out[open_[hit]] = self.values[at[open_[hit]]]
                new[open_[hit]] = False
                open_ = open_[~hit & (here != self.EMPTY)]
            missed = missed[new[missed]]
            out[missed] = self.first[symbol[missed].view(np.int64)]
        return out, new


@dataclass
class LanguageModel:
    """codes: code point -> symbol (0 blank, 1 a letter that no learned text has); automata: one for each language."""

    names: list[str]
    codes: np.ndarray
    automata: list[Automaton]
    bits: np.ndarray


def symbols(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with each run of blanks as one, and the offsets of the texts."""
    s = codes[data]
    keep = np.ones(len(s), dtype=bool)
    if len(s):
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        keep[offsets[:-1][offsets[:-1] < len(s)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], total[offsets]


def suffix_automaton(seq: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of ``seq``."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in seq.tolist():
        cur = len(nxt)
        nxt.append({})
        link.append(-1)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def build(samples: dict[str, str]) -> LanguageModel:
    """Automata over the text of each language."""
    names = sorted(k for k, t in samples.items() if any(ch.isalpha() for ch in t))
    codes = _letter_table().astype(np.int32)
    letters = sorted({ch for k in names for ch in samples[k].lower() if ch.isalpha()})
    for i, ch in enumerate(letters):
        codes[ord(ch)] = i + 2
    seqs = [symbols(*_codepoints([samples[k]]), codes)[0] for k in names]
    return LanguageModel(names, codes, [Automaton(s, len(letters) + 2) for s in seqs], np.log2([len(s) + 1.0 for s in seqs]))


def phrases(model: LanguageModel, sym: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Phrases that each text needs in each language."""
    n = len(offsets) - 1
    out = np.zeros((n, len(model.names)))
    lens = np.diff(offsets)
    pieces = (lens + PIECE - 1) // PIECE
    rows = np.repeat(np.arange(n), pieces)
    if not len(rows):
        return out
    begin = offsets[rows] + (np.arange(len(rows)) - (np.cumsum(pieces) - pieces)[rows]) * PIECE
    size = np.minimum(PIECE, offsets[rows + 1] - begin)
    order = np.argsort(-size, kind="stable")  # whole pieces first; the last ones of texts, which have none behind them, by length
    lane = np.empty(len(order), dtype=np.int64)
    lane[order] = np.arange(len(order))
    behind = np.full(len(order), -1)  # the lane of the piece behind, in the same text
    inner = np.flatnonzero(rows[1:] == rows[:-1])
    behind[lane[inner]] = lane[inner + 1]
    begin, size, rows = begin[order], size[order], rows[order]
    longest = int(size[0])
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # so many pieces are longer than t
    symbol = np.zeros((longest, len(rows)), dtype=C.U)
    for t in range(longest):
        symbol[t, : active[t]] = sym[begin[: active[t]] + t]
    starts = np.empty((longest, len(rows)), dtype=bool)
    for l, automaton in enumerate(model.automata):
        starts[:] = False
        state = np.full(len(rows), automaton.start, dtype=C.U)
        for t in range(longest):
            k = active[t]
            state[:k], starts[t, :k] = automaton.step(state[:k], symbol[t, :k])
        on = np.flatnonzero(behind >= 0)
        lanes, state = behind[on], state[on]
        while len(lanes):
            by = np.argsort(lanes)
            lanes, state = lanes[by], state[by]
            met = np.zeros(len(lanes), dtype=bool)
            for t in range(longest):
                k = int(np.searchsorted(lanes, active[t]))  # the others have ended
                if t % 4 == 0:  # from where the parses meet on they are one
                    stay = ~met
                    stay[k:] = False
                    lanes, state, met = lanes[stay], state[stay], met[stay]
                    k = len(lanes)
                if not k:
                    break
                mine = lanes[:k]
                state[:k], new = automaton.step(state[:k], symbol[t, mine])
                met[:k] |= new & starts[t, mine]
                starts[t, mine] = new
            on = np.flatnonzero(~met & (behind[lanes] >= 0))
            lanes, state = behind[lanes[on]], state[on]
        out[:, l] = np.bincount(rows, weights=starts.sum(axis=0), minlength=n)
    return out


def predict(model: LanguageModel, texts: list[str | None], limit: int = 1 << 22) -> tuple[list[str], np.ndarray]:
    """The language of each text and how sure it is: a softmax over bits per symbol, sharper for longer texts up to 64 symbols."""
    names, scores = [], np.zeros(len(texts))
    a = 0
    while a < len(texts):
        b, total = a, 0
        while b < len(texts) and (b == a or total + len(texts[b] or "") <= limit):
            total += len(texts[b] or "")
            b += 1
        data, offsets = _codepoints([t or "" for t in texts[a:b]])
        sym, so = symbols(data, offsets, model.codes)
        has = np.add.reduceat(np.append(sym, 0) > 0, so[:-1]) * (np.diff(so) > 0) if len(so) > 1 else np.zeros(0)
        if not model.names:
            names += [UND] * (b - a)
        else:
            cost = phrases(model, sym, so) * model.bits / np.maximum(np.diff(so), 1)[:, None]
            best = cost.argmin(1)
            sure = 1 / np.exp2((cost.min(1)[:, None] - cost) * np.minimum(np.diff(so), 64)[:, None]).sum(1)
            names += [model.names[i] if h else UND for i, h in zip(best, has)]
            scores[a:b] = np.where(has > 0, sure, 0.0)
        a = b
    return names, scores


def fit(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_chars: int = 24_000, max_docs: int = 40, max_piece: int = 3_000, max_languages: int = 64) -> LanguageModel:
    """Learn from rows for which ``training`` holds and ``lang`` is known.

    The sample is bounded by its parameters: of each language at most ``max_docs`` documents, those with the smallest hashes of their ids (one
    row for an id: the one with the smallest hash of its text), of each at most ``max_piece`` characters, from a place that the id's hash
    chooses, and together at most ``max_chars`` characters. More than ``max_languages`` languages are refused, so that the model, about
    3 MB for each, is small enough for every executor.
    """
    known = docs.filter(training & F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    names = known.select(F.col(lang).alias("l")).distinct().limit(max_languages + 1).count()
    if names > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    w = Window.partitionBy("l").orderBy("h", "id")
    h = F.xxhash64(F.lit("lang"), F.col(doc_id))
    ids = known.select(F.col(doc_id).alias("id"), F.col(lang).alias("l"), h.alias("h")).distinct().withColumn("n", F.row_number().over(w)).filter(F.col("n") <= max_docs)
    body = F.coalesce(F.col(text), F.lit(""))
    start = F.pmod(h, F.greatest(F.length(body) - max_piece + 1, F.lit(1))).cast("int") + 1
    pieces = known.select(F.col(doc_id).alias("id"), F.col(lang).alias("l"), F.struct(F.xxhash64(body).alias("p"), F.substring(body, start, F.lit(max_piece)).alias("t")).alias("x"))
    rows = pieces.join(F.broadcast(ids), ["id", "l"]).groupBy("l", "n").agg(F.min("x").alias("x")).collect()
    samples: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["l"], r["n"])):
        samples[r["l"]] = (samples.get(r["l"], "") + " " + r["x"]["t"])[: max_chars + 1]
    return build(samples)


def identify(spark, model: LanguageModel, text: Column) -> Column:
    """A struct of lang_pred and score for each text."""
    import pyarrow as pa

    shared = spark.sparkContext.broadcast(model)

    @C.arrow_udf("lang_pred string, score double")
    def language(col):
        names, scores = predict(shared.value, col.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    return language(text)
