"""BPE encoding and decoding with content-defined chunk reuse.

Whole texts are cut where a rolling hash of the last bytes has a fixed pattern, so that equal passages of different documents
give equal chunks. The inside of a chunk, between its first and last blank, is encoded once and kept in a bounded cache of the
worker, of which the half not used for longest goes when it is full; the pieces of words at a join of two chunks are put together and encoded again, over as many chunks as a word spans,
so that the ids are exactly those of the whole text. Words are encoded once for as long as they stay in a second cache.

A global exchange of chunks would move each text twice through a shuffle and cost more than encoding; reuse is therefore per
worker, which documents of one task or of tasks that follow each other share.

The vocabulary is a file of the tokenizers library (its path is a parameter). Chunks and words can be encoded apart where the file's
rules are those of RULES: blanks and case don't matter beyond a word, and tokens are joined by blanks. With other rules each
whole text goes through the library. Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows give
equal rows; texts of any length are encoded whole; other columns of the caller are not read.
"""

from __future__ import annotations

import json
import sys
import types
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import common as C

WINDOW, MASK = 16, (1 << 9) - 1
CACHED_WORDS, CACHED_CHUNK_BYTES = 150_000, 8 << 20

_BLANK = b" \t\n\r\x0b\x0c"
#: The pieces that the vocabulary's own splitting rule gives within a word, fixed by the vocabulary file.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: The normaliser, splitter and decoder of a vocabulary file whose words can be encoded apart.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _PIECES}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
    "decoder": None,
}


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Words(dict):
    """Word -> ids in two generations: when the young one is full it becomes the old one, from which words in use return."""

    def __init__(self, learn):
        self.old: dict[bytes, bytes] = {}
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.learn([word])[0]
        self[word] = ids
        return ids

    def see(self, words: set[bytes]) -> None:
        """Have all of ``words`` at hand, learning the unknown ones at once."""
        if len(self) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        old = self.old
        unknown = [w for w in words if w not in self and w not in old]
        for a in range(0, len(unknown), 50_000):
            part = unknown[a : a + 50_000]
            self.update(zip(part, self.learn(part)))


class Encoder:
    """Encodes and decodes words and texts exactly as the whole-text calls of the library do."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.by_words = {k: json.loads(self.whole.to_str()).get(k) for k in RULES} == RULES
        self.bare = Tokenizer(self.whole.model)
        self.tokens = [(self.whole.id_to_token(i) or "").encode() for i in range(self.whole.get_vocab_size(with_added_tokens=True))]
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.pieces = regex.compile(_PIECES).findall
        self.letters = _byte_letters()
        self.ids = Words(self.learn)
        self.chunks: dict[bytes, bytes] = {}
        self.old_chunks: dict[bytes, bytes] = {}
        self.chunk_bytes = 0

    def _plain(self, word: str) -> list[str] | None:
        """The pieces of a Latin word in byte letters; None where the library should see the word itself."""
        low = word.lower()
        if low.isascii():
            if word.isalpha():
                return [low]
            if low[:-1].isalpha() and low[-1] in ".,!?;:|":
                return [low[:-1], low[-1]]
        if len(low) != len(word) or max(low) > "ɏ" or any(s in word for s in self.special):
            return None
        if not word.isascii() and not (max(word) <= "ɏ" and unicodedata.is_normalized("NFC", word)):
            return None
        pieces = [low] if low.isalpha() else self.pieces(low)
        if "".join(pieces) != low:
            return None
        if low.isascii() and low.isprintable():
            return pieces
        return [p.encode().decode("latin-1").translate(self.letters) for p in pieces]

    def learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        plain, where, out = [], [], [b""] * len(words)
        for i, w in enumerate(words):
            p = self._plain(w.decode())
            if p is None:
                out[i] = np.array(self.whole.encode(w.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                plain += p
                where += [i] * len(p)
        if plain:
            e = self.bare.encode(plain, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, dtype="<u4")
            at = np.array(where)[np.array(e.word_ids)]
            raw = ids.tobytes()
            ends = np.flatnonzero(np.append(at[1:] != at[:-1], True)) + 1
            a = 0
            for b, i in zip(ends.tolist(), at[ends - 1].tolist()):
                out[i] = raw[4 * a : 4 * b]
                a = b
        return out

    def words(self, text: bytes) -> bytes:
        """Ids of blank-separated words."""
        return b"".join(map(self.ids.__getitem__, text.split()))

    def inside(self, chunk: bytes) -> bytes:
        """words(), once for each chunk in the cache."""
        got = self.chunks.get(chunk)
        if got is None:
            got = self.old_chunks.get(chunk)
            if got is None:
                got = self.words(chunk)
            size = len(chunk) + len(got) + 200
            if self.chunk_bytes + size > CACHED_CHUNK_BYTES // 2:
                self.old_chunks, self.chunks, self.chunk_bytes = self.chunks, {}, 0
            self.chunks[chunk] = got
            self.chunk_bytes += size
        return got

    def text(self, data: bytes, cuts: np.ndarray) -> bytes:
        """Ids of a whole text that is cut at the given places."""
        ids, open_word = [], b""
        edges = [0, *cuts.tolist(), len(data)]
        for a, b in zip(edges, edges[1:]):
            chunk = data[a:b]
            body = chunk.lstrip(_BLANK)
            if len(body) == len(chunk):  # a word may go on from the chunk before
                parts = chunk.split(None, 1)
                head = parts[0] if parts else b""
                if len(head) == len(chunk):
                    open_word += chunk
                    continue
                open_word += head
                body = chunk[len(head) :].lstrip(_BLANK)
            if open_word:
                ids.append(self.words(open_word))
            open_word = b""
            if body and body[-1] not in _BLANK:
                open_word = body.rsplit(None, 1)[-1]
                body = body[: len(body) - len(open_word)]
            if body:
                ids.append(self.inside(body))
        if open_word:
            ids.append(self.words(open_word))
        return b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        """The library's decoded text: without a decoder it joins tokens by blanks."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def cut_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All content-defined cuts in a buffer, and for each text the range of its own."""
    h = C.RollingHash(data, seed=11).windows(WINDOW)
    cuts = np.flatnonzero((h & C.U(MASK)) == 0) + WINDOW
    # a window must lie within one text; then its place depends on that text's bytes only
    rows = np.searchsorted(offsets, cuts - 1, side="right") - 1
    cuts = cuts[cuts - WINDOW >= offsets[rows]]
    return cuts, np.searchsorted(cuts, offsets)


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary; it outlives tasks."""
    kept = sys.modules.setdefault("_ledgerloom_encoders", types.ModuleType("_ledgerloom_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def encode_texts(col, path: str, limit: int = 1 << 18) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """For each text of an Arrow column its ids (little-endian unsigned 32-bit) and its decoded text in UTF-8; the texts of
    ``limit`` bytes, or one longer text, at a time."""
    e = encoder(path)
    data, offsets = C.text_bytes(col)
    for a, b in C.slices(offsets, limit):
        ids, decoded = [], []
        d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        raw = d.tobytes()
        if not e.by_words:
            for i in range(b - a):
                found = e.whole.encode(raw[o[i] : o[i + 1]].decode(), add_special_tokens=False).ids
                ids.append(np.array(found, dtype="<u4").tobytes())
                decoded.append(e.whole.decode(found, skip_special_tokens=False).encode())
        else:
            cuts, own = cut_points(d, o)
            e.ids.see(set(raw.split()))
            for i in range(b - a):
                ids.append(e.text(raw[o[i] : o[i + 1]], cuts[own[i] : own[i + 1]] - o[i]))
                decoded.append(e.decode(ids[-1]))
        yield ids, decoded


def encode(text: Column, path: str) -> Column:
    """A struct of ids (binary, little-endian unsigned 32-bit) and decoded (string) for each text. Ids take several times the bytes of
    rare words, so they leave a worker slice by slice and not batch by batch."""
    import pyarrow as pa

    def coded(columns):
        for col in columns:
            for ids, decoded in encode_texts(col, path):
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())], ["ids", "decoded"])

    coded.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(coded, "ids binary, decoded string")(text)
