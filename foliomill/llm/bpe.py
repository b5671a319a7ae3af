"""Byte-level BPE over whole corpora by a backtracking encoder.

Instead of merging pairs until none is left, the encoder takes at each position the longest token that an Aho-Corasick
automaton found there and keeps it if it is compatible with the token before it: merging the two tokens' bytes in the
order of the vocabulary must give just these two tokens.  Otherwise it goes on with the next shorter token, or takes
the token before it back.  Positions from which no encoding is left are marked and never tried again, so the work is
linear in the text.  Whether a pair is compatible depends on the vocabulary alone and is kept in a table.  Decoding
reads slices of one byte string by a table of offsets.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

#: Splits a text into the pieces that are encoded on their own (fixed by the public vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded pieces that a worker remembers before it starts afresh: a bound on memory, not on what is encoded.
REMEMBERED = 1 << 19


class Encoder:
    """Encodes bytes by the ranks of a vocabulary file (a base64 token and its rank on each line)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.pieces = regex.compile(PATTERN).findall
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._compatible: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int] = {}
        self._known: dict[str, tuple[int, ...]] = {}

    def halves(self, r: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one: the last merge of its own bytes; None for a single byte."""
        if r not in self._halves:
            t = self.token[r]
            # parts of the token, merged in the order of ranks by merges below its own rank, until two are left
            parts = [t[i : i + 1] for i in range(len(t))]
            while len(parts) > 2:
                best, at = r, -1
                for i in range(len(parts) - 1):
                    m = self.rank.get(parts[i] + parts[i + 1], r)
                    if m < best:
                        best, at = m, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[r] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        return self._halves[r]

    def compatible(self, a: int, b: int) -> bool:
        """True if merging the bytes of the two tokens in rank order gives the two tokens again."""
        known = self._compatible.get((a, b))
        if known is None:
            known = self._compatible[a, b] = self._stays(a, b)
        return known

    def _stays(self, a: int, b: int) -> bool:
        """Undoes merges, the later one first, and looks for an earlier merge across the border."""
        limit = len(self.token)
        while True:
            across = self.rank.get(self.token[a] + self.token[b])
            if across is not None and across < limit:
                return False
            if a > b:
                limit, h = a, self.halves(a)
                if h is None:
                    h, limit = self.halves(b), b
                    if h is None:
                        return True
                    b = h[0]
                    # a border merge of the same rank as the left part's sibling wins when it stands further left
                    limit = limit + 1
                else:
                    a = h[1]
            else:
                limit, h = b, self.halves(b)
                if h is None:
                    limit, h = a, self.halves(a)
                    if h is None:
                        return True
                    a = h[1]
                else:
                    b = h[0]
                    limit = limit + 1

    def shorter(self, r: int) -> int:
        """The longest proper prefix of the token that is a token, or -1."""
        known = self._shorter.get(r)
        if known is None:
            t = self.token[r]
            known = next((self.rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank), -1)
            self._shorter[r] = known
        return known

    def longest(self, data: str) -> list[int]:
        """The longest token that starts at each position."""
        best = [-1] * len(data)
        token = self.token
        for end, r in self.automaton.iter(data):
            best[end + 1 - len(token[r])] = r  # matches that start at one position come in order of length
        return best

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        n, longest = len(data), self.longest(data.decode("latin-1"))
        dead = bytearray(n + 1)  # positions from which the rest can't be encoded after the tokens chosen so far
        out: list[int] = []
        pos, nxt = 0, longest[0]
        while nxt >= 0:
            r = nxt
            while True:
                end = pos + len(self.token[r])
                if not dead[end] and (not out or self.compatible(out[-1], r)):
                    out.append(r)
                    pos = end
                    nxt = longest[pos] if pos < n else -1
                    break
                shorter = self.shorter(r)
                if shorter >= 0:
                    r = shorter
                    continue
                dead[pos] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                r = out.pop()
                pos -= len(self.token[r])
                r = self.shorter(r)
                while r < 0:
                    dead[pos] = 1
                    r = out.pop()
                    pos -= len(self.token[r])
                    r = self.shorter(r)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null one.  Strings that look like special tokens are ordinary text."""
        if not text:
            return []
        out: list[int] = []
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = tuple(self.encode_piece(piece.encode("utf-8")))
                if len(piece) <= 64:
                    known[piece] = ids
            out += ids
        return out


class Decoder:
    """The bytes of all tokens in one string; token i lies between offsets i and i + 1."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f))
        self.offset, parts = [0] * (pairs[-1][0] + 2), []
        at = 0
        for r, t in pairs:
            self.offset[r], at = at, at + len(t)
            self.offset[r + 1] = at
            parts.append(t)
        self.all = b"".join(parts)

    def decode(self, ids) -> str:
        o, a = self.offset, self.all
        return b"".join([a[o[i] : o[i + 1]] for i in ids]).decode("utf-8", "replace")


_loaded: dict[tuple[type, str], object] = {}


def _load(kind: type, path: str):
    """Built once in each Python worker."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def encode_texts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """key, ids: the token ids of each row's text, an empty list for an empty or null text; rows are kept as they are.

    `path` is the vocabulary file, which every worker reads from its own disk.  Other columns are not read.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _load(Encoder, path)
        for b in batches:
            b.columns = ["k", "t"]
            yield pd.DataFrame({key: b["k"], "ids": [encoder.encode(t) for t in b["t"]]})

    return df.select(F.col(key), F.col(text)).mapInPandas(run, schema)


def decode_ids(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """key, text: the inverse of `encode_texts`; null ids give null."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = _load(Decoder, path)
        for b in batches:
            b.columns = ["k", "i"]
            yield pd.DataFrame({key: b["k"], "text": [None if i is None else decoder.decode(i) for i in b["i"]]})

    return df.select(F.col(key), F.col(ids)).mapInPandas(run, schema)
