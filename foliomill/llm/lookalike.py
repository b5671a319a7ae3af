"""One form for texts that look the same.

The code points of the collection and the strings they stand for (compatibility and canonical decompositions) are the
nodes of a union-find forest; characters that cannot be told apart join two nodes, and classes are transitive.  Each
class is represented by its most frequent member, by counts over all texts; a class with a longer member by that, so
that ligatures fall apart.  An Aho-Corasick automaton over all members, strings such as a letter with its accent among
them, rewrites a text in one greedy pass from left to right; what accents then stand on a rewritten letter are composed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Letters of other scripts that look like a Latin letter, beside it.
LOOK_ALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚК", "M": "МΜ",
    "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥУ", "Z": "Ζ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ց", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ",
    "q": "ԛզ", "s": "ѕ", "u": "սυ", "v": "νѵ", "w": "ԝա", "x": "х", "y": "уүγ",
}
# Kinds of hyphen; compatibility forms of them come in by decomposition.
HYPHENS = "-‐‑⁃˗−"
# Characters without width or shape that are not in the category of format characters.
NO_SHAPE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"


def invisible(c: str) -> bool:
    n = ord(c)
    if 0x600 <= n <= 0x605 or n in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD):
        return False  # format characters that are drawn
    return unicodedata.category(c) == "Cf" or c in NO_SHAPE or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF


class Forest:
    """Union-find over strings."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """What each code point and each string of the collection's classes is rewritten to, where that is not itself.

    `counts` has how often each code point stands in the collection.
    """
    forest = Forest()
    chars = set(counts) | {x for k, v in LOOK_ALIKES.items() for x in k + v} | set(HYPHENS) | {" "}
    for c in list(chars):
        whole = unicodedata.normalize("NFKD", c)
        if invisible(c):
            forest.union(c, "")
        elif unicodedata.category(c) == "Zs":
            forest.union(c, " ")
        elif whole != c:
            forest.union(c, whole)
            if len(whole) > 1:
                chars.update(whole)
    for c in chars:
        forest.find(c)
    for latin, others in LOOK_ALIKES.items():
        for o in others:
            forest.union(o, latin)
    for h in HYPHENS:
        forest.union(h, "-")
    classes: dict[str, list[str]] = {}
    for x in forest.parent:
        classes.setdefault(forest.find(x), []).append(x)
    chosen: dict[str, str] = {}
    for members in classes.values():
        if "" in members:
            best = ""
        else:
            longest = max(map(len, members))
            best = min((m for m in members if len(m) == longest), key=lambda m: (-counts.get(m, 0), m))
        for m in members:
            chosen[m] = best

    def whole(s: str, seen: frozenset = frozenset()) -> str:
        """A longer representative is rewritten character by character."""
        out = chosen.get(s, s)
        if len(out) <= 1 or out in seen:
            return out
        return "".join(whole(c, seen | {out}) for c in out)

    return {m: w for m in chars | set(forest.parent) if m and (w := unicodedata.normalize("NFC", whole(m))) != m}


def character_counts(texts: DataFrame) -> dict[str, int]:
    """How often each code point stands in the only column of `texts`; the result is bounded by Unicode's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0x110000, dtype=np.int64)
        for b in batches:
            whole = "".join(x for x in b.column(0).to_pylist() if x)
            if whole:
                n = np.bincount(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
                seen[: len(n)] += n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["c", "n"])

    rows = texts.mapInArrow(count, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n")).collect()
    return {chr(r["c"]): r["n"] for r in rows}


class Rewriter:
    """Rewrites by the longest member that begins at each place, from left to right."""

    def __init__(self, to: dict[str, str]):
        import ahocorasick

        self.to = to
        self.automaton = ahocorasick.Automaton()
        for member in to:
            self.automaton.add_word(member, member)
        if to:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        if self.to:
            for end, member in self.automaton.iter_long(text):
                start = end + 1 - len(member)
                out.append(text[at:start])
                out.append(self.to[member])
                at = end + 1
        out.append(text[at:])
        return unicodedata.normalize("NFC", "".join(out))


_rewriters: dict[int, Rewriter] = {}


def one_form(df: DataFrame, key: str, text: str, to: dict[str, str]) -> DataFrame:
    """key, text, form: every text with its one form; null stays null, texts that are it already are not sent to Python.

    Pure ASCII texts are left as they are, unless an ASCII character is not its class's representative.
    """
    held = df.sparkSession.sparkContext.broadcast(to)  # at most one entry for each code point
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("text", T.StringType()), T.StructField("form", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite = Rewriter(held.value)
        for b in batches:
            b.columns = ["k", "t"]
            yield pd.DataFrame({key: b["k"], "text": b["t"], "form": [rewrite(t) for t in b["t"]]})

    df = df.select(F.col(key), F.col(text).alias("text"))
    plain = F.coalesce(F.octet_length("text") == F.length("text"), F.lit(True)) if not any(c.isascii() for c in to) else F.col("text").isNull()
    return df.where(plain).withColumn("form", F.col("text")).unionByName(df.where(~plain).mapInPandas(run, schema))


def _hashes(c: str) -> list[Column]:
    return [F.xxhash64(c), F.xxhash64(F.lit(1), c)]


def look_alike_pairs(forms: DataFrame, key: str) -> DataFrame:
    """a < b: rows of different texts with one form.  A key given twice counts once; null texts have no pair.

    Only forms that some text differs from can have pairs, so the others are dropped before the shuffle.
    """
    f1, f2 = _hashes("form")
    t1, t2 = _hashes("text")
    rows = forms.where("form IS NOT NULL").select(F.col(key).alias("id"), f1.alias("f1"), f2.alias("f2"), t1.alias("t1"), t2.alias("t2"), (F.col("text") != F.col("form")).alias("other"))
    from foliomill.session import staged

    rows = staged(rows, "forms")
    keys = rows.where("other").select("f1", "f2").distinct()
    rows = rows.drop("other").join(keys, ["f1", "f2"], "left_semi").distinct()
    # which texts share a form: a few for each, however many rows have them
    kinds = rows.select("f1", "f2", "t1", "t2").distinct()
    meet = kinds.join(kinds.withColumnsRenamed({"t1": "u1", "t2": "u2"}), ["f1", "f2"]).where("t1 < u1 OR (t1 = u1 AND t2 < u2)").select("t1", "t2", "u1", "u2")
    left = rows.select("t1", "t2", F.col("id").alias("x")).join(meet, ["t1", "t2"])
    return left.join(rows.select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("id").alias("y")), ["u1", "u2"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
