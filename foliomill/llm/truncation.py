"""Texts cut off by a field limit or while being sent.

Whole texts are cut artificially to get positives; a logistic regression over hashed features of the closing characters,
the closing line, punctuation and the distance to the source's length limit is fitted on a bounded sample, and every
text is scored.  Texts of the sample that the first fit takes for cut are left out of the second as doubtful.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from foliomill.session import hashed_sample

#: Texts for the fit, chosen by the hash of their key; all texts are scored.
SAMPLE = 20_000
DIMENSIONS = 1 << 15
#: Closing characters that are looked at.
TAIL = 240
#: A source has a limit if at least so many texts have just its greatest length ...
LIMIT_COUNT = 4
#: ... and they are at least so many times as many as of the lengths just below.
LIMIT_EXCESS = 8
#: What senders put after a cut, used for a share of the artificial cuts.
MARKS = ["…", "...", " […]", " [...]", " [", "�", "&am", "&", "&quo", "\\u00"]
#: Artificial cuts of each text of the sample.
CUTS = 3


def source_limits(texts: DataFrame, source: str, text: str) -> DataFrame:
    """source, char_limit, byte_limit: null where lengths do not pile up at the greatest one.

    All lengths are counted; a source is spread over its lengths.
    """
    def limit(measure: Column, name: str) -> DataFrame:
        n = texts.where(F.length(text) > 0).select(F.col(source).alias("source"), measure.alias("n")).groupBy("source", "n").agg(F.count("*").alias("c"))
        top = F.max("n").over(Window.partitionBy("source"))
        near = n.withColumn("top", top).where("n >= top * 0.9").groupBy("source", "top").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("c")).otherwise(0)).alias("at"), F.sum("c").alias("all"))
        below = (F.col("all") - F.col("at")) / F.greatest(F.col("top") * 0.1, F.lit(1.0))
        return near.where((F.col("at") >= LIMIT_COUNT) & (F.col("at") >= LIMIT_EXCESS * below)).select("source", F.col("top").alias(name))

    return limit(F.length(text), "char_limit").join(limit(F.octet_length(text), "byte_limit"), "source", "full")


_SHAPES = [(re.compile(r"[^\W\d_]*[A-Z][^\W\d_]*"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0")]


def shape(s: str) -> str:
    """Letter runs become a or, with a capital, A; digit runs 0; marks stay."""
    for rx, c in _SHAPES:
        s = rx.sub(c, s)
    return re.sub(r"[ \t]+", " ", s)


def features(tail: str, near_limit: bool) -> list[str]:
    """Names of the features of a text's end."""
    t = tail.rstrip()
    lines = [x for x in t.split("\n") if x.strip()] or [""]
    line, before = lines[-1].strip(), lines[-2].strip() if len(lines) > 1 else ""
    last, head = t[-1:], shape(line[:24])[:3]
    kind = "letter" if last.isalpha() else "digit" if last.isdigit() else last
    words = line.split()
    first = words[0] if words and (words[0].endswith(":") or not words[0][0].isalnum()) else ""
    if first.startswith("["):
        first = shape(first)
    n = len(words)
    size = "1" if n == 1 else "2-3" if n < 4 else "4-8" if n < 9 else "9+"
    whole = shape(line) if n < 9 else "long"
    out = [
        f"last {kind}", f"three {shape(t[-12:])[-3:]}", f"five {shape(t[-20:])[-5:]}", f"marks {''.join(c for c in t[-3:] if not c.isalnum())}", f"head {head}", f"first {first}", f"size {size}", f"whole {whole}",
        f"last {kind} size {size}", f"last {kind} first {first}", f"last {kind} head {head}", f"first {first} size {size} last {kind}",
        f"before {shape(before[:24])[:3]} head {head}", f"lines {min(len(lines), 3)} last {kind}",
        f"open {line.count('(') > line.count(')')} {line.count('[') > line.count(']')} {line.count(chr(34)) % 2} {line.count('|') % 2}",
        f"space {tail != t} {kind}", f"letters {len(words[-1]) if words and len(words[-1]) < 4 else 4} {kind}", f"sentences {len(re.findall(r'[.!?] [A-Z]', line)) > 0} {kind}",
    ]
    if near_limit:
        out.append("near the limit")
    return out


def _rows(batch: list[tuple[str, bool]]) -> np.ndarray:
    import xxhash

    out = [[xxhash.xxh32_intdigest(f) % (DIMENSIONS - 1) + 1 for f in features(t, n)] for t, n in batch]
    width = max(map(len, out), default=1)
    return np.array([r + [0] * (width - len(r)) for r in out], dtype=np.int32)  # place 0 has no weight


def fit(x: np.ndarray, cut: np.ndarray, rounds: int = 25, seed: int = 5) -> np.ndarray:
    """Weights of a logistic regression with a small ridge over hashed rows; place 0 stays 0 and the last place is the constant."""
    y = np.array(cut, dtype=np.float64)
    w, g2, b, rng = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-8), DIMENSIONS, np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        w[b] = -1.0 if not len(y) or not y[0] else 1.0
        return w
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 256):
            at = order[i : i + 256]
            p = 1 / (1 + np.exp(-np.clip(w[x[at]].sum(axis=1) + w[b], -30, 30)))
            err = (p - y[at]) / len(at)
            g = np.bincount(x[at].ravel(), np.repeat(err, x.shape[1]), len(w))
            g[b] = err.sum()
            g += 1e-6 * w
            g[0] = 0
            g2 += g * g
            w -= 0.2 * g / np.sqrt(g2)
    return w


def score(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1) + w[DIMENSIONS], -30, 30))) if len(x) else np.zeros(0)


def training_rows(texts: DataFrame, total: int, sample: int = SAMPLE) -> pd.DataFrame:
    """tail, near_limit, cut: each text of the sample as it is, if not at its source's limit, and cut at some places."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, t, near in zip(b["h"], b["text"], b["near"]):
                rng = np.random.default_rng(int(key) & 0x7FFFFFFF)
                if not near:
                    # now and then a whole text happens to be as long as the limit
                    out.append((t[-TAIL:], bool(rng.random() < 0.02), False))
                for _ in range(CUTS if len(t) > 40 else 0):
                    at = int(rng.integers(len(t) // 4, len(t) - 1))
                    part = t[:at]
                    whole = part.rstrip()
                    if whole and (whole[-1] not in ".!?。|)\"*" and t[at] not in "\n\r" and not (whole[-1].isdigit() and t[at : at + 1] in "\r\n")):
                        if rng.random() < 0.3:
                            part += MARKS[int(rng.integers(len(MARKS)))]
                        out.append((part[-TAIL:], bool(rng.random() < 0.4), True))
            yield pd.DataFrame(out, columns=["tail", "near", "cut"])

    return hashed_sample(texts, "h", sample, total).mapInPandas(make, "tail string, near boolean, cut boolean").toPandas()


def find_truncated(docs: DataFrame, key: str, source: str, text: str, sample: int = SAMPLE) -> DataFrame:
    """key, source, probability, cut: every text that is not null or blank, scored.

    Edge cases: null and blank texts have no row; a null source has no limit; a collection too small or too uniform for a
    fit gives the same probability to all; repeated rows are scored each; other columns are not read.
    """
    limits = source_limits(docs, source, text)
    near = F.coalesce((F.length("text") >= F.col("char_limit") - 1) | (F.octet_length("text") >= F.col("byte_limit") - 3), F.lit(False))
    rows = docs.select(F.col(key), F.col(source).alias("source"), F.col(text).alias("text")).where(F.length(F.trim("text")) > 0)
    # at most one row for each source; Spark broadcasts it only below its own threshold
    rows = rows.join(limits, "source", "left").select(key, "source", "text", near.alias("near"), F.xxhash64("text", F.col(key)).alias("h"))
    made = training_rows(rows.select("text", "near", "h"), rows.count(), sample)
    x, cuts = _rows(list(zip(made["tail"], made["near"]))), made["cut"].to_numpy(dtype=bool)
    w = fit(x, cuts)
    for _ in range(2):
        if len(x):
            sure = cuts | (score(w, x) < 0.5)
            w = fit(x[sure], cuts[sure])
    held = docs.sparkSession.sparkContext.broadcast(w)  # DIMENSIONS + 1 numbers
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = score(held.value, _rows(list(zip(b["tail"], b["near"]))))
            yield pd.DataFrame({key: b[key], "source": b["source"], "probability": p, "cut": p > 0.5})

    return rows.select(key, "source", F.right("text", F.lit(TAIL)).alias("tail"), "near").mapInPandas(run, f"`{key}` {kind}, source string, probability double, cut boolean")


def share_by_source(scored: DataFrame) -> DataFrame:
    """source, texts, cut, share."""
    n = F.sum(F.col("cut").cast("int"))
    return scored.groupBy("source").agg(F.count("*").alias("texts"), n.alias("cut"), (n / F.count("*")).alias("share"))
