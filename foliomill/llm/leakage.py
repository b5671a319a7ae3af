"""Evaluation passages inside training documents.

Each window of `MIN_RUN` consecutive words of a test item is represented by the rarest of its word n-grams (rarest in
the corpus; all documents are counted), so a document that holds the window holds its seed.  The seeds meet the
documents' n-grams in an equality join, and each document and item that share a seed are aligned by Smith-Waterman over
words around the seeds, which scores edited copies and gives the longest verbatim run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from foliomill.session import staged
from foliomill.text import words

GRAM = 5
MIN_RUN = 13
#: Scores of the alignment: a word that agrees, one that differs, one left out or put in.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Test items are broadcast only up to so many n-grams; beyond that the join shuffles.
BROADCAST_GRAMS = 2_000_000
#: The ids of documents with a seed are broadcast up to this many.
BROADCAST_DOCUMENTS = 1_000_000


def grams(w: Column, n: int) -> Column:
    """64-bit hashes of the n-grams of an array of words; none if it is shorter."""
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.xxhash64(*[F.get(w, i - 1 + k) for k in range(n)]))
    return F.when(F.size(w) >= n, at).otherwise(F.array().cast("array<bigint>"))


def seeds(items: DataFrame, held: DataFrame, gram: int = GRAM, run: int = MIN_RUN) -> DataFrame:
    """item_id, gram, pos: for each window of `run` words its rarest n-gram; ties go to the first.

    `held` has a row for each place of the corpus where an n-gram of an item stands.  An item shorter than `run` words is one window; one shorter than `gram` words has none.
    """
    at = items.select("item_id", F.posexplode("grams").alias("pos", "gram"))
    df = held.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = at.join(df, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    width = run - gram + 1  # n-grams in a window
    last = F.max("pos").over(Window.partitionBy("item_id"))
    window = Window.partitionBy("item_id").orderBy("pos").rowsBetween(0, width - 1)
    best = F.min(F.struct("df", "pos", "gram")).over(window)
    return ranked.select("item_id", "pos", best.alias("best"), last.alias("last")).where(F.col("pos") <= F.greatest(F.col("last") - (width - 1), F.lit(0))).select("item_id", "best.gram", "best.pos").distinct()


def _small(df: DataFrame, grams_of_items: DataFrame) -> DataFrame:
    """Broadcast, if there are few n-grams of test items."""
    return F.broadcast(df) if grams_of_items.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS else df


def align(doc: list[str], item: list[str]) -> tuple[int, int, int]:
    """Best local alignment score, the end of it in `doc`, and the longest run of equal words.

    Row by row over the shorter side; the gaps within a row are closed by a running maximum, so all steps are vectors.
    """
    ids: dict[str, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in doc], dtype=np.int64)
    b = np.array([ids.setdefault(w, len(ids)) for w in item], dtype=np.int64)
    ramp = -GAP * np.arange(1, len(a) + 1)
    row, run = np.zeros(len(a) + 1, np.int64), np.zeros(len(a) + 1, np.int64)
    score = end = longest = 0
    for w in b:
        same = a == w
        now = np.maximum(0, np.maximum(row[:-1] + np.where(same, MATCH, MISMATCH), row[1:] + GAP))
        now = np.maximum(now, np.maximum.accumulate(now + ramp) - ramp)
        run[1:] = np.where(same, run[:-1] + 1, 0)
        row[1:] = now
        m = int(now.argmax())
        if now[m] > score:
            score, end = int(now[m]), m
        longest = max(longest, int(run.max()))
    return score, end, longest


def leaks(documents: DataFrame, items: DataFrame, gram: int = GRAM, run: int = MIN_RUN) -> DataFrame:
    """doc_id, item_id, score, share, longest_run, seeds: each document and test item that share a seed.

    `documents` has doc_id and text, `items` has item_id and text; other columns are not read.  `share` is the score
    over that of a verbatim copy of the whole item.  Null and empty texts have no words, so no row.  A document or item
    given twice counts once.  The seeds of one document and item are aligned in one piece, which reaches from the first
    to the last seed and an item's length beyond both; a document of any length is therefore never aligned as a whole
    unless its seeds lie so far apart.
    """
    it = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= gram).distinct()
    it = it.withColumn("grams", grams(F.col("w"), gram))
    docs = documents.where("text IS NOT NULL").select("doc_id", words(F.col("text")).alias("dw")).where(F.size("dw") >= gram)
    small = it.select(F.explode("grams").alias("gram"))
    # the n-grams of all documents are made once; what stays are the places of those that an item holds
    hits = docs.select("doc_id", F.posexplode(grams(F.col("dw"), gram)).alias("at", "gram"))
    hits = staged(hits.join(_small(small.distinct(), small), "gram", "left_semi"), "hits")
    sd = seeds(it, hits, gram, run)
    # where a seed stands, without the words: a posting of a few bytes
    found = hits.select("doc_id", "at", "gram").join(_small(sd, small), "gram").groupBy("doc_id", "item_id").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count_distinct("pos").alias("seeds"))
    found = staged(found, "postings")
    # only the few documents with a seed are joined with their words
    ids = found.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_DOCUMENTS else ids
    some = docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    pairs = found.join(some, "doc_id").join(it.select("item_id", "w"), "item_id")
    first = F.greatest(F.col("lo") - F.size("w"), F.lit(0))
    pairs = pairs.select("doc_id", "item_id", "seeds", "w", F.slice("dw", first + 1, F.col("hi") - first + gram + F.size("w")).alias("dw"))
    schema = T.StructType([pairs.schema["doc_id"], pairs.schema["item_id"], T.StructField("score", T.IntegerType()), T.StructField("share", T.DoubleType()), T.StructField("longest_run", T.IntegerType()), T.StructField("seeds", T.LongType())])

    def run_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [align(list(d), list(w)) for d, w in zip(b["dw"], b["w"])]
            score = np.array([s for s, _, _ in out], dtype=np.int32)
            yield pd.DataFrame({"doc_id": b["doc_id"], "item_id": b["item_id"], "score": score, "share": score / (MATCH * b["w"].map(len).to_numpy()) if len(b) else np.array([], float), "longest_run": np.array([r for _, _, r in out], dtype=np.int32), "seeds": b["seeds"]})

    return pairs.mapInPandas(run_pairs, schema)
