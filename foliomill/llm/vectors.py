"""The k most similar vectors for every vector: a block matrix join with int8 tiles.

Vectors of one dimension are blocked by the nearest of a set of centres; a tile is the product of the rows of one
block with the queries that have this block among their `PROBES` nearest, cut into parts of bounded size.  Rows and
queries are quantised to int8, so that the product is exact in integers and its error as a similarity has a bound.
Only pairs whose upper bound reaches the k-th best lower bound of their query are computed again in double precision
and kept in a heap of k per query and tile; the heaps are merged by rank.

Which tiles are computed is the only approximation (measured recall in the README); the bounds lose nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from foliomill.session import hashed_sample, staged

#: Centres are fitted on at most so many rows of a dimension, chosen by the hash of the id.
SAMPLE = 40_000
MOST_CENTRES = 4096
#: Blocks per query.  More blocks: higher recall, more products.
PROBES = 4
#: Rows and queries of a tile; larger blocks are cut, whatever their size.
TILE = 4096


def usable(records: DataFrame, jobs: DataFrame, configs: DataFrame) -> DataFrame:
    """record_id, dim, v: status ok, as long as its document's configured dimension, finite, not all zero; a key counts once."""
    one = jobs.where("document_id IS NOT NULL").groupBy("document_id").agg(F.min("config_id").alias("config_id"))
    dims = one.join(configs.select("config_id", F.col("embedding_dimension").alias("dim")).distinct(), "config_id").select("document_id", "dim")
    df = records.where("status = 'ok' AND embedding IS NOT NULL AND record_id IS NOT NULL").select("record_id", "document_id", F.col("embedding").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.join(dims, "document_id").where((F.size("v") == F.col("dim")) & fine).select("record_id", "dim", "v").dropDuplicates(["record_id"])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # the squares of very large or small numbers would not be finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centres(rows: DataFrame, total: int, sample: int = SAMPLE, rounds: int = 6) -> np.ndarray:
    """Centres on the unit sphere by Lloyd's rounds over a bounded sample; their number grows with the root of `total`."""
    part = hashed_sample(rows.withColumn("h", F.xxhash64("record_id")), "h", sample, total)
    x = _unit(np.stack(part.select("v").toPandas()["v"].to_list()).astype(np.float64)).astype(np.float32)
    k = max(1, min(MOST_CENTRES, len(x) // 8, int(2 * math.sqrt(total))))
    c = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c).astype(np.float32)
    return c


_ASSIGNED = "record_id bigint, dim int, cells array<int>, v array<float>, part int"


def _assign(df: DataFrame, centres: dict[int, np.ndarray], probes: int) -> DataFrame:
    """Each record with its nearest blocks, the nearest first."""
    held = df.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CENTRES for each configured dimension

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, g in b.groupby("dim"):
                c = held.value[dim]
                x = _unit(np.stack(g["v"].to_list()).astype(np.float64)).astype(np.float32)
                s = x @ c.T
                p = min(probes, len(c))
                top = np.argpartition(-s, p - 1, axis=1)[:, :p]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
                ids = g["record_id"].to_numpy()
                yield pd.DataFrame({"record_id": ids, "dim": np.int32(dim), "cells": list(top.astype(np.int32)), "v": g["v"], "part": (ids * 2654435761 % 2147483647).astype(np.int32)})

    return df.mapInPandas(run, _ASSIGNED)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers from -127 to 127, their scale for each row, and the length of what rounding took off each row."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    q = np.rint(x / scale)
    return q, scale[:, 0], np.linalg.norm(x - q * scale, axis=1)


def tile_top(qid: np.ndarray, q: np.ndarray, rid: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, row id, cosine of the k best rows of each query in one tile; a record is not its own neighbour.

    The int8 product p with scales s and t is off from the true one by no more than e_q (1 + e_r) + e_r, with e the
    rounding lengths and vectors of unit length.  Equal cosines go to the smaller id.
    """
    qi, qs, qe = quantise(q)
    ri, rs, re = quantise(r)
    # products of whole numbers up to 127: sums below 2^24 are exact in float32, which has the fast matrix product
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    approx = (qi.astype(kind) @ ri.astype(kind).T) * (qs.astype(kind)[:, None] * rs.astype(kind)[None, :])
    slack = qe[:, None] * (1 + re.max()) + re.max() + 1e-6
    approx[qid[:, None] == rid[None, :]] = -np.inf
    if approx.shape[1] > k:
        kth = -np.partition(-approx, k - 1, axis=1)[:, k - 1 : k]
        a, b = np.nonzero(approx >= kth - 2 * slack)
    else:
        a, b = np.nonzero(approx > -np.inf)
    cos = np.einsum("ij,ij->i", q[a], r[b])
    order = np.lexsort((rid[b], -cos, a))
    a, b, cos = a[order], b[order], cos[order]
    first = np.searchsorted(a, a)  # where each query's survivors begin
    keep = np.arange(len(a)) - first < k
    return qid[a[keep]], rid[b[keep]], cos[keep]


def top_neighbours(rows: DataFrame, k: int = 5, probes: int = PROBES, tile: int = TILE, all_tiles: bool = False) -> DataFrame:
    """record_id, neighbour_id, similarity, rank: the k most similar records of each, of its own dimension only.

    `rows` has record_id (unique), dim and v (finite, not all zero; see `usable`).  Similarity is (cosine + 1) / 2.
    Records with no other of their dimension have no row; there are fewer than k if there are fewer others.  Of vectors
    that are identical only the k + 1 with the smallest ids take part as rows, since by the rule for ties no other can
    be among anyone's k best; the others take their neighbours from among them, so a vector that a third of all
    records share costs no more than any other.  With `all_tiles` every block is compared with every other one, which
    is exact and quadratic.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("same", F.struct(F.xxhash64("v"), F.hash("v")))
    rank = F.row_number().over(Window.partitionBy("dim", "same").orderBy("record_id"))
    rows = staged(rows.withColumn("copy", rank), "vectors")
    kept = rows.where(F.col("copy") <= k + 1)
    totals = {r["dim"]: r["n"] for r in kept.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a few dimensions
    schema = "record_id bigint, neighbour_id bigint, cosine double"
    if not totals:
        return spark.createDataFrame([], "record_id bigint, neighbour_id bigint, similarity double, rank int")
    centres = {dim: fit_centres(kept.where(F.col("dim") == dim), n) for dim, n in totals.items()}
    probes = max(len(c) for c in centres.values()) if all_tiles else probes
    near = staged(_assign(kept.select("record_id", "dim", "v"), centres, probes), "blocks")
    near = near.select("record_id", "dim", "v", "part", F.posexplode("cells").alias("near", "cell"))
    sizes = near.groupBy("dim", "cell").agg(F.sum((F.col("near") == 0).cast("int")).alias("rows"), F.count("*").alias("queries"))
    cuts = F.broadcast(sizes.select("dim", "cell", F.ceil(F.col("rows") / tile).cast("int").alias("rc"), F.ceil(F.col("queries") / tile).cast("int").alias("qc")).where("rc > 0"))  # one row a block
    near = near.join(cuts, ["dim", "cell"])
    # a row goes to one part of its block's rows and meets all parts of its queries, and the other way round
    both = near.select("dim", "cell", "record_id", "v", F.explode(F.concat(
        F.transform(F.sequence(F.lit(1), F.col("rc")), lambda i: F.struct((i - 1).alias("rp"), F.pmod("part", F.col("qc")).alias("qp"), F.lit(True).alias("query"))),
        F.when(F.col("near") == 0, F.transform(F.sequence(F.lit(1), F.col("qc")), lambda i: F.struct(F.pmod("part", F.col("rc")).alias("rp"), (i - 1).alias("qp"), F.lit(False).alias("query")))).otherwise(F.array()),
    )).alias("t")).select("dim", "cell", "t.rp", "t.qp", "t.query", "record_id", "v")

    def tiles(g: pd.DataFrame) -> pd.DataFrame:
        is_query = g["query"].to_numpy()
        ids, x = g["record_id"].to_numpy(), _unit(np.stack(g["v"].to_list()).astype(np.float64))
        rid, r = ids[~is_query], x[~is_query]
        qid, q = ids[is_query], x[is_query]
        out = [tile_top(qid[i : i + 512], q[i : i + 512], rid, r, k) for i in range(0, len(qid), 512)] if len(rid) else []
        a, b, c = (np.concatenate(z) for z in zip(*out)) if out else (np.array([], np.int64), np.array([], np.int64), np.array([], float))
        return pd.DataFrame({"record_id": a, "neighbour_id": b, "cosine": c})

    best = both.groupBy("dim", "cell", "rp", "qp").applyInPandas(tiles, schema)
    rest = rows.where(F.col("copy") > k + 1).select("record_id", "dim", "same")
    firsts = kept.where(F.col("copy") <= k).select("dim", "same", F.col("record_id").alias("neighbour_id"))
    copies = rest.join(firsts, ["dim", "same"]).select("record_id", "neighbour_id", F.lit(1.0).alias("cosine"))
    order = Window.partitionBy("record_id").orderBy(F.col("cosine").desc(), "neighbour_id")
    # a row stands in one block only, so a query meets it once
    return best.unionByName(copies).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("record_id", "neighbour_id", ((F.greatest(F.least(F.col("cosine"), F.lit(1.0)), F.lit(-1.0)) + 1) / 2).alias("similarity"), "rank")


def neighbour_pairs(top: DataFrame) -> DataFrame:
    """record_a < record_b, each pair once: one is among the best of the other."""
    return top.select(F.least("record_id", "neighbour_id").alias("record_a"), F.greatest("record_id", "neighbour_id").alias("record_b")).distinct()
