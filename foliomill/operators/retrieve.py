"""Exact cosine retrieval: one query or a table of queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliomill.text import is_blank

# Statuses and placeholders of results.
OK, EMPTY, NO_MATCH, INVALID, OUT_OF_RANGE = "ok", "library_empty", "no_match", "invalid_query", "topk_out_of_range"
UNKNOWN_PAGE, UNKNOWN_DOCUMENT = "UNKNOWN_PAGE", "UNKNOWN_DOCUMENT"


def validate(text: Column, top_k: Column, most_chars: int = 4000) -> Column:
    """null for a valid query; the text is checked first."""
    return F.when(is_blank(text) | (F.length(text) > most_chars), INVALID).when(~F.coalesce(top_k, F.lit(1)).between(1, 100), OUT_OF_RANGE)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def similarity(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """(cosine + 1) / 2; 0 for different or no dimensions and for vectors of length 0; a cosine that is no number counts as 1."""
    na, nb = norm_a if norm_a is not None else norm(a), norm_b if norm_b is not None else norm(b)
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na != 0) & (nb != 0)
    return F.coalesce(F.when(fine, (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb))) + 1) / 2), F.lit(0.0))


FILTERS = {"documentId": "document_id", "pageNumber": "page_number", "headingPath": "heading_path"}


def metadata_filter(filters: dict | None) -> Column:
    """All conditions hold; an unknown name matches nothing, a null page only pages that are null."""
    out = F.lit(True)
    for name, value in (filters or {}).items():
        if name not in FILTERS:
            return F.lit(False)
        col = F.col(FILTERS[name])
        want = F.array(*map(F.lit, value)).cast("array<string>") if isinstance(value, (list, tuple)) else F.lit(value)
        out = out & col.eqNullSafe(want)
    return out


def _ordered(df: DataFrame) -> list[Column]:
    return [F.col("similarity").desc(), F.col("document_id"), F.col("order_index"), F.col("chunk_id")]


def top_k(store: DataFrame, vector: list[float], k: int, filters: dict | None = None) -> DataFrame:
    """The k best rows of a store for one vector: filters reach the scan, and only k rows of each task are sorted further."""
    v = F.array(*[F.lit(float(x)) for x in vector])
    length = math.sqrt(sum(float(x) ** 2 for x in vector))
    scored = store.where(metadata_filter(filters)).withColumn("similarity", similarity(F.col("embedding"), v, norm_b=F.lit(length)))
    return scored.orderBy(*_ordered(scored)).limit(max(0, k))


def distance_similarity(distance: Column) -> Column:
    """The similarity of a cosine distance (0 to 2), as databases with vectors give it."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / 2))


#: Queries are held beside a block of the store up to this many numbers; more go in groups, each a pass over the store.
BROADCAST_NUMBERS = 4_000_000


def batch_top_k(store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank and the store's columns: the k best rows for each of query_id, vector.

    The stated queries are held beside every block of the store, scored there in one matrix product for each Arrow batch,
    and each batch gives only its k best of each query to the merge, so what is shuffled does not grow with the store's
    width.  A query set too large for that goes in groups by the hash of its key, each of about half the bound.
    """
    n = queries.agg(F.sum(F.size("vector").cast("bigint"))).first()[0] or 0
    groups = 1 if n <= BROADCAST_NUMBERS else 2 * math.ceil(n / BROADCAST_NUMBERS)
    out = None
    for g in range(groups):
        part = _group_top_k(store, queries if groups == 1 else queries.where(F.pmod(F.xxhash64("query_id", F.lit(groups)), F.lit(groups)) == g), k)
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(*_ordered(out))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _group_top_k(store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best rows of each Arrow batch of the store for each query of a bounded group."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    rows = queries.select("query_id", "vector").toPandas()
    held = store.sparkSession.sparkContext.broadcast((rows["query_id"].tolist(), [np.asarray(v, dtype=float) for v in rows["vector"]]))
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = held.value
        for b in batches:
            if not len(b) or not len(ids):
                continue
            b = b.reset_index(drop=True)
            size = b["embedding"].map(lambda v: 0 if v is None else len(v)).to_numpy()
            key = list(zip(b["document_id"].fillna(""), b["order_index"], b["chunk_id"]))
            rank = np.empty(len(b), dtype=np.int64)
            rank[sorted(range(len(b)), key=key.__getitem__)] = np.arange(len(b))
            sims = np.zeros((len(ids), len(b)))
            for dim in {len(v) for v in vectors} & set(size.tolist()) - {0}:
                at, qs = np.flatnonzero(size == dim), [i for i, v in enumerate(vectors) if len(v) == dim]
                x, q = np.stack(b["embedding"].iloc[at].to_list()).astype(float), np.stack([vectors[i] for i in qs])
                with np.errstate(all="ignore"):
                    length = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
                    c = np.where(length == 0, -1.0, (q @ x.T) / np.where(length == 0, 1.0, length))
                c = np.where(np.isnan(c), 1.0, np.clip(c, -1.0, 1.0))
                sims[np.ix_(qs, at)] = (c + 1) / 2
            for i, q in enumerate(ids):
                best = np.lexsort((rank, -sims[i]))[:k]
                yield pd.DataFrame({"query_id": q, "document_id": b["document_id"].iloc[best].to_numpy(), "order_index": b["order_index"].iloc[best].to_numpy(), "chunk_id": b["chunk_id"].iloc[best].to_numpy(), "similarity": sims[i][best]})

    return store.select("document_id", "order_index", "chunk_id", "embedding").mapInPandas(run, f"query_id {kind}, document_id string, order_index bigint, chunk_id string, similarity double")


def placeholders(hits: DataFrame) -> DataFrame:
    """Missing pages and documents get their placeholders; pages become text."""
    return hits.withColumns({"page_number": F.coalesce(F.col("page_number").cast("string"), F.lit(UNKNOWN_PAGE)), "document_id": F.coalesce(F.when(F.col("document_id") != "", F.col("document_id")), F.lit(UNKNOWN_DOCUMENT))})


def result_status(queries: DataFrame, hits: DataFrame, store: DataFrame) -> DataFrame:
    """query_id, status of each query: its error, else ok, no_match, or library_empty if the store has no row at all."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    empty = store.isEmpty()
    return queries.join(n, "query_id", "left").select("query_id", F.coalesce("error", F.when(F.col("n") > 0, OK).when(F.lit(empty), EMPTY).otherwise(NO_MATCH)).alias("status"))
