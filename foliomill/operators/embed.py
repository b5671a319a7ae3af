"""Embedding models as ports, with retries and failures as rows."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foliomill.sources.registry import models

ATTEMPTS = 4  # the first and three more


def hash_embedding(text: Column, model: str, dimension: int) -> Column:
    """A vector from hashes of the text, the same in every engine; each number lies in [-1, 1)."""
    digest = lambda i: F.substring(F.sha2(F.concat(F.lit(model + "\x1f"), text, F.lit("\x1f"), i.cast("string")), 256), 1, 8)
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.conv(digest(i), 16, 10).cast("double") / 2147483648.0 - 1.0)


def seeded_vector(text: str, model: str, dimension: int) -> list[float]:
    """A vector from a generator seeded by the text's hash; for tests that need bit-exact numbers of the Mersenne Twister."""
    rng = random.Random(int.from_bytes(hashlib.sha256(model.encode() + b"\x00" + text.encode()).digest()[:8], "big"))
    return [rng.uniform(-1.0, 1.0) for _ in range(dimension)]


def rejection(model: str | None, dimension: int, model_dimension: int | None = None) -> str | None:
    """Why no text need be embedded at all, decided on the driver."""
    if model is None:
        return "model_not_configured"
    if not models.is_registered(model):
        return "model_unrecognized"
    return "dimension_misconfigured" if model_dimension is not None and model_dimension != dimension else None


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], dimension: int, timeout: float = 10.0, attempts: int = ATTEMPTS) -> DataFrame:
    """Adds embedding, status (ok or failed), attempts, cause to chunks (with content).

    The port gets a batch of texts; if that fails, texts are tried alone, each up to `attempts` times.  Errors, an overrun
    time and a wrong length use up an attempt; afterwards the row is failed with an empty vector.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("status", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("cause", T.StringType())])

    def once(texts: list[str]) -> tuple[list[list[float]] | None, str | None]:
        import time

        began = time.monotonic()
        try:
            out = [list(map(float, v)) for v in model(texts)]
        except Exception as e:
            return None, f"error: {e}"
        if time.monotonic() - began > timeout * len(texts):
            return None, "timeout"
        if len(out) != len(texts) or any(len(v) != dimension for v in out):
            return None, "wrong_dimension"
        return out, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["content"].tolist()
            whole, _ = once(texts) if len(texts) > 1 else (None, None)
            rows = []
            for i, t in enumerate(texts):
                if whole is not None:
                    rows.append((whole[i], "ok", 1, None))
                    continue
                for n in range(1, attempts + 1):
                    v, cause = once([t])
                    if v is not None:
                        rows.append((v[0], "ok", n, None))
                        break
                else:
                    rows.append(([], "failed", attempts, cause))
            out = b.copy()
            for j, name in enumerate(("embedding", "status", "attempts", "cause")):
                out[name] = pd.Series([r[j] for r in rows], index=b.index, dtype="object" if j != 2 else "int32")
            yield out

    return chunks.mapInPandas(run, schema)


def embed_rejected(chunks: DataFrame, why: str) -> DataFrame:
    return chunks.withColumns({"embedding": F.array().cast("array<double>"), "status": F.lit("failed"), "attempts": F.lit(0), "cause": F.lit(why)})


def embed_hashed(chunks: DataFrame, model: str, dimension: int) -> DataFrame:
    """As `embed` with the hash model, all in SQL."""
    return chunks.withColumns({"embedding": hash_embedding(F.col("content"), model, dimension), "status": F.lit("ok"), "attempts": F.lit(1), "cause": F.lit(None).cast("string")})


def failed_documents(embedded: DataFrame) -> DataFrame:
    """document_id of each document with a failed chunk: its embedding stage has failed."""
    return embedded.where("status = 'failed'").select("document_id").distinct()


def encoder_port(load: Callable[[], object], batch_size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A port over a model with ``encode(texts, ...)``, as sentence encoders have it; loaded once in each worker, at its first batch."""
    held: list[object] = []

    def port(texts: list[str]) -> list[list[float]]:
        if not held:
            held.append(load())
        return [[float(x) for x in v] for v in held[0].encode(texts, normalize_embeddings=True, batch_size=batch_size, show_progress_bar=False)]

    return port


models.register("hash", lambda dimension=64: ("hash", dimension), replace=True)
