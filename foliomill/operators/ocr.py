"""Images that need OCR, the port for it, and what becomes of its results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

RESULT = "document_id string, image_ref string, page int, seq int, text string, confidence double, error_kind string"


def images_to_read(pages: DataFrame, images: DataFrame) -> DataFrame:
    """document_id, image_ref, page, seq: pages without text layer that have an image, then embedded images with text."""
    p = pages.where("NOT has_text_layer AND page_image_ref IS NOT NULL").select("document_id", F.col("page_image_ref").alias("image_ref"), "page", F.lit(0).alias("step"))
    i = images.where("has_text").select("document_id", "image_ref", "page", F.lit(1).alias("step"))
    from pyspark.sql import Window

    order = Window.partitionBy("document_id").orderBy("step", "page", "image_ref")
    return p.unionByName(i).withColumn("seq", F.row_number().over(order) - 1).drop("step")


def planned(images: DataFrame, plan: DataFrame, timeout: float, default: str | None = None) -> DataFrame:
    """Results by a table image_ref, text, confidence, error_kind, duration: a longer duration than the timeout comes before any error; what is not planned is unreadable or `default`."""
    known = plan.groupBy("image_ref").agg(*[F.first(c).alias(c) for c in ("text", "confidence", "error_kind", "duration")], F.lit(True).alias("known"))
    df = images.join(known, "image_ref", "left")
    missing = F.col("known").isNull()
    kind = F.when(missing, F.lit(None if default is not None else "unreadable")).when(F.col("duration") > timeout, "timeout").otherwise(F.col("error_kind"))
    good = kind.isNull()
    return df.select("document_id", "image_ref", "page", "seq", F.when(good, F.when(missing, F.lit(default)).otherwise(F.col("text"))).alias("text"), F.when(good, F.when(missing, F.lit(1.0)).otherwise(F.col("confidence"))).alias("confidence"), kind.alias("error_kind"))


def read_images(images: DataFrame, port: Callable[[str], tuple[str, float]], timeout: float) -> DataFrame:
    """Results of a port, called once for each image in the workers; an exception becomes an error row, never a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                began, text, conf, kind = time.monotonic(), None, None, None
                try:
                    text, conf = port(r.image_ref)
                except Exception as e:
                    kind = getattr(e, "kind", "unreadable")
                if time.monotonic() - began > timeout:
                    text, conf, kind = None, None, "timeout"
                out.append((r.document_id, r.image_ref, r.page, r.seq, text, conf, kind))
            yield pd.DataFrame(out, columns=["document_id", "image_ref", "page", "seq", "text", "confidence", "error_kind"])

    return images.select("document_id", "image_ref", "page", "seq").mapInPandas(run, RESULT)


def flag_low(results: DataFrame, threshold: float | Column) -> DataFrame:
    """Adds low_confidence: strictly below the threshold; a missing confidence is not low."""
    return results.withColumn("low_confidence", F.coalesce(F.col("confidence") < threshold, F.lit(False)))


def split_results(results: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(blocks, errors): texts as OCR blocks numbered among themselves, failures as rows of their own."""
    from pyspark.sql import Window

    good = flag_low(results.where("error_kind IS NULL"), threshold)
    blocks = good.withColumn("origin", F.row_number().over(Window.partitionBy("document_id").orderBy("seq")) - 1).select("document_id", F.lit("ocr").alias("item_kind"), "origin", "page", "text", F.lit("ocr_text").alias("kind"), F.lit(True).alias("from_ocr"), F.col("confidence").alias("ocr_confidence"), "low_confidence")
    return blocks, results.where("error_kind IS NOT NULL").select("document_id", "image_ref", "page", "error_kind")
