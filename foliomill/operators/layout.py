"""From raw items to reading order: columns, positions, block types, cells, and the outcome for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliomill.text import is_blank, strip

# Kinds of raw block and the types they become; others become other.
BLOCK_TYPES = {"paragraph": "paragraph", "heading": "heading", "title": "heading", "caption": "caption", "ocr_text": "ocr_text", "list_item": "list_item", "footnote": "footnote"}


def block_type(kind: Column, heading_level: Column) -> Column:
    k = F.lower(strip(kind))
    known = F.create_map(*[F.lit(x) for kv in BLOCK_TYPES.items() for x in kv])
    return F.when(heading_level.isNotNull(), "heading").otherwise(F.coalesce(F.try_element_at(known, k), F.lit("other")))


def infer_columns(items: DataFrame) -> DataFrame:
    """Adds ``col``: the given column, else the band of the left edge on its page, else 0.

    A gap between left edges above half the mean width of the page's boxes (at least 1) opens a new band.  A page is the
    unit of all windows, so a long document is spread over its pages.
    """
    boxed = F.col("column").isNull() & F.col("bbox").isNotNull()
    x0, width = F.col("bbox.x0"), F.col("bbox.x1") - F.col("bbox.x0")
    page = Window.partitionBy("document_id", "page", "__boxed")
    df = items.withColumn("__boxed", boxed)
    df = df.withColumn("__limit", F.greatest(0.5 * F.coalesce(F.avg(F.when(boxed & (width > 0), width)).over(page), F.lit(0.0)), F.lit(1.0)))
    df = df.withColumn("__before", F.lag(x0).over(page.orderBy(x0)))
    opens = F.when(x0 - F.col("__before") > F.col("__limit"), 1).otherwise(0)
    band = F.sum(opens).over(page.orderBy(x0).rangeBetween(Window.unboundedPreceding, 0))
    return df.withColumn("col", F.coalesce("column", F.when(boxed, band), F.lit(0)).cast("int")).drop("__boxed", "__limit", "__before")


def reading_order(items: DataFrame) -> DataFrame:
    """Adds ``col`` and ``position`` from 0: by page, column, top edge, left edge and origin; items without a box count as at 0.

    Positions within a page are counted on the page, pages are then placed by their sizes: no task holds a document.
    """
    df = infer_columns(items)
    key = [F.col("col"), F.coalesce("bbox.y0", F.lit(0.0)), F.coalesce("bbox.x0", F.lit(0.0)), F.col("origin")]
    df = df.withColumn("__on_page", F.row_number().over(Window.partitionBy("document_id", "page").orderBy(*key)))
    pages = df.groupBy("document_id", "page").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = pages.select("document_id", "page", before.alias("__before"))
    return df.join(starts, ["document_id", "page"]).withColumn("position", (F.col("__before") + F.col("__on_page") - 1).cast("bigint")).drop("__before", "__on_page")


def with_origins(items: DataFrame) -> DataFrame:
    """Renumbers ``origin`` over a document: blocks, then tables, then figures, then what OCR added."""
    rank = F.when(F.col("item_kind") == "block", 0).when(F.col("item_kind") == "table", 1).when(F.col("item_kind") == "figure", 2).otherwise(3)
    return items.withColumn("origin", F.row_number().over(Window.partitionBy("document_id").orderBy(rank, "origin")) - 1)


def parsed_items(items: DataFrame) -> DataFrame:
    """Items in reading order with block types, heading levels, sources and cells that are not blank."""
    df = reading_order(items)
    is_block = F.col("item_kind").isin("block", "ocr")
    kind = block_type(F.col("kind"), F.col("heading_level"))
    return df.withColumns({
        "block_type": F.when(is_block, kind),
        "heading_level": F.when(is_block & (kind == "heading"), F.coalesce("heading_level", F.lit(1))),
        "source": F.when(is_block, F.when(F.coalesce("from_ocr", F.lit(False)), "ocr").otherwise("text_layer")),
        "cells": F.filter("cells", lambda c: strip(c["value"]) != ""),
    }).drop("kind", "from_ocr")


def headings(parsed: DataFrame) -> DataFrame:
    return parsed.where("block_type = 'heading'").select("document_id", "page", "position", "text", F.col("heading_level").alias("level"))


def parse_status(documents: DataFrame, items: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """document_id, parse_status (ok or failed), parse_kind, parse_reason for every document.

    `failures` (document_id, kind: engine_unavailable, parse_error or timeout, reason) come first; a document without a
    block that is not blank and without tables and figures has no_extractable_content.
    """
    content = items.where((F.col("item_kind").isin("table", "figure")) | ~is_blank(F.col("text"))).select("document_id").distinct().withColumn("__some", F.lit(True))
    df = documents.select("document_id").distinct().join(content, "document_id", "left")
    if failures is None:
        df = df.withColumns({"kind": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
    else:
        df = df.join(failures.groupBy("document_id").agg(F.min_by("kind", F.struct("kind", "reason")).alias("kind"), F.min_by("reason", F.struct("kind", "reason")).alias("reason")), "document_id", "left")
    kind = F.coalesce("kind", F.when(F.col("__some").isNull(), "no_extractable_content"))
    return df.select("document_id", F.when(kind.isNull(), "ok").otherwise("failed").alias("parse_status"), kind.alias("parse_kind"), F.coalesce("reason", F.when(kind.isNotNull(), F.concat(F.lit("parsing: "), kind))).alias("parse_reason"))
