"""Readers of submitted files and of the JSON that layout engines write: all give rows of raw items.

A raw item is ``document_id, item_kind (block, table, figure; page_image, image: what OCR has to read), origin, page, text, kind, heading_level, bbox, column,
from_ocr, cells, degraded, raw_text, image_ref, caption``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliomill.text import strip

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
CELLS = "array<struct<row_index:int,col_index:int,value:string,row_span:int,col_span:int>>"
RAW_ITEM = f"document_id string, item_kind string, origin int, page int, text string, kind string, heading_level int, bbox {BBOX}, column int, from_ocr boolean, cells {CELLS}, degraded boolean, raw_text string, image_ref string, caption string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """filename, content of every file under a path; contents are read only if a later step asks for them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("filename"), "content")


def _items(df: DataFrame, **given: Column) -> DataFrame:
    """Missing fields of a raw item are null."""
    from pyspark.sql import types as T

    schema = T._parse_datatype_string(RAW_ITEM)
    have = {"from_ocr": F.lit(False), "degraded": F.lit(False)} | given
    return df.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def text_layer(sources: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Raw items of plain text: document_id, content (bytes or text) → one block for each part that is not blank, all on page 0.

    Bytes that are no UTF-8 become replacement characters.
    """
    text = F.make_valid_utf8(F.col("content").cast("string"))
    parts = F.transform(F.split(text, F.lit("\\Q" + separator + "\\E")), strip)
    parts = F.filter(parts, lambda p: p != "")
    df = sources.select("document_id", F.posexplode(parts).alias("i", "part"))
    return _items(df, document_id=F.col("document_id"), item_kind=F.lit("block"), origin=F.col("i"), page=F.lit(0), text=F.col("part"), kind=F.lit("paragraph"))


def pdf_pages(sources: DataFrame) -> DataFrame:
    """Raw items of PDF text layers through `pypdf`; raises if that is not installed (the caller records the engine as unavailable)."""
    import importlib.util

    if importlib.util.find_spec("pypdf") is None:
        raise RuntimeError("engine_unavailable: pypdf")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for b in batches:
            rows = []
            for key, content in zip(b["document_id"], b["content"]):
                n = 0
                for page, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
                    try:
                        text = p.extract_text() or ""
                    except Exception:
                        text = ""
                    parts = [x.strip() for x in text.split("\n\n") if x.strip()] or ([text] if text.strip() else [])
                    for part in parts:
                        rows.append((key, "block", n, page, part, None))
                        n += 1
                    if not parts:  # no text layer: the page itself is an image to be read
                        rows.append((key, "page_image", n, page, None, f"{key}#{page}"))
                        n += 1
            yield pd.DataFrame(rows, columns=["document_id", "item_kind", "origin", "page", "text", "image_ref"])

    df = sources.select("document_id", "content").mapInPandas(run, "document_id string, item_kind string, origin int, page int, text string, image_ref string")
    block = F.col("item_kind") == "block"
    return _items(df, document_id=F.col("document_id"), item_kind=F.col("item_kind"), origin=F.col("origin"), page=F.col("page"), text=F.col("text"), kind=F.when(block, "paragraph"), image_ref=F.col("image_ref"))


# Labels of layout engines and the kinds of block they stand for; others are paragraphs.
LABEL_KINDS = {"paragraph": "paragraph", "text": "paragraph", "section_header": "heading", "title": "heading", "subtitle": "heading", "heading": "heading", "caption": "caption", "list_item": "list_item", "footnote": "footnote"}
ITEM_KINDS = {"text": "paragraph", "paragraph": "paragraph", "heading": "heading", "title": "heading", "caption": "caption"}


def _kind(label: Column, table: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.coalesce(F.lower(strip(label)), F.lit("paragraph"))), F.lit("paragraph"))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, path: str, *kinds: str) -> Column:
    """True if the value at `path` has one of these kinds; a number in text is none."""
    found = F.schema_of_variant(F.variant_get(v, path, "variant"))
    return F.coalesce(found.isin(*kinds), F.lit(False))


def _text(v: Column, path: str) -> Column:
    return F.when(_is(v, path, "STRING"), _get(v, path, "string"))


def _whole(v: Column, path: str) -> Column:
    return F.when(_is(v, path, "BIGINT", "INT", "SMALLINT", "TINYINT"), _get(v, path, "bigint"))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def layout_json(native: DataFrame) -> DataFrame:
    """Raw items of a layout engine's export: document_id, native (JSON text) with texts, tables and pictures.

    Wrong shapes are tolerated: an item that is no object or has no text is dropped (a table becomes a degraded one on
    page 0), numbers that are no whole numbers count as missing, boxes without all four sides are null.
    """
    doc = native.select("document_id", F.try_parse_json("native").alias("v"))

    def placed(item: Column) -> dict[str, Column]:
        page = F.greatest(F.coalesce(_whole(item, "$.prov[0].page_no"), _whole(item, "$.prov[0].page"), F.lit(0)), F.lit(0))
        sides = [_get(item, f"$.prov[0].bbox.{s}", "double") for s in "ltrb"]
        box = F.struct(*[s.alias(n) for s, n in zip(sides, ("x0", "y0", "x1", "y1"))])
        whole = sides[0].isNotNull() & sides[1].isNotNull() & sides[2].isNotNull() & sides[3].isNotNull()
        return {"page": page, "bbox": F.when(whole, box).cast(BBOX)}

    v, t = F.col("v"), F.col("item")
    texts = doc.select("document_id", F.posexplode(_list(v, "$.texts")).alias("i", "item")).where(_text(t, "$.text").isNotNull())
    kind = _kind(_get(t, "$.label", "string"), LABEL_KINDS)
    level = F.when(kind == "heading", F.when(_whole(t, "$.level") >= 1, _whole(t, "$.level")).otherwise(1))
    blocks = _items(texts, document_id=F.col("document_id"), item_kind=F.lit("block"), origin=F.col("i"), text=_text(t, "$.text"), kind=kind, heading_level=level, **placed(t))

    def cell(c: Column) -> Column:
        at = lambda a, b, least: F.greatest(F.coalesce(_whole(c, a), _whole(c, b) if b else F.lit(None), F.lit(least)), F.lit(least)).cast("int")
        return F.struct(at("$.start_row_offset_idx", "$.row_index", 0).alias("row_index"), at("$.start_col_offset_idx", "$.col_index", 0).alias("col_index"), F.coalesce(_get(c, "$.text", "string"), F.lit("")).alias("value"), at("$.row_span", None, 1).alias("row_span"), at("$.col_span", None, 1).alias("col_span"))

    cells = F.filter(F.transform(_list(t, "$.data.table_cells"), cell), lambda c: strip(c["value"]) != "")
    tabs = doc.select("document_id", F.posexplode(_list(v, "$.tables")).alias("i", "item"))
    raw = _text(t, "$.raw_text")
    flag = F.coalesce(_get(t, "$.degraded", "boolean"), F.lit(False))
    is_object = F.coalesce(F.schema_of_variant(t).startswith("OBJECT"), F.lit(False))
    tables = _items(tabs, document_id=F.col("document_id"), item_kind=F.lit("table"), origin=F.col("i"), cells=cells, degraded=~is_object | flag | ((F.size(cells) == 0) & raw.isNotNull()), raw_text=raw, **placed(t))
    pics = doc.select("document_id", F.posexplode(_list(v, "$.pictures")).alias("i", "item"))
    caption = F.coalesce(_text(t, "$.captions[0].text"), _text(t, "$.captions[0]"), _text(t, "$.caption"))
    figures = _items(pics, document_id=F.col("document_id"), item_kind=F.lit("figure"), origin=F.col("i"), image_ref=F.coalesce(_text(t, "$.image_ref"), _text(t, "$.self_ref"), F.lit("")), caption=caption, **placed(t))
    return blocks.unionByName(tables).unionByName(figures)


def page_json(native: DataFrame) -> DataFrame:
    """Raw items of a page-wise export: one object with pages, a list of such objects, or a list of pages.

    A page without items falls back to its text.
    """
    doc = native.select("document_id", F.try_parse_json("native").alias("v"))
    v, p, t = F.col("v"), F.col("p"), F.col("item")
    jobs = F.flatten(F.transform(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)), lambda j: F.when(F.try_variant_get(j, "$.pages", "array<variant>").isNotNull(), _list(j, "$.pages")).when(F.try_variant_get(j, "$.items", "variant").isNotNull(), F.array(j)).otherwise(F.array().cast("array<variant>"))))
    pages = doc.select("document_id", F.posexplode(jobs).alias("pi", "p"))
    page = F.greatest(F.coalesce(_whole(p, "$.page"), _whole(p, "$.page_no"), F.lit(0)), F.lit(0))
    items = pages.select("document_id", "pi", page.alias("page"), F.posexplode(_list(p, "$.items")).alias("ii", "item"))
    label = F.lower(strip(F.coalesce(_get(t, "$.type", "string"), F.lit("text"))))
    value = F.coalesce(_text(t, "$.value"), _text(t, "$.text"), _text(t, "$.md"))
    order = F.col("pi") * 100_000 + F.col("ii")
    kind = _kind(label, ITEM_KINDS)
    level = F.coalesce(_whole(t, "$.lvl"), _whole(t, "$.level"))
    texts = items.where((label != "table") & value.isNotNull())
    blocks = _items(texts, document_id=F.col("document_id"), item_kind=F.lit("block"), origin=order, page=F.col("page"), text=value, kind=kind, heading_level=F.when(kind == "heading", F.when(level >= 1, level).otherwise(1)))
    bare = pages.where((F.size(_list(p, "$.items")) == 0) & (strip(F.coalesce(_text(p, "$.text"), F.lit(""))) != ""))
    blocks = blocks.unionByName(_items(bare, document_id=F.col("document_id"), item_kind=F.lit("block"), origin=F.col("pi") * 100_000, page=page, text=_text(p, "$.text"), kind=F.lit("paragraph")))
    rows = _list(t, "$.rows")
    cells = F.flatten(F.transform(rows, lambda r, i: F.transform(F.coalesce(F.try_variant_get(r, "$", "array<variant>"), F.array().cast("array<variant>")), lambda c, j: F.struct(i.alias("row_index"), j.alias("col_index"), F.coalesce(F.try_variant_get(c, "$", "string"), F.lit("")).alias("value"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span")))))
    cells = F.filter(cells, lambda c: strip(c["value"]) != "")
    raw = F.coalesce(_text(t, "$.md"), _text(t, "$.csv"), _text(t, "$.text"))
    degraded = F.coalesce(_get(t, "$.degraded", "boolean"), F.lit(False)) | ((F.size(cells) == 0) & raw.isNotNull())
    tables = _items(items.where(label == "table"), document_id=F.col("document_id"), item_kind=F.lit("table"), origin=order, page=F.col("page"), cells=cells, degraded=degraded, raw_text=F.when(degraded | (F.size(cells) == 0), raw))
    imgs = pages.select("document_id", "pi", page.alias("page"), F.posexplode(_list(p, "$.images")).alias("ii", "item"))
    figures = _items(imgs, document_id=F.col("document_id"), item_kind=F.lit("figure"), origin=order, page=F.col("page"), image_ref=F.coalesce(_text(t, "$.name"), _text(t, "$.image_ref"), F.lit("")), caption=_text(t, "$.caption"))
    return blocks.unionByName(tables).unionByName(figures)


def book_title(filename: Column) -> Column:
    """The name of a file without folders and without its last extension."""
    base = F.regexp_extract(filename, "[^/]*$", 0)
    return F.when(base.rlike(r"^\.+[^.]*$"), base).otherwise(F.regexp_replace(base, r"\.[^.]*$", ""))


def pdf_year(raw_date: Column) -> Column:
    """The year of a date like D:20180102; empty otherwise."""
    return F.when(F.startswith(raw_date, F.lit("D:")) & (F.length(raw_date) >= 6), F.substring(raw_date, 3, 4)).otherwise("")
