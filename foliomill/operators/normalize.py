"""Cleaning of parsed documents: running headers, broken words, order, heading paths, and their JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliomill.text import collapse, is_blank

NUMBER_SIGN = "\x00N\x00"


def exact_signature(text: Column) -> Column:
    return collapse(text)


def template_signature(text: Column) -> Column:
    """The signature with every run of digits replaced by one sign; null if it has none."""
    s = collapse(text)
    return F.when(s.rlike(r"\p{Nd}"), F.regexp_replace(s, r"\p{Nd}+", NUMBER_SIGN))


def region_candidates(blocks: DataFrame, region: int = 1) -> DataFrame:
    """Adds candidate: the block is among the first or last `region` blocks of its page; a page is the unit of the windows."""
    page = Window.partitionBy("document_id", "page")
    first = F.row_number().over(page.orderBy("position", "item"))
    last = F.row_number().over(page.orderBy(F.col("position").desc(), F.col("item").desc()))
    return blocks.withColumn("candidate", (first <= region) | (last <= region))


def running_signatures(candidates: DataFrame, min_pages: int = 2) -> DataFrame:
    """document_id, signature, is_template: signatures of candidates on at least `min_pages` pages of their document."""
    c = candidates.where("candidate").select("document_id", "page", exact_signature(F.col("text")).alias("exact"), template_signature(F.col("text")).alias("template")).where("exact != ''")
    both = c.select("document_id", "page", F.explode(F.array(F.struct(F.col("exact").alias("signature"), F.lit(False).alias("is_template")), F.struct(F.col("template").alias("signature"), F.lit(True).alias("is_template")))).alias("s")).select("document_id", "page", "s.*").where("signature IS NOT NULL")
    # distinct first, so that a line on all pages of a long document is counted in parts
    return both.distinct().groupBy("document_id", "signature", "is_template").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages).drop("pages")


def remove_running(blocks: DataFrame, region: int = 1, min_pages: int = 2) -> DataFrame:
    """Drops candidates whose exact or template signature recurs; blocks has document_id, page, position, item, text."""
    if min_pages < 2 or region < 1:
        raise ValueError("a signature recurs on two pages at least, and a region has one block at least")
    c = region_candidates(blocks, region)
    found = running_signatures(c, min_pages)
    exact = found.where("NOT is_template").select("document_id", F.col("signature").alias("__exact"))
    template = found.where("is_template").select("document_id", F.col("signature").alias("__template"))
    c = c.withColumns({"__exact": exact_signature(F.col("text")), "__template": template_signature(F.col("text"))})
    body = c.where("NOT candidate")
    edge = c.where("candidate").join(exact, ["document_id", "__exact"], "left_anti").join(template, ["document_id", "__template"], "left_anti")
    return body.unionByName(edge).select(blocks.columns)


#: Two parts of a word on both sides of a hyphen and a line's end.
BROKEN = r"([\p{L}\p{N}_]+)-\r?\n[ \t]*([\p{L}\p{N}_]+)"


def dehyphenate(text: Column, dictionary: Column) -> Column:
    """Joins a word broken by a hyphen at a line's end if the joined word, in lower case, is in `dictionary` (an array)."""
    whole, left, right = (F.regexp_extract_all(text, F.lit(BROKEN), F.lit(i)) for i in range(3))
    fixed = F.transform(F.arrays_zip(whole.alias("w"), left.alias("l"), right.alias("r")), lambda z: F.when(F.array_contains(dictionary, F.lower(F.concat(z["l"], z["r"]))), F.concat(z["l"], z["r"])).otherwise(z["w"]))
    pieces = F.split(text, BROKEN, -1)
    woven = F.zip_with(pieces, F.concat(fixed, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.when(text.contains("-"), F.array_join(woven, "")).otherwise(text)


#: Words that one array literal beside every row may hold.
MOST_WORDS = 50_000


def dehyphenate_blocks(blocks: DataFrame, dictionary: DataFrame, text: str = "text") -> DataFrame:
    """As `dehyphenate`, by the words of a table (column word); blank words do not count, an empty table joins nothing.

    The table is read once as a single row of an array; above MOST_WORDS words the broken words are joined to it instead.
    """
    words = dictionary.select(F.lower(F.trim("word")).alias("word")).where("word != ''").distinct()
    if words.limit(MOST_WORDS + 1).count() <= MOST_WORDS:
        one = words.agg(F.coalesce(F.collect_list("word"), F.array().cast("array<string>")).alias("__words"))
        return blocks.crossJoin(F.broadcast(one)).withColumn(text, dehyphenate(F.col(text), F.col("__words"))).drop("__words")
    pair = F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(BROKEN), F.lit(1)).alias("l"), F.regexp_extract_all(text, F.lit(BROKEN), F.lit(2)).alias("r")), lambda z: F.lower(F.concat(z["l"], z["r"])))
    marked = blocks.withColumn("__key", F.xxhash64(text))
    broken = marked.select("__key", F.explode(pair).alias("word")).join(words, "word").groupBy("__key").agg(F.collect_set("word").alias("__words"))
    return marked.join(broken, "__key", "left").withColumn(text, dehyphenate(F.col(text), F.coalesce("__words", F.array().cast("array<string>")))).drop("__key", "__words")


def merge_elements(cleaned: DataFrame, headings: DataFrame, others: DataFrame) -> DataFrame:
    """Elements in order: cleaned blocks, headings that no cleaned block stands at, tables and figures.

    cleaned: document_id, page, position, text, block_type, heading_level; headings: document_id, page, position, text,
    level; others: document_id, page, position, item_kind and payload columns.  Adds rank and kind (text, heading, table, figure).
    """
    blocks = cleaned.select("document_id", "page", "position", F.lit(0).alias("rank"), F.when(F.col("block_type") == "heading", "heading").otherwise("text").alias("kind"), "text", "heading_level")
    # against the cleaned blocks: a heading taken out as a running line comes back from its own record
    rest = headings.join(blocks.select("document_id", "page", "position"), ["document_id", "page", "position"], "left_anti").select("document_id", "page", "position", F.lit(1).alias("rank"), F.lit("heading").alias("kind"), "text", F.col("level").alias("heading_level"))
    more = others.select("document_id", "page", "position", F.when(F.col("item_kind") == "table", 2).otherwise(3).alias("rank"), F.col("item_kind").alias("kind"), *[c for c in ("cells", "degraded", "raw_text", "image_ref", "caption") if c in others.columns])
    return blocks.unionByName(rest).unionByName(more, allowMissingColumns=True)


MOST_LEVELS = 64


def heading_paths(elements: DataFrame) -> DataFrame:
    """Adds heading_path: the open headings above each text and heading; tables and figures have none.

    A heading closes those of its own and deeper levels.  So the heading of a level that is open at an element is the last
    one of that level, if no heading of a smaller level came after it: one running maximum for each level, in one window.
    """
    levels = [r[0] for r in elements.where("kind = 'heading'").select(F.coalesce("heading_level", F.lit(1)).alias("l")).distinct().orderBy("l").limit(MOST_LEVELS + 1).collect()]
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} heading levels")
    if not levels:
        return elements.withColumn("heading_path", F.array().cast("array<string>"))
    before = Window.partitionBy("document_id").orderBy("page", "position", "rank").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct("page", "position", "rank", "text")
    level = F.when(F.col("kind") == "heading", F.coalesce("heading_level", F.lit(1)))
    df = elements.withColumn("__level", level)
    df = df.withColumns({f"__h{i}": F.last(F.when(F.col("__level") == l, place), ignorenulls=True).over(before) for i, l in enumerate(levels)})
    path = F.array().cast("array<string>")
    for i, l in enumerate(levels):
        h = F.col(f"__h{i}")
        is_open = h.isNotNull()
        for j in range(i):
            g = F.col(f"__h{j}")
            is_open = is_open & (g.isNull() | (F.struct(h["page"], h["position"], h["rank"]) > F.struct(g["page"], g["position"], g["rank"])))
        # a heading has only smaller levels above itself
        is_open = is_open & (F.col("__level").isNull() | (F.col("__level") > l))
        path = F.concat(path, F.when(is_open, F.array(h["text"])).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("heading_path", F.when(F.col("kind").isin("text", "heading"), path).otherwise(F.array().cast("array<string>")))
    return df.drop("__level", *[f"__h{i}" for i in range(len(levels))])


def normalize_status(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """document_id, norm_status: malformed (a null or empty id), empty (no element) or normalized."""
    some = elements.select("document_id").distinct().withColumn("__some", F.lit(True))
    return documents.select("document_id").distinct().join(some, "document_id", "left").select("document_id", F.when(F.coalesce(F.col("document_id"), F.lit("")) == "", "malformed").when(F.col("__some").isNull(), "empty").otherwise("normalized").alias("norm_status"))


CELL_JSON = "array<struct<colIndex:int,colSpan:int,rowIndex:int,rowSpan:int,value:string>>"


def _fields(elements: DataFrame) -> DataFrame:
    for name, kind in (("cells", "array<struct<row_index:int,col_index:int,value:string,row_span:int,col_span:int>>"), ("degraded", "boolean"), ("raw_text", "string"), ("image_ref", "string"), ("caption", "string")):
        if name not in elements.columns:
            elements = elements.withColumn(name, F.lit(None).cast(kind))
    return elements


def element_json(elements: DataFrame) -> Column:
    """One element as JSON, keys in alphabetical order, nulls kept."""
    keep = {"ignoreNullFields": "false"}
    cells = F.transform("cells", lambda c: F.struct(c["col_index"].alias("colIndex"), c["col_span"].alias("colSpan"), c["row_index"].alias("rowIndex"), c["row_span"].alias("rowSpan"), c["value"].alias("value")))
    text = F.to_json(F.struct(F.col("heading_level").alias("headingLevel"), F.col("text")), keep)
    tab = F.to_json(F.struct(F.coalesce(cells, F.array().cast(CELL_JSON)).alias("cells"), F.coalesce("degraded", F.lit(False)).alias("degraded"), F.col("raw_text").alias("rawText")), keep)
    fig = F.to_json(F.struct("caption", F.col("image_ref").alias("imageRef")), keep)
    payload = F.when(F.col("kind").isin("text", "heading"), text).when(F.col("kind") == "table", tab).otherwise(fig)
    head = F.to_json(F.struct(F.col("heading_path").alias("headingPath"), "kind", F.col("page").alias("pageNumber")), keep)
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"payload":'), payload, F.lit(',"readingOrderPosition":'), F.col("position").cast("string"), F.lit("}"))


def serialize(elements: DataFrame) -> DataFrame:
    """document_id, json: a whole document as one text.  For exchange of documents of moderate size; Parquet is the artifact between stages."""
    df = _fields(elements)
    row = df.select("document_id", F.struct("page", "position", "rank", element_json(df).alias("json")).alias("e"))
    all_ = row.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["json"]), ",").alias("all"))
    return all_.select("document_id", F.concat(F.lit('{"documentId":'), F.to_json(F.struct("document_id")).substr(F.lit(16), F.length(F.to_json(F.struct("document_id"))) - 16), F.lit(',"elements":['), F.col("all"), F.lit('],"schemaVersion":1}')).alias("json"))


ELEMENT_JSON = f"struct<headingPath:array<string>,kind:string,pageNumber:int,payload:struct<text:string,headingLevel:int,cells:{CELL_JSON},degraded:boolean,rawText:string,imageRef:string,caption:string>,readingOrderPosition:bigint>"


def deserialize(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, errors) of document_id, json: the inverse of `serialize`; errors are document_id, error.

    A text that is no JSON object, whose elements are no list, or with an element of unknown kind or without its page,
    position or payload, gives an error and no element.  Missing spans are 1, missing flags false, missing paths empty.
    """
    doc = F.from_json("json", f"struct<documentId:string,elements:array<{ELEMENT_JSON}>,schemaVersion:int>", {"mode": "PERMISSIVE"})
    v = F.try_parse_json("json")
    kind_of = F.coalesce(F.schema_of_variant(v), F.lit(""))
    df = docs.select("document_id", "json", doc.alias("doc"), kind_of.alias("shape"), F.try_variant_get(v, "$.elements", "array<variant>").alias("list"), F.try_variant_get(v, "$.elements", "variant").alias("any"))
    fine = lambda e: F.coalesce(e["kind"].isin("text", "heading", "table", "figure") & e["pageNumber"].isNotNull() & e["readingOrderPosition"].isNotNull() & e["payload"].isNotNull() & F.when(e["kind"].isin("text", "heading"), e["payload"]["text"].isNotNull()).when(e["kind"] == "figure", e["payload"]["imageRef"].isNotNull()).otherwise(True), F.lit(False))
    error = (
        F.when(~F.startswith("shape", F.lit("OBJECT")), "no JSON object")
        .when(F.col("doc.documentId").isNull(), "no documentId")
        .when(F.col("any").isNotNull() & F.col("list").isNull(), "elements are no list")
        .when(~F.forall(F.coalesce("doc.elements", F.array().cast(f"array<{ELEMENT_JSON}>")), fine), "an element lacks a field or has an unknown kind")
    )
    df = df.withColumn("error", error)
    e = df.where("error IS NULL").select(F.col("doc.documentId").alias("document_id"), F.explode("doc.elements").alias("e"))
    cells = F.transform("e.payload.cells", lambda c: F.struct(c["rowIndex"].alias("row_index"), c["colIndex"].alias("col_index"), c["value"].alias("value"), F.coalesce(c["rowSpan"], F.lit(1)).alias("row_span"), F.coalesce(c["colSpan"], F.lit(1)).alias("col_span")))
    elements = e.select("document_id", F.col("e.pageNumber").alias("page"), F.col("e.readingOrderPosition").alias("position"), F.col("e.kind").alias("kind"), F.col("e.payload.text").alias("text"), F.col("e.payload.headingLevel").alias("heading_level"), cells.alias("cells"), F.when(F.col("e.kind") == "table", F.coalesce("e.payload.degraded", F.lit(False))).alias("degraded"), F.col("e.payload.rawText").alias("raw_text"), F.col("e.payload.imageRef").alias("image_ref"), F.col("e.payload.caption").alias("caption"), F.coalesce("e.headingPath", F.array().cast("array<string>")).alias("heading_path"))
    return elements, df.where("error IS NOT NULL").select("document_id", "error")


def clean(parsed: DataFrame, dictionary: DataFrame | None = None, region: int = 1, min_pages: int = 2) -> DataFrame:
    """parsed items → elements with heading paths: running lines out, broken words joined, merged and ordered."""
    blocks = parsed.where(F.col("item_kind").isin("block", "ocr")).withColumn("item", F.col("origin"))
    kept = remove_running(blocks, region, min_pages)
    if dictionary is not None:
        kept = dehyphenate_blocks(kept, dictionary)
    from foliomill.operators.layout import headings

    return heading_paths(merge_elements(kept, headings(parsed), parsed.where(F.col("item_kind").isin("table", "figure"))))


def blank_elements(elements: DataFrame) -> DataFrame:
    return elements.where(F.col("kind").isin("text", "heading") & is_blank(F.col("text")))
