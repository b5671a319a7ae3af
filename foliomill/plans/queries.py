"""The queries of the core operators: each takes (spark, sf_dir) and runs over whole tables.

ORACLE_SQL has the same queries for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliomill.operators import answer, chunk, embed, ingest, layout, normalize, ocr, retrieve
from foliomill.plans import pipeline
from foliomill.session import table
from foliomill.sources import readers, store

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


# white space in DuckDB's regular expressions
_S = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STRIP = lambda c: f"regexp_replace({c}, '^[{_S}]+|[{_S}]+$', '', 'g')"
_COLLAPSE = lambda c: _STRIP(f"regexp_replace({c}, '[{_S}]+', ' ', 'g')")


# ---- submission gate


def _submissions(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of several kinds, by their key."""
    t = F.coalesce("text", F.lit(""))
    k = F.pmod("doc_id", F.lit(7))
    body = (
        F.when(k == 0, F.concat(F.lit("<!DOCTYPE html><HTML>"), t, F.lit("</HTML>"))).when(k == 1, F.concat(F.lit("  <html>"), t)).when(k == 2, F.concat(F.lit("%PDF-1.4 "), t, F.lit("%%EOF")))
        .when(k == 3, F.concat(F.lit("%PDF-1.4 "), t)).when(k == 4, F.concat(F.lit("GIF89a"), t)).when(k == 5, F.lit("")).otherwise(t)
    )
    name = F.when(F.pmod("doc_id", F.lit(50)) == 0, "").otherwise(F.concat("source", F.lit("-"), F.col("doc_id").cast("string")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("submission_id"), name.alias("filename"), body.cast("binary").alias("content"))


_SUBMISSIONS = """s AS (SELECT doc_id AS submission_id, CASE WHEN doc_id % 50 = 0 THEN '' ELSE source || '-' || doc_id END AS filename,
 CASE doc_id % 7 WHEN 0 THEN '<!DOCTYPE html><HTML>' || coalesce(text, '') || '</HTML>' WHEN 1 THEN '  <html>' || coalesce(text, '') WHEN 2 THEN '%PDF-1.4 ' || coalesce(text, '') || '%%EOF'
 WHEN 3 THEN '%PDF-1.4 ' || coalesce(text, '') WHEN 4 THEN 'GIF89a' || coalesce(text, '') WHEN 5 THEN '' ELSE coalesce(text, '') END AS t FROM documents),
g AS (SELECT *, CASE WHEN filename = '' THEN 'invalid_filename' WHEN t = '' THEN 'empty_file'
 WHEN starts_with(t, '%PDF-') THEN CASE WHEN contains(t, '%%EOF') THEN NULL ELSE 'corrupted_file' END
 WHEN starts_with(lower(ltrim(t)), '<!doctype html') OR contains(lower(left(ltrim(t), 1024)), '<html') THEN CASE WHEN contains(lower(t), '</html>') THEN NULL ELSE 'corrupted_file' END
 ELSE 'unsupported_format' END AS code FROM s)"""


@query(f"WITH {_SUBMISSIONS} SELECT submission_id, code, sha256(encode(t)) AS content_hash FROM g")
def ingest_gate(spark: SparkSession, d: str) -> DataFrame:
    return ingest.gate(_submissions(spark, d)).select("submission_id", "code", "content_hash")


@query(f"""WITH {_SUBMISSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY sha256(encode(t)) ORDER BY submission_id) AS n FROM g WHERE code IS NULL)
SELECT submission_id, CASE WHEN n = 1 THEN 'accepted' ELSE 'duplicate' END AS outcome, sha256('job' || sha256(encode(t))) AS job_id FROM r
UNION ALL SELECT submission_id, 'rejected', NULL FROM g WHERE code IS NOT NULL""")
def ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return ingest.submit(ingest.gate(_submissions(spark, d))).select("submission_id", "outcome", "job_id")


@query("SELECT document_id, count(DISTINCT job_id) AS submissions, min(job_id) AS first_job FROM jobs GROUP BY document_id")
def ingest_resubmissions(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of the same bytes, by the deduplication key."""
    jobs = table(spark, d, "jobs").select("document_id", "job_id").distinct()
    return jobs.groupBy("document_id").agg(F.count("*").alias("submissions"), F.min("job_id").alias("first_job"))


@query("""SELECT n AS id, CASE WHEN h LIKE '89504E470D0A1A0A%' THEN 'PNG image' WHEN h LIKE 'FFD8FF%' THEN 'JPEG image' WHEN h LIKE '474946383761%' OR h LIKE '474946383961%' THEN 'GIF image'
 WHEN h LIKE '25215053%' THEN 'PostScript' WHEN h LIKE '7B5C727466%' THEN 'RTF document' WHEN h LIKE '1F8B%' THEN 'gzip archive' WHEN h LIKE '504B%' THEN 'ZIP-based archive (not EPUB or DOCX)'
 ELSE 'an unrecognized/unsupported format' END AS label FROM (VALUES (1, '89504E470D0A1A0A00'), (2, 'FFD8FFE0'), (3, '474946383761'), (4, '474946383961'), (5, '252150532D'), (6, '7B5C72746631'), (7, '1F8B08'), (8, '504B0304'), (9, '00')) t(n, h)""")
def sniff_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = ["89504E470D0A1A0A00", "FFD8FFE0", "474946383761", "474946383961", "252150532D", "7B5C72746631", "1F8B08", "504B0304", "00"]
    return spark.createDataFrame([(i, bytearray.fromhex(h)) for i, h in enumerate(rows, 1)], "id int, content binary").select("id", ingest.unsupported_label(F.col("content")).alias("label"))


@query("""SELECT doc_id AS submission_id, CASE doc_id % 6 WHEN 0 THEN 'docx' WHEN 1 THEN 'docx' WHEN 2 THEN 'epub' WHEN 3 THEN 'epub' WHEN 4 THEN 'docx' END AS format,
 CASE doc_id % 6 WHEN 1 THEN 'corrupted_file' WHEN 4 THEN 'corrupted_file' WHEN 5 THEN 'unsupported_format' END AS code FROM documents""")
def zip_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents in ZIP containers of six kinds: whole, without a part, with either mark of an EPUB, damaged, of no known kind."""
    kinds = [["[Content_Types].xml", "word/document.xml"], ["word/document.xml"], ["META-INF/container.xml"], ["mimetype", "META-INF/container.xml"], ["[Content_Types].xml", "word/document.xml"], ["other"]]

    def pack(batches):
        import io
        import zipfile

        import pandas as pd

        for b in batches:
            out = []
            for key, text in zip(b["doc_id"], b["text"]):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    for name in kinds[key % 6]:
                        z.writestr(name, "application/epub+zip" if name == "mimetype" else text or "")
                out.append(held.getvalue()[: -20 if key % 6 == 4 else None])
            yield pd.DataFrame({"submission_id": b["doc_id"], "filename": "a.zip", "content": pd.Series(out, dtype=object, index=b.index)})

    packed = table(spark, d, "documents").select("doc_id", "text").mapInPandas(pack, "submission_id bigint, filename string, content binary")
    return ingest.gate(packed).select("submission_id", "format", "code")


@query("SELECT content_hash, min(job_id) AS job_id FROM jobs WHERE content_hash IN (SELECT content_hash FROM jobs WHERE byte_size % 2 = 0) GROUP BY content_hash")
def job_lookup(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs")
    return ingest.find_jobs(jobs.select("content_hash", "job_id"), jobs.where("byte_size % 2 = 0")).select("content_hash", "job_id")


@query("SELECT DISTINCT job_id, CASE WHEN overall_status = 'failed' THEN 'queued' ELSE overall_status END AS overall_status FROM jobs")
def job_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Failed jobs are put back into the queue."""
    jobs = table(spark, d, "jobs").select("job_id", "overall_status").distinct()
    return ingest.upsert_jobs(jobs, jobs.where("overall_status = 'failed'").withColumn("overall_status", F.lit("queued")))


# ---- parsing


@query(f"""SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS origin, part AS text FROM (
 SELECT CAST(doc_id AS VARCHAR) AS document_id, {_STRIP('part')} AS part, i FROM (
 SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS part, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS i FROM documents)) WHERE part <> ''""")
def text_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("content"))
    return readers.text_layer(src).select("document_id", "origin", "text")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_blocks").distinct()
    return raw.select("document_id", F.lit("block").alias("item_kind"), F.col("raw_id").alias("origin"), F.col("page_number").alias("page"), "text", "kind", "heading_level", "bbox", F.col("layout_column").alias("column"), "from_ocr", F.lit(None).cast(readers.CELLS).alias("cells"))


_LAYOUT = """r AS (SELECT DISTINCT * FROM raw_blocks),
b AS (SELECT *, layout_column IS NULL AND bbox IS NOT NULL AS boxed FROM r),
l AS (SELECT *, greatest(0.5 * coalesce(avg(CASE WHEN boxed AND bbox.x1 - bbox.x0 > 0 THEN bbox.x1 - bbox.x0 END) OVER (PARTITION BY document_id, page_number, boxed), 0), 1) AS lim,
 lag(bbox.x0) OVER (PARTITION BY document_id, page_number, boxed ORDER BY bbox.x0) AS before FROM b),
c AS (SELECT *, coalesce(layout_column, CASE WHEN boxed THEN sum(CASE WHEN bbox.x0 - before > lim THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_number, boxed ORDER BY bbox.x0 RANGE UNBOUNDED PRECEDING) END, 0) AS col FROM l)"""


@query(f"WITH {_LAYOUT} SELECT raw_id, CAST(col AS INTEGER) AS col, row_number() OVER (PARTITION BY document_id ORDER BY page_number, col, coalesce(bbox.y0, 0), coalesce(bbox.x0, 0), raw_id) - 1 AS position FROM c")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(_raw(spark, d)).select(F.col("origin").alias("raw_id"), "col", "position")


@query("""SELECT raw_id, CASE WHEN heading_level IS NOT NULL THEN 'heading' ELSE CASE lower(trim(kind)) WHEN 'title' THEN 'heading' WHEN 'heading' THEN 'heading' WHEN 'paragraph' THEN 'paragraph' WHEN 'caption' THEN 'caption'
 WHEN 'ocr_text' THEN 'ocr_text' WHEN 'list_item' THEN 'list_item' WHEN 'footnote' THEN 'footnote' ELSE 'other' END END AS block_type, CASE WHEN from_ocr THEN 'ocr' ELSE 'text_layer' END AS source FROM (SELECT DISTINCT * FROM raw_blocks)""")
def block_typing(spark: SparkSession, d: str) -> DataFrame:
    return layout.parsed_items(_raw(spark, d)).select(F.col("origin").alias("raw_id"), "block_type", "source")


@query(f"""SELECT j.document_id, CASE WHEN s.document_id IS NULL THEN 'failed' ELSE 'ok' END AS parse_status, CASE WHEN s.document_id IS NULL THEN 'no_extractable_content' END AS parse_kind
FROM (SELECT DISTINCT document_id FROM jobs) j LEFT JOIN (SELECT DISTINCT document_id FROM raw_blocks WHERE {_STRIP('text')} <> '') s ON s.document_id = j.document_id""")
def parse_status(spark: SparkSession, d: str) -> DataFrame:
    return layout.parse_status(table(spark, d, "jobs"), _raw(spark, d)).select("document_id", "parse_status", "parse_kind")


@query("""SELECT block_id, ocr_confidence < c.ocr_confidence_threshold AS low FROM (SELECT DISTINCT block_id, document_id, ocr_confidence FROM text_blocks WHERE ocr_confidence IS NOT NULL) b
JOIN (SELECT document_id, min(config_id) AS config_id FROM jobs GROUP BY document_id) j USING (document_id) JOIN pipeline_configs c USING (config_id)""")
def ocr_low_confidence(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "text_blocks").where("ocr_confidence IS NOT NULL").select("block_id", "document_id", "ocr_confidence").distinct()
    j = table(spark, d, "jobs").groupBy("document_id").agg(F.min("config_id").alias("config_id"))
    c = table(spark, d, "pipeline_configs").select("config_id", "ocr_confidence_threshold")
    scored = b.join(j, "document_id").join(F.broadcast(c), "config_id").withColumnRenamed("ocr_confidence", "confidence")
    return ocr.flag_low(scored, F.col("ocr_confidence_threshold")).select("block_id", F.col("low_confidence").alias("low"))


def _images(spark: SparkSession, d: str) -> DataFrame:
    """Pages that hold nothing but scanned blocks as images, and every tenth raw block as an embedded one."""
    raw = table(spark, d, "raw_blocks").select("raw_id", "document_id", F.col("page_number").alias("page"), "from_ocr").distinct()
    pages = raw.groupBy("document_id", "page").agg((~F.every("from_ocr")).alias("has_text_layer")).withColumn("page_image_ref", F.concat_ws("#", "document_id", F.col("page").cast("string")))
    images = raw.where("raw_id % 10 = 0").select("document_id", "page", F.concat(F.lit("image "), F.col("raw_id").cast("string")).alias("image_ref"), (F.col("raw_id") % 20 == 0).alias("has_text"))
    return ocr.images_to_read(pages, images)


_IMAGES = """ra AS (SELECT DISTINCT raw_id, document_id, page_number AS page, from_ocr FROM raw_blocks),
im AS (SELECT document_id, document_id || '#' || page AS image_ref, page, 0 AS step FROM ra GROUP BY document_id, page HAVING bool_and(from_ocr)
 UNION ALL SELECT document_id, 'image ' || raw_id, page, 1 FROM ra WHERE raw_id % 20 = 0),
sel AS (SELECT document_id, image_ref, page, CAST(row_number() OVER (PARTITION BY document_id ORDER BY step, page, image_ref) - 1 AS INTEGER) AS seq FROM im)"""


@query(f"WITH {_IMAGES} SELECT * FROM sel")
def ocr_selection(spark: SparkSession, d: str) -> DataFrame:
    return _images(spark, d)


@query(f"""WITH {_IMAGES}, r AS (SELECT *, length(image_ref) % 3 = 0 AS bad FROM sel)
SELECT document_id, image_ref AS item, page, CASE WHEN bad THEN 'unreadable' END AS error_kind, CASE WHEN NOT bad THEN 'read ' || image_ref END AS text, NOT bad AND length(image_ref) % 10 / 10.0 < 0.7 AS low,
 CASE WHEN NOT bad THEN CAST(row_number() OVER (PARTITION BY document_id, bad ORDER BY seq) - 1 AS INTEGER) ELSE -1 END AS origin FROM r""")
def ocr_results(spark: SparkSession, d: str) -> DataFrame:
    """Images read through a port that fails for some: blocks of what it read, and a row for each failure."""
    def port(ref: str) -> tuple[str, float]:
        if len(ref) % 3 == 0:
            raise ValueError(ref)
        return f"read {ref}", len(ref) % 10 / 10

    blocks, errors = ocr.split_results(ocr.read_images(_images(spark, d), port, 60), 0.7)
    none = lambda kind: F.lit(None).cast(kind)
    return blocks.select("document_id", F.substring("text", 6, 10_000).alias("item"), "page", none("string").alias("error_kind"), "text", F.col("low_confidence").alias("low"), "origin").unionByName(
        errors.select("document_id", F.col("image_ref").alias("item"), "page", "error_kind", none("string").alias("text"), F.lit(False).alias("low"), F.lit(-1).alias("origin")))


@query("""SELECT CAST(event_id AS VARCHAR) AS image_ref, CASE WHEN p.event_id IS NULL THEN 'unreadable' WHEN p.value > 60 THEN 'timeout' WHEN p.event_type = 'error' THEN 'corrupt' END AS error_kind,
 CASE WHEN p.event_id IS NOT NULL AND p.value <= 60 AND p.event_type <> 'error' THEN p.value / 100 END AS confidence
FROM (SELECT event_id FROM events) i LEFT JOIN (SELECT * FROM events WHERE event_id % 5 <> 0) p USING (event_id)""")
def ocr_planned(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    images = e.select(F.lit("d").alias("document_id"), F.col("event_id").cast("string").alias("image_ref"), F.lit(0).alias("page"), F.lit(0).alias("seq"))
    plan = e.where("event_id % 5 <> 0").select(F.col("event_id").cast("string").alias("image_ref"), F.col("event_type").alias("text"), (F.col("value") / 100).alias("confidence"), F.when(F.col("event_type") == "error", "corrupt").alias("error_kind"), F.col("value").alias("duration"))
    return ocr.planned(images, plan, 60).select("image_ref", "error_kind", "confidence")


_EXPORT = """e AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY raw_id) - 1 AS i FROM (SELECT DISTINCT raw_id, document_id, text, page_number, kind, heading_level, bbox FROM raw_blocks))"""


def _export(spark: SparkSession, d: str) -> DataFrame:
    """Raw blocks in the order of their ids, with their number in the document."""
    from pyspark.sql import Window

    raw = table(spark, d, "raw_blocks").select("raw_id", "document_id", "text", "page_number", "kind", "heading_level", "bbox").distinct()
    return raw.withColumn("i", F.row_number().over(Window.partitionBy("document_id").orderBy("raw_id")) - 1)


def _in_order(df: DataFrame, item) -> DataFrame:
    return df.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", item.alias("x")))), lambda e: e["x"]).alias("items"))


@query(f"""WITH {_EXPORT} SELECT document_id, CAST(i AS INTEGER) AS origin, greatest(page_number, 0) AS page, text, m AS kind, CASE WHEN m = 'heading' THEN CASE WHEN heading_level >= 1 THEN heading_level ELSE 1 END ELSE 0 END AS heading_level, coalesce(bbox.x0, -1) AS x0
FROM (SELECT *, CASE lower(trim(kind)) WHEN 'section_header' THEN 'heading' WHEN 'title' THEN 'heading' WHEN 'subtitle' THEN 'heading' WHEN 'heading' THEN 'heading' WHEN 'caption' THEN 'caption' WHEN 'list_item' THEN 'list_item' WHEN 'footnote' THEN 'footnote' ELSE 'paragraph' END AS m FROM e) WHERE text IS NOT NULL""")
def layout_export(spark: SparkSession, d: str) -> DataFrame:
    """Raw blocks by way of a layout engine's JSON."""
    box = F.when(F.col("bbox").isNotNull(), F.struct(*[F.col(f"bbox.{c}").alias(n) for c, n in zip(("x0", "y0", "x1", "y1"), "ltrb")]))
    item = F.struct("text", F.col("kind").alias("label"), F.col("heading_level").alias("level"), F.array(F.struct(F.col("page_number").alias("page_no"), box.alias("bbox"))).alias("prov"))
    native = _in_order(_export(spark, d), item).select("document_id", F.to_json(F.struct(F.col("items").alias("texts"))).alias("native"))
    return readers.layout_json(native).select("document_id", "origin", "page", "text", "kind", F.coalesce("heading_level", F.lit(0)).alias("heading_level"), F.coalesce("bbox.x0", F.lit(-1.0)).alias("x0"))


@query(f"""WITH {_EXPORT}, p AS (SELECT document_id, page_number, row_number() OVER (PARTITION BY document_id ORDER BY page_number) - 1 AS pi FROM (SELECT DISTINCT document_id, page_number FROM e)),
q AS (SELECT e.*, pi, row_number() OVER (PARTITION BY e.document_id, e.page_number ORDER BY raw_id) - 1 AS ii, CASE lower(trim(kind)) WHEN 'title' THEN 'heading' WHEN 'heading' THEN 'heading' WHEN 'caption' THEN 'caption' ELSE 'paragraph' END AS m FROM e JOIN p ON p.document_id = e.document_id AND p.page_number = e.page_number)
SELECT document_id, CAST(pi * 100000 + ii AS INTEGER) AS origin, greatest(page_number, 0) AS page, text, m AS kind, CASE WHEN m = 'heading' THEN CASE WHEN heading_level >= 1 THEN heading_level ELSE 1 END ELSE 0 END AS heading_level FROM q WHERE text IS NOT NULL""")
def page_export(spark: SparkSession, d: str) -> DataFrame:
    """Raw blocks by way of a page-wise JSON."""
    item = F.struct(F.col("kind").alias("type"), F.col("heading_level").alias("lvl"), F.col("text").alias("value"))
    pages = _export(spark, d).groupBy("document_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", item.alias("x")))), lambda e: e["x"]).alias("items"))
    pages = pages.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "items"))), lambda p: F.struct(p["page_number"].alias("page"), p["items"].alias("items"))).alias("pages"))
    return readers.page_json(pages.select("document_id", F.to_json(F.struct("pages")).alias("native"))).select("document_id", "origin", "page", "text", "kind", F.coalesce("heading_level", F.lit(0)).alias("heading_level"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS document_id, CAST(count(*) FILTER (WHERE l_linenumber % 3 <> 0) AS INTEGER) AS cells FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1""")
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    """Tables of a document; cells that are blank are left out."""
    cell = F.struct(F.col("l_linenumber").cast("int").alias("row_index"), F.lit(0).alias("col_index"), F.when(F.col("l_linenumber") % 3 == 0, "\u00a0 ").otherwise("v").alias("value"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"))
    tabs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().groupBy(F.col("l_orderkey").cast("string").alias("document_id")).agg(F.collect_list(cell).alias("cells"))
    none = lambda kind: F.lit(None).cast(kind)
    items = tabs.select("document_id", F.lit("table").alias("item_kind"), F.lit(0).alias("origin"), F.lit(1).alias("page"), none("string").alias("text"), none("string").alias("kind"), none("int").alias("heading_level"), none(readers.BBOX).alias("bbox"), none("int").alias("column"), F.lit(False).alias("from_ocr"), "cells")
    return layout.parsed_items(layout.with_origins(items)).select("document_id", F.size("cells").alias("cells"))


# ---- cleaning


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_blocks").select("block_id", "document_id", "page_number", "reading_order_position", "text", "block_type", "heading_level").distinct().select("document_id", F.col("page_number").alias("page"), F.col("reading_order_position").alias("position"), F.col("block_id").alias("item"), "text", "block_type", "heading_level")


@query(f"""WITH b AS (SELECT DISTINCT block_id, document_id, page_number, reading_order_position AS p, text FROM text_blocks),
c AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY p, block_id) = 1 OR row_number() OVER (PARTITION BY document_id, page_number ORDER BY p DESC, block_id DESC) = 1 AS cand, {_COLLAPSE('text')} AS e FROM b),
t AS (SELECT *, CASE WHEN regexp_matches(e, '\\p{{Nd}}') THEN regexp_replace(e, '\\p{{Nd}}+', '<N>', 'g') END AS m FROM c),
ex AS (SELECT document_id, e FROM t WHERE cand AND e <> '' GROUP BY 1, 2 HAVING count(DISTINCT page_number) >= 2),
te AS (SELECT document_id, m FROM t WHERE cand AND m IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT page_number) >= 2)
SELECT block_id FROM t WHERE NOT (cand AND ((document_id, e) IN (SELECT (document_id, e) FROM ex) OR (m IS NOT NULL AND (document_id, m) IN (SELECT (document_id, m) FROM te))))""")
def header_footer_removal(spark: SparkSession, d: str) -> DataFrame:
    return normalize.remove_running(_blocks(spark, d)).select(F.col("item").alias("block_id"))


@query(r"""WITH w AS (SELECT list(DISTINCT lower(trim(word))) AS words FROM dictionary_words WHERE trim(word) <> ''),
b AS (SELECT block_id, text, regexp_extract_all(text, '([\p{L}\p{N}_]+)-\r?\n[ \t]*([\p{L}\p{N}_]+)', 0) AS m, regexp_extract_all(text, '([\p{L}\p{N}_]+)-\r?\n[ \t]*([\p{L}\p{N}_]+)', 1) AS l, regexp_extract_all(text, '([\p{L}\p{N}_]+)-\r?\n[ \t]*([\p{L}\p{N}_]+)', 2) AS r,
 string_split_regex(text, '([\p{L}\p{N}_]+)-\r?\n[ \t]*([\p{L}\p{N}_]+)') AS s FROM (SELECT DISTINCT block_id, text FROM text_blocks))
SELECT block_id, array_to_string(list_transform(range(1, len(s) + 1), lambda i: s[i] || coalesce(CASE WHEN list_contains(words, lower(l[i] || r[i])) THEN l[i] || r[i] ELSE m[i] END, '')), '') AS text FROM b, w""")
def dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    return normalize.dehyphenate_blocks(_blocks(spark, d).select(F.col("item").alias("block_id"), "text"), table(spark, d, "dictionary_words"))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    return b.select("document_id", "page", "position", F.lit(0).alias("rank"), F.when(F.col("block_type") == "heading", "heading").otherwise("text").alias("kind"), "text", "heading_level", "item")


@query("""WITH b AS (SELECT DISTINCT block_id, document_id, page_number AS g, reading_order_position AS p, text, CASE WHEN block_type = 'heading' THEN coalesce(heading_level, 1) END AS lv FROM text_blocks),
h AS (SELECT * FROM b WHERE lv IS NOT NULL),
k AS (SELECT *, (SELECT min((n.g, n.p)) FROM h n WHERE n.document_id = h.document_id AND (n.g, n.p) > (h.g, h.p) AND n.lv <= h.lv) AS closed FROM h)
SELECT b.block_id, coalesce(list(k.text ORDER BY k.g, k.p) FILTER (WHERE k.text IS NOT NULL), []) AS heading_path FROM b
LEFT JOIN k ON k.document_id = b.document_id AND (k.g, k.p) < (b.g, b.p) AND (k.closed IS NULL OR k.closed >= (b.g, b.p)) AND (b.lv IS NULL OR k.lv < b.lv) GROUP BY b.block_id""")
def heading_path(spark: SparkSession, d: str) -> DataFrame:
    return normalize.heading_paths(_elements(spark, d)).select(F.col("item").alias("block_id"), "heading_path")


@query("SELECT j.document_id, CASE WHEN b.document_id IS NULL THEN 'empty' ELSE 'normalized' END AS norm_status FROM (SELECT DISTINCT document_id FROM jobs) j LEFT JOIN (SELECT DISTINCT document_id FROM text_blocks) b USING (document_id)")
def normalize_status(spark: SparkSession, d: str) -> DataFrame:
    return normalize.normalize_status(table(spark, d, "jobs"), _elements(spark, d))


@query("SELECT DISTINCT block_id, document_id, page_number, reading_order_position AS position, text, CASE WHEN block_type = 'heading' THEN 'heading' ELSE 'text' END AS kind, coalesce(heading_level, 0) AS heading_level FROM text_blocks")
def serialize_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Elements after a trip through their document's JSON; a caption beside each element carries its key."""
    e = _elements(spark, d)
    marks = e.select("document_id", "page", "position", F.lit(3).alias("rank"), F.lit("figure").alias("kind"), F.col("item").cast("string").alias("image_ref"), F.lit("mark").alias("caption"))
    back, _ = normalize.deserialize(normalize.serialize(normalize.heading_paths(e.drop("item").unionByName(marks, allowMissingColumns=True))))
    keys = back.where("kind = 'figure' AND caption = 'mark'").select("document_id", "page", "position", F.col("image_ref").cast("bigint").alias("block_id"))
    return back.where("kind != 'figure'").join(keys, ["document_id", "page", "position"]).select("block_id", "document_id", F.col("page").alias("page_number"), "position", "text", "kind", F.coalesce("heading_level", F.lit(0)).alias("heading_level"))


@query(f"""WITH {_LAYOUT}, b2 AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number, col, coalesce(bbox.y0, 0), coalesce(bbox.x0, 0), raw_id) - 1 AS p FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY p) = 1 OR row_number() OVER (PARTITION BY document_id, page_number ORDER BY p DESC) = 1 AS cand, {_COLLAPSE('text')} AS x,
 CASE WHEN heading_level IS NOT NULL OR lower(trim(kind)) IN ('title', 'heading') THEN 'heading' ELSE 'text' END AS what FROM b2),
t2 AS (SELECT *, CASE WHEN regexp_matches(x, '\\p{{Nd}}') THEN regexp_replace(x, '\\p{{Nd}}+', '<N>', 'g') END AS m FROM k),
ex AS (SELECT document_id, x FROM t2 WHERE cand AND x <> '' GROUP BY 1, 2 HAVING count(DISTINCT page_number) >= 2),
te AS (SELECT document_id, m FROM t2 WHERE cand AND m IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT page_number) >= 2),
r2 AS (SELECT *, cand AND ((document_id, x) IN (SELECT (document_id, x) FROM ex) OR (m IS NOT NULL AND (document_id, m) IN (SELECT (document_id, m) FROM te))) AS gone FROM t2)
SELECT document_id, page_number AS page, p AS position, CAST(CASE WHEN gone THEN 1 ELSE 0 END AS INTEGER) AS rank, what AS kind, text FROM r2 WHERE NOT gone OR what = 'heading'
UNION ALL SELECT document_id, page_number, p, 3, 'figure', NULL FROM (SELECT document_id, max(page_number) AS page_number, count(*) AS p FROM c GROUP BY document_id)""")
def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    """Parsed blocks and a figure behind them as clean elements; headings that went as running lines are back."""
    raw = _raw(spark, d)
    figures = raw.groupBy("document_id").agg(F.max("page").alias("page"), F.max("origin").alias("origin")).select("document_id", F.lit("figure").alias("item_kind"), (F.col("origin") + 1).alias("origin"), "page", F.lit(1 << 20).alias("column"), F.lit("ref").alias("image_ref"))
    parsed = layout.parsed_items(raw.unionByName(figures, allowMissingColumns=True))
    return normalize.clean(parsed).select("document_id", "page", "position", "rank", "kind", "text")


# ---- chunks


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^{_S}]+') AS k FROM documents),
w AS (SELECT doc_id, k, unnest(range(0, CAST(greatest(ceil((len(k) - 512) / 448.0), 0) AS BIGINT) + 1)) AS i FROM t WHERE len(k) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS order_index, array_to_string(k[i * 448 + 1:i * 448 + 512], ' ') AS content, len(k[i * 448 + 1:i * 448 + 512]) AS token_count, CASE WHEN i = 0 THEN 0 ELSE 64 END AS overlap_token_count FROM w""")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunk_texts(table(spark, d, "documents"), "doc_id", "text", 512, 64)


@query(f"""WITH b AS (SELECT DISTINCT block_id, document_id, page_number AS g, reading_order_position AS p, text FROM text_blocks),
t AS (SELECT document_id, g, p, unnest(regexp_extract_all(text, '[^{_S}]+')) AS tok, unnest(range(len(regexp_extract_all(text, '[^{_S}]+')))) AS j FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY p, j) - 1 AS s, count(*) OVER (PARTITION BY document_id) AS total FROM t),
e AS (SELECT *, unnest(range(CAST(greatest(floor((s - 256) / 224.0) + 1, 0) AS BIGINT), CAST(least(floor(s / 224.0), greatest(ceil((total - 256) / 224.0), 0)) AS BIGINT) + 1)) AS i FROM n)
SELECT document_id, i AS order_index, string_agg(tok, ' ' ORDER BY s) AS content, CAST(count(*) AS INTEGER) AS token_count, arg_min(g, s) AS page_number FROM e GROUP BY document_id, i""")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d).withColumn("heading_path", F.array().cast("array<string>"))
    return chunk.chunk_elements(e, 256, 32).select("document_id", "order_index", "content", "token_count", "page_number")


@query(f"""SELECT doc_id, array_to_string(regexp_extract_all(text, '[^{_S}]+'), ' ') AS tokens FROM documents WHERE len(regexp_extract_all(text, '[^{_S}]+')) > 0""")
def chunk_completeness(spark: SparkSession, d: str) -> DataFrame:
    """The token stream put together again from the chunks without their overlaps."""
    c = chunk.chunk_texts(table(spark, d, "documents"), "doc_id", "text", 128, 32)
    own = F.struct("order_index", F.array_join(F.slice(F.split("content", " "), F.col("overlap_token_count") + 1, F.greatest(F.col("token_count"), F.lit(1))), " ").alias("t"))
    return c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["t"]), " ").alias("tokens"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS table_id, string_agg(q::INTEGER || ' | ' || f, chr(10) ORDER BY l_linenumber) AS text FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, min(l_returnflag) AS f FROM lineitem GROUP BY ALL) GROUP BY 1""")
def table_text(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"), F.min("l_returnflag").alias("l_returnflag"))
    cell = lambda c, v: F.struct(F.col("l_linenumber").cast("int").alias("row_index"), F.lit(c).alias("col_index"), v.alias("value"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"))
    cells = F.flatten(F.collect_list(F.array(cell(1, F.col("l_returnflag")), cell(0, F.col("l_quantity").cast("int").cast("string")))))
    return li.groupBy(F.col("l_orderkey").cast("string").alias("table_id")).agg(cells.alias("cells")).select("table_id", chunk.table_text(F.col("cells"), F.lit(None)).alias("text"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, min(l_quantity)::INTEGER AS q, min(l_returnflag) AS f FROM lineitem GROUP BY ALL),
t AS (SELECT l_orderkey AS k, flatten(list([CAST(q AS VARCHAR), '|', f] ORDER BY l_linenumber)) AS w FROM l GROUP BY 1),
p AS (SELECT k, w, unnest(range(0, CAST(ceil(len(w) / 8.0) AS BIGINT))) AS i FROM t)
SELECT CAST(k AS VARCHAR) AS document_id, 1 + i AS order_index, array_to_string(w[i * 8 + 1:i * 8 + 8], ' ') AS content, CAST(len(w[i * 8 + 1:i * 8 + 8]) AS INTEGER) AS token_count, true AS is_table_part FROM p
UNION ALL SELECT CAST(k AS VARCHAR), 0, 'items of order ' || k, 4, false FROM t UNION ALL SELECT CAST(k AS VARCHAR), 1 + CAST(ceil(len(w) / 8.0) AS BIGINT), 'end', 1, false FROM t""")
def chunk_tables(spark: SparkSession, d: str) -> DataFrame:
    """A table between two texts; a figure and a blank table change nothing."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("f"))
    cell = lambda c, v: F.struct(F.col("l_linenumber").cast("int").alias("row_index"), F.lit(c).alias("col_index"), v.alias("value"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"))
    tabs = li.groupBy("l_orderkey").agg(F.flatten(F.collect_list(F.array(cell(1, F.col("f")), cell(0, F.col("q").cast("int").cast("string"))))).alias("all"))
    element = lambda at, kind, text=None, cells=None: F.struct(F.lit(at).alias("position"), F.lit(kind).alias("kind"), (text if text is not None else F.lit(None).cast("string")).alias("text"), (cells if cells is not None else F.lit(None).cast(readers.CELLS)).alias("cells"))
    key = F.col("l_orderkey").cast("string")
    e = tabs.select(key.alias("document_id"), F.explode(F.array(element(0, "text", F.concat(F.lit("items of  order "), key)), element(1, "figure"), element(2, "table", cells=F.col("all")), element(3, "table"), element(4, "text", F.lit("end")))).alias("e")).select("document_id", "e.*")
    e = e.withColumns({"rank": F.lit(0), "page": F.lit(1), "heading_path": F.array().cast("array<string>")})
    return chunk.chunk_elements(e, 8, 2).select("document_id", "order_index", "content", "token_count", "is_table_part")


# ---- embeddings and retrieval

_HASH = "list_transform(range(0, {n}), lambda i: CAST(CAST('0x' || substring(sha256('{m}' || chr(31) || {t} || chr(31) || i), 1, 8) AS BIGINT) AS DOUBLE) / 2147483648.0 - 1.0)"


@query(f"SELECT item_id, {_HASH.format(n=8, m='hash', t='text')} AS embedding FROM eval_items")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", embed.hash_embedding(F.col("text"), "hash", 8).alias("embedding"))


@query("SELECT (SELECT count(*) FROM eval_items) AS ok, 0 AS failed, 8 AS least_size, 8 AS most_size")
def seeded_embedding(spark: SparkSession, d: str) -> DataFrame:
    """The seeded model through the port, with its policy."""
    c = table(spark, d, "eval_items").select(F.col("item_id").cast("string").alias("document_id"), F.col("text").alias("content"))
    e = embed.embed(c, lambda ts: [embed.seeded_vector(t, "seeded", 8) for t in ts], 8)
    n = lambda s: F.sum((F.col("status") == s).cast("bigint"))
    return e.agg(n("ok").alias("ok"), n("failed").cast("int").alias("failed"), F.min(F.size("embedding")).alias("least_size"), F.max(F.size("embedding")).alias("most_size"))


_PORT = """CASE WHEN length(text) % 5 = 0 THEN 'error: refused' WHEN length(text) % 7 = 0 THEN 'wrong_dimension' END"""


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    def port(texts: list[str]) -> list[list[float]]:
        if any(len(t) % 5 == 0 for t in texts):
            raise ValueError("refused")
        return [[0.5] * (3 if len(t) % 7 == 0 else 4) for t in texts]

    return embed.embed(table(spark, d, "eval_items").select("item_id", F.col("suite").alias("document_id"), F.col("text").alias("content")), port, 4)


@query(f"SELECT item_id, CASE WHEN cause IS NULL THEN 'ok' ELSE 'failed' END AS status, CASE WHEN cause IS NULL THEN 1 ELSE 4 END AS attempts, cause, CASE WHEN cause IS NULL THEN 4 ELSE 0 END AS size FROM (SELECT item_id, {_PORT} AS cause FROM eval_items)")
def embedding_policy(spark: SparkSession, d: str) -> DataFrame:
    """Texts that a port refuses, or embeds in a wrong length, fail after all attempts; the others of their batch do not."""
    return _embedded(spark, d).select("item_id", "status", "attempts", "cause", F.size("embedding").alias("size"))


@query(f"SELECT DISTINCT suite AS document_id FROM eval_items WHERE {_PORT} IS NOT NULL")
def failed_documents(spark: SparkSession, d: str) -> DataFrame:
    return embed.failed_documents(_embedded(spark, d))


@query("SELECT item_id, 'failed' AS status, 0 AS attempts, 'model_unrecognized' AS cause FROM eval_items")
def embedding_rejected(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "eval_items").select("item_id", F.col("text").alias("content"))
    return embed.embed_rejected(c, embed.rejection("of another name", 8)).select("item_id", "status", "attempts", "cause")


def _store(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("document_id"), F.col("vec_id").alias("order_index"), "embedding", F.lit(None).cast("int").alias("page_number"), F.array().cast("array<string>").alias("heading_path"))


_COS = "(greatest(-1, least(1, list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))) + 1) / 2"
_VEC = "CAST(embedding AS DOUBLE[])"


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]


@query(f"""WITH q AS (SELECT {_VEC} AS v FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT CAST(vec_id AS VARCHAR) AS chunk_id, round({_COS.format(a=_VEC, b='q.v')}, 6) AS similarity FROM embeddings, q ORDER BY {_COS.format(a=_VEC, b='q.v')} DESC, CAST(label AS VARCHAR), vec_id LIMIT 10""")
def cosine_top_k(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.top_k(_store(spark, d), _first_vector(spark, d), 10).select("chunk_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH q AS (SELECT {_VEC} AS v FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT CAST(vec_id AS VARCHAR) AS chunk_id, round({_COS.format(a=_VEC, b='q.v')}, 6) AS similarity FROM embeddings, q WHERE label = 3 ORDER BY {_COS.format(a=_VEC, b='q.v')} DESC, vec_id LIMIT 10""")
def cosine_top_k_filtered(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.top_k(_store(spark, d), _first_vector(spark, d), 10, {"documentId": "3", "pageNumber": None}).select("chunk_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT CAST(vec_id AS VARCHAR) AS chunk_id FROM embeddings WHERE false")
def unknown_filter_empty(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.top_k(_store(spark, d), _first_vector(spark, d), 10, {"author": "x"}).select("chunk_id")


@query(f"""WITH q AS (SELECT vec_id AS query_id, {_VEC} AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, e.vec_id, CAST(label AS VARCHAR) AS l, {_COS.format(a='CAST(e.embedding AS DOUBLE[])', b='q.v')} AS s FROM embeddings e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, l, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(vec_id AS VARCHAR) AS chunk_id, round(s, 6) AS similarity FROM r WHERE rank <= 5""")
def batch_top_k(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieve.batch_top_k(_store(spark, d), q, 5).select("query_id", "rank", "chunk_id", F.round("similarity", 6).alias("similarity"))


_STATUS = "CASE WHEN trim(text) = '' OR length(text) > 400 THEN 'invalid_query' WHEN item_id % 120 > 100 OR item_id % 120 = 0 THEN 'topk_out_of_range' {0} END"


@query(f"""SELECT item_id AS query_id, 'filled' AS of, {_STATUS.format("WHEN item_id % 13 < 10 THEN 'ok' ELSE 'no_match'")} AS status FROM eval_items UNION ALL SELECT item_id, 'empty', {_STATUS.format("ELSE 'library_empty'")} FROM eval_items""")
def retrieval_status(spark: SparkSession, d: str) -> DataFrame:
    """All five statuses: hits are those of a search in the label that a query asks for, of which there are ten."""
    q = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), retrieve.validate(F.col("text"), F.pmod("item_id", F.lit(120)), 400).alias("error"))
    full = _store(spark, d)
    labels = full.select(F.col("document_id").alias("label")).distinct()
    hits = q.where("error IS NULL").withColumn("label", F.pmod("query_id", F.lit(13)).cast("string")).join(labels, "label")
    return retrieve.result_status(q, hits, full).withColumn("of", F.lit("filled")).unionByName(retrieve.result_status(q, hits.limit(0), full.limit(0)).withColumn("of", F.lit("empty")))


@query("SELECT probe_id, record_id, round(similarity, 9) AS similarity FROM (SELECT DISTINCT probe_id, record_id, similarity FROM scored_records) WHERE similarity IS NOT NULL")
def distance_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarities by way of the cosine distance that a database gives."""
    s = table(spark, d, "scored_records").where("similarity IS NOT NULL").select("probe_id", "record_id", "similarity").distinct()
    return s.select("probe_id", "record_id", F.round(retrieve.distance_similarity(2 - 2 * F.col("similarity")), 9).alias("similarity"))


@query("SELECT record_id, coalesce(CAST(page_number AS VARCHAR), 'UNKNOWN_PAGE') AS page_number, document_id FROM (SELECT DISTINCT record_id, page_number, document_id FROM vector_records)")
def placeholder_fill(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.placeholders(table(spark, d, "vector_records").select("record_id", "page_number", "document_id").distinct())


# ---- store


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vector_records").select("chunk_id", "document_id", "token_count", F.col("record_id").alias("seq"))


@query("SELECT chunk_id, arg_max(token_count, record_id) AS token_count FROM vector_records GROUP BY chunk_id")
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return store.last_of_each(_records(spark, d).distinct(), "seq").select("chunk_id", "token_count")


def _snapshots(spark: SparkSession, d: str) -> store.SnapshotStore:
    """A new store under the shared folder with all records in it."""
    import uuid

    from foliomill.session import shared_dir

    s = store.SnapshotStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", buckets=8)
    names = [c.split(" ")[0] for c in store.RECORD.split(", ")]
    s.upsert(table(spark, d, "vector_records").withColumn("embedding", F.col("embedding").cast("array<double>")).select(*names, F.col("record_id").alias("seq")))
    return s


_KEPT = "r AS (SELECT chunk_id, arg_max(token_count, record_id) AS token_count, arg_max(document_id, record_id) AS document_id, arg_max(status, record_id) AS status, arg_max(order_index, record_id) AS order_index FROM vector_records GROUP BY chunk_id), f AS (SELECT min(document_id) AS document_id FROM r)"


@query(f"WITH {_KEPT} SELECT chunk_id, document_id, CASE WHEN status = 'failed' THEN 0 ELSE token_count END AS token_count FROM r")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Failed records, tried again with 0 tokens, put into the store."""
    s = _snapshots(spark, d)
    s.upsert(s.read().where("status = 'failed'").withColumn("token_count", F.lit(0)))
    return s.read().select("chunk_id", "document_id", "token_count")


@query(f"WITH {_KEPT} SELECT chunk_id, document_id, CASE WHEN document_id = (SELECT document_id FROM f) THEN -1 ELSE token_count END AS token_count FROM r WHERE document_id <> (SELECT document_id FROM f) OR order_index % 2 = 0")
def replace_document(spark: SparkSession, d: str) -> DataFrame:
    """The first document comes again with every other chunk."""
    s = _snapshots(spark, d)
    first = s.read().agg(F.min("document_id")).first()[0]
    s.replace_document(first, s.get_document(first).where("order_index % 2 = 0").withColumn("token_count", F.lit(-1)))
    return s.read().select("chunk_id", "document_id", "token_count")


@query(f"WITH {_KEPT} SELECT document_id, count(*) AS chunks, false AS gone FROM r WHERE document_id <> (SELECT document_id FROM f) GROUP BY document_id UNION ALL SELECT document_id, count(*), true FROM r WHERE document_id = (SELECT document_id FROM f) GROUP BY document_id")
def delete_document(spark: SparkSession, d: str) -> DataFrame:
    s = _snapshots(spark, d)
    first = s.read().agg(F.min("document_id")).first()[0]
    gone = s.delete_document(first).agg(F.count("*").alias("chunks")).select(F.lit(first).alias("document_id"), "chunks", F.lit(True).alias("gone"))
    return s.read().groupBy("document_id").agg(F.count("*").alias("chunks")).withColumn("gone", F.lit(False)).unionByName(gone)


@query(f"WITH {_KEPT} SELECT r.chunk_id, r.order_index FROM r, f WHERE r.document_id = f.document_id")
def get_document(spark: SparkSession, d: str) -> DataFrame:
    s = _snapshots(spark, d)
    return s.get_document(s.read().agg(F.min("document_id")).first()[0]).select("chunk_id", "order_index")


@query("SELECT record_id, heading_path FROM (SELECT DISTINCT record_id, coalesce(heading_path, []) AS heading_path FROM vector_records)")
def heading_path_codec(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "vector_records").select("record_id", "heading_path").distinct()
    return r.select("record_id", store.heading_path_from_text(store.heading_path_text(F.col("heading_path"))).alias("heading_path"))


@query("SELECT document_id, coalesce(min(title) FILTER (WHERE book_id % 2 = 1), min(title)) AS title FROM books WHERE document_id IS NOT NULL AND title IS NOT NULL GROUP BY document_id")
def book_registry(spark: SparkSession, d: str) -> DataFrame:
    """Titles written to a registry, then those of odd ids over them."""
    import uuid

    from foliomill.session import shared_dir

    path = f"{shared_dir(spark)}/books-{uuid.uuid4().hex}"
    b = table(spark, d, "books").where("document_id IS NOT NULL AND title IS NOT NULL")
    titles = lambda x: x.groupBy("document_id").agg(F.min("title").alias("title"))
    store.write_books(titles(b), path)
    store.write_books(store.merge_books(store.read_books(spark, path).select("document_id", "title"), titles(b.where("book_id % 2 = 1"))), path)
    return store.read_books(spark, path).select("document_id", "title")


@query("SELECT vec_id, true AS same FROM embeddings")
def vector_codec(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", (store.vector_from_text(store.vector_text(v)) == v).alias("same"))


# ---- jobs

# Events as the log of a job for each user: their types stand for stages and their values for statuses.
_LOG = """log AS (SELECT CAST(user_id AS VARCHAR) AS job_id, CASE event_type WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'normalization' WHEN 'signup' THEN 'chunking' WHEN 'purchase' THEN 'embedding' ELSE 'storage' END AS stage,
 CASE WHEN value < 20 THEN 'running' WHEN value < 40 THEN 'failed' ELSE 'succeeded' END AS status, event_id AS seq FROM events),
st AS (SELECT j.job_id, s.stage, coalesce(l.status, 'pending') AS status, coalesce(l.attempts, 0) AS attempts, s.n FROM (SELECT DISTINCT job_id FROM log) j
 CROSS JOIN (VALUES ('parsing', 1), ('normalization', 2), ('chunking', 3), ('embedding', 4), ('storage', 5)) s(stage, n)
 LEFT JOIN (SELECT job_id, stage, arg_max(status, seq) AS status, count(*) FILTER (WHERE status = 'running') AS attempts FROM log GROUP BY ALL) l ON l.job_id = j.job_id AND l.stage = s.stage)"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    stage = F.when(F.col("event_type") == "view", "parsing").when(F.col("event_type") == "click", "normalization").when(F.col("event_type") == "signup", "chunking").when(F.col("event_type") == "purchase", "embedding").otherwise("storage")
    return e.select(F.col("user_id").cast("string").alias("job_id"), stage.alias("stage"), F.when(F.col("value") < 20, "running").when(F.col("value") < 40, "failed").otherwise("succeeded").alias("status"), F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("reason"))


def _states(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return pipeline.stage_states(log.select("job_id").distinct(), log)


@query(f"WITH {_LOG} SELECT job_id, stage, status, attempts FROM st")
def stage_states(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).select("job_id", "stage", "status", "attempts")


@query(f"WITH {_LOG} SELECT job_id, CAST(count(*) FILTER (WHERE status = 'succeeded') * 100 // 5 AS INTEGER) AS progress_percent FROM st GROUP BY job_id")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.progress(_states(spark, d))


@query(f"""WITH {_LOG} SELECT job_id, CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (WHERE status = 'succeeded') = 5 THEN 'completed' WHEN count(*) FILTER (WHERE status = 'pending') = 5 THEN 'queued' ELSE 'processing' END AS overall_status,
 arg_min(stage, n) FILTER (WHERE status = 'failed') AS failing_stage FROM st GROUP BY job_id""")
def job_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.outcomes(_states(spark, d))


@query("SELECT DISTINCT document_id, chunk_id FROM vector_records WHERE chunk_id NOT IN (SELECT chunk_id FROM vector_records WHERE status = 'ok')")
def unstored_chunks(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "vector_records")
    return pipeline.unstored(r, r.where("status = 'ok'")).distinct()


# ---- answers


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the earlier search, with their records and books."""
    s = table(spark, d, "scored_records").where("similarity IS NOT NULL").groupBy("probe_id", "record_id").agg(F.min("hit_rank").alias("rank"), F.max("similarity").alias("similarity"))
    r = table(spark, d, "vector_records").select("record_id", "document_id", "content", "page_number", "heading_path").distinct()
    b = table(spark, d, "books").where("document_id IS NOT NULL").groupBy("document_id").agg(F.min_by("title", "book_id").alias("title"), F.min_by("author", "book_id").alias("author"))
    h = s.join(r, "record_id").select(F.col("probe_id").alias("query_id"), "record_id", "rank", "similarity", "document_id", "content", "page_number", "heading_path")
    return retrieve.placeholders(answer.with_books(h, b))


_HITS = """h AS (SELECT s.probe_id AS query_id, s.record_id, s.rank, s.similarity, r.content, coalesce(CAST(r.page_number AS VARCHAR), 'UNKNOWN_PAGE') AS page_number, array_to_string(r.heading_path, ' > ') AS section,
 coalesce(nullif(b.title, ''), 'Unknown source') AS book, coalesce(b.author, '') AS author
FROM (SELECT probe_id, record_id, min(hit_rank) AS rank, max(similarity) AS similarity FROM scored_records WHERE similarity IS NOT NULL GROUP BY ALL) s
JOIN (SELECT DISTINCT record_id, document_id, content, page_number, heading_path FROM vector_records) r USING (record_id)
LEFT JOIN (SELECT document_id, m.t AS title, m.a AS author FROM (SELECT document_id, min(struct_pack(k := book_id, t := title, a := author)) AS m FROM books WHERE document_id IS NOT NULL GROUP BY document_id)) b USING (document_id))"""


@query(f"WITH {_HITS} SELECT query_id, record_id, concat_ws(', ', book, nullif(author, ''), 'section: ' || nullif(section, ''), 'p.' || page_number) AS label FROM h")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("query_id", "record_id", answer.source_label().alias("label"))


@query(f"""WITH {_HITS}, g AS (SELECT query_id, book, author, min(rank) AS f, list(DISTINCT page_number) AS p FROM h GROUP BY ALL)
SELECT query_id, book, author, list_transform(list_sort(list_transform(p, lambda x: struct_pack(o := try_cast(x AS BIGINT) IS NULL, n := try_cast(x AS BIGINT), s := x))), lambda y: y.s) AS pages FROM g""")
def source_groups(spark: SparkSession, d: str) -> DataFrame:
    return answer.sources(_hits(spark, d)).select("query_id", "book", "author", "pages")


@query(f"""WITH {_HITS}, f AS (SELECT *, replace({_STRIP('content')}, chr(10), ' ') AS t FROM h)
SELECT query_id, 'No language model is at hand; these are the passages that fit best:' || chr(10) || chr(10) || string_agg('[' || rank || '] (' || concat_ws(', ', book, nullif(author, ''), 'section: ' || nullif(section, ''), 'p.' || page_number) || ', score ' || printf('%.2f', similarity) || ')' || chr(10) || CASE WHEN length(t) > 500 THEN left(t, 500) || '...' ELSE t END, chr(10) || chr(10) ORDER BY rank) AS answer FROM f GROUP BY query_id""")
def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d)
    return answer.extracts(h, h.select("query_id").distinct())


@query("""SELECT book_id, concat_ws(' - ', coalesce(nullif(title, ''), nullif(source_filename, ''), 'Unknown title'), nullif(author, '')) AS label, regexp_replace(source_filename, '\\.[^.]*$', '') AS stem FROM (SELECT DISTINCT * FROM books)""")
def book_labels(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "books").distinct()
    return b.select("book_id", answer.book_display(F.col("title"), F.col("author"), F.col("source_filename")).alias("label"), readers.book_title(F.col("source_filename")).alias("stem"))


@query("SELECT DISTINCT document_id FROM jobs WHERE document_id NOT IN (SELECT document_id FROM vector_records)")
def skip_ingested(spark: SparkSession, d: str) -> DataFrame:
    return answer.not_stored(table(spark, d, "jobs").select("document_id").distinct(), table(spark, d, "vector_records"))


@query(f"""WITH {_HITS}, f AS (SELECT *, replace({_STRIP('content')}, chr(10), ' ') AS t FROM h)
SELECT query_id, 'Use them.' || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg('[' || rank || '] (Source: ' || concat_ws(', ', book, nullif(author, ''), 'section: ' || nullif(section, ''), 'p.' || page_number) || ')' || chr(10) || t, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: what?' || chr(10) || chr(10) || 'Answer:' AS prompt FROM f GROUP BY query_id""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d)
    return answer.prompts(h, h.select("query_id").distinct().withColumn("text", F.lit("what?")), "Use them.")


@query("""SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 5 ELSE item_id % 4 END AS k, CASE item_id % 5 WHEN 0 THEN 'No documents have been ingested yet. Upload a PDF first.' WHEN 1 THEN 'No matching passages were found for that query/filter.' WHEN 2 THEN 'The query was empty or too long.'
 WHEN 3 THEN 'The requested number of results is out of range (1-100).' ELSE 'No results.' END AS message FROM eval_items""")
def messages(spark: SparkSession, d: str) -> DataFrame:
    """What is said for each status, and the number of results that is asked for."""
    status = F.element_at(F.array(*map(F.lit, [retrieve.EMPTY, retrieve.NO_MATCH, retrieve.INVALID, retrieve.OUT_OF_RANGE, retrieve.OK])), (F.col("item_id") % 5 + 1).cast("int"))
    return table(spark, d, "eval_items").select("item_id", answer.effective_top_k(F.col("item_id") % 4, 5).alias("k"), answer.status_message(status).alias("message"))


# ---- all together


@query(f"""WITH t AS (SELECT doc_id, '<html>' || text || '</html>' AS t FROM documents WHERE text IS NOT NULL AND NOT contains(text, '%PDF')),
k AS (SELECT DISTINCT sha256(encode(t)) AS document_id, regexp_extract_all(t, '[^{_S}]+') AS w FROM t)
SELECT document_id, CAST(greatest(ceil((len(w) - 128) / 112.0), 0) AS BIGINT) + 1 AS chunks, CAST(len(w) + 16 * CAST(greatest(ceil((len(w) - 128) / 112.0), 0) AS BIGINT) AS BIGINT) AS tokens FROM k""")
def pipeline_run(spark: SparkSession, d: str) -> DataFrame:
    """All five stages over all documents as HTML files: the chunks that stand in the store."""
    import uuid

    from foliomill.config import PipelineConfig
    from foliomill.session import shared_dir

    p = pipeline.Pipeline(spark, f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", PipelineConfig(embedding_dimension=64, max_chunk_tokens=128, chunk_overlap_tokens=16))
    docs = table(spark, d, "documents").where("text IS NOT NULL AND NOT contains(text, '%PDF')")
    p.submit(docs.select(F.col("doc_id").alias("submission_id"), F.lit("a.html").alias("filename"), F.concat(F.lit("<html>"), F.col("text"), F.lit("</html>")).cast("binary").alias("content")))
    p.process()
    return p.store.read().groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))



@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^{_S}]+') AS k FROM documents),
w AS (SELECT doc_id, k, unnest(range(0, CAST(greatest(ceil((len(k) - 128) / 96.0), 0) AS BIGINT) + 1)) AS i FROM t WHERE len(k) > 0),
c AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, i AS order_index, array_to_string(k[i * 96 + 1:i * 96 + 128], ' ') AS content FROM w),
e AS (SELECT *, {_HASH.format(n=16, m='hash', t='content')} AS v FROM c), q AS (SELECT {_HASH.format(n=16, m='hash', t="'recovery after treatment'")} AS v)
SELECT document_id, order_index, round({_COS.format(a='e.v', b='q.v')}, 6) AS similarity FROM e, q ORDER BY {_COS.format(a='e.v', b='q.v')} DESC, document_id, order_index LIMIT 5""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, embeds and searches all documents for one question."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    c = chunk.chunk_texts(docs, "document_id", "text", 128, 32).withColumns({"order_index": F.col("order_index").cast("bigint"), "chunk_id": chunk.chunk_id("document_id", "order_index", "content")})
    stored = embed.embed_hashed(c, "hash", 16)
    v = [float(x) for x in spark.range(1).select(embed.hash_embedding(F.lit("recovery after treatment"), "hash", 16)).first()[0]]
    return retrieve.top_k(stored, v, 5).select("document_id", "order_index", F.round("similarity", 6).alias("similarity"))
