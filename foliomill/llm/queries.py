"""The queries of the training-data operators: each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliomill.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.llm import splitting

    over = splitting.oversized(table(spark, d, "text_blocks"), table(spark, d, "jobs"), table(spark, d, "pipeline_configs"))
    pieces = splitting.split_oversized(over, "text", "max_chunk_tokens", "chunk_overlap_tokens")
    return pieces.where("piece_no = 1").select("block_id")


@query
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.llm import splitting

    over = splitting.oversized(table(spark, d, "text_blocks"), table(spark, d, "jobs"), table(spark, d, "pipeline_configs"))
    return splitting.split_oversized(over, "text", "max_chunk_tokens", "chunk_overlap_tokens")


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.llm import repeated_lines

    return repeated_lines.lines_to_remove(table(spark, d, "text_blocks"), "document_id", "page_number", "block_id", "text").select(F.col("block").alias("block_id"), "line_no")


@query
def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.llm import repeated_lines

    return repeated_lines.remove_repeated(table(spark, d, "text_blocks"), "document_id", "page_number", "block_id", "text").select(F.col("block").alias("block_id"), "text", "removed")


_SPACE_RE2 = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ORACLE_SQL["p3_found"] = f"""
SELECT b.block_id
FROM (SELECT DISTINCT block_id, document_id, text FROM text_blocks) b
JOIN (SELECT document_id, min(config_id) AS config_id FROM jobs GROUP BY document_id) j USING (document_id)
JOIN pipeline_configs c USING (config_id)
WHERE len(regexp_extract_all(b.text, '[^{_SPACE_RE2}]+')) > c.max_chunk_tokens"""
_REPEATED = r"""lines AS (
  SELECT block_id, document_id, page_number, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no
  FROM (SELECT DISTINCT block_id, document_id, page_number, text FROM text_blocks)),
keyed AS (SELECT *, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS k FROM lines),
often AS (SELECT document_id, k FROM keyed WHERE length(k) >= 10 GROUP BY document_id, k HAVING count(DISTINCT page_number) >= 4)"""
ORACLE_SQL["p4_found"] = f"WITH {_REPEATED} SELECT block_id, line_no FROM keyed JOIN often USING (document_id, k)"
ORACLE_SQL["p4_clean"] = f"""
WITH {_REPEATED}, gone AS (SELECT block_id, line_no FROM keyed JOIN often USING (document_id, k))
SELECT b.block_id, CASE WHEN b.text IS NOT NULL THEN coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE g.line_no IS NULL), '') END AS text, CAST(count(g.line_no) AS INTEGER) AS removed
FROM (SELECT DISTINCT block_id, text FROM text_blocks) b LEFT JOIN lines l ON l.block_id = b.block_id LEFT JOIN gone g ON g.block_id = l.block_id AND g.line_no = l.line_no GROUP BY b.block_id, b.text"""


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.llm import bpe

    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text", vocabulary(spark))


@query
def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts that do not come back from their ids: none."""
    from foliomill.llm import bpe

    docs = table(spark, d, "documents").select("doc_id", "text")
    back = bpe.decode_ids(bpe.encode_texts(docs, "doc_id", "text", vocabulary(spark)), "doc_id", "ids", vocabulary(spark))
    return docs.join(back.withColumnRenamed("text", "back"), "doc_id").where(F.coalesce("text", F.lit("")) != F.col("back")).select("doc_id")


def vocabulary(spark: SparkSession) -> str:
    """The place of the vocabulary file, by the setting ``spark.foliomill.vocabulary``."""
    return spark.conf.get("spark.foliomill.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@query
def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.llm import leakage

    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.llm import leakage

    return p9_leaks(spark, d).where(F.col("longest_run") >= leakage.MIN_RUN).select("doc_id", "item_id")


ORACLE_SQL["p8_round_trip"] = "SELECT doc_id FROM documents WHERE false"
ORACLE_SQL["p9_found"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda p: array_to_string(w[p:p + 12], ' '))) AS g FROM d WHERE len(w) >= 13),
ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 11), lambda p: array_to_string(w[p:p + 12], ' '))) AS g FROM i WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""


def _usable_vectors(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.llm import vectors

    return vectors.usable(table(spark, d, "vector_records"), table(spark, d, "jobs"), table(spark, d, "pipeline_configs"))


@query
def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.llm import vectors

    return vectors.top_neighbours(_usable_vectors(spark, d))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.llm import vectors

    return vectors.neighbour_pairs(p2_neighbours(spark, d))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.llm import neardup

    links, members = neardup.near_duplicate_classes(table(spark, d, "text_blocks"), "block_id", "text")
    return neardup.pairs(links, members, "block_id").select(F.col("a").alias("block_a"), F.col("b").alias("block_b"))


@query
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """block_id, group_id, links: one row for each block that has copies; links are those of its class of equal sets."""
    from foliomill.llm import graph, neardup

    links, members = neardup.near_duplicate_classes(table(spark, d, "text_blocks"), "block_id", "text")
    of = graph.components(links).withColumnsRenamed({"node": "h", "component": "c"})
    degree = links.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count("*").alias("links"))
    copies = members.groupBy("h").agg(F.count("*").alias("n"), F.min("block_id").alias("least"))
    classes = copies.join(of, "h", "left").join(degree, "h", "left").where("n > 1 OR c IS NOT NULL").withColumn("c", F.coalesce("c", "h"))
    named = classes.join(classes.groupBy("c").agg(F.min("least").alias("group_id")), "c")
    return members.join(named, "h").select("block_id", "group_id", (F.coalesce("links", F.lit(0))).alias("links"))


ORACLE_SQL["p5_found"] = r"""
WITH b AS (SELECT block_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT block_id, text FROM text_blocks)),
g AS (SELECT DISTINCT block_id, unnest(list_transform(range(1, len(w) - 1), lambda p: hash(w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]))) AS g FROM b WHERE len(w) >= 40),
n AS (SELECT block_id, count(*) AS n FROM g GROUP BY block_id),
c AS (SELECT x.block_id AS block_a, y.block_id AS block_b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.block_id < y.block_id GROUP BY ALL)
SELECT block_a, block_b FROM c JOIN n p ON p.block_id = block_a JOIN n q ON q.block_id = block_b WHERE 3 * c >= p.n + q.n"""


def _forms(spark: SparkSession, d: str) -> list[tuple[str, str, DataFrame]]:
    from foliomill.llm import lookalike

    blocks, raw = table(spark, d, "text_blocks"), table(spark, d, "raw_blocks")
    to = lookalike.representatives(lookalike.character_counts(blocks.select("text").unionByName(raw.select("text"))))
    return [("TextBlock.text", "block_id", lookalike.one_form(blocks, "block_id", "text", to)), ("RawBlock.text", "raw_id", lookalike.one_form(raw, "raw_id", "text", to))]


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.llm import lookalike

    a, b = (lookalike.look_alike_pairs(f, key).select(F.lit(field).alias("field"), F.col("a").alias("id_a"), F.col("b").alias("id_b")) for field, key, f in _forms(spark, d))
    return a.unionByName(b)


@query
def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    a, b = (f.select(F.lit(field).alias("field"), F.col(key).alias("id"), "form") for field, key, f in _forms(spark, d))
    return a.unionByName(b)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.llm import names

    entities = names.link_all(table(spark, d, "books"), "book_id", {"author": "author", "title": "title"})
    return names.linked_pairs(entities, "book_id").select("field", F.col("a").alias("book_a"), F.col("b").alias("book_b"))


@query
def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.llm import names

    return names.link_all(table(spark, d, "books"), "book_id", {"author": "author", "title": "title"}).select("field", "book_id", "entity")


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.llm import truncation

    return truncation.find_truncated(table(spark, d, "documents"), "doc_id", "source", "text")


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncated(spark, d).where("cut").select("doc_id")


@query
def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.llm import truncation

    return truncation.share_by_source(_truncated(spark, d))


@query
def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    from foliomill.llm import ocr_repair

    return ocr_repair.repair_scanned(table(spark, d, "text_blocks"), table(spark, d, "raw_blocks"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_repaired(spark, d).select("block_id", F.explode("kinds").alias("kind"))
