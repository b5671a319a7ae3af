"""Token windows over documents, and tables as chunks of their own.

Tokens are never gathered for a whole document: a running sum gives each element its place in its segment's token stream,
each element is cut into the parts that the windows over it need, and a window is put together from its parts, of which
there are no more than it has tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliomill.text import is_blank, tokens


class ChunkingError(ValueError):
    pass


def check_bounds(most: int, overlap: int) -> None:
    if most < 1 or not 0 <= overlap < most:
        raise ChunkingError(f"windows of {most} tokens with an overlap of {overlap}")


def table_text(cells: Column, raw_text: Column) -> Column:
    """Rows of cells joined by bars; the raw text if there are no cells, else empty."""
    ordered = F.array_sort(F.transform(cells, lambda c: F.struct(c["row_index"].alias("r"), c["col_index"].alias("c"), c["value"].alias("v"))))
    rows = F.array_distinct(F.transform(ordered, lambda c: c["r"]))
    joined = F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(F.filter(ordered, lambda c: c["r"] == r), lambda c: c["v"]), " | ")), "\n")
    return F.when(F.coalesce(F.size(cells), F.lit(0)) > 0, joined).otherwise(F.coalesce(raw_text, F.lit("")))


def last_window(n: Column, most: int, step: int) -> Column:
    return F.greatest(F.ceil((n - most) / step), F.lit(0)).cast("bigint")


def chunk_elements(elements: DataFrame, most: int, overlap: int) -> DataFrame:
    """document_id, order_index, content, token_count, overlap_token_count, page_number, heading_path, is_table_part, chunk_id.

    elements: document_id, position, rank, kind, text, page, heading_path and, of tables, cells and raw_text.  A table that is
    not blank ends the run of text before it; figures and blank tables do not.  A table above the limit is cut into parts
    that do not overlap.  Page and path are those of a window's first token.  Documents without tokens have no chunk.
    """
    check_bounds(most, overlap)
    for name, kind in (("cells", "array<struct<row_index:int,col_index:int,value:string,row_span:int,col_span:int>>"), ("raw_text", "string")):
        if name not in elements.columns:
            elements = elements.withColumn(name, F.lit(None).cast(kind))
    df = elements.where("kind != 'figure'").withColumn("text", F.when(F.col("kind") == "table", table_text(F.col("cells"), F.col("raw_text"))).otherwise(F.col("text")))
    df = df.where(~is_blank(F.col("text"))).withColumn("is_table", F.col("kind") == "table")
    df = df.select("document_id", "position", "rank", "is_table", "page", "heading_path", tokens(F.col("text")).alias("toks"))
    order = Window.partitionBy("document_id").orderBy("position", "rank")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    # runs of text lie between tables; a table is a segment alone
    seg = 2 * F.coalesce(F.sum(F.col("is_table").cast("int")).over(so_far), F.lit(0)) - F.col("is_table").cast("int")
    df = df.withColumn("segment", seg).withColumn("n", F.size("toks"))
    inside = Window.partitionBy("document_id", "segment")
    start = F.coalesce(F.sum("n").over(inside.orderBy("position", "rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumns({"s": start, "total": F.sum("n").over(inside)})
    lap = F.when(F.col("is_table"), 0).otherwise(overlap)
    step = most - lap
    first = F.greatest(F.floor((F.col("s") - most) / step) + 1, F.lit(0)).cast("bigint")
    last = F.least(F.floor((F.col("s") + F.col("n") - 1) / step).cast("bigint"), F.greatest(F.ceil((F.col("total") - most) / step), F.lit(0)).cast("bigint"))
    part = df.withColumn("step", step).select("*", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias("i"))
    begin = F.greatest(F.col("i") * F.col("step") - F.col("s"), F.lit(0)).cast("int")
    end = F.least(F.col("i") * F.col("step") + most - F.col("s"), F.col("n").cast("bigint")).cast("int")
    part = part.select("document_id", "segment", "i", "is_table", F.struct("s", F.slice("toks", begin + 1, end - begin).alias("t"), "page", "heading_path").alias("p"))
    whole = part.groupBy("document_id", "segment", "i", "is_table").agg(F.array_sort(F.collect_list("p"), lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(0)).alias("ps"))
    toks = F.flatten(F.transform("ps", lambda p: p["t"]))
    chunks = whole.select("document_id", "segment", "i", "is_table", F.array_join(toks, " ").alias("content"), F.size(toks).alias("token_count"), F.get("ps", F.lit(0))["page"].alias("page_number"), F.get("ps", F.lit(0))["heading_path"].alias("heading_path"))
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("segment", "i")) - 1
    chunks = chunks.withColumn("order_index", index.cast("bigint"))
    return chunks.select("document_id", "order_index", "content", "token_count", F.when((F.col("i") == 0) | F.col("is_table"), 0).otherwise(overlap).alias("overlap_token_count"), "page_number", "heading_path", F.col("is_table").alias("is_table_part"), chunk_id("document_id", "order_index", "content").alias("chunk_id"))


def chunk_id(document_id: str, order_index: str, content: str) -> Column:
    """An id that a task run again gives again."""
    return F.sha2(F.concat_ws("\x1f", document_id, F.col(order_index).cast("string"), content), 256)


def chunk_texts(df: DataFrame, key: str, text: str, most: int, overlap: int) -> DataFrame:
    """key, order_index, content, token_count, overlap_token_count: windows over the tokens of each row's text; no shuffle."""
    check_bounds(most, overlap)
    step = most - overlap
    t = df.select(F.col(key), tokens(F.col(text)).alias("toks")).where(F.size("toks") > 0)
    t = t.select(key, "toks", F.explode(F.sequence(F.lit(0), last_window(F.size("toks"), most, step).cast("int"))).alias("order_index"))
    cut = F.slice("toks", F.col("order_index") * step + 1, most)
    return t.select(key, "order_index", F.array_join(cut, " ").alias("content"), F.size(cut).alias("token_count"), F.when(F.col("order_index") == 0, 0).otherwise(overlap).alias("overlap_token_count"))


