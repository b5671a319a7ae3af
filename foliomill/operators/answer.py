"""From hits to answers: books, sources, labels, prompts and extracts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# What a status says.
MESSAGES = {"library_empty": "No documents have been ingested yet. Upload a PDF first.", "no_match": "No matching passages were found for that query/filter.", "invalid_query": "The query was empty or too long.", "topk_out_of_range": "The requested number of results is out of range (1-100)."}
OPENING = "No language model is at hand; these are the passages that fit best:"
NO_PASSAGES, NO_RESULTS, UNKNOWN_SOURCE = "No relevant passages were found in the library.", "No results.", "Unknown source"
SNIPPET = 500


def status_message(status: Column) -> Column:
    out = F.lit(NO_RESULTS)
    for k, v in MESSAGES.items():
        out = F.when(status == k, v).otherwise(out)
    return out


def effective_top_k(top_k: Column, default: int) -> Column:
    """0 and null mean the default."""
    return F.coalesce(F.nullif(top_k, F.lit(0)), F.lit(default))


def _given(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def with_books(hits: DataFrame, books: DataFrame) -> DataFrame:
    """Adds book, author, section to hits; `books` has one row for each document (document_id, title, author)."""
    b = books.select("document_id", F.col("title").alias("__title"), F.col("author").alias("__author"))
    return hits.join(b, "document_id", "left").withColumns({"book": F.coalesce(_given("__title"), F.lit(UNKNOWN_SOURCE)), "author": F.coalesce("__author", F.lit("")), "section": F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " > ")}).drop("__title", "__author")


def book_display(title: Column, author: Column, filename: Column) -> Column:
    name = F.coalesce(F.nullif(title, F.lit("")), F.nullif(filename, F.lit("")), F.lit("Unknown title"))
    return F.concat_ws(" - ", name, F.nullif(author, F.lit("")))


def source_label() -> Column:
    return F.concat_ws(", ", "book", _given("author"), F.concat(F.lit("section: "), _given("section")), F.concat(F.lit("p."), F.col("page_number").cast("string")))


def sources(hits: DataFrame) -> DataFrame:
    """query_id, place, book, author, pages: each book once, in the order of its first hit; numbers before other pages."""
    page = F.struct(F.col("page_number").try_cast("bigint").isNull().alias("odd"), F.col("page_number").try_cast("bigint").alias("n"), F.col("page_number").cast("string").alias("s"))
    g = hits.groupBy("query_id", "book", "author").agg(F.min("rank").alias("first"), F.transform(F.array_sort(F.collect_set(page)), lambda p: p["s"]).alias("pages"))
    from pyspark.sql import Window

    return g.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).drop("first")


def _flat(c: str) -> Column:
    from foliomill.text import strip

    return F.replace(strip(F.col(c)), F.lit("\n"), F.lit(" "))


def two_places(c: Column) -> Column:
    return F.replace(F.format_number(c, 2), F.lit(","), F.lit(""))


def _joined(hits: DataFrame, line: Column, name: str) -> DataFrame:
    rows = hits.select("query_id", F.struct("rank", line.alias("line")).alias("r"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n\n").alias(name))


def prompts(hits: DataFrame, questions: DataFrame, instruction: str = "Answer from the numbered passages only, cite them like [1], end with the sources, and say so if they hold no answer.") -> DataFrame:
    """query_id, prompt for a language model; a query has at most top-k passages."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (Source: "), source_label(), F.lit(")\n"), _flat("content"))
    ctx = _joined(hits, line, "context")
    return questions.join(ctx, "query_id").select("query_id", F.concat(F.lit(instruction + "\n\nContext:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("text"), F.lit("\n\nAnswer:")).alias("prompt"))


def extracts(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, answer: an opening and the passages themselves, cut at 500 characters, when no model is at hand."""
    flat = _flat("content")
    snippet = F.when(F.length(flat) > SNIPPET, F.concat(F.substring(flat, 1, SNIPPET), F.lit("..."))).otherwise(flat)
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), source_label(), F.lit(", score "), two_places(F.col("similarity")), F.lit(")\n"), snippet)
    return questions.select("query_id").join(_joined(hits, line, "answer"), "query_id", "left").select("query_id", F.coalesce(F.concat(F.lit(OPENING + "\n\n"), F.col("answer")), F.lit(NO_PASSAGES)).alias("answer"))


def not_stored(candidates: DataFrame, store: DataFrame) -> DataFrame:
    """Candidates whose document is not in the store: a second ingestion does nothing."""
    return candidates.join(store.select("document_id").distinct(), "document_id", "left_anti")


def generate(hits: DataFrame, questions: DataFrame, provider: Callable[[str], str], timeout: float = 120.0) -> DataFrame:
    """query_id, answer, error: each question's prompt through a provider's port, called in the workers.

    An exception or an overrun time gives a null answer and its error; a question without hits has the fixed answer and no
    call.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, prompt in zip(b["query_id"], b["prompt"]):
                began, text, error = time.monotonic(), NO_PASSAGES, None
                if prompt is not None:
                    try:
                        text = provider(prompt) or ""
                    except Exception as e:
                        text, error = None, str(e)
                    if time.monotonic() - began > timeout:
                        text, error = None, "timeout"
                out.append((key, text, error))
            yield pd.DataFrame(out, columns=["query_id", "answer", "error"])

    asked = questions.select("query_id").join(prompts(hits, questions), "query_id", "left")
    kind = questions.schema["query_id"].dataType.simpleString()
    return asked.mapInPandas(run, f"query_id {kind}, answer string, error string")


# The names of providers, the ones that need a key first.
PROVIDERS = ("freemodel", "openai", "ollama", "extractive")


def choose_provider(prefer: str | None, keys: set[str], reachable: bool = False) -> str:
    """Which provider answers: the preferred one, else by the keys at hand, else a reachable local server, else extracts."""
    if (prefer or "").lower() in PROVIDERS:
        return prefer.lower()
    return next((p for p in PROVIDERS[:2] if p in keys), "ollama" if reachable else "extractive")
