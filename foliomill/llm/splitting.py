"""Splitting oversized texts at natural boundaries.

Every token is reduced to one letter that says how strong the boundary after it is: ``p`` paragraph, ``l`` line,
``s`` sentence, ``c`` clause, ``w`` none.  One regular expression with bounded quantifiers, its alternatives ordered by
strength, then cuts this string into pieces that each consume up to the limit; the last alternative takes as many
tokens as fit when there is no boundary.  A token of more than `TOKEN_CHARS` characters counts as several, so that a text
without white space is cut by characters.  The lengths of the matches are token offsets, and looking back from each
offset supplies the overlap.  Everything is an SQL expression of one row, so there is no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliomill.text import ASCII_SOLID, ASCII_SPACE, SOLID, SPACE, is_ascii, token_count

#: Boundaries from the strongest to the weakest; a piece ends at the strongest one in the last half of its room.
STRENGTHS = "plsc"
#: Characters that a token may have before it is cut.
TOKEN_CHARS = 4096


def _codes(parts: Column) -> Column:
    """A boundary letter for each token; `parts` are tokens with the white space that follows."""
    def code(p: Column) -> Column:
        tail = F.regexp_extract(p, f"{SPACE}+$", 0)
        return (
            F.when(tail == " ", F.when(p.rlike(r"[.!?\x{2026}\x{3002}][\"')\]\x{2019}\x{201d}\x{bb}]* $"), "s").when(p.rlike("[,;:] $"), "c").otherwise("w"))
            .when(tail.rlike(r"\n[^\n]*\n|\x{2029}"), "p")
            .when(tail.rlike(r"[\n\r\x{85}\x{2028}]"), "l")
            .when(p.rlike(rf"[.!?\x{{2026}}\x{{3002}}][\"')\]\x{{2019}}\x{{201d}}\x{{bb}}]*{SPACE}*$"), "s")
            .when(p.rlike(rf"[,;:]{SPACE}*$"), "c")
            .otherwise("w")
        )
    return F.array_join(F.transform(parts, code), "")


def _pattern(limit: Column, overlap: Column) -> Column:
    """First piece: up to `limit` tokens and more than the overlap; each later one: up to `limit - overlap` fresh ones."""
    step = limit - overlap
    def ordered(anchor: str, least: Column, most: Column) -> Column:
        least, most = least.cast("string"), most.cast("string")
        take = F.concat(F.lit(anchor + "[a-z]{1,"), most, F.lit("}$|"))
        for s in STRENGTHS:
            take = F.concat(take, F.lit(anchor + "[a-z]{"), least, F.lit(","), most, F.lit("}(?<=" + s + ")|"))
        return F.concat(take, F.lit(anchor + "[a-z]{1,"), most, F.lit("}"))
    first = ordered("^", F.greatest(overlap, F.ceil(limit / 2)), limit)
    later = ordered("(?<!^)", F.ceil(step / 2), step)
    return F.concat(first, F.lit("|"), later)


def split_oversized(items: DataFrame, text: str, limit: str, overlap: str, token_chars: int = TOKEN_CHARS) -> DataFrame:
    """Cut each row's `text` into pieces of at most `limit` white-space tokens.

    Returns the columns of `items` (without `text`) and ``piece_no`` from 0, ``first_token`` (offset in the text),
    ``token_count``, ``overlap_count``, ``boundary`` (the letter at its end) and ``piece``.  Consecutive pieces share
    exactly `overlap` tokens.  White space between tokens stays as it is; that around a piece is dropped.

    Edge cases: a null or blank text gives no piece; a text within the limit gives one; a null limit or one below 1
    leaves the text whole; a null or negative overlap counts as 0 and one of `limit` or more as ``limit - 1``.  A
    token is cut after each `token_chars` characters, and its parts count as tokens, so that no piece is longer than
    `limit` times as many characters and the white space between them.  Repeated rows give repeated pieces.  Names of `items` never clash with the
    scratch columns, which live in one struct.
    """
    t, z = F.col(text), "__split"
    cut_at = lambda solid, space: F.regexp_extract_all(t, F.lit(f"{solid}{{1,{token_chars}}}{space}*"), F.lit(0))
    parts = F.when(is_ascii(t), cut_at(ASCII_SOLID, ASCII_SPACE)).otherwise(cut_at(SOLID, SPACE))
    lim = F.when(F.col(limit) >= 1, F.col(limit)).otherwise(F.greatest(F.size(F.col(f"{z}.parts")), F.lit(1))).cast("int")
    df = items.withColumn(z, F.struct(parts.alias("parts")))
    df = df.withColumn(z, F.struct(F.col(f"{z}.parts").alias("parts"), lim.alias("limit")))
    at = lambda n: F.col(f"{z}.{n}")
    lap = F.least(F.greatest(F.coalesce(F.col(overlap), F.lit(0)), F.lit(0)), at("limit") - 1).cast("int")
    df = df.withColumn(z, F.struct(at("parts").alias("parts"), at("limit").alias("limit"), lap.alias("lap"), _codes(at("parts")).alias("codes")))
    # regexp_extract_all keeps its compiled pattern as long as it stays the same, and there are few limits
    cut = F.transform(F.regexp_extract_all(at("codes"), _pattern(at("limit"), at("lap")), F.lit(0)), lambda s: F.struct(F.length(s).alias("n"), F.right(s, F.lit(1)).alias("end")))
    ends = F.aggregate(
        cut,
        F.array().cast("array<struct<start:int,n:int,end:string>>"),
        lambda acc, s: F.concat(acc, F.array(F.struct(F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1)["start"] + F.element_at(F.when(F.size(acc) > 0, acc), -1)["n"], F.lit(0)).alias("start"), s["n"].alias("n"), s["end"].alias("end")))),
    )
    df = df.withColumn(z, F.struct(at("parts").alias("parts"), at("lap").alias("lap"), ends.alias("cuts")))
    keep = [F.col(f"`{c}`") for c in items.columns if c != text]
    df = df.select(*keep, F.col(z), F.posexplode(at("cuts")).alias("piece_no", "__cut"))
    back = F.when(F.col("piece_no") == 0, 0).otherwise(at("lap"))
    first = (F.col("__cut.start") - back).alias("first_token")
    return df.select(
        *keep,
        "piece_no",
        first,
        (F.col("__cut.n") + back).alias("token_count"),
        back.alias("overlap_count"),
        F.col("__cut.end").alias("boundary"),
        F.regexp_replace(F.array_join(F.slice(at("parts"), F.col("__cut.start") - back + 1, F.col("__cut.n") + back), ""), f"{SPACE}+$", "").alias("piece"),
    )


def document_limits(jobs: DataFrame, configs: DataFrame) -> DataFrame:
    """document_id, max_chunk_tokens, chunk_overlap_tokens: one row for each document, however often it was submitted."""
    one = jobs.where("document_id IS NOT NULL AND config_id IS NOT NULL").groupBy("document_id").agg(F.min("config_id").alias("config_id"))
    return one.join(configs.select("config_id", "max_chunk_tokens", "chunk_overlap_tokens").dropDuplicates(["config_id"]), "config_id").drop("config_id")


def oversized(blocks: DataFrame, jobs: DataFrame, configs: DataFrame) -> DataFrame:
    """block_id, document_id, text, n_tokens and the limits of the blocks above their document's limit; a key counts once.

    Blocks not above the smallest limit of all are left out before the join, so only few texts are shuffled, and a text
    of fewer than 2n - 1 characters has fewer than n tokens, so few are counted.
    """
    least = configs.agg(F.min("max_chunk_tokens").alias("least_limit"))  # one row
    n = token_count(F.col("text"))
    candidates = (
        blocks.select("block_id", "document_id", "text").crossJoin(F.broadcast(least))
        .where(F.length("text") > 2 * F.col("least_limit")).withColumn("n_tokens", n).where("n_tokens > least_limit").drop("least_limit")
        .distinct()
    )
    return candidates.join(document_limits(jobs, configs), "document_id").where("n_tokens > max_chunk_tokens")
