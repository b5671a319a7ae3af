"""Lines repeated across one source's pages: found by their pages, scored by a log-likelihood ratio and removed.

A line class (its letters in lower case) on at least `MIN_PAGES` pages of a source is a case, whatever its score.  For
the score, the share of the source's pages that it stands on is compared with the share of the pages of all other sources
that it stands on.  Dunning's ratio gives a p-value, and the Benjamini-Hochberg step-up rule over all classes of all sources
sets the level.  A collection of one source has no pages outside: one page without any of its lines stands for them, and scores are near nothing.  All counting is by SQL aggregates keyed on (source, class, page); a source
with a third of all rows is spread over its classes and pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliomill.session import staged

MIN_LETTERS = 10
MIN_PAGES = 4
FDR = 0.01
#: p-values are counted in bins of a twentieth of a decade; the last bin takes all smaller ones.
BINS_PER_DECADE, LAST_BIN = 20, 8000


def line_key(line: Column) -> Column:
    """The letters of a line in lower case; what else it holds does not count."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def keyed_lines(blocks: DataFrame, source: str, page: str, block: str, text: str) -> DataFrame:
    """src, k1, k2, page, block, line_no (from 1): the lines, cut at line feeds, that have a class.

    Lines of fewer than MIN_LETTERS letters, null texts and rows without a source have none.  `src` and the class are
    hashes of together 192 bits, so that no text is shuffled.
    """
    df = blocks.where(F.col(source).isNotNull() & (F.length(text) >= MIN_LETTERS))
    df = df.select(F.xxhash64(source).alias("src"), F.col(page).alias("page"), F.col(block).alias("block"), F.posexplode(F.split(F.col(text), "\n")).alias("i", "line"))
    df = df.where(F.length("line") >= MIN_LETTERS).select("src", "page", "block", (F.col("i") + 1).cast("bigint").alias("line_no"), line_key(F.col("line")).alias("key"))
    return df.where(F.length("key") >= MIN_LETTERS).select("src", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"), "page", "block", "line_no")


def _xlogx_ratio(k: Column, n: Column, p: Column) -> Column:
    """log-likelihood of k of n at rate p, with 0 log 0 = 0."""
    return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log1p(-p)).otherwise(0.0)


def repeated_classes(keyed: DataFrame, min_pages: int = MIN_PAGES, fdr: float = FDR) -> DataFrame:
    """src, k1, k2, pages, llr, log10_p, significant: the classes on at least `min_pages` pages of their source.

    What is counted is that a class stands on a page, so repeated rows change nothing.
    """
    placed = keyed.where("page IS NOT NULL")
    by_class = placed.select("src", "k1", "k2", "page").distinct().groupBy("src", "k1", "k2").agg(F.count("*").alias("pages"))
    often = by_class.where(F.col("pages") >= min_pages)
    totals = placed.select("src", "page").distinct().groupBy("src").agg(F.count("*").alias("n_source"))
    all_pages = totals.agg(F.sum("n_source").alias("all_pages"))
    tests = by_class.agg(F.count("*").alias("all_classes"))
    outside = by_class.join(often.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.sum("pages").alias("everywhere"))
    df = often.join(outside, ["k1", "k2"]).join(totals, "src").crossJoin(F.broadcast(all_pages))
    a, n1 = F.col("pages").cast("double"), F.col("n_source").cast("double")
    b = (F.col("everywhere") - F.col("pages")).cast("double")
    n2 = F.greatest((F.col("all_pages") - F.col("n_source")).cast("double"), F.lit(1.0))
    eps = 1e-12
    rate = lambda k, n: F.least(F.greatest(k / n, F.lit(eps)), F.lit(1 - eps))
    both = rate(a + b, n1 + n2)
    llr = 2 * (_xlogx_ratio(a, n1, rate(a, n1)) + _xlogx_ratio(b, n2, rate(b, n2)) - _xlogx_ratio(a, n1, both) - _xlogx_ratio(b, n2, both))
    df = df.withColumn("llr", F.when(a / n1 > b / n2, F.greatest(llr, F.lit(0.0))).otherwise(0.0))
    x = F.col("llr") / 2
    # the tail of chi-square with one degree of freedom, bounded from above
    df = df.withColumn("log10_p", F.when(x > 0.5, -(x + 0.5 * F.log(x * 3.141592653589793)) / 2.302585092994046).otherwise(0.0))
    df = df.withColumn("bin", F.least(F.floor(-F.col("log10_p") * BINS_PER_DECADE), F.lit(LAST_BIN)).cast("int"))
    # step-up rule on a histogram of at most LAST_BIN + 1 rows
    hist = df.groupBy("bin").agg(F.count("*").alias("c"))
    hist = hist.withColumn("rank", F.sum("c").over(Window.orderBy(F.col("bin").desc()))).crossJoin(F.broadcast(tests))
    passing = hist.where(-F.col("bin") / BINS_PER_DECADE <= F.log10(F.col("rank") / F.col("all_classes") * fdr)).agg(F.coalesce(F.min("bin"), F.lit(LAST_BIN + 1)).alias("least_bin"))
    return df.crossJoin(F.broadcast(passing)).select("src", "k1", "k2", "pages", "llr", "log10_p", (F.col("bin") >= F.col("least_bin")).alias("significant"))


def lines_to_remove(blocks: DataFrame, source: str, page: str, block: str, text: str, min_pages: int = MIN_PAGES) -> DataFrame:
    """block, line_no, log10_p, significant of each line whose class is on at least `min_pages` pages of its source; each once.

    The last two are the score of its class; they decide nothing.

    Edge cases: null source, page or text: the row has no case (a null page counts for no page); a key counts once;
    an empty table gives an empty result; other columns are not looked at.
    """
    keyed = staged(keyed_lines(blocks, source, page, block, text), "lines")  # the classes are needed three times, the texts once
    hits = repeated_classes(keyed, min_pages).select("src", "k1", "k2", "log10_p", "significant")
    return keyed.join(hits, ["src", "k1", "k2"]).groupBy("block", "line_no").agg(F.min("log10_p").alias("log10_p"), F.max("significant").alias("significant"))


def remove_repeated(blocks: DataFrame, source: str, page: str, block: str, text: str) -> DataFrame:
    """block, text, removed: every block without its repeated lines, the rest in its order; null texts stay null.

    Only the numbers of the removed lines are joined to the blocks; the lines are left out by position.
    """
    gone = lines_to_remove(blocks, source, page, block, text).groupBy("block").agg(F.collect_set("line_no").alias("gone"))
    one = blocks.select(F.col(block).alias("block"), F.col(text).alias("text")).distinct()
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", (i + 1).cast("bigint"))), "\n")
    return one.join(gone, "block", "left").select("block", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("removed"))
