"""python -m foliomill FOLDER QUESTION...: ingests the files of a folder and prints the best passages for each question."""

from __future__ import annotations

import sys
import tempfile


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession, functions as F

    from foliomill.operators import answer
    from foliomill.plans.pipeline import Pipeline
    from foliomill.sources.readers import book_title, read_files

    spark = SparkSession.builder.appName("foliomill").getOrCreate()
    p = Pipeline(spark, tempfile.mkdtemp(prefix="foliomill-"))
    files = read_files(spark, args[0])
    p.submit(files.select(F.col("filename").alias("submission_id"), "filename", "content")).groupBy("outcome", "code").count().show(truncate=False)
    p.process().groupBy("overall_status").count().show()
    questions = spark.createDataFrame([(str(i), q) for i, q in enumerate(args[1:], 1)], "query_id string, text string")
    hits, status = p.retrieve(questions)
    books = p.jobs().select("document_id", book_title(F.col("filename")).alias("title"), F.lit("").alias("author"))
    for r in answer.extracts(answer.with_books(hits, books), questions).orderBy("query_id").collect():  # one row a question
        print(r["answer"], end="\n\n")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
