"""The gate for submitted files: ordered checks, then deduplication by content."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foliomill.config import PipelineConfig

# How contents begin, and what they are then called.
PREFIX_LABELS = [
    ("89504E470D0A1A0A", "PNG image"), ("FFD8FF", "JPEG image"), ("474946383761", "GIF image"), ("474946383961", "GIF image"), ("25215053", "PostScript"),
    ("7B5C727466", "RTF document"), ("1F8B", "gzip archive"), ("504B", "ZIP-based archive (not EPUB or DOCX)"),
]
ZIP_STARTS = ("504B0304", "504B0506", "504B0708")


def _hex(s: str) -> Column:
    return F.unhex(F.lit(s))


def _has(content: Column, s: str) -> Column:
    return F.contains(content, F.lit(s.encode()))


def _latin(content: Column) -> Column:
    return F.lower(F.decode(content, "ISO-8859-1"))


def sniff(content: Column) -> Column:
    """pdf, epub, docx or html; null for anything else."""
    head = F.when(F.startswith(content, _hex("EFBBBF")), F.substring(content, 4, 1 << 30)).otherwise(content)
    # leading white space is skipped before the first 1024 bytes are looked at; only a file that begins with much of it is read further
    begin = lambda c: F.substring(F.regexp_replace(_latin(c), r"^[\t-\r ]+", ""), 1, 1024)
    short = begin(F.substring(head, 1, 4096))
    text = F.when((F.octet_length(head) <= 4096) | (F.length(short) == 1024), short).otherwise(begin(head))
    is_zip = F.startswith(content, _hex(ZIP_STARTS[0])) | F.startswith(content, _hex(ZIP_STARTS[1])) | F.startswith(content, _hex(ZIP_STARTS[2]))
    return (
        F.when(F.startswith(content, F.lit(b"%PDF-")), "pdf")
        .when(is_zip, F.when(_has(F.substring(content, 1, 4096), "mimetypeapplication/epub+zip") | _has(content, "META-INF/container.xml"), "epub").when(_has(content, "word/document.xml"), "docx"))
        .when(F.startswith(text, F.lit("<!doctype html")) | F.contains(text, F.lit("<html")), "html")
    )


def unsupported_label(content: Column) -> Column:
    out = F.lit("an unrecognized/unsupported format")
    for start, label in reversed(PREFIX_LABELS):
        out = F.when(F.startswith(content, _hex(start)), label).otherwise(out)
    return out


def _zip_names(content: bytes) -> set[str] | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return None if z.testzip() is not None else set(z.namelist())
    except Exception:  # whatever is wrong with one archive must not end the job
        return None


def zip_well_formed(kind: str, content: bytes) -> bool:
    names = _zip_names(content)
    if names is None:
        return False
    return {"word/document.xml", "[Content_Types].xml"} <= names if kind == "docx" else bool({"mimetype", "META-INF/container.xml"} & names)


def gate(submissions: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Adds format, code, message and content_hash to submission_id, filename, content; the first failing check decides.

    code is null for what passes.  Only ZIP containers, by then a branch of their own, are sent to Python.
    """
    name, size = F.coalesce(F.length("filename"), F.lit(0)), F.coalesce(F.octet_length("content"), F.lit(0))
    content = F.col("content")
    early = (
        F.when(~name.between(1, config.max_filename_length), "invalid_filename")
        .when(size == 0, "empty_file")
        .when(size > config.max_file_size_bytes, "file_too_large")
    )
    df = submissions.withColumns({"code": early, "format": F.when(early.isNull(), sniff(content))})
    df = df.withColumn("code", F.coalesce("code", F.when(F.col("format").isNull(), "unsupported_format")))
    tail = F.substring(content, -2048, 2048)
    plain = F.when(F.col("format") == "pdf", _has(F.when(F.octet_length("content") > 2048, tail).otherwise(content), "%%EOF")).when(F.col("format") == "html", F.contains(_latin(content), F.lit("</html>")))
    boxed = F.col("format").isin("epub", "docx")
    direct = df.where(~F.coalesce(boxed, F.lit(False))).withColumn("good", plain)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(good=[zip_well_formed(k, bytes(c)) for k, c in zip(b["format"], b["content"])])

    zipped = df.where(boxed)
    from pyspark.sql import types as T

    checked = zipped.mapInPandas(look, T.StructType([*zipped.schema.fields, T.StructField("good", T.BooleanType())]))
    out = direct.unionByName(checked)
    code = F.coalesce("code", F.when(~F.coalesce("good", F.lit(False)), "corrupted_file"))
    message = (
        F.when(code == "invalid_filename", F.format_string(f"The filename must have 1 to {config.max_filename_length} characters; it has %d.", name))
        .when(code == "empty_file", "The file is empty.")
        .when(code == "file_too_large", F.format_string("The file has %d bytes; the limit is 500 MB.", size))
        .when(code == "unsupported_format", F.concat(F.lit("Not a supported format (PDF, EPUB, DOCX, HTML): "), unsupported_label(content)))
        .when(code == "corrupted_file", F.concat(F.lit("The file is damaged or incomplete: "), F.col("format")))
    )
    return out.select(*submissions.columns, "format", code.alias("code"), message.alias("message"), F.sha2("content", 256).alias("content_hash"))


def find_jobs(jobs: DataFrame, hashes: DataFrame) -> DataFrame:
    """content_hash, job_id: the job of each given content_hash that has one; of several the smallest id."""
    return jobs.join(hashes.select("content_hash").distinct(), "content_hash", "left_semi").groupBy("content_hash").agg(F.min("job_id").alias("job_id"))


def upsert_jobs(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """The jobs after rows that replace those of the same job_id."""
    return jobs.join(new.select("job_id"), "job_id", "left_anti").unionByName(new)


def job_id(content_hash: Column) -> Column:
    """An id that a task run again gives again."""
    return F.sha2(F.concat(F.lit("job"), content_hash), 256)


def submit(gated: DataFrame, jobs: DataFrame | None = None, order: str = "submission_id") -> DataFrame:
    """submission_id, outcome (accepted, duplicate, rejected), job_id, document_id, code, message.

    The first passing submission of a content creates its job, later ones and those of contents in `jobs` (content_hash,
    job_id) are duplicates of it.  Rejected ones register nothing.
    """
    fine = gated.where("code IS NULL").select(order, "content_hash")
    # one content may be a third of all submissions: the first of each is found by partial aggregates
    fine = fine.join(fine.groupBy("content_hash").agg(F.min(order).alias("__first")), "content_hash")
    if jobs is not None:
        fine = fine.join(jobs.groupBy("content_hash").agg(F.min("job_id").alias("existing")), "content_hash", "left")
    else:
        fine = fine.withColumn("existing", F.lit(None).cast("string"))
    passed = fine.select(order, F.when((F.col(order) == F.col("__first")) & F.col("existing").isNull(), "accepted").otherwise("duplicate").alias("outcome"), F.coalesce("existing", job_id(F.col("content_hash"))).alias("job_id"), F.col("content_hash").alias("document_id"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("message"))
    return passed.unionByName(gated.where("code IS NOT NULL").select(order, F.lit("rejected").alias("outcome"), F.lit(None).cast("string").alias("job_id"), F.lit(None).cast("string").alias("document_id"), "code", "message"))


def new_jobs(submitted: DataFrame, gated: DataFrame, order: str = "submission_id", at: Column | None = None) -> DataFrame:
    """The rows to append to the jobs table for what was accepted."""
    return submitted.where("outcome = 'accepted'").join(gated.select(order, "filename", "format", F.octet_length("content").alias("byte_size"), "content_hash"), order).select("job_id", "document_id", "filename", F.col("format").alias("doc_format"), "byte_size", "content_hash", (at if at is not None else F.current_timestamp()).alias("submitted_at_utc"), F.lit("parsing").alias("current_stage"), F.lit("queued").alias("overall_status"), F.lit(0).alias("progress_percent"))


def retained_sources(submitted: DataFrame, gated: DataFrame, order: str = "submission_id") -> DataFrame:
    """document_id, content of accepted and duplicate submissions, each content once."""
    return submitted.where("outcome != 'rejected'").join(gated.select(order, "content"), order).groupBy("document_id").agg(F.first("content").alias("content"))
