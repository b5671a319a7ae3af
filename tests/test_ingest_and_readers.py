import hashlib
import io
import json
import zipfile

from pyspark.sql import functions as F

from foliomill.config import PipelineConfig
from foliomill.operators import ingest
from foliomill.sources import readers


def boxed(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "application/epub+zip" if n == "mimetype" else "x")
    return out.getvalue()


FILES = [
    (1, "a.pdf", b"%PDF-1.7 x %%EOF", None), (2, "b.pdf", b"%PDF-1.7 x", "corrupted_file"), (3, "c.html", b"\xef\xbb\xbf \n<!DOCTYPE HTML><p></HTML>", None), (4, "d.html", b"<html>", "corrupted_file"),
    (5, "e.docx", boxed("word/document.xml", "[Content_Types].xml"), None), (6, "f.docx", boxed("word/document.xml"), "corrupted_file"), (7, "g.epub", boxed("mimetype", "META-INF/container.xml"), None),
    (8, "h.zip", boxed("x"), "unsupported_format"), (9, "i.png", b"\x89PNG\r\n\x1a\n", "unsupported_format"), (10, "", b"%PDF-", "invalid_filename"), (11, None, b"%PDF-", "invalid_filename"),
    (12, "x" * 255, b"%PDF-%%EOF", None), (13, "\U0001f600" * 256, b"%PDF-%%EOF", "invalid_filename"), (14, "j", b"", "empty_file"), (15, "k", b"%PDF-%%EOF" + b"z" * 2000, "file_too_large"),
    (16, "again.pdf", b"%PDF-1.7 x %%EOF", None), (17, "l.docx", boxed("word/document.xml", "[Content_Types].xml")[:-30], "corrupted_file"), (18, "m", None, "empty_file"),
]


def test_gate_and_outcomes(spark):
    df = spark.createDataFrame([f[:3] for f in FILES], "submission_id int, filename string, content binary")
    gated = ingest.gate(df, PipelineConfig(max_file_size_bytes=1500))
    assert {r.submission_id: r.code for r in gated.collect()} == {f[0]: f[3] for f in FILES}
    out = {r.submission_id: r for r in ingest.submit(gated).collect()}
    assert out[1].outcome == "accepted" and out[16].outcome == "duplicate" and out[16].job_id == out[1].job_id
    assert out[1].document_id == hashlib.sha256(FILES[0][2]).hexdigest()
    assert out[9].outcome == "rejected" and "PNG" in out[9].message
    jobs = ingest.new_jobs(ingest.submit(gated), gated)
    assert jobs.count() == jobs.select("job_id").distinct().count() == 5
    again = ingest.submit(gated, jobs)
    assert again.where("outcome = 'accepted'").isEmpty()
    assert ingest.retained_sources(again, gated).count() == 5


def test_text_layer(spark):
    df = spark.createDataFrame([("d", "a\n\n  　b \n\n\n\n".encode()), ("e", b"x\xff"), ("f", b""), ("g", None)], "document_id string, content binary")
    got = [(r.document_id, r.origin, r.text) for r in readers.text_layer(df).orderBy("document_id", "origin").collect()]
    assert got == [("d", 0, "a"), ("d", 1, "b"), ("e", 0, "x�")]


def test_layout_json(spark):
    native = {
        "texts": [{"text": "T", "label": "Section_Header", "level": 2, "prov": [{"page_no": 3, "bbox": {"l": 1, "t": 2, "r": 3, "b": 4}}]}, {"text": "p", "label": "odd", "prov": [{"page_no": "x", "bbox": {"l": 1}}]}, {"label": "text"}, 7, {"text": "h", "label": "title", "level": "2"}],
        "tables": [{"data": {"table_cells": [{"text": "v", "start_row_offset_idx": 1, "start_col_offset_idx": -2, "row_span": 0}, {"text": " "}]}, "prov": [{"page_no": 1}]}, {"raw_text": "r"}, "odd"],
        "pictures": [{"captions": [{"text": "c"}], "self_ref": "#/p"}, {"caption": "d", "image_ref": "i"}],
    }
    df = spark.createDataFrame([("d", json.dumps(native)), ("e", "no json"), ("f", None), ("g", "[]")], "document_id string, native string")
    rows = readers.layout_json(df).collect()
    assert {r.document_id for r in rows} == {"d"}
    blocks = sorted((r.origin, r.text, r.kind, r.heading_level, r.page, r.bbox and tuple(r.bbox)) for r in rows if r.item_kind == "block")
    assert blocks == [(0, "T", "heading", 2, 3, (1.0, 2.0, 3.0, 4.0)), (1, "p", "paragraph", None, 0, None), (4, "h", "heading", 1, 0, None)]
    tables = sorted((r.origin, [tuple(c) for c in r.cells], r.degraded, r.raw_text) for r in rows if r.item_kind == "table")
    assert tables == [(0, [(1, 0, "v", 1, 1)], False, None), (1, [], True, "r"), (2, [], True, None)]
    assert sorted((r.image_ref, r.caption) for r in rows if r.item_kind == "figure") == [("#/p", "c"), ("i", "d")]


def test_page_json(spark):
    page = {"page": 2, "items": [{"type": "heading", "lvl": 3, "value": "H"}, {"type": "table", "rows": [["a", None], ["", 5]], "md": "m"}, {"value": "t"}, {"type": "table", "csv": "c"}], "images": [{"name": "n"}]}
    df = spark.createDataFrame([("d", json.dumps([{"pages": [page, {"page": 3, "text": "only"}]}])), ("e", json.dumps({"pages": [page]})), ("f", json.dumps([page])), ("g", "7")], "document_id string, native string")
    rows = readers.page_json(df).collect()
    d = [r for r in rows if r.document_id == "d"]
    assert [(r.text, r.kind, r.heading_level, r.page) for r in sorted(d, key=lambda r: r.origin) if r.item_kind == "block"] == [("H", "heading", 3, 2), ("t", "paragraph", None, 2), ("only", "paragraph", None, 3)]
    tabs = [([tuple(c)[:3] for c in r.cells], r.degraded, r.raw_text) for r in sorted(d, key=lambda r: r.origin) if r.item_kind == "table"]
    assert tabs == [([(0, 0, "a"), (1, 1, "5")], False, None), ([], True, "c")]
    assert {r.document_id for r in rows} == {"d", "e", "f"}


def test_titles_and_years(spark):
    df = spark.createDataFrame([("a/b/Book.v2.pdf", "D:2018"), (".hidden", "2018"), ("x", None)], "f string, y string")
    assert [tuple(r) for r in df.select(readers.book_title(F.col("f")), F.coalesce(readers.pdf_year(F.col("y")), F.lit(""))).collect()] == [("Book.v2", "2018"), (".hidden", ""), ("x", "")]
