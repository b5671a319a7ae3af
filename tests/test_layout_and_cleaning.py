import random
import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from foliomill.operators import chunk, layout, normalize, ocr
from foliomill.sources.readers import CELLS

ITEM = f"document_id string, item_kind string, origin int, page int, text string, kind string, heading_level int, bbox struct<x0:double,y0:double,x1:double,y1:double>, column int, from_ocr boolean, cells {CELLS}"


def plain_order(items):
    """The same by loops: items of one document."""
    col = {}
    for page in {i[3] for i in items}:
        free = [i for i in items if i[3] == page and i[8] is None and i[7]]
        widths = [i[7][2] - i[7][0] for i in free if i[7][2] > i[7][0]]
        gap = max(sum(widths) / len(widths) / 2 if widths else 0, 1.0)
        band, before, of = 0, None, {}
        for x in sorted({i[7][0] for i in free}):
            band += before is not None and x - before > gap
            of[x], before = band, x
        for i in items:
            if i[3] == page:
                col[i[2]] = i[8] if i[8] is not None else of[i[7][0]] if i[7] else 0
    return [i[2] for i in sorted(items, key=lambda i: (i[3], col[i[2]], i[7][1] if i[7] else 0.0, i[7][0] if i[7] else 0.0, i[2]))]


def test_reading_order(spark):
    rnd, rows = random.Random(3), []
    for d in range(40):
        for o in range(rnd.randint(0, 9)):
            box = None if rnd.random() < 0.3 else (float(rnd.choice([0, 5, 200, 400])), float(rnd.randint(0, 5)), 150.0 + rnd.choice([0, 200, 400]), 9.0)
            rows.append((str(d), "block", o, rnd.randint(0, 2), "t", "paragraph", None, box, rnd.choice([None, None, 0, 1]), False, None))
    got = {}
    for r in layout.reading_order(spark.createDataFrame(rows, ITEM)).collect():
        got.setdefault(r.document_id, {})[r.position] = r.origin
    for d in {r[0] for r in rows}:
        want = plain_order([r for r in rows if r[0] == d])
        assert [got[d][i] for i in range(len(want))] == want


def test_typing_and_status(spark):
    rows = [("d", "block", 0, 0, "a", " Title ", None, None, None, False, None), ("d", "block", 1, 0, "b", "odd", 3, None, None, True, None), ("d", "block", 2, 0, "c", "odd", None, None, None, False, None), ("d", "table", 0, 0, None, None, None, None, None, False, [(0, 0, " ", 1, 1), (0, 1, "x", 1, 1)]), ("e", "block", 0, 0, " 　", "paragraph", None, None, None, False, None)]
    df = layout.with_origins(spark.createDataFrame(rows, ITEM))
    got = {r.text: (r.block_type, r.heading_level, r.source) for r in layout.parsed_items(df).collect() if r.text and r.document_id == "d"}
    assert got == {"a": ("heading", 1, "text_layer"), "b": ("heading", 3, "ocr"), "c": ("other", None, "text_layer")}
    docs = spark.createDataFrame([("d",), ("e",), ("f",), ("g",)], "document_id string")
    bad = spark.createDataFrame([("g", "timeout", "slow")], "document_id string, kind string, reason string")
    assert {r.document_id: r.parse_kind for r in layout.parse_status(docs, df, bad).collect()} == {"d": None, "e": "no_extractable_content", "f": "no_extractable_content", "g": "timeout"}


def test_ocr(spark):
    pages = spark.createDataFrame([("d", 0, False, "p0"), ("d", 1, True, "p1"), ("d", 2, False, None)], "document_id string, page int, has_text_layer boolean, page_image_ref string")
    images = spark.createDataFrame([("d", "i1", 1, True), ("d", "i2", 1, False), ("d", "i3", 2, True), ("d", "i4", 2, True)], "document_id string, image_ref string, page int, has_text boolean")
    todo = ocr.images_to_read(pages, images)
    assert [r.image_ref for r in todo.orderBy("seq").collect()] == ["p0", "i1", "i3", "i4"]
    plan = spark.createDataFrame([("p0", "text", 0.7, None, 1.0), ("i1", "x", 0.2, "corrupt", 99.0), ("i3", None, None, "corrupt", 60.0)], "image_ref string, text string, confidence double, error_kind string, duration double")
    blocks, errors = ocr.split_results(ocr.planned(todo, plan, 60), 0.7)
    assert [(r.text, r.origin, r.low_confidence) for r in blocks.collect()] == [("text", 0, False)]
    assert {r.image_ref: r.error_kind for r in errors.collect()} == {"i1": "timeout", "i3": "corrupt", "i4": "unreadable"}
    read = ocr.read_images(todo, lambda ref: (ref, 0.5) if ref != "i1" else 1 / 0, 60)
    assert {r.image_ref: r.error_kind for r in read.collect()} == {"p0": None, "i1": "unreadable", "i3": None, "i4": None}


def test_running_lines(spark):
    rows = [("d", p, 3 * p + i, 3 * p + i, t) for p in range(3) for i, t in enumerate([f"Report {p}", "body" if p else "Report 9", "  Foot er "])]
    df = spark.createDataFrame(rows, "document_id string, page int, position int, item int, text string")
    assert [r.text for r in normalize.remove_running(df).orderBy("position").collect()] == ["Report 9", "body", "body"]


WORDS = ["re", "port", "reé", "x_y", "a", "b", "report", "ab"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(WORDS + ["-\n", "-\r\n  ", "-", " ", "\n"]), max_size=12).map("".join), min_size=30, max_size=60))
def test_dehyphenate(spark, texts):
    known = {"report", "reéport", "ab", "x_ya"}
    dictionary = spark.createDataFrame([(w.upper(),) for w in known] + [(" ",)], "word string")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.text for r in normalize.dehyphenate_blocks(df, dictionary).collect()}
    rx = re.compile(r"(\w+)-\r?\n[ \t]*(\w+)")
    for i, t in enumerate(texts):
        assert got[i] == rx.sub(lambda m: m[1] + m[2] if (m[1] + m[2]).lower() in known else m[0], t)
    empty = normalize.dehyphenate_blocks(df, dictionary.limit(0))
    assert {r.i: r.text for r in empty.collect()} == dict(enumerate(texts))


def test_heading_paths_and_merge(spark):
    rnd, rows = random.Random(5), []
    for d in range(30):
        for p in range(rnd.randint(1, 12)):
            level = rnd.choice([None, None, 1, 2, 3, 4])
            rows.append((str(d), p // 4, p, 0, "text" if level is None else "heading", f"{d}.{p}", level))
    df = spark.createDataFrame(rows, "document_id string, page int, position int, rank int, kind string, text string, heading_level int")
    got = {r.text: r.heading_path for r in normalize.heading_paths(df).collect()}
    for d in range(30):
        stack = []
        for r in (r for r in rows if r[0] == str(d)):
            if r[6] is not None:
                stack = [s for s in stack if s[0] < r[6]]
            assert got[r[5]] == [s[1] for s in stack]
            if r[6] is not None:
                stack.append((r[6], r[5]))
    cleaned = spark.createDataFrame([("d", 0, 1, "H", "heading", 1), ("d", 0, 2, "t", "paragraph", None)], "document_id string, page int, position int, text string, block_type string, heading_level int")
    heads = spark.createDataFrame([("d", 0, 1, "H", 1), ("d", 0, 0, "taken out", 2)], "document_id string, page int, position int, text string, level int")
    other = spark.createDataFrame([("d", 0, 3, "table", [(0, 0, "v", 1, 1)], "raw", None, None, False)], f"document_id string, page int, position int, item_kind string, cells {CELLS}, raw_text string, image_ref string, caption string, degraded boolean")
    merged = normalize.heading_paths(normalize.merge_elements(cleaned, heads, other))
    assert [(r.kind, r.text) for r in merged.orderBy("position").collect()] == [("heading", "taken out"), ("heading", "H"), ("text", "t"), ("table", None)]
    back, errors = normalize.deserialize(normalize.serialize(merged))
    assert errors.isEmpty()
    names = ["page", "position", "kind", "text", "heading_level", "heading_path", "raw_text"]
    assert [tuple(r) for r in back.select(names).orderBy("position").collect()] == [tuple(r) for r in merged.select(names).orderBy("position").collect()]
    import json

    doc = json.loads(normalize.serialize(merged).first().json)
    assert list(doc) == ["documentId", "elements", "schemaVersion"] and doc["elements"][3]["payload"]["cells"][0]["value"] == "v"


def test_deserialize_errors(spark):
    bad = ["nonsense", "[]", '{"elements":[]}', '{"documentId":"d","elements":7}', '{"documentId":"d","elements":[{"kind":"odd","pageNumber":0,"readingOrderPosition":0,"payload":{"text":"x"}}]}', '{"documentId":"d","elements":[{"kind":"text","pageNumber":0,"readingOrderPosition":0}]}']
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bad)] + [("ok", '{"documentId":"d"}')], "document_id string, json string")
    elements, errors = normalize.deserialize(df)
    assert elements.isEmpty() and {r.document_id for r in errors.collect()} == {str(i) for i in range(len(bad))}


def plain_chunks(elements, most, lap):
    """One document's chunks by loops; elements are (position, kind, text, cells)."""
    segments, run = [], []
    for _, kind, text in sorted(elements):
        if kind == "figure" or not text.split():
            continue
        if kind == "table":
            segments += [("t", run)] if run else []
            segments.append(("T", text.split()))
            run = []
        else:
            run += text.split()
    segments += [("t", run)] if run else []
    out = []
    for s, toks in segments:
        step, i = most - (lap if s == "t" else 0), 0
        while True:
            out.append((" ".join(toks[i * step : i * step + most]), 0 if i == 0 or s == "T" else lap, s == "T"))
            if i * step + most >= len(toks):
                break
            i += 1
    return out


def test_chunks(spark):
    rnd, rows = random.Random(8), []
    for d in range(60):
        for p in range(rnd.randint(0, 7)):
            kind = rnd.choice(["text", "text", "heading", "table", "figure"])
            rows.append((str(d), p, 0, kind, None if kind == "table" else " ".join(f"w{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 9))), p // 2, [], [(0, 0, f"c{p}", 1, 1), (0, 1, "x y", 1, 1), (1, 0, "z", 1, 1)][: rnd.randint(0, 3)] if kind == "table" else None, None))
    df = spark.createDataFrame(rows, f"document_id string, position int, rank int, kind string, text string, page int, heading_path array<string>, cells {CELLS}, raw_text string")
    for most, lap in ((4, 0), (5, 2), (3, 2), (1, 0), (100, 7)):
        got = {}
        for r in chunk.chunk_elements(df, most, lap).orderBy("order_index").collect():
            assert r.token_count == len(r.content.split()) <= most
            got.setdefault(r.document_id, []).append((r.content, r.overlap_token_count, r.is_table_part))
        for d in range(60):
            def text(r):
                if r[3] != "table":
                    return r[4] or ""
                by_row = {}
                for c in r[7]:
                    by_row.setdefault(c[0], []).append(c[2])
                return "\n".join(" | ".join(v) for v in by_row.values())
            assert got.get(str(d), []) == plain_chunks([(r[1], r[3], text(r)) for r in rows if r[0] == str(d)], most, lap)
    import pytest

    with pytest.raises(chunk.ChunkingError):
        chunk.chunk_elements(df, 3, 3)
    assert chunk.chunk_texts(df.limit(0).select("document_id", "text"), "document_id", "text", 5, 2).count() == 0
    assert df.select(F.max(F.size("cells"))).first()[0] <= 3
