import math

import pytest
from pyspark.sql import functions as F

from foliomill.config import PipelineConfig
from foliomill.operators import answer, embed, retrieve
from foliomill.plans import pipeline as P
from foliomill.sources import store as S
from foliomill.sources.store import RECORD, DocumentNotFound, PersistenceError, SnapshotStore, merge_books, read_books
from foliomill.streaming.ingest import watch


def records(spark, *rows):
    return spark.createDataFrame([(c, d, f"text {c}", 2, i, 0, 1, ["H"], False, "m", "ok", 1, [float(i), 1.0]) for i, (c, d) in enumerate(rows)], RECORD)


def keys(df):
    return sorted((r.document_id, r.chunk_id) for r in df.collect())


def test_store(spark, tmp_path):
    s = SnapshotStore(spark, f"file://{tmp_path}")
    assert s.read().isEmpty()
    s.upsert(records(spark, ("1", "a"), ("2", "a"), ("3", "b")))
    s.upsert(records(spark, ("3", "b"), ("4", "b")))
    assert keys(s.read()) == [("a", "1"), ("a", "2"), ("b", "3"), ("b", "4")]
    assert s.replace_document("a", records(spark, ("9", "a"))) and not s.replace_document("c", records(spark, ("5", "c")))
    assert keys(s.read()) == [("a", "9"), ("b", "3"), ("b", "4"), ("c", "5")]
    assert sorted(r.chunk_id for r in s.delete_document("b").collect()) == ["3", "4"]
    assert s.get_document("b").isEmpty() and keys(s.get_document("a")) == [("a", "9")]
    with pytest.raises(DocumentNotFound):
        s.delete_document("b")
    with pytest.raises(PersistenceError):
        s.upsert(records(spark, ("1", "a")), "x")
    before = keys(s.read())

    def broken():
        raise OSError("disk")

    s.commit_hook = broken
    with pytest.raises(PersistenceError):
        s.upsert(records(spark, ("7", "z")))
    assert keys(s.read()) == before


def test_books(spark, tmp_path):
    assert read_books(spark, str(tmp_path / "none")).isEmpty()
    (tmp_path / "b.json").write_text('{"document_id":"d","title":"T"}\nnonsense\n')
    b = read_books(spark, str(tmp_path / "b.json")).select("document_id", "title")
    new = spark.createDataFrame([("d", "U"), ("e", "V")], "document_id string, title string")
    assert sorted(map(tuple, merge_books(b, new).collect())) == [("d", "U"), ("e", "V")]


def cosine(a, b):
    if len(a) != len(b) or not a or not any(a) or not any(b):
        return 0.0
    c = sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    return (max(-1.0, min(1.0, c)) + 1) / 2


def test_retrieval(spark):
    vs = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 0.0], [2.0, 0.0], [1.0], [], [-1.0, 0.0]]
    df = spark.createDataFrame([(str(i), "d" if i % 2 else "e", i, v, None if i == 2 else i, ["A"]) for i, v in enumerate(vs)], "chunk_id string, document_id string, order_index bigint, embedding array<double>, page_number int, heading_path array<string>")
    q = [1.0, 0.2]
    want = sorted(range(8), key=lambda i: (-cosine(vs[i], q), "d" if i % 2 else "e", i))
    assert [int(r.chunk_id) for r in retrieve.top_k(df, q, 8).collect()] == want
    queries = spark.createDataFrame([("q", q), ("zero", [0.0, 0.0]), ("one", [3.0])], "query_id string, vector array<double>")
    rows = retrieve.batch_top_k(df, queries, 8).collect()
    assert [int(r.chunk_id) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == "q"] == want
    assert all(abs(r.similarity - cosine(vs[int(r.chunk_id)], {"q": q, "zero": [0.0, 0.0], "one": [3.0]}[r.query_id])) < 1e-12 for r in rows)
    assert retrieve.top_k(df, q, 0).count() == 0
    assert [r.chunk_id for r in retrieve.top_k(df, q, 9, {"pageNumber": None, "headingPath": ["A"]}).collect()] == ["2"]
    assert retrieve.top_k(df, q, 9, {"nothing": 1}).count() == 0
    v = spark.createDataFrame([("a", " ", 1), ("b", "x", 0), ("c", "x", 101), ("d", "x", None), ("e", "y" * 5, 3)], "query_id string, text string, k int")
    v = v.withColumn("error", retrieve.validate(F.col("text"), F.col("k"), 4))
    hits = spark.createDataFrame([("d",)], "query_id string")
    assert {r.query_id: r.status for r in retrieve.result_status(v, hits, df).collect()} == {"a": "invalid_query", "b": "topk_out_of_range", "c": "topk_out_of_range", "d": "ok", "e": "invalid_query"}
    assert {r.status for r in retrieve.result_status(v.where("query_id = 'd'"), hits.limit(0), df.limit(0)).collect()} == {"library_empty"}


def test_embedding_policy(spark):
    c = spark.createDataFrame([("d", "good"), ("d", "bad"), ("e", "short")], "document_id string, content string")

    def model(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[1.0] * (2 if t == "short" else 3) for t in texts]

    got = {r.content: (r.status, r.attempts, len(r.embedding), r.cause) for r in embed.embed(c.coalesce(1), model, 3).collect()}
    assert got == {"good": ("ok", 1, 3, None), "bad": ("failed", 4, 0, "error: no"), "short": ("failed", 4, 0, "wrong_dimension")}
    assert embed.seeded_vector("a", "m", 4) == embed.seeded_vector("a", "m", 4) != embed.seeded_vector("b", "m", 4)
    assert embed.rejection(None, 8) and embed.rejection("none", 8) and embed.rejection("hash", 8, 9) and embed.rejection("hash", 8, 8) is None
    assert embed.embed_rejected(c, "x").where("attempts = 0 AND status = 'failed'").count() == 3


def test_answers(spark):
    h = spark.createDataFrame([("q", 1, "d", "a\nb" + "c" * 600, "7", ["A", "B"], 0.125), ("q", 2, "e", "t", "UNKNOWN_PAGE", [], 0.5), ("q", 3, "d", "u", "10", [], 0.25)], "query_id string, rank int, document_id string, content string, page_number string, heading_path array<string>, similarity double")
    books = spark.createDataFrame([("d", "T", "W")], "document_id string, title string, author string")
    w = answer.with_books(h, books)
    assert [tuple(r) for r in answer.sources(w).orderBy("place").select("book", "author", "pages").collect()] == [("T", "W", ["7", "10"]), ("Unknown source", "", ["UNKNOWN_PAGE"])]
    qs = spark.createDataFrame([("q", "why?"), ("r", "what?")], "query_id string, text string")
    out = {r.query_id: r.answer for r in answer.extracts(w, qs).collect()}
    assert out["r"] == answer.NO_PASSAGES
    assert out["q"].startswith(answer.OPENING + "\n\n[1] (T, W, section: A > B, p.7, score 0.12)\na b") and "..." in out["q"]
    assert "Question: why?" in answer.prompts(w, qs).first().prompt
    assert answer.choose_provider(None, {"openai"}) == "openai" and answer.choose_provider(None, set()) == "extractive" and answer.choose_provider("ollama", {"openai"}) == "ollama"
    assert spark.range(1).select(answer.effective_top_k(F.lit(0), 5)).first()[0] == 5


def test_pipeline(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.html", b"<html>\n\nalpha beta\n\ngamma</html>"), (2, "b.html", b"<html>delta epsilon</html>"), (3, "c.txt", b"plain")], "submission_id int, filename string, content binary")
    p = P.Pipeline(spark, f"file://{tmp_path}/p", PipelineConfig(embedding_dimension=64, stage_retry_limit=1))
    p.submit(files)
    assert {r.overall_status for r in p.process().collect()} == {"completed"}
    assert {r.progress_percent for r in P.progress(p.states()).collect()} == {100}
    n = p.store.read().count()
    assert p.submit(files).where("outcome = 'accepted'").isEmpty()
    p.process()
    assert p.store.read().count() == n
    hits, status = p.retrieve(spark.createDataFrame([("q", "<html>delta epsilon</html>"), ("r", " ")], "query_id string, text string"), 1)
    assert [(r.query_id, r.content) for r in hits.collect()] == [("q", "<html>delta epsilon</html>")]
    assert {r.query_id: r.status for r in status.collect()} == {"q": "ok", "r": "invalid_query"}
    with pytest.raises(P.UnknownJob):
        p.job("x")
    with pytest.raises(P.ResumeRejected):
        p.resume()


def test_failures_and_resume(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.html", b"<html>alpha</html>"), (2, "b.html", b"<html>beta</html>")], "submission_id int, filename string, content binary")
    broken = {"on": True}

    def chunk_stage(p, docs, elements):
        rows, bad = P.chunk_stage(p, docs, elements)
        if broken["on"]:
            return rows, elements.where("text LIKE '%beta%'").select("document_id", F.lit("made to fail").alias("reason")).distinct()
        return rows, bad

    p = P.Pipeline(spark, f"file://{tmp_path}/p", PipelineConfig(embedding_dimension=64, stage_retry_limit=2), stages={"chunking": chunk_stage})
    p.submit(files)
    assert sorted(((r.overall_status, r.failing_stage) for r in p.process().collect()), key=str) == [("completed", None), ("failed", "chunking")]
    states = p.states()
    bad = states.where("status = 'failed'").collect()
    assert [(r.stage, r.attempts, r.reason) for r in bad] == [("chunking", 3, "made to fail")]
    assert sorted(r.progress_percent for r in P.progress(states).collect()) == [40, 100]
    broken["on"] = False
    assert {r.overall_status for r in p.resume().collect()} == {"completed"}
    assert states.where("stage = 'parsing'").agg(F.max("attempts")).first()[0] == 1


def test_a_change_writes_only_its_buckets(spark, tmp_path):
    s = SnapshotStore(spark, f"file://{tmp_path}", buckets=16)
    s.upsert(records(spark, *[(f"c{i}", f"d{i}") for i in range(60)]))
    before = s.manifest()["folders"]
    s.upsert(records(spark, ("new", "d7")))
    after = s.manifest()
    assert len([b for b in after["folders"] if before.get(b) != after["folders"][b]]) == 1 and len(after["stale"]) == 1
    # a chunk that goes to another document leaves the one it was of
    s.upsert(records(spark, ("c3", "elsewhere")))
    assert s.get_document("d3").isEmpty() and s.read().count() == 61
    # what the change before last had replaced is deleted
    assert not list((tmp_path / "records").glob(after["stale"][0] + "/*.parquet"))
    (tmp_path / "records" / "CURRENT").write_text("damaged")
    assert SnapshotStore(spark, f"file://{tmp_path}").read().isEmpty()


def test_the_last_of_a_batch_wins(spark, tmp_path):
    s = SnapshotStore(spark, f"file://{tmp_path}")
    s.upsert(records(spark, ("1", "a"), ("1", "a"), ("1", "a")).coalesce(1))
    assert [r.order_index for r in s.read().collect()] == [2]


def test_databases():
    assert S.jdbc_url(env={"DATABASE_URL": "postgres://h/d"}) == "jdbc:postgresql://h/d" and S.jdbc_url("jdbc:x") == "jdbc:x" and S.jdbc_url(connection=lambda: "postgresql://h") == "jdbc:postgresql://h"
    with pytest.raises(ValueError):
        S.jdbc_url(env={})
    with pytest.raises(ValueError):
        S.nearest_sql("a; b", [1.0], 3)
    assert S.nearest_sql("t", [1, 2.5], 3, {"document_id": "o'x", "page_number": 4}) == "SELECT *, (embedding <=> '[1.0,2.5]') AS distance FROM t WHERE document_id = 'o''x' AND page_number = 4 ORDER BY distance, document_id LIMIT 3"


@pytest.mark.parametrize("n", [200, 400, 800])
def test_queries_beyond_the_bound_go_in_groups(spark, monkeypatch, n):
    df = spark.createDataFrame([(str(i), "d", i, [float(i % 7), 1.0 + i % 5, float(i % 3)]) for i in range(40)], "chunk_id string, document_id string, order_index bigint, embedding array<double>")
    q = spark.createDataFrame([(i, [float(i % 11), 1.0, 0.5]) for i in range(n // 3)], "query_id bigint, vector array<double>")
    want = {(r.query_id, r["rank"], r.chunk_id) for r in retrieve.batch_top_k(df, q, 2).collect()}
    monkeypatch.setattr(retrieve, "BROADCAST_NUMBERS", 100)
    assert {(r.query_id, r["rank"], r.chunk_id) for r in retrieve.batch_top_k(df, q, 2).collect()} == want and len(want) == 2 * (n // 3)


def test_one_call_a_chunk_and_the_last_artifact_holds(spark, tmp_path):
    calls = tmp_path / "calls"

    def model(texts):
        with open(calls, "a") as f:
            f.write("x\n" * len(texts))
        return [[1.0] * 64 for _ in texts]

    p = P.Pipeline(spark, f"file://{tmp_path}/p", model=model, model_id="counted")
    p.submit(spark.createDataFrame([(i, f"{i}.html", f"<html>text {i}</html>".encode()) for i in range(5)], "submission_id int, filename string, content binary"))
    assert {r.overall_status for r in p.process().collect()} == {"completed"}
    assert len(calls.read_text().split()) == p.store.read().count() == 5
    # the process ended after the artifact was written and before its outcome was: the stage runs again
    one = p.jobs().limit(1)
    again = P.Pipeline(spark, p.path)
    again._from("chunking", one)
    assert again.artifact("chunking").count() == 5 and p.store.read().count() == 5
    with pytest.raises(P.MissingArtifact):
        p.artifact("nothing")
    lame = P.Pipeline(spark, f"file://{tmp_path}/q", PipelineConfig(embedding_dimension=64, embedding_model="unheard of", stage_retry_limit=0))
    lame.submit(spark.createDataFrame([(1, "a.html", b"<html>a</html>")], "submission_id int, filename string, content binary"))
    assert [tuple(r)[1:] for r in lame.process().collect()] == [("failed", "embedding")]
    assert lame.states().where("status = 'failed'").first().reason == "model_unrecognized"
    with pytest.raises(P.QueryNotEmbedded):
        P.Pipeline(spark, p.path, model=lambda ts: 1 / 0).retrieve(spark.createDataFrame([("q", "x")], "query_id string, text string"))[0].count()


def test_pages_without_text_are_read_by_ocr(spark, tmp_path):
    from foliomill.sources.readers import RAW_ITEM
    from foliomill.sources.registry import engines

    def engine(src):
        rows = [("block", 0, 1, "typed text", None), ("page_image", 1, 2, None, "page-2"), ("image", 2, 3, None, "broken")]
        items = spark.createDataFrame(rows, "item_kind string, origin int, page int, text string, image_ref string")
        names = [f.split(" ")[0] for f in RAW_ITEM.split(", ")]
        df = src.select("document_id").crossJoin(items).withColumns({"kind": F.lit("paragraph"), "from_ocr": F.lit(False), "degraded": F.lit(False)})
        return spark.createDataFrame([], RAW_ITEM).unionByName(df, allowMissingColumns=True).select(names)

    def port(ref):
        if ref == "broken":
            raise RuntimeError("no image")
        return "words of the page", 0.4

    engines.register("scans", engine, replace=True)
    p = P.Pipeline(spark, f"file://{tmp_path}/p", engine="scans", ocr_port=port)
    p.submit(spark.createDataFrame([(1, "a.html", b"<html>a</html>")], "submission_id int, filename string, content binary"))
    assert {r.overall_status for r in p.process().collect()} == {"completed"}
    got = p.artifact("parsing").orderBy("position").collect()
    assert [(r.page, r.text, r.source, r.block_type, r.low_confidence) for r in got] == [(1, "typed text", "text_layer", "paragraph", None), (2, "words of the page", "ocr", "ocr_text", True)]
    assert [(r.image_ref, r.error_kind) for r in p.artifact("ocr_errors").collect()] == [("broken", "unreadable")]


def test_providers_and_encoders(spark):
    h = spark.createDataFrame([("q", 1, "d", "a", "7", [], 0.5)], "query_id string, rank int, document_id string, content string, page_number string, heading_path array<string>, similarity double")
    w = answer.with_books(h, spark.createDataFrame([], "document_id string, title string, author string"))
    qs = spark.createDataFrame([("q", "why?"), ("r", "what?")], "query_id string, text string")
    assert {r.query_id: (r.answer, r.error) for r in answer.generate(w, qs, lambda p: p[-7:]).collect()} == {"q": ("Answer:", None), "r": (answer.NO_PASSAGES, None)}
    assert {r.query_id: r.error for r in answer.generate(w, qs, lambda p: 1 / 0).collect()} == {"q": "division by zero", "r": None}

    class Encoder:
        def encode(self, texts, normalize_embeddings, batch_size, show_progress_bar):
            return [[float(len(t)), 1.0] for t in texts]

    e = embed.embed(spark.createDataFrame([("ab",), ("abc",)], "content string"), embed.encoder_port(Encoder), 2)
    assert sorted(tuple(r.embedding) for r in e.collect()) == [(2.0, 1.0), (3.0, 1.0)]


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_bytes(b"<html>alpha</html>")
    p = P.Pipeline(spark, f"file://{tmp_path}/p", PipelineConfig(embedding_dimension=64))
    watch(p, f"file://{tmp_path}/in", f"file://{tmp_path}/c").awaitTermination()
    assert p.store.read().count() == 1
    watch(p, f"file://{tmp_path}/in", f"file://{tmp_path}/c").awaitTermination()
    assert p.store.read().count() == 1
