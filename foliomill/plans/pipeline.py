"""Stages over batches of documents: every stage writes an artifact table, failures are rows, and failed jobs can go on later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliomill.config import PipelineConfig
from foliomill.operators import chunk, embed, ingest, layout, normalize, ocr, retrieve
from foliomill.session import staged
from foliomill.sources import readers
from foliomill.sources.registry import engines
from foliomill.sources.store import SnapshotStore

# The stages in their order.
STAGES = ("parsing", "normalization", "chunking", "embedding", "storage")
RETRIEVAL_SECONDS = 2.0
#: Hits are broadcast up to this many rows.
MOST_HITS = 200_000
TRANSITION = "seq bigint, job_id string, stage string, status string, at timestamp, reason string"

#: A stage takes (pipeline, documents, artifact of the stage before) and gives (artifact rows, failures).
Stage = Callable[["Pipeline", DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]

engines.register("text", readers.text_layer, replace=True)
engines.register("pypdf", readers.pdf_pages, replace=True)
engines.register("docling", readers.layout_json, replace=True)
engines.register("llamaparse", readers.page_json, replace=True)


class UnknownJob(LookupError):
    pass


class ResumeRejected(RuntimeError):
    pass


class MissingArtifact(LookupError):
    pass


class QueryNotEmbedded(RuntimeError):
    pass


# ---- views over the log of transitions


def stage_states(jobs: DataFrame, transitions: DataFrame) -> DataFrame:
    """job_id, stage, status, attempts, reason for each job and stage; what has not begun is pending."""
    stages = jobs.select("job_id", F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))
    seen = transitions.groupBy("job_id", "stage").agg(F.max_by("status", "seq").alias("status"), F.sum((F.col("status") == "running").cast("int")).alias("attempts"), F.max_by("reason", "seq").alias("reason"))
    return stages.join(seen, ["job_id", "stage"], "left").withColumns({"status": F.coalesce("status", F.lit("pending")), "attempts": F.coalesce("attempts", F.lit(0))})


def progress(states: DataFrame) -> DataFrame:
    """job_id, progress_percent: finished stages in percent of all."""
    done = F.sum((F.col("status") == "succeeded").cast("int"))
    return states.groupBy("job_id").agg(F.floor(done * 100 / len(STAGES)).cast("int").alias("progress_percent"))


def outcomes(states: DataFrame) -> DataFrame:
    """job_id, overall_status (queued, processing, completed, failed), failing_stage."""
    n = lambda s: F.sum((F.col("status") == s).cast("int"))
    failing = F.min_by(F.when(F.col("status") == "failed", F.col("stage")), F.when(F.col("status") == "failed", F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))))
    g = states.groupBy("job_id").agg(n("succeeded").alias("done"), n("failed").alias("bad"), n("pending").alias("open"), failing.alias("failing_stage"))
    return g.select("job_id", F.when(F.col("bad") > 0, "failed").when(F.col("done") == len(STAGES), "completed").when(F.col("open") == len(STAGES), "queued").otherwise("processing").alias("overall_status"), "failing_stage")


def unstored(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks that should be in the store and are not."""
    return expected.select("document_id", "chunk_id").join(stored.select("chunk_id"), "chunk_id", "left_anti")


# ---- the stages


def _none(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], "document_id string, reason string")


def parse_stage(p: Pipeline, docs: DataFrame, _: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    src = docs.join(p.sources(), "document_id", "left")
    lost = src.where("content IS NULL").select("document_id", F.lit("parse_error").alias("kind"), F.lit("the content is not retained").alias("reason"))
    try:
        items = engines.create(p.engine, src.where("content IS NOT NULL"))
    except (LookupError, RuntimeError) as e:
        why = docs.select("document_id", F.lit(f"engine_unavailable: {e}").alias("reason"))
        return p.spark.createDataFrame([], readers.RAW_ITEM), why
    # an engine may be slow and is asked once; what it found to be read by OCR are rows of their own
    items = staged(items, "items")
    images = items.where("item_kind IN ('page_image', 'image')")
    items = items.where("item_kind NOT IN ('page_image', 'image')")
    if p.ocr is not None:
        page = F.col("item_kind") == "page_image"
        wanted = ocr.images_to_read(
            images.where(page).select("document_id", "page", F.lit(False).alias("has_text_layer"), F.col("image_ref").alias("page_image_ref")),
            images.where(~page).select("document_id", "page", "image_ref", F.lit(True).alias("has_text")),
        )
        results = staged(ocr.read_images(wanted, p.ocr, p.config.ocr_page_timeout_seconds), "ocr")
        blocks, errors = ocr.split_results(results, p.config.ocr_confidence_threshold)
        items = items.unionByName(blocks, allowMissingColumns=True)
        p.put_artifact("ocr_errors", errors)
    items = layout.with_origins(items)
    status = layout.parse_status(docs, items, lost)
    bad = status.where("parse_status = 'failed'").select("document_id", F.col("parse_reason").alias("reason"))
    return layout.parsed_items(items), bad


def normalize_stage(p: Pipeline, docs: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return normalize.clean(parsed, p.dictionary), _none(docs)


def chunk_stage(p: Pipeline, docs: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    return chunk.chunk_elements(elements, p.config.max_chunk_tokens, p.config.chunk_overlap_tokens), _none(docs)


def embed_stage(p: Pipeline, docs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    why = embed.rejection(p.model_id, p.config.embedding_dimension) if p.model is None else None
    if why is not None:
        out = embed.embed_rejected(chunks, why)
    elif p.model is None:
        out = embed.embed_hashed(chunks, "hash", p.config.embedding_dimension)
    else:
        # the port is called once for a chunk: artifact and outcome come from the same rows
        out = staged(embed.embed(chunks, p.model, p.config.embedding_dimension, p.config.embedding_timeout_seconds, 1 + p.config.embedding_max_retries), "embedded")
    bad = embed.failed_documents(out).withColumn("reason", F.lit(why or "a chunk could not be embedded"))
    return out.withColumn("model_id", F.lit(p.model_id)), bad


def store_stage(p: Pipeline, docs: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = records.select([c.split(" ")[0] for c in _record_columns()])
    rows = staged(rows, "records")
    p.store.upsert(rows)
    missing = unstored(rows, p.store.read()).select("document_id").distinct().withColumn("reason", F.lit("chunks are not stored"))
    return rows.select("document_id", "chunk_id"), missing


def _record_columns() -> list[str]:
    from foliomill.sources.store import RECORD

    return RECORD.split(", ")


DEFAULT_STAGES: dict[str, Stage] = dict(zip(STAGES, (parse_stage, normalize_stage, chunk_stage, embed_stage, store_stage)))


class Pipeline:
    """Jobs, sources, artifacts, transitions and records under one shared folder."""

    def __init__(self, spark: SparkSession, path: str, config: PipelineConfig | None = None, engine: str | None = "text", model: Callable | None = None, model_id: str | None = None, dictionary: DataFrame | None = None, stages: dict[str, Stage] | None = None, ocr_port: Callable[[str], tuple[str, float]] | None = None):
        """`engine` None takes the configured one, `model_id` None the configured model, else the hash model."""
        self.spark, self.path, self.model, self.dictionary, self.ocr = spark, path.rstrip("/"), model, dictionary, ocr_port
        self.config = config or PipelineConfig(embedding_dimension=64)
        self.engine, self.model_id = engine or self.config.parsing_engine, model_id or self.config.embedding_model or "hash"
        self.stages = DEFAULT_STAGES | (stages or {})
        self.store = SnapshotStore(spark, f"{self.path}/store")

    def _read(self, name: str, schema: str) -> DataFrame:
        fs, p = self.store._fs(f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(str(p)) if fs.exists(p) else self.spark.createDataFrame([], schema)

    def jobs(self) -> DataFrame:
        return self._read("jobs", "job_id string, document_id string, filename string, doc_format string, byte_size int, content_hash string, submitted_at_utc timestamp, current_stage string, overall_status string, progress_percent int")

    def sources(self) -> DataFrame:
        return self._read("sources", "document_id string, content binary")

    def transitions(self) -> DataFrame:
        return self._read("transitions", TRANSITION)

    def states(self) -> DataFrame:
        return stage_states(self.jobs(), self.transitions())

    def job(self, job_id: str) -> DataFrame:
        one = self.jobs().where(F.col("job_id") == job_id)
        if one.isEmpty():
            raise UnknownJob(job_id)
        return one

    def submit(self, files: DataFrame) -> DataFrame:
        """submission_id, filename, content → the outcome of each; accepted ones become jobs."""
        gated = staged(ingest.gate(files, self.config), "gated")
        out = staged(ingest.submit(gated, self.jobs()), "submitted")
        kept = ingest.retained_sources(out, gated).join(self.sources().select("document_id"), "document_id", "left_anti")
        kept.write.mode("append").parquet(f"{self.path}/sources")
        ingest.new_jobs(out, gated).write.mode("append").parquet(f"{self.path}/jobs")
        return out

    def _last_seq(self) -> int:
        if getattr(self, "_seq", None) is None:
            self._seq = self.transitions().agg(F.max("seq")).first()[0] or 0
        return self._seq

    def _record(self, jobs: DataFrame, stage: str, status: str) -> None:
        self._seq = self._last_seq() + 1
        reason = F.col("reason") if "reason" in jobs.columns else F.lit(None).cast("string")
        jobs.select(F.lit(self._seq).cast("bigint").alias("seq"), "job_id", F.lit(stage).alias("stage"), F.lit(status).alias("status"), F.current_timestamp().alias("at"), reason.alias("reason")).coalesce(1).write.mode("append").parquet(f"{self.path}/transitions")

    def has_artifact(self, stage: str) -> bool:
        fs, p = self.store._fs(f"{self.path}/artifacts/{stage}")
        return fs.exists(p)

    def put_artifact(self, stage: str, rows: DataFrame) -> None:
        """Rows of documents; those of a document that are put later stand for the ones before."""
        self._runs = max(getattr(self, "_runs", 0) + 1, self._last_seq())
        rows.withColumn("run", F.lit(self._runs).cast("bigint")).write.mode("append").parquet(f"{self.path}/artifacts/{stage}")

    def artifact(self, stage: str, docs: DataFrame | None = None) -> DataFrame:
        """The last rows that were put for each document, of `docs` only if given."""
        if not self.has_artifact(stage):
            raise MissingArtifact(stage)
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/artifacts/{stage}")
        if docs is not None:
            rows = rows.join(docs.select("document_id"), "document_id", "left_semi")
        return rows.join(rows.groupBy("document_id").agg(F.max("run").alias("run")), ["document_id", "run"], "left_semi").drop("run")

    def process(self, jobs: DataFrame | None = None) -> DataFrame:
        """Runs all stages of the given jobs (by default of those not begun) and gives their outcomes."""
        alive = jobs if jobs is not None else self.jobs().join(self.transitions().select("job_id").distinct(), "job_id", "left_anti")
        return self._from(STAGES[0], alive)

    def resume(self, job_ids: list[str] | None = None) -> DataFrame:
        """Failed jobs go on at the stage that failed, from the artifact of the stage before."""
        states = outcomes(self.states()).where("overall_status = 'failed'")
        if job_ids is not None:
            states = states.where(F.col("job_id").isin(job_ids))
        if states.isEmpty():
            raise ResumeRejected("no failing stage is recorded")
        failed = staged(states.join(self.jobs().select("job_id", "document_id"), "job_id"), "failed")
        for stage in STAGES:
            some = failed.where(F.col("failing_stage") == stage).select("job_id", "document_id")
            if not some.isEmpty():
                self._from(stage, some)
        return outcomes(self.states())

    def _from(self, first: str, alive: DataFrame) -> DataFrame:
        alive = staged(alive.select("job_id", "document_id"), "alive")
        for at, stage in enumerate(STAGES):
            if at < STAGES.index(first):
                continue
            todo, done = alive, None
            for _ in range(1 + self.config.stage_retry_limit):
                if todo.isEmpty():
                    break
                self._record(todo, stage, "running")
                before = self.artifact(STAGES[at - 1], todo) if at else None
                try:
                    rows, bad = self.stages[stage](self, todo.select("document_id"), before)
                    bad = staged(todo.join(bad, "document_id"), "failed")
                    # only what the good documents produced is kept
                    self.put_artifact(stage, rows.join(bad.select("document_id"), "document_id", "left_anti"))
                except Exception as e:
                    bad = staged(todo.withColumn("reason", F.lit(str(e)[:1000])), "failed")
                good = staged(todo.join(bad.select("job_id"), "job_id", "left_anti"), "good")
                self._record(bad, stage, "failed")
                self._record(good, stage, "succeeded")
                done = good if done is None else done.unionByName(good)
                todo = bad.select("job_id", "document_id")
            alive = done if done is not None else alive.limit(0)
        return outcomes(self.states())

    def retrieve(self, queries: DataFrame, k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(hits, statuses) of query_id, text: embedded by the hash model or the port, scored against the whole store."""
        k = k or self.config.default_top_k
        q = queries.withColumn("error", retrieve.validate(F.col("text"), F.lit(k), self.config.max_query_chars))
        fine = q.where("error IS NULL")
        if self.model is None:
            v = fine.select("query_id", embed.hash_embedding(F.col("text"), "hash", self.config.embedding_dimension).alias("vector"))
        else:
            done = staged(embed.embed(fine.select("query_id", F.col("text").alias("content")), self.model, self.config.embedding_dimension, RETRIEVAL_SECONDS), "queries")
            lost = done.where("status != 'ok'").select("cause").first()
            if lost is not None:
                raise QueryNotEmbedded(lost[0])
            v = done.select("query_id", F.col("embedding").alias("vector"))
        store = self.store.read()
        # no more than k rows a query: the store is filtered by them, not shuffled
        best = staged(retrieve.batch_top_k(store, v, k), "best")
        few = F.broadcast(best) if best.count() <= MOST_HITS else best
        hits = retrieve.placeholders(store.select("chunk_id", "content", "page_number", "heading_path").join(few, "chunk_id"))
        return hits, retrieve.result_status(q, hits, store)
