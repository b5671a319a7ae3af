"""A vector store of Parquet files in buckets of documents.

A change writes the buckets that it touches anew, and a manifest that names the folder of each bucket is replaced at the
end, so that readers see all of a change or nothing of it.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from foliomill.sources.registry import stores

RECORD = "chunk_id string, document_id string, content string, token_count int, order_index bigint, overlap_token_count int, page_number int, heading_path array<string>, is_table_part boolean, model_id string, status string, attempts int, embedding array<double>"
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class PersistenceError(RuntimeError):
    pass


class DocumentNotFound(LookupError):
    pass


def safe_name(name: str) -> str:
    if not NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no table name")
    return name


def vector_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))


def vector_from_text(s: Column) -> Column:
    inner = F.regexp_replace(s, r"^\s*\[|\]\s*$", "")
    return F.when(F.trim(inner) == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(x).cast("double")))


def last_of_each(records: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each chunk_id; of several the last by `order`, else the last of the frame."""
    df = records if order else records.withColumn("__order", F.monotonically_increasing_id())
    by = F.col(order or "__order")
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy("chunk_id").orderBy(by.desc()))).where("__rank = 1").drop("__rank", order or "__order")


class SnapshotStore:
    """Rows lie in folders ``v=ID/bucket=N`` by the hash of their document; the manifest CURRENT names those that hold.

    One writer at a time.  `commit_hook` runs before the manifest is replaced: if it raises, the state before stays.  What a
    change replaces is deleted by the change after it, so a reader that has begun can end.
    """

    def __init__(self, spark: SparkSession, path: str, table: str = "records", commit_hook: Callable[[], None] | None = None, buckets: int = 64):
        self.spark, self.root, self.commit_hook, self._new_buckets = spark, f"{path.rstrip('/')}/{safe_name(table)}", commit_hook, buckets

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def manifest(self) -> dict:
        """buckets: their number; folders: of each bucket that has rows; stale: what the next change deletes.  A missing or damaged one is that of an empty store."""
        fs, p = self._fs(f"{self.root}/CURRENT")
        if fs.exists(p):
            try:
                found = json.loads("".join(r[0] for r in self.spark.read.text(str(p)).collect()))  # one small file
                return {"buckets": int(found["buckets"]), "folders": {int(k): str(v) for k, v in found["folders"].items()}, "stale": [str(x) for x in found["stale"]]}
            except Exception:  # damaged in whatever way
                pass
        return {"buckets": self._new_buckets, "folders": {}, "stale": []}

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(RECORD).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], RECORD)

    def read(self) -> DataFrame:
        """All rows; a store without a readable manifest is empty."""
        return self._rows(list(self.manifest()["folders"].values()))

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64("document_id"), F.lit(n)).cast("int")

    def _install(self, touched: set[int], change: Callable[[DataFrame], DataFrame]) -> None:
        """Writes the touched buckets anew, as `change` makes them of their rows, and replaces the manifest."""
        now = self.manifest()
        name = f"v={uuid.uuid4().hex}"
        fs, new = self._fs(f"{self.root}/{name}")
        replaced = [now["folders"][b] for b in sorted(touched) if b in now["folders"]]
        try:
            rows = change(self._rows(replaced)).select(*[c.split(" ")[0] for c in RECORD.split(", ")]).withColumn("bucket", self._bucket(now["buckets"]))
            # by ranges, so that a document of any size is split, and a file's statistics let a read of one document skip others
            rows.repartitionByRange("bucket", "document_id", "order_index").sortWithinPartitions("bucket", "document_id", "order_index").write.partitionBy("bucket").parquet(f"{self.root}/{name}")
            if self.commit_hook:
                self.commit_hook()
        except Exception as e:
            fs.delete(new, True)
            raise PersistenceError(str(e)) from e
        written = {int(str(f.getPath().getName()).partition("=")[2]) for f in fs.listStatus(new) if f.isDirectory()}
        folders = {b: f for b, f in now["folders"].items() if b not in touched} | {b: f"{name}/bucket={b}" for b in written}
        text = json.dumps({"buckets": now["buckets"], "folders": folders, "stale": replaced})
        fs, p = self._fs(f"{self.root}/CURRENT.new")
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, to = self._fs(f"{self.root}/CURRENT")
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(p), fs.makeQualified(to), overwrite)
        for f in now["stale"]:
            fs, p = self._fs(f"{self.root}/{f}")
            fs.delete(p, True)

    def _staged(self, document_id: str | None, records: DataFrame) -> DataFrame:
        wrong = F.col("chunk_id").isNull() | F.col("document_id").isNull() | (F.col("document_id") != document_id if document_id is not None else F.lit(False))
        if not records.where(wrong).isEmpty():
            raise PersistenceError("a record without ids or of another document")
        return last_of_each(records, "seq" if "seq" in records.columns else None)

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self._bucket(self.manifest()["buckets"])).distinct().collect()}  # at most one row a bucket

    def upsert(self, records: DataFrame, document_id: str | None = None) -> None:
        """Rows with the chunk_ids of the store replace them, whatever their document was."""
        new = self._staged(document_id, records)
        touched = self._touched(new.select("document_id")) | self._touched(self.read().select("chunk_id", "document_id").join(new.select("chunk_id"), "chunk_id", "left_semi"))
        if touched:
            self._install(touched, lambda old: old.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new.select(old.columns)))

    def replace_document(self, document_id: str, records: DataFrame) -> bool:
        """True if there was a version before; no records take the document out."""
        new, one = self._staged(document_id, records), self.spark.createDataFrame([(document_id,)], "document_id string")
        had = not self.get_document(document_id).isEmpty()
        self._install(self._touched(one), lambda old: old.where(F.col("document_id") != document_id).unionByName(new.select(old.columns)))
        return had

    def delete_document(self, document_id: str) -> DataFrame:
        """The chunk_ids that are gone; they can be read until the next change."""
        gone = self.get_document(document_id).select("chunk_id")
        if gone.isEmpty():
            raise DocumentNotFound(document_id)
        self._install(self._touched(self.spark.createDataFrame([(document_id,)], "document_id string")), lambda old: old.where(F.col("document_id") != document_id))
        return gone

    def get_document(self, document_id: str) -> DataFrame:
        """The document's rows in order; only its bucket is read."""
        now = self.manifest()
        bucket = self.spark.range(1).select(F.lit(document_id).alias("document_id")).select(self._bucket(now["buckets"])).first()[0]
        folder = now["folders"].get(bucket)
        return self._rows([folder] if folder else []).where(F.col("document_id") == document_id).orderBy("order_index")


def jdbc_url(url: str | None = None, connection: Callable[[], str] | None = None, env: dict[str, str] | None = None) -> str:
    """Where the database is: given, from a factory, or from the environment (DATABASE_URL); one source at least."""
    found = url or (connection() if connection else None) or (os.environ if env is None else env).get("DATABASE_URL")
    if not found:
        raise ValueError("a database needs its address, a factory of it, or DATABASE_URL")
    return found if found.startswith("jdbc:") else f"jdbc:{found.replace('postgres://', 'postgresql://', 1)}"


def heading_path_text(path: Column) -> Column:
    return F.to_json(F.coalesce(path, F.array().cast("array<string>")))


def heading_path_from_text(s: Column) -> Column:
    return F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))


def nearest_sql(table: str, vector: list[float], top_k: int, filters: dict[str, str | int] | None = None) -> str:
    """The query that lets the database rank by cosine distance; ids and numbers are the only values it takes."""
    where = [f"{safe_name(c)} = " + (str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'") for c, v in (filters or {}).items()]
    numbers = ",".join(repr(float(x)) for x in vector)
    return f"SELECT *, (embedding <=> '[{numbers}]') AS distance FROM {safe_name(table)}" + (" WHERE " + " AND ".join(where) if where else "") + f" ORDER BY distance, document_id LIMIT {max(0, int(top_k))}"


def read_nearest(spark: SparkSession, url: str, table: str, vector: list[float], top_k: int, filters: dict[str, str | int] | None = None, **options: str) -> DataFrame:
    """Hits of a database that ranks vectors itself, with their similarity."""
    from foliomill.operators.retrieve import distance_similarity

    df = spark.read.format("jdbc").option("url", url).option("query", nearest_sql(table, vector, top_k, filters)).options(**options).load()
    return df.withColumns({"heading_path": heading_path_from_text(F.col("heading_path")), "embedding": vector_from_text(F.col("embedding").cast("string")), "similarity": distance_similarity(F.col("distance"))}).drop("distance")


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Rows of a store in an SQL database with the same columns; vectors and paths are texts there."""
    df = spark.read.format("jdbc").option("url", url).option("dbtable", safe_name(table)).options(**options).load()
    return df.withColumns({"embedding": vector_from_text(F.col("embedding").cast("string")), "heading_path": heading_path_from_text(F.col("heading_path"))})


def merge_books(books: DataFrame, new: DataFrame) -> DataFrame:
    """The registry of books after new entries; one row for each document."""
    return books.join(new.select("document_id"), "document_id", "left_anti").unionByName(new.dropDuplicates(["document_id"]))


def write_books(books: DataFrame, path: str) -> None:
    """Writes the registry as JSON lines, beside the old one, which it then replaces."""
    spark = books.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    books.write.mode("overwrite").json(str(new))
    fs = old.getFileSystem(conf)
    fs.delete(old, True)
    fs.rename(new, old)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """A registry in JSON lines; a file that is missing or damaged counts as empty."""
    schema = "document_id string, title string, author string, edition string, year string, source_filename string"
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("document_id IS NOT NULL")
    except Exception:
        return spark.createDataFrame([], schema)


stores.register("pgvector", read_jdbc, replace=True)
stores.register("snapshots", SnapshotStore, replace=True)
