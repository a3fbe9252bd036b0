"""Structured Streaming forms of ingest, document states and query mining."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragloom.durable import materialize, settings, shared_path
from ragloom.functions.text import ascii_tokens, dedup_key
from ragloom.operators.retrieval import embed_texts


def current_version(spark: SparkSession, path: str) -> int:
    """The newest complete version of a table that is written as ``v=<n>`` folders; -1 if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return -1
    names = [s.getPath() for s in fs.listStatus(p)]
    done = [int(n.getName()[2:]) for n in names if n.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
    return max(done, default=-1)


def read_version(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    v = current_version(spark, path) if version is None else version
    return spark.createDataFrame([], schema) if v < 0 else spark.read.schema(schema).parquet(f"{path}/v={v}")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder as a stream, whether it is one file ``<name>.parquet`` or a folder of part files by that name.

    Stream sources read folders: a table that is a folder is read itself, one that is a file is picked out of its folder.
    """
    path = f"{folder}/{name}.parquet"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_file = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if is_file else stream.parquet(path)


#: Buckets of a derived table of U1: a batch rewrites those its documents fall into. A table keeps the number it began with.
BUCKETS = 64
_BUCKET = "_bucket"
#: Snapshots that stay readable, and folders of a cache's bucket above which they become one.
KEPT_SNAPSHOTS, CACHE_FOLDERS = 2, 8
#: A snapshot's manifest: which folders hold each bucket of each table.
_MANIFEST = f"name string, {_BUCKET} int, folder string"
#: Documents that a task of a batch gets at least, so that a small batch of many partitions isn't many small files.
TASK_DOCUMENTS = 256
#: Shuffle files go when the table that needed them is written, not when the driver happens to collect its garbage.
_BATCH_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
VECTORS, CACHE = "vectors", "vector_cache"
VECTOR_SCHEMAS = {VECTORS: "doc_id long, no int, key string, embedding array<float>", CACHE: "key string, embedding array<float>"}


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


Places = dict[tuple[str, int], list[str]]


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Places:
    """``(table, bucket) -> folders`` of a snapshot (the newest by default): what one manifest says about all tables."""
    out: Places = {}
    for r in read_version(spark, f"{path}/manifest", _MANIFEST, version).collect():  # tables times buckets, a few folders each
        out.setdefault((r[0], r[1]), []).append(r[2])
    return out


def _read_places(spark: SparkSession, path: str, name: str, schema: str, places: Places, buckets: set[int] | None = None) -> DataFrame:
    at = [f"{path}/{name}/{folder}/{_BUCKET}={b}" for (n, b), folders in sorted(places.items()) if n == name and (buckets is None or b in buckets) for folder in folders]
    return spark.read.schema(schema).parquet(*at) if at else spark.createDataFrame([], schema)


def read_derived(spark: SparkSession, path: str, schema: str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """A derived table of U1, ``<root>/<table>``, as of a snapshot (the newest by default), all of it or some of its buckets.

    Tables read with the same ``version`` belong to the same batch.
    """
    root, name = path.rstrip("/").rsplit("/", 1)
    return _read_places(spark, root, name, schema, snapshot(spark, root, version), buckets)


def _bucket_of(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def _among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose document is (``left_semi``) or isn't (``left_anti``) among ``ids (doc_id)``; null is a document too."""
    return rows.join(ids.select(F.col("doc_id").alias("_id")), F.col("doc_id").eqNullSafe(F.col("_id")), how)


class Batch:
    """One batch's writing: tables see the snapshot before it and add folders of their own; the manifest comes last."""

    def __init__(self, spark: SparkSession, path: str, version: int, buckets: int):
        self.spark, self.path, self.version, self.buckets = spark, path, version, buckets
        self.places = snapshot(spark, path, min(current_version(spark, f"{path}/manifest"), version - 1))

    def touched(self, rows: DataFrame, key: str) -> set[int]:
        return {r[0] for r in rows.select(_bucket_of(key, self.buckets)).distinct().collect()}  # at most ``buckets`` numbers

    def read(self, name: str, schema: str, buckets: set[int] | None = None) -> DataFrame:
        return _read_places(self.spark, self.path, name, schema, self.places, buckets)

    def write(self, name: str, schema: str, rows: DataFrame, key: str, replaced: set[int] | None, direct: bool = False) -> DataFrame:
        """Adds rows by bucket of ``key``; of ``replaced`` buckets nothing else stays. Returns what was written.

        ``direct``: the tasks that make the rows write them, each a file for each bucket. Else rows are shuffled, so that a bucket is
        as many tasks as its size asks for: one task would spill all of it.
        """
        folder = f"v={self.version}.{uuid.uuid4().hex}"  # a repeated batch writes beside what an earlier try has left
        at, rows = f"{self.path}/{name}/{folder}", rows.withColumn(_BUCKET, _bucket_of(key, self.buckets))
        # one more than buckets: a task that has as many open files as this sorts the rest of its rows by bucket
        with settings(self.spark, {"spark.sql.maxConcurrentOutputFileWriters": str(self.buckets + 1)}):
            (rows if direct else rows.hint("rebalance", _BUCKET)).write.mode("append").option("compression", "zstd").partitionBy(_BUCKET).parquet(at)
        for b in replaced or ():
            self.places.pop((name, b), None)
        for x in _names(self.spark, at):
            if x.startswith(f"{_BUCKET}="):  # a bucket left empty has no folder
                self.places.setdefault((name, int(x.rsplit("=", 1)[1])), []).append(folder)
        return self.spark.read.schema(schema).parquet(at).drop(_BUCKET)

    def replace(self, name: str, schema: str, rows: DataFrame, changed: DataFrame, touched: set[int]) -> DataFrame:
        """Rows of ``changed`` documents, which fall into the buckets ``touched``, instead of those they had. Returns what was written of ``rows``.

        Which old documents stay is found from their ids alone; a bucket that keeps none isn't read, the others are written anew.
        """
        ids = materialize(_among(self.read(name, schema, touched).select("doc_id").distinct(), changed, "left_anti"), "kept-documents")
        left = self.touched(ids, "doc_id")
        old = self.read(name, schema, left)
        written = self.write(name, schema, rows, "doc_id", touched, direct=True)
        if left:
            kept = _among(old, ids, "left_semi") if ids.count() < changed.count() else _among(old, changed, "left_anti")
            self.write(name, schema, kept, "doc_id", None)
        return written

    def commit(self, keep: int) -> None:
        rows = [(name, b, folder) for (name, b), folders in self.places.items() for folder in folders]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={self.version}")
        remove_unnamed(self.spark, self.path, keep)


def remove_unnamed(spark: SparkSession, path: str, keep: int = KEPT_SNAPSHOTS) -> list[str]:
    """Removes manifests but the newest ``keep``, then the folders up to the newest snapshot that no manifest names."""
    done = sorted((int(x[2:]) for x in _names(spark, f"{path}/manifest") if x.startswith("v=")), reverse=True)
    newest = current_version(spark, f"{path}/manifest")
    named = {(name, folder) for v in done[:keep] for (name, _), folders in snapshot(spark, path, v).items() for folder in folders}
    gone = [f"{path}/manifest/v={v}" for v in done[keep:]]
    for name in _names(spark, path):
        if name != "manifest":
            folders = [x for x in _names(spark, f"{path}/{name}") if x.startswith("v=")]
            gone += [f"{path}/{name}/{x}" for x in folders if (name, x) not in named and int(x[2:].split(".")[0]) <= newest]
    for x in gone:
        p, fs = _hadoop(spark, x)
        fs.delete(p, True)
    return gone


def _vectors(batch: Batch, chunks: DataFrame, changed: DataFrame, touched: set[int], embed: Callable, dim: int) -> None:
    """Vectors of changed documents' chunks. Vectors are cached by a hash of the chunk's text, so only texts that were never seen go
    through the model; a failed text gets a zero vector, which isn't cached. Texts are shuffled once, by the hash's 32 bytes."""
    schema = VECTOR_SCHEMAS[CACHE]
    digest, text = F.unhex("key").alias("digest"), F.lower(F.hex("digest")).alias("key")
    keyed = chunks.select("doc_id", "no", F.sha2("chunk", 256).alias("key"), "chunk")
    known = batch.read(CACHE, schema, batch.touched(keyed, "key")).select(digest, "embedding")
    needed = keyed.select(digest, F.col("chunk").alias("text")).dropDuplicates(["digest"])
    new = needed.join(known.select("digest"), "digest", "left_anti")
    made = embed_texts(new.withColumnRenamed("digest", "chunk_id"), embed, dim=dim).withColumnRenamed("chunk_id", "digest")
    written = batch.write(CACHE, schema, made.select(text, "embedding").where(F.exists("embedding", lambda x: x != 0)), "key", None, direct=True)
    zero = F.array(*[F.lit(0.0)] * dim).cast("array<float>")
    rows = keyed.select("doc_id", "no", digest).join(known.unionByName(written.select(digest, "embedding")), "digest", "left")
    batch.replace(VECTORS, VECTOR_SCHEMAS[VECTORS], rows.select("doc_id", "no", text, F.coalesce("embedding", zero).alias("embedding")), changed, touched)
    full = {b for (name, b), folders in batch.places.items() if name == CACHE and len(folders) > CACHE_FOLDERS}
    if full:
        batch.write(CACHE, schema, batch.read(CACHE, schema, full), "key", full)


def ingest_stream(
    documents: DataFrame, path: str, checkpoint: str, derive: Callable[[DataFrame], dict[str, DataFrame]], schemas: dict[str, str], buckets: int = BUCKETS,
    embed: Callable | None = None, dim: int = 64, keep: int = KEPT_SNAPSHOTS,
) -> StreamingQuery:
    """Each batch of changed documents replaces their rows in every derived table, in all of them at once.

    A table is cut into ``buckets`` by document. Batch ``n`` writes the rows of its documents by bucket into a folder of its own,
    and those of other documents in the same buckets into another; last comes one manifest that names the folders of all tables. A reader holds to
    a manifest, so it sees all tables of one batch; a batch that stops half-way has no manifest and is repeated. With ``embed``
    the table ``vectors`` of the derived ``chunks`` is kept too (see ``_vectors``). ``keep`` snapshots stay readable; folders
    that none of them names are removed.
    """

    def merge(rows: DataFrame, batch_id: int) -> None:
        with settings(rows.sparkSession, _BATCH_SETTINGS):
            batch = Batch(rows.sparkSession, path, batch_id, buckets)
            changed = materialize(rows.select("doc_id").distinct(), "changed-documents")
            touched = batch.touched(changed, "doc_id")
            shares = -(-changed.count() // TASK_DOCUMENTS)
            written = {name: batch.replace(name, schemas[name], new, changed, touched) for name, new in derive(rows.coalesce(max(1, shares))).items()}
            if embed is not None:
                _vectors(batch, written["chunks"], changed, touched, embed, dim)
            batch.commit(keep)

    return documents.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunk_tables(batch: DataFrame) -> dict[str, DataFrame]:
    """Derived tables of U1 for plain documents ``(doc_id, text[, arrived])``: chunks and postings.

    Of a document that arrives more than once in a batch the version with the latest ``arrived`` stands (of the same time the
    greatest text); without that column such a document stops the batch, as nothing says which version is the last.
    """
    from ragloom.functions.chunking import char_windows

    # texts of documents that come once, most of them, needn't be shuffled to find the last version
    repeated = materialize(batch.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-documents")
    last = batch.select("doc_id", "text")
    if not repeated.isEmpty():
        versions = _among(batch, repeated, "left_semi").groupBy("doc_id")
        if "arrived" in batch.columns:
            one = versions.agg(F.max_by("text", F.struct("arrived", "text")).alias("text"))
        else:
            unlike = F.when(F.count_distinct(F.coalesce("text", F.lit(""))) > 1, F.raise_error(F.concat(F.lit("a batch holds two versions of document "), F.col("doc_id").cast("string"))).cast("string"))
            one = versions.agg(F.coalesce(unlike, F.max("text")).alias("text"))
        last = _among(last, repeated, "left_anti").unionByName(one)
    chunks = char_windows(last.select("doc_id", F.lit(None).cast("string").alias("title"), F.col("text").alias("contents"))).select("doc_id", "no", "chunk")
    return {"chunks": chunks, "postings": _postings(chunks)}


def _postings(chunks: DataFrame) -> DataFrame:
    """``(doc_id, no, term, tf)``, counted within each row: a term's number is the length of its run among the sorted tokens."""
    tokens = chunks.select("doc_id", "no", F.sort_array(ascii_tokens(F.col("chunk"))).alias("ts"))
    starts = F.filter(F.sequence(F.lit(0), F.size("ts")), lambda i: (i == 0) | (i == F.size("ts")) | (F.get("ts", i) != F.get("ts", i - 1)))
    x = tokens.select("doc_id", "no", "ts", starts.alias("at"))
    runs = F.zip_with(F.slice("at", 1, F.size("at") - 1), F.slice("at", 2, F.size("at")), lambda a, b: F.struct(F.get("ts", a).alias("term"), (b - a).cast("long").alias("tf")))
    return x.select("doc_id", "no", F.inline(runs))


CHUNK_SCHEMAS = {"chunks": "doc_id long, no int, chunk string", "postings": "doc_id long, no int, term string, tf long"}


def latest_states(events: DataFrame) -> DataFrame:
    """``(doc_id, state, ts, event_id)``: the newest state of each document; older updates that come late change nothing."""
    return events.groupBy("doc_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("ts"))


def stale_sessions(events: DataFrame, minutes: int, in_progress: tuple[str, ...], late: str = "1 hour") -> DataFrame:
    """A document's events up to a gap of ``minutes``; sessions that end in progress are alarms, once the watermark passes them."""
    x = events.withWatermark("ts", late)
    s = x.groupBy("doc_id", F.session_window("ts", f"{minutes} minutes").alias("w")).agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n"))
    return s.where(F.col("state").isin(*in_progress)).select("doc_id", "state", "n", F.col("w.end").alias("stale_at"))


def mined_queries(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """U4: ``(ts, text)``: distinct questions by their compact form within the watermark."""
    x = messages.withColumn("norm", dedup_key(F.col("text"))).where("norm <> ''")
    return x.withWatermark("ts", late).dropDuplicatesWithinWatermark(["norm"])


def stage_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by stage and tumbling window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "state").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "state", "n")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there, each batch into a version of a Parquet table beside its checkpoint.

    In complete mode the newest version is the result, otherwise all of them are. Nothing passes the driver, and without
    ``checkpoint`` offsets and state are in a fresh folder of the shared one.
    """
    spark = stream.sparkSession
    at = checkpoint or shared_path(spark, name)
    table = f"{at}-table"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/v={batch_id}")

    w = stream.writeStream.foreachBatch(write).queryName(name).outputMode(mode).trigger(availableNow=True)
    w.option("checkpointLocation", at).start().awaitTermination()
    if mode == "complete" or current_version(spark, table) < 0:
        return read_version(spark, table, stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{table}/v=*")
