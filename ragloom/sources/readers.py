"""Scans and sinks. Every JSON reader has a schema; nothing is inferred."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.durable import materialize, settings
from ragloom.functions.text import clean_text, reflow_paragraphs, strip

BENCHMARK = "id string, question string, golden_answers array<string>"
CORPUS = "id string, title string, contents string"
EVAL_ITEM = "item_id string, kb_id string, query string, relevant_chunk_ids array<string>, gold_answer string, tags array<string>, source string"
RICH_CHUNK = (
    "id string, title string, contents string, doc string, kb_id string, source_type string, parser string, vector_id string, context string, "
    "structure struct<heading_path: array<string>, heading_level: int, step_number: int, page_idx: int>, "
    "images array<struct<path: string, caption: string, page_idx: int, img_id: string>>, tables array<struct<markdown: string, caption: string, page_idx: int>>"
)
#: First bytes of image formats, as hex.
IMAGE_MAGIC = ("ffd8ff", "89504e470d0a1a0a", "474946383761", "474946383961", "424d", "52494646")
IMAGE_NAMES = r"(?i)\.(jpe?g|png|gif|bmp|webp)$"


#: Folders of a tree that is written as files, and what a file counts beside its bytes where a task's share of a tree is cut.
FOLDERS, FILE_COST = 256, 65_536
#: Bytes of files that a task reads, and bytes or files that it hands on at once.
TASK_BYTES, BATCH_BYTES, BATCH_FILES = 64 << 20, 4 << 20, 4096
#: Files that Spark's readers leave out, by name.
HIDDEN = re.compile(r"_[^=]*\Z|\.|.*\._COPYING_\Z", re.S)
_LEVEL = "root int, rel string, is_dir boolean, length long, modified long"


def benchmark(spark: SparkSession, path: str, schema: str = BENCHMARK) -> DataFrame:
    """Json lines, a json array, or parquet, by extension."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "jsonl":
        return spark.read.schema(schema).json(path)
    if kind == "json":
        return spark.read.schema(schema).option("multiLine", True).json(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown benchmark format: {kind}")


def key_map(df: DataFrame, keys: dict[str, str], limit: int = -1, shuffle: bool = False, seed: int = 42, order: list[Column] | None = None) -> DataFrame:
    """Alias <- source column (absent ones are null); an optional seeded shuffle comes before the limit."""
    if not keys:
        raise ValueError("key_map is empty")
    if limit != -1 and limit < 1:
        raise ValueError("limit is -1 or at least 1")
    cols = [(df[src] if src in df.columns else F.lit(None).cast("string")).alias(alias) for alias, src in keys.items()]
    if shuffle:
        df = df.orderBy(*(order or [F.xxhash64(F.lit(seed), F.to_json(F.struct(*df.columns)))]))
    out = df.select(*cols)
    return out if limit == -1 else out.limit(limit)


def corpus(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """Json lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_corpus(df: DataFrame, path: str, json: bool = False) -> None:
    """Parquet, or json lines."""
    (df.write.mode("overwrite").json if json else df.write.mode("overwrite").parquet)(path)


def tolerant_chunks(spark: SparkSession, path: str, schema: str = RICH_CHUNK) -> DataFrame:
    """A missing file is empty, bad lines go."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], schema)
    kind = T._parse_datatype_string(schema + ", _corrupt_record string")
    rows = spark.read.schema(kind).option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def strict_corpus(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """Bad json or missing contents fail the job."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.withColumn("contents", F.when(F.col("contents").isNull(), F.raise_error(F.lit("contents is missing")).cast("string")).otherwise(F.col("contents")))


def lenient_index(spark: SparkSession, path: str) -> DataFrame:
    """``(text, metadata map, file_name, segment_id)``: bad lines and blank contents go; the line number stays."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.posexplode(F.split("value", "\n")).alias("segment_id", "line"))
    x = files.withColumn("m", F.from_json("line", "map<string,string>")).withColumn("text", F.try_element_at("m", F.lit("contents")))
    return x.where(strip(F.coalesce("text", F.lit(""))) != "").select("text", F.map_filter("m", lambda k, v: k != "contents").alias("metadata"), "file_name", "segment_id")


def write_tree(files: DataFrame, path: str, extension: str) -> None:
    """``(text)`` as a tree with a file for each row, ``<folder>/part-<n>.<extension>``, a line end after the text.

    The tasks write the files themselves: a commit of Spark's writer renames file by file on the driver. Names come from the
    row's place in its partition, so a repeated task writes the same files again: ``files`` is a scan, without a shuffle.
    """
    base = files.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    base.getFileSystem(files.sparkSession._jsc.hadoopConfiguration()).mkdirs(base)  # there for an empty table too

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        made = set()
        for b in batches:
            for n, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folder = f"{root}/{n % FOLDERS}"
                if folder not in made:
                    fs.create_dir(folder)
                    made.add(folder)
                with fs.open_output_stream(f"{folder}/part-{n}.{extension}", compression=None) as f:
                    f.write(f"{text or ''}\n".encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    files.select(F.monotonically_increasing_id(), "text").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def _listed(spark: SparkSession, roots: list[tuple[str, str]], found: DataFrame) -> DataFrame:
    """``(root, rel, is_dir, length, modified)`` of the files below ``found``. Tasks list the folders of a level, the next job those they found there."""
    schema = pa.schema([("root", pa.int32()), ("rel", pa.string()), ("is_dir", pa.bool_()), ("length", pa.int64()), ("modified", pa.int64())])

    def listed(batches):
        stores = [pafs.FileSystem.from_uri(uri) for _, uri in roots]
        for b in batches:
            for r, rel in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, top = stores[r]
                below = [x for x in fs.get_file_info(pafs.FileSelector(f"{top}/{rel}" if rel else top)) if x.type in (pafs.FileType.File, pafs.FileType.Directory) and not HIDDEN.match(x.base_name)]
                for lo in range(0, len(below), BATCH_FILES):
                    rows = [(r, f"{rel}/{x.base_name}" if rel else x.base_name, x.type == pafs.FileType.Directory, x.size or 0, (x.mtime_ns or 0) // 1_000_000) for x in below[lo : lo + BATCH_FILES]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files, folders = found.where("not is_dir"), found.where("is_dir")
    while n := folders.count():
        tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
        found = materialize(folders.select("root", "rel").repartition(tasks).mapInArrow(listed, _LEVEL), "tree-level")
        files, folders = files.unionByName(found.where("not is_dir")), found.where("is_dir")
    return files.where("length > 0")


def _tree(spark: SparkSession, path: str, names: str, first_bytes: int | None, name: str) -> DataFrame:
    """``(path, modificationTime, length, content)`` of the files of a tree whose path matches ``names``, as Spark's ``binaryFile`` gives them:
    hidden and empty files are left out. ``content`` is the whole file, its first bytes, or null where none are asked for.

    The tasks list the folders and read the files, many to a task, so that the driver holds no file names. A folder's own names are held by one task.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    if not there:
        raise FileNotFoundError(path)
    roots = [(s.getPath().toString().rstrip("/"), s.getPath().toUri().toString()) for s in there]
    try:
        for _, uri in roots:
            pafs.FileSystem.from_uri(uri)
    except (OSError, pa.ArrowException):  # a store that only Spark reads: its listing is held by the driver
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("path").rlike(names))
        content = F.lit(None).cast("binary") if first_bytes == 0 else F.col("content") if first_bytes is None else F.substring("content", 1, first_bytes)
        with settings(spark, {"spark.sql.files.openCostInBytes": str(FILE_COST), "spark.sql.files.maxPartitionBytes": str(TASK_BYTES)}):
            return materialize(files.select("path", "modificationTime", "length", content.alias("content")), name)
    tops = [(i, "", s.isDirectory(), s.getLen(), s.getModificationTime()) for i, s in enumerate(there)]
    found = _listed(spark, roots, spark.createDataFrame(tops, _LEVEL))
    full = F.element_at(F.array(*[F.lit(base) for base, _ in roots]), F.col("root") + 1)
    full = F.when(F.col("rel") == "", full).otherwise(F.concat(full, F.lit("/"), F.col("rel")))
    files = found.select("root", "rel", full.alias("path"), F.timestamp_millis("modified").alias("modificationTime"), "length").where(F.col("path").rlike(names))
    if first_bytes == 0:
        return files.select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))

    def read(batches):
        stores = [pafs.FileSystem.from_uri(uri) for _, uri in roots]
        for b in batches:
            held, size, lo = [], 0, 0
            for i, (r, rel) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                fs, top = stores[r]
                with fs.open_input_file(f"{top}/{rel}" if rel else top) as f:
                    held.append(f.read(first_bytes))
                size += len(held[-1])
                if size >= BATCH_BYTES or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.slice(lo, len(held)).columns[2:], pa.array(held, pa.binary())], names=["path", "modificationTime", "length", "content"])
                    held, size, lo = [], 0, i + 1

    n, total = files.agg(F.count("*"), F.sum("length")).first()
    tasks = 1 + (n * FILE_COST + (total or 0 if first_bytes is None else 0)) // TASK_BYTES
    return files.repartition(tasks).mapInArrow(read, "path string, modificationTime timestamp, length long, content binary")


def _stem() -> Column:
    return F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")


def text_corpus(spark: SparkSession, path: str, reflow: bool = False) -> DataFrame:
    """Text files of a tree: the stem is id and title, contents are cleaned, empty ones go."""
    body = clean_text(F.col("content").cast("string"))
    files = _tree(spark, path, r"\.(txt|md)\z", None, "text-files")
    out = materialize(files.select(_stem().alias("id"), _stem().alias("title"), (reflow_paragraphs(body) if reflow else body).alias("contents")), "text-corpus")
    return out.where("contents <> ''")


def image_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Images by name and first bytes, numbered by path."""
    from ragloom.functions.chunking import running_id

    heads = _tree(spark, path, IMAGE_NAMES, 8, "image-heads")
    heads = materialize(heads.select(F.col("path").alias("image_path"), F.lower(F.hex("content")).alias("head")), "image-heads")
    fine = F.lit(False)
    for magic in IMAGE_MAGIC:
        fine = fine | F.col("head").startswith(magic)
    found = heads.where(fine).select("image_path")
    x = running_id(found, ["image_path"], "id")
    return x.select("id", F.regexp_replace(F.element_at(F.split("image_path", "/"), -1), r"\.[^.]+$", "").alias("image_id"), "image_path")


def parsed_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``<stem>/auto/*.md`` as one text row for each stem, and the images beside them."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).withColumn("file", F.input_file_name())
    at = F.regexp_extract("file", r"/([^/]+)/auto/[^/]+\.md$", 1)
    texts = files.select(F.url_decode(at).alias("id"), "file", clean_text(F.col("value")).alias("contents")).where("id <> ''")
    texts = texts.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "contents"))), lambda s: s["contents"]), "\n\n").alias("contents"))
    return texts.select("id", F.col("id").alias("title"), "contents"), image_corpus(spark, path)


def _fields(lines: DataFrame) -> DataFrame:
    """Lines with fields and a place in their file: (line_no, f)."""
    return lines.select("line_no", F.filter(F.split(strip(F.col("value")), r"\s+"), lambda x: x != "").alias("f"))


def qrels(lines: DataFrame) -> DataFrame:
    """S11 on ``(line_no, value)``: short lines go, an unreadable grade is 1, the last of repeated pairs stays."""
    x = _fields(lines).where(F.size("f") >= 4)
    x = x.select("line_no", F.get("f", F.lit(0)).alias("qid"), F.get("f", F.lit(2)).alias("docid"), F.coalesce(F.get("f", F.lit(3)).try_cast("int"), F.lit(1)).alias("rel"))
    return x.groupBy("qid", "docid").agg(F.max_by("rel", "line_no").alias("rel"))


def runs(lines: DataFrame) -> DataFrame:
    """Short lines go, an unreadable score is 0, the last of repeated pairs stays."""
    x = _fields(lines).where(F.size("f") >= 6)
    x = x.select("line_no", F.get("f", F.lit(0)).alias("qid"), F.get("f", F.lit(2)).alias("docid"), F.coalesce(F.get("f", F.lit(4)).try_cast("double"), F.lit(0.0)).alias("score"))
    return x.groupBy("qid", "docid").agg(F.max_by("score", "line_no").alias("score"))


def trec_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file with their number, for :func:`qrels` and :func:`runs`."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "value"))


def write_metrics(metrics: DataFrame, path: str, stamp: str) -> str:
    """Long metric rows under a stamped name."""
    target = f"{path.rstrip('/')}/metrics_{stamp}"
    metrics.withColumn("value", F.round("value", 6)).write.mode("overwrite").json(target)
    return target


def write_eval_items(items: DataFrame, path: str) -> None:
    """Json lines without empty tags and without source manual."""
    x = items.withColumn("tags", F.when(F.size("tags") > 0, F.col("tags"))).withColumn("source", F.when(F.col("source") != "manual", F.col("source")))
    x.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def append_trace(trace: DataFrame, path: str) -> None:
    """``(run_id, qid, round, step, var, value)`` appended by run."""
    trace.write.mode("append").partitionBy("run_id").parquet(path)


def slice_trace(trace: DataFrame) -> DataFrame:
    """``(step, var, values array<string>)`` -> one row for each step and question; variables are map entries, short lists give null."""
    n = trace.agg(F.max(F.size("values")))
    x = trace.withColumn("_n", n.scalar()).select("step", "var", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("case_no"), "values")
    x = x.withColumn("value", F.get("values", F.col("case_no")))
    return x.groupBy("case_no", "step").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("var", "value")))).alias("vars"))


def payload(chunks: DataFrame) -> DataFrame:
    """``{kb_id, doc, source_type, parser, chunk_data}`` with defaults."""
    unknown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c)
    return chunks.select("chunk_id", unknown("kb_id"), unknown("doc"), unknown("source_type"), unknown("parser"), F.to_json(F.struct("chunk_id", "contents")).alias("chunk_data"))


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines without blank ones and comments."""
    x = trec_lines(spark, path).select("line_no", strip(F.col("value")).alias("query"))
    return x.where("query <> '' and not startswith(query, '#')")


def register_files(spark: SparkSession, path: str, kb_id: str) -> DataFrame:
    """Pending document rows of a file listing; contents aren't read."""
    files = _tree(spark, path, "", 0, "file-listing")
    return files.select(F.lit(kb_id).alias("kb_id"), F.element_at(F.split("path", "/"), -1).alias("doc_id"), "path", F.col("length").alias("n_bytes"), F.lit("pending").alias("state"), F.col("modificationTime").alias("created_at"))


def last_row_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_k = 1").drop("_k")
