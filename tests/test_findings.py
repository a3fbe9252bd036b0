"""Small tables on which registered queries and their SQL must agree, or on which a query's cost must stay bounded."""

import duckdb
from pyspark.sql import functions as F

from ragloom.plans import catalogue

from .harness import compare


def _beside_sql(spark, tmp_path, name: str, **tables) -> str:
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    return compare(catalogue.queries()[name](spark, str(tmp_path)), con, catalogue.oracle_sql()[name])


def test_titles_whose_text_goes_on_with_the_number(spark, tmp_path):
    texts = ["4501042 Anth", "3.4 x", "、 x", "12 (3) y", "　一、 z ", "\x0b### h\n# t", "a\r  ## b ", "Section-3.1.2 Section-4", "", None]
    rows = [(20 * k + heading, t) for k, t in enumerate(texts) for heading in range(20)]
    assert _beside_sql(spark, tmp_path, "clean_titles", documents=spark.createDataFrame(rows, "doc_id long, text string")) == ""


def test_many_small_files_are_few_tasks(spark, tmp_path):
    from ragloom.sources import readers

    for k in range(300):
        (tmp_path / f"{k}.txt").write_text(f" text {k}\n")
        (tmp_path / f"{k}.gif").write_bytes(b"GIF87a" if k % 2 else b"plain")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        texts, files, images = (f(spark, f"file://{tmp_path}", *more) for f, more in ((readers.text_corpus, ()), (readers.register_files, ("kb",)), (readers.image_corpus, ())))
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "4m"
        assert texts.rdd.getNumPartitions() <= 16 and files.rdd.getNumPartitions() <= 16
        assert sorted((r.id, r.contents) for r in texts.collect()) == sorted((str(k), f"text {k}") for k in range(300))
        assert files.count() == 600 and images.count() == 150
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tasks_list_what_spark_lists(spark, tmp_path, monkeypatch):
    from ragloom.sources import readers

    for name in ("a b.txt", "x%20+é#.md", "k=1/_k=2/y.txt", "k=1/.z/y.txt", "_h/y.txt", "d/e/_s.txt", "d/e/.t", "d/e/empty.txt", "d/e/f.TXT", "u._COPYING_", "x;y,{z}.txt"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(b"" if "empty" in name else b"\xff\xfe " + name.encode())
    (tmp_path / "none").mkdir()
    at = f"file://{tmp_path}/t"
    expected = sorted(map(tuple, spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at).collect()))
    tree = readers._tree(spark, at, "", None, "t")
    plan = readers.register_files(spark, at, "kb")._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, tree.collect())) == expected and len(expected) == 5 and "binaryFile" not in plan  # the driver has no file index
    heads = {(r.path, r.content) for r in readers._tree(spark, at, r"\.md\z", 2, "t").collect()}
    assert heads == {(x[0], x[3][:2]) for x in expected if x[0].endswith(".md")} and len(heads) == 1
    one = f"{at}/k=1/_k=2/y.txt"
    assert [r.id for r in readers.text_corpus(spark, one).collect()] == ["y"] and readers._tree(spark, f"file://{tmp_path}/none", "", None, "t").count() == 0
    assert {r.id for r in readers.text_corpus(spark, f"{at}/*").collect()} == {"a b", "x%20+é#", "y", "x;y,{z}"}
    ids = {r.id for r in readers.text_corpus(spark, at).collect()}

    class Unknown:  # as for a store that only Spark reads
        def from_uri(self, uri):
            raise OSError(uri)

    monkeypatch.setattr(readers.pafs, "FileSystem", Unknown())
    assert {r.id for r in readers.text_corpus(spark, at).collect()} == ids == {"a b", "x%20+é#", "y", "x;y,{z}"}


def test_trees_hold_a_file_for_each_row(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, ""), (3, None), (4, "\r\nx\r\n\r\n\r\n\r\ny "), (5, "é　")], "doc_id long, text string")
    for name in ("text_tree", "registered_files", "image_tree"):
        assert _beside_sql(spark, tmp_path / name, name, documents=docs) == ""


def test_needles_are_looked_for_where_the_texts_are(spark):
    import random

    from ragloom.operators import retrieval

    r = random.Random(4)
    texts = ["".join(r.choice("abé中 \n") for _ in range(r.randint(0, 80))) for _ in range(60)] + [None, "", "a\U0001f600b"]
    needles = ["".join(r.choice("abé中 \n") for _ in range(r.randint(1, 6))) for _ in range(700)] + [t[a : a + n] for t in texts[:40] if t for a, n in ((3, 2), (1, 7), (0, 16), (5, 33), (2, 60))] + [None, "", "\U0001f600b"]
    left, right = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "chunk_id int, hay string"), spark.createDataFrame([(n,) for n in needles], "needle string")
    expected = sorted((i // 2, n) for i, t in enumerate(texts) if t is not None for n in {n for n in needles if n} if n in t)
    found = retrieval.containing(left, right)
    assert sorted(map(tuple, found.collect())) == expected == sorted(map(tuple, retrieval.containing(left, right, held=0).collect()))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # however many pieces there are up to the bound


def test_merged_lists_compute_each_list_once(spark):
    from ragloom.plans import retrieval_queries as q

    plan = q.merge_lists(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_a_task_of_the_index_holds_one_folder_of_one_slice(spark, tmp_path):
    from ragloom.functions.text import ascii_tokens
    from ragloom.operators import postings

    texts = [(i, " ".join(f"w{(i * k) % 97}" for k in range(i % 30))) for i in range(2000)]
    c = spark.createDataFrame(texts, "chunk_id long, contents string")
    q = spark.createDataFrame([(1, "w3 w7 w7 w90"), (2, "w1 w2"), (3, "none")], "qid long, question string")
    found = {}
    for size in (64, 1 << 15):
        path = f"file://{tmp_path}/{size}"
        postings.write_blocks(c, ascii_tokens(F.col("contents")), path, buckets=4, cell_chunks=8, slice_chunks=size)
        found[size] = sorted(map(tuple, postings.search_blocks(spark, path, q, ascii_tokens(F.col("question")), 5, full_scan_cells=2).collect()))
        blocks = spark.read.parquet(f"{path}/blocks")
        assert blocks.groupBy("term", "cell").count().where("count > 1").isEmpty()
        files = blocks.groupBy(F.input_file_name()).agg(F.count_distinct("bucket").alias("b"), F.sum("n").alias("n")).collect()
        assert len(files) >= 5 * -(-2000 // size) * 0.8 and all(r.b == 1 for r in files)
    assert found[64] == found[1 << 15] and len(found[64]) == 10


def test_a_large_bucket_is_written_by_many_tasks(spark, tmp_path):
    from ragloom.streaming import streams

    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before, schema = spark.conf.get(name), "doc_id long, text string"
    spark.conf.set(name, "64k")
    try:
        batch = streams.Batch(spark, f"file://{tmp_path}/out", 0, 1)
        rows = spark.range(0, 60_000, 1, 4).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
        written = batch.write("t", schema, rows, "doc_id", {0})
        assert written.count() == 60_000 and len(written.inputFiles()) > 1  # as many as tasks wrote it, at most
    finally:
        spark.conf.set(name, before)


def test_a_batch_is_written_without_a_shuffle_of_its_texts(spark):
    from ragloom.streaming import streams

    schema = "doc_id long, text string, arrived long"
    once = spark.createDataFrame([(1, "b a B", 1), (2, None, 1), (None, "x", 1), (4, "é!", 1)], schema)
    for made in streams.chunk_tables(once).values():
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    many = streams.chunk_tables(once.unionByName(spark.createDataFrame([(1, "c", 2), (None, "y z y", 2), (4, "old", 0)], schema)))
    assert {(r.doc_id, r.no, r.chunk) for r in many["chunks"].collect()} == {(1, 0, "c"), (None, 0, "y z y"), (4, 0, "é!")}
    assert sorted((r.doc_id or 0, r.no, r.term, r.tf) for r in many["postings"].collect()) == [(0, 0, "y", 2), (0, 0, "z", 1), (1, 0, "c", 1)]
    assert sorted((r.doc_id or 0, r.term, r.tf) for r in streams.chunk_tables(once)["postings"].collect()) == [(0, "x", 1), (1, "a", 1), (1, "b", 2)]


def test_a_bucket_that_keeps_no_document_is_not_written_again(spark, tmp_path):
    from ragloom.streaming import streams

    at, schema = f"file://{tmp_path}/out", "doc_id long, text string"
    docs = lambda ids, text: spark.createDataFrame([(i, text) for i in ids], schema)
    bucket = {r.doc_id: r.b for r in docs([*range(20), None], "").select("doc_id", streams._bucket_of("doc_id", 2).alias("b")).collect()}
    first = streams.Batch(spark, at, 0, 2)
    first.replace("t", schema, docs(bucket, "old"), docs(bucket, "").select("doc_id"), {0, 1})
    first.commit(2)
    changed = [i for i, b in bucket.items() if b == bucket[None] or i == min(i for i, b in bucket.items() if b != bucket[None])]
    batch = streams.Batch(spark, at, 1, 2)
    written = batch.replace("t", schema, docs(changed[1:], "new"), docs(changed, "").select("doc_id"), {0, 1})
    batch.commit(2)
    assert {(r.doc_id, r.text) for r in written.collect()} == {(i, "new") for i in changed[1:]}  # without the kept ones
    expected = {(i, "new") for i in changed[1:]} | {(i, "old") for i in bucket if i not in changed}
    rows = streams.read_derived(spark, f"{at}/t", schema).collect()
    assert len(rows) == len(expected) and {tuple(r) for r in rows} == expected
    assert [len(batch.places["t", b]) for b in (bucket[None], 1 - bucket[None])] == [1, 2]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_packing_gives_python_the_lengths_once(spark):
    from ragloom.functions import chunking

    parts = ["One.", " Two!", " é中。", " x\n", "y" * 9]
    texts = [(1, "t", "".join(parts) * 50), (2, "t", ""), (3, "t", None)]
    docs = spark.createDataFrame(texts, "doc_id int, title string, contents string")
    paragraphs = docs.select("doc_id", F.transform(F.split("contents", " "), lambda p: F.struct(p.alias("text"), F.array(p).alias("imgs"))).alias("parts"))
    for made in (chunking.sentence_chunks(docs, 12, 6), chunking.recursive_chunks(docs, 12), chunking.sliding_windows(paragraphs, 12, 4)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        (node,) = [x for x in plan.splitlines() if "ArrowEvalPython" in x]
        assert "lambdafunction(length(" in node
    all_parts = [p for _ in range(50) for p in parts[:-1]]  # the letters at the end join the next sentence
    all_parts[4::4] = [parts[-1] + p for p in all_parts[4::4]]
    all_parts.append(parts[-1])
    expected = ["".join(all_parts[a : b + 1]).strip() for a, b in chunking.cuts([len(x) for x in all_parts], 12, 6)]
    assert [r.chunk for r in chunking.sentence_chunks(docs, 12, 6).orderBy("doc_id", "no").collect()] == expected


def test_a_routed_file_is_read_once_for_all_branches(spark):
    from ragloom.plans import ingest

    rows = [("a", "sop", "1.txt", "in\nSTEP 1: x\nSTEP 2: y"), ("b", "sop", "1.txt", "STEP 7: z"), ("a", "general", "2.md", "# H\nbody"), ("a", "general", "3.txt", "p\n" * 500), ("a", "sop", "4.txt", "q"), ("a", "sop", "5.pdf", "q"), ("a", "sop", "6.txt", " ")]
    files = spark.createDataFrame(rows, "kb_id string, kb_type string, doc_id string, contents string")
    got = ingest.dispatch(files)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "Join" not in plan
    found = sorted((r.kb_id, r.chunk_id, r.chunk) for r in got.collect() if "_window_" not in r.chunk_id)
    assert found == [("a", "1.txt_intro", "in"), ("a", "1.txt_step_1", "STEP 1: x"), ("a", "1.txt_step_2", "STEP 2: y"), ("a", "2.md_section_1", "body"), ("a", "4.txt_intro", "q"), ("b", "1.txt_step_7", "STEP 7: z")]
    out = ingest.full_ingest(files, lambda ts: [[1.0] * 64 for _ in ts], lambda p: p.assign(context="c"))
    assert "MapInArrow" not in out["vectors"].select("chunk_id")._jdf.queryExecution().optimizedPlan().toString()
    assert out["vectors"].count() == got.count() == out["chunks"].where("context = 'c'").count()


def test_runs_segmented_together_are_those_segmented_alone(spark, monkeypatch):
    import random

    from ragloom.functions import segmentation as sg

    r = random.Random(2)
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(r.randint(1, n)))
    for cells in (sg.WHOLE_CELLS, 0):
        monkeypatch.setattr(sg, "WHOLE_CELLS", cells)
        for _ in range(150):
            table, total = sg.prefix_table({some("一丁丂七", 4): r.choice((1, 2, 3, 6, 11)) for _ in range(r.randint(0, 9))})
            runs = [some("一丁丂七丄", 30) for _ in range(r.randint(0, 6))]
            assert sg.Lattice(table, total).segment(runs) == [sg.segment(x, table, total) for x in runs]
    # equal paths: the longer first word stands, whatever is behind it
    table, total = sg.prefix_table({"一丁": 11, "丂七丄": 3, "一丁丂": 3, "七丄": 11, "丈": 7})
    for tail in range(40):
        assert sg.Lattice(table, total).segment(["一丁丂七丄" + "丈" * tail])[0][:2] == ["一丁丂", "七丄"]
    monkeypatch.setattr(sg, "SEGMENTED_CHARS", 5)
    words = sg.dictionary(spark.createDataFrame([("一丁", 3)], "word string, freq int"))
    texts = spark.createDataFrame([("一丁A一",), (None,), ("",), ("x",), ("丁一丁丁",)], "t string").coalesce(1)
    assert [x.k for x in texts.select(sg.segmented_tokens(F.col("t"), words).alias("k")).collect()] == [["一丁", "A", "一", "a"], [], [], ["x", "x"], ["丁", "一丁", "丁"]]


def test_stemmed_overlap_is_one_pass_that_stems_what_can_match(spark):
    import random

    from ragloom.operators import evaluation as ev
    from ragloom.plans import retrieval_queries as q

    plan = q.rouge_stemmed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan
    r, ends = random.Random(3), ("", "s", "ed", "ing", "ies", "ation", "ly", "alli", "logi", "ness", "y", "e", "ll", "ied")
    words = ["".join(r.choice("aeylst") for _ in range(r.randint(1, 4))) + r.choice(ends) for _ in range(4000)] + ["dying", "lying", "skies", "inning"]
    for w in words:
        s = ev._stemmed([w])[0]
        assert w in ev.IRREGULAR_WORDS or s[:2] == w[: min(2, len(s))]
    some = lambda n: " ".join(r.choice(words[-60:]) for _ in range(r.randint(0, n)))
    for _ in range(200):
        golds, pred = [some(12), some(30)], some(60)
        mine, expected = ev._stemmed(pred.split()), [0.0, 0.0, 0.0]
        for g in (ev._stemmed(g.split()) for g in golds):
            grams = lambda x: (ev.Counter(x), ev.Counter(zip(x, x[1:])))
            for k, (a, b) in enumerate(zip(grams(g), grams(mine))):
                if both := (a & b).total():
                    expected[k] = max(expected[k], 2.0 * both / (a.total() + b.total()))
            if n := ev.common_subsequence(g, mine):
                expected[2] = max(expected[2], 2.0 * n / (len(g) + len(mine)))
        assert list(ev._stemmed_scores(golds, pred)) == expected


def test_postings_of_many_chunks_are_one_row_of_the_shuffle(spark, tmp_path):
    import random
    import re

    import numpy as np
    import pyarrow as pa

    from ragloom.functions.text import ascii_tokens
    from ragloom.operators import postings, retrieval

    r = random.Random(5)
    texts = [None, "", "a", "é", "aé1 b", " b-b_c ", "K İx", "zz9", "Ab\U0001f600aB", "9" * 40] + ["".join(r.choice("abC1é -\n") for _ in range(r.randint(0, 60))) for _ in range(290)]
    for at, rows in ((0, texts), (7, texts[7:40])):  # a part of an array too
        words, lengths = postings.ascii_runs(pa.array([t and t.lower() for t in texts])[at : at + len(rows)])
        expected = [re.findall("[a-z0-9]+", (t or "").lower()) for t in rows]
        assert words.to_pylist() == [w for x in expected for w in x] and lengths.tolist() == [len(x) for x in expected]
    c = spark.createDataFrame([(i % 295, t) for i, t in enumerate(texts)], "chunk_id int, contents string").repartition(2)
    q = spark.createDataFrame([(1, "a b b"), (2, "c1 zz9 a1"), (3, "none")], "qid long, question string")
    found = []
    for i, tokens in enumerate((F.lower("contents"), ascii_tokens(F.col("contents")))):
        postings.write_blocks(c, tokens, f"file://{tmp_path}/{i}", stop_words=("ab",), buckets=4, cell_chunks=16, slice_chunks=64)
        hits = postings.search_blocks(spark, f"file://{tmp_path}/{i}", q, ascii_tokens(F.col("question")), 5).collect()
        found.append((sorted(map(tuple, hits)), sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/{i}/terms").collect())), spark.read.parquet(f"file://{tmp_path}/{i}/stats").first()))
    assert found[0] == found[1] and len(found[0][0]) == 10 and "ab" not in dict(found[0][1])
    assert {t for t, _ in found[0][1]} == {t for t, *_ in map(tuple, retrieval.bm25_index(c, ascii_tokens(F.col("contents")), ("ab",))[1].collect())}
    schema = postings._posting_schema(c.schema["chunk_id"].dataType)
    packed = c.select("chunk_id", F.lower("contents").alias("ts"), F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("slice")).mapInArrow(postings._packed(4, 5, schema), "part int, folder int, piece binary")
    assert packed.count() <= 2 * 5  # a row for each folder and task, however many postings
    x = [np.array(v) for v in ([0, 0, 0, 1], [3, 3, 2, 3], [9, 4, 2**40, 1])]
    assert [y.tolist() for y in postings._least(*x)] == [[0, 0, 1], [2, 3, 3], [2**40, 4, 1]]
    huge = [y.tolist() for y in postings._least(x[0] << 20, x[1], x[2])]
    assert huge == [[0, 0, 1 << 20], [2, 3, 3], [2**40, 4, 1]]  # too many bits for one number


def test_an_index_of_a_hundred_cells_is_read_once(spark, tmp_path, monkeypatch):
    from ragloom.functions.text import ascii_tokens
    from ragloom.operators import postings

    c = spark.range(1000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("common "), F.repeat(F.lit("x "), (F.col("id") % 9).cast("int"))).alias("contents"))
    q = spark.createDataFrame([(1, "common x")], "qid long, question string")
    postings.write_blocks(c, F.lower("contents"), f"file://{tmp_path}/i", buckets=4, cell_chunks=10, slice_chunks=1000)
    search = lambda **more: sorted(map(tuple, postings.search_blocks(spark, f"file://{tmp_path}/i", q, ascii_tokens(F.col("question")), 3, **more).collect()))
    bounded = search(full_scan_cells=0)
    monkeypatch.setattr(postings, "bounds", None)
    assert search() == bounded and len(bounded) == 3
