"""Small literal cases of operators, and the invariants of fusion, metrics and streams."""

import json

import pytest
from pyspark.sql import functions as F

from ragloom.functions import chunking, parsing, prompts, text
from ragloom.operators import citations, curation, evaluation, graph, retrieval
from ragloom.plans import loops
from ragloom.sources import readers
from ragloom.streaming import streams


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "f,value,want",
    [
        (text.clean_text, "　a\r\nb\r\n\r\n\r\nc ", "a\nb\n\nc"),
        (text.clean_text, None, ""),
        (text.eval_normalize, "True", "yes"),
        (text.eval_normalize, "The_Cat, an  owl", "cat owl"),
        (text.reflow_paragraphs, "one\ntwo-\nthree.\nfour", "one twothree. four"),
        (text.reflow_paragraphs, "It goes\n\non here!\n\nNew", "It goes on here!\n\nNew"),
        (text.unglue_steps, "done.STEP 2: go", "done.\nSTEP 2: go"),
        (text.rewrite_citations, "a \\cite{textid2, textid1} b", "a [1][2] b"),
        (text.clean_title, "Section-1. Start", ". Start"),
        (text.clean_title, "Section Overview", "Section Overview"),
        (text.clean_title, "Sections of law", "Sections of law"),
        (text.clean_title, "Section 1.2 Intro", ".2 Intro"),
        (text.clean_title, "12.\u3000Intro", "Intro"),
        (text.clean_title, "第一章 第2节：开始", "开始"),
        (text.clean_generated, "a\n  ## B\nc Section-2.1 d\n\n\n\ne", "a\n\n## B\n\nc  d\n\ne"),
        (parsing.boxed, "so \\boxed{a{b}c} end", "a{b}c"),
        (parsing.boxed, "\\boxed{\\text{yes}}", "yes"),
        (parsing.boxed, "plain", "plain"),
        (parsing.last_search_tag, "<search>a</search><search> b </search>", "b?"),
        (parsing.last_search_tag, "x", "There is no query."),
        (parsing.last_query_tag, "<|begin_of_query|>q<|end_of_query|>", "q?"),
        (parsing.so_the_answer_is, "x So the answer is: 4\ny", "4"),
    ],
)
def test_strings(spark, f, value, want):
    assert one(spark, f, value) == want


def test_metrics(spark):
    rows = [(1, ["paris"], "the capital is Paris."), (2, ["london"], "Tokyo is in Japan"), (3, [""], "x"), (4, ["a b c"], "b c d"), (5, [], "x"), (6, None, None)]
    m = evaluation.generation_metrics(spark.createDataFrame(rows, "id int, golds array<string>, pred string"), list(evaluation.METRICS))
    got = {r.id: r for r in m.collect()}
    assert (got[1].acc, got[2].acc, got[3].acc, got[3].coverem) == (1, 0, 0, 0)
    assert got[4].f1 == pytest.approx(0.8) and got[4].rougel == pytest.approx(0.666667)
    assert all(v in (0, None) for v in got[6][1:])
    assert evaluation.averages(m.where("id < 3")).first().avg_acc == 0.5


def test_overlap_counts_copies(spark):
    rows = [(1, ["a a b", None], "a b b c"), (2, ["x y x y"], "x y x"), (3, [None], "a"), (4, ["a"], ""), (5, ["a " * 200_000], "a " * 100_000)]
    answers = spark.createDataFrame(rows, "id int, golds array<string>, pred string")
    got = {r.id: r for r in answers.select("id", evaluation.token_f1(F.col("golds"), F.col("pred")).alias("f1"), evaluation.rouge_n(F.col("golds"), F.col("pred"), 2).alias("r2")).collect()}
    assert got[1].f1 == pytest.approx(4 / 7) and got[1].r2 == pytest.approx(2 / 5)
    assert got[2].f1 == pytest.approx(6 / 7) and got[2].r2 == pytest.approx(4 / 5)
    assert (got[3].f1, got[3].r2, got[4].f1, got[4].r2) == (0, 0, 0, 0)
    assert got[5].f1 == pytest.approx(2 / 3)


def test_ranking(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    gold = spark.createDataFrame([(1, "a"), (2, "b")], "qid int, chunk_id string")
    hits = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (2, "x", 1), (2, "b", 2), (2, "y", 3), (2, "b", 4)], "qid int, chunk_id string, rank int")
    m = {r.qid: r for r in evaluation.ranking_metrics(q, gold, hits, (1, 2, 5)).collect()}
    assert (m[1].recall_1, m[2].recall_1, m[2].recall_5, m[3].recall_5) == (1, 0, 1, 0)
    assert m[2].ndcg_2 == pytest.approx(0.63093, abs=1e-5)
    assert (m[1].mrr + m[2].mrr) / 2 == 0.75


def test_rrf(spark):
    h = lambda ids: spark.createDataFrame([(1, c, k + 1) for k, c in enumerate(ids)], "qid int, chunk_id string, rank int")
    alone = {r.chunk_id: r.score for r in retrieval.rrf([(h("ABA"), 0.7)]).collect()}
    assert alone["A"] == pytest.approx(0.7 / 61)
    both = [r.chunk_id for r in retrieval.rrf([(h("ABC"), 0.7), (h("CX"), 0.3)]).orderBy("rank").collect()]
    assert both[0] == "C" and set(both) == set("ABCX")
    assert both == [r.chunk_id for r in retrieval.rrf([(h("CX"), 0.3), (h("ABC"), 0.7)]).orderBy("rank").collect()]


def test_bm25(spark):
    c = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, ""), (4, "green tree")], "chunk_id int, contents string")
    index = retrieval.bm25_index(c, text.ascii_tokens(F.col("contents")))
    q = spark.createDataFrame([(1, "Red fox"), (2, ""), (3, "zzz")], "qid int, question string")
    hits = retrieval.bm25_search(index, q, text.ascii_tokens(F.col("question")), 2).orderBy("qid", "rank").collect()
    assert [(h.qid, h.chunk_id) for h in hits] == [(1, 1), (1, 2)] and hits[0].score > hits[1].score > 0


def test_sliding_windows(spark):
    parts = [("a" * 500, ["1"]), ("b" * 90, ["2"]), ("c" * 400, []), ("d" * 900, ["3"])]
    x = chunking.sliding_windows(spark.createDataFrame([(1, parts)], "doc_id int, parts array<struct<text string, imgs array<string>>>")).orderBy("no").collect()
    assert [(r.chunk[0], r.images) for r in x] == [("a", ["1", "2"]), ("b", []), ("d", ["3"])]
    assert x[1].chunk == "b" * 90 + "\n" + "c" * 400


def test_sections_and_images(spark):
    lines = "intro\n# A\nx\n### C\ny\n## B\nz".split("\n")
    x = chunking.heading_sections(spark.createDataFrame([(1, k, v) for k, v in enumerate(lines)], "doc_id int, line_no int, line string"))
    assert {tuple(r.heading_path): r.chunk for r in x.collect()} == {(): "intro", ("A",): "x", ("A", "C"): "y", ("A", "B"): "z"}
    s = one(spark, text.split_images, "t\n[IMG: a/b.png]\nu")
    assert (s.text, s.images) == ("t\nu", ["a/b.png"])


def test_sentences_keep_everything(spark):
    body = "One two. Three four five! Six? " * 30
    x = chunking.sentence_chunks(spark.createDataFrame([(1, None, body)], "doc_id int, title string, contents string"), 80, 0).orderBy("no").collect()
    assert all(len(r.chunk) <= 80 for r in x) and "".join(r.chunk for r in x).replace(" ", "") == body.replace(" ", "")
    y = chunking.recursive_chunks(spark.createDataFrame([(1, None, "w" * 700)], "doc_id int, title string, contents string"), 256).collect()
    assert sorted(len(r.chunk) for r in y) == [188, 256, 256]


def test_context(spark):
    c = spark.createDataFrame([(1, "a", None), (2, "b", "kept")], "chunk_id int, chunk string, context string")
    x = {r.chunk_id: (r.context, r.status) for r in chunking.enrich_context(c, lambda p: p.assign(context="about " + p["chunk"])).collect()}
    assert x == {1: ("about a", "generated"), 2: ("kept", "skipped")}

    def broken(pdf):
        raise RuntimeError("down")

    assert {r.chunk_id: r.status for r in chunking.enrich_context(c, broken).collect()} == {1: "failed", 2: "skipped"}


def test_citations(spark):
    p = spark.createDataFrame([(1, 0, 1, "b"), (1, 0, 2, "a"), (1, 1, 1, "a "), (1, 1, 2, "c")], "qid int, round int, rank int, passage string")
    assert [r.cite_id for r in citations.stable_numbers(p).orderBy("round", "rank").collect()] == [1, 2, 2, 3]
    q = spark.createDataFrame([(1, s, r, f"{s}-{r % 8}") for s in range(3) for r in range(1, 20)], "qid int, sub_no int, rank int, passage string")
    assert citations.quota_dedupe(q).count() == 20


def test_prompts(spark):
    x = spark.range(1).select(prompts.render("{a} {b} {c}", a=F.lit("{b}<"), b=F.lit("'")).alias("p"), prompts.render("{a}", escape=False, a=F.lit("<")).alias("r")).first()
    assert (x.p, x.r) == ("{b}&lt; &#39; {c}", "<")


def test_embed_and_rerank(spark):
    c = spark.createDataFrame([(1, "good"), (2, "bad")], "chunk_id long, text string")

    def embed(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[1.0] * 4 for _ in texts]

    assert {r.chunk_id: r.embedding for r in retrieval.embed_texts(c, embed, dim=4).collect()} == {1: [1.0] * 4, 2: [0.0] * 4}
    pairs = spark.createDataFrame([(1, "q", 1, "xx"), (1, "q", 2, "x"), (1, "q", 3, " ")], "qid long, question string, chunk_id long, text string")
    assert [r.chunk_id for r in retrieval.rerank_with(pairs, lambda q, t: [len(x) for x in t]).orderBy("rank").collect()] == [1, 2]


def test_readers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "1", "title": "t", "contents": "x", "k": "v"}\n\nbad\n{"id": "2", "contents": " "}\n')
    p = f"file://{tmp_path}/c.jsonl"
    assert [r.id for r in readers.tolerant_chunks(spark, p, readers.CORPUS).orderBy("id").collect()] == ["1", "2"]
    assert readers.tolerant_chunks(spark, f"file://{tmp_path}/none.jsonl").count() == 0
    (row,) = readers.lenient_index(spark, p).collect()
    assert (row.text, row.segment_id, row.metadata["k"]) == ("x", 0, "v")
    with pytest.raises(Exception):
        readers.strict_corpus(spark, p).collect()
    (tmp_path / "b.json").write_text(json.dumps([{"id": "1", "question": "q", "golden_answers": ["a"]}]))
    assert readers.benchmark(spark, f"file://{tmp_path}/b.json").first().golden_answers == ["a"]
    with pytest.raises(ValueError):
        readers.benchmark(spark, "x.csv")
    d = tmp_path / "tree"
    (d / "s1" / "auto").mkdir(parents=True)
    (d / "s1" / "auto" / "s1.md").write_text("# A\r\nb")
    (d / "s1" / "auto" / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n123")
    (d / "s1" / "auto" / "no.png").write_bytes(b"text")
    texts, images = readers.parsed_tree(spark, f"file://{d}")
    assert texts.first().contents == "# A\nb" and [(r.id, r.image_id) for r in images.collect()] == [(0, "i")]
    assert readers.text_corpus(spark, f"file://{d}").first().id == "s1"
    assert readers.register_files(spark, f"file://{d}", "kb").count() == 3
    (tmp_path / "q.txt").write_text("# c\n one \n\ntwo\n")
    assert {r.query for r in readers.query_list(spark, f"file://{tmp_path}/q.txt").collect()} == {"one", "two"}
    items = spark.createDataFrame([("1", "kb", "q", ["c"], None, [], "manual")], readers.EVAL_ITEM)
    readers.write_eval_items(items, f"file://{tmp_path}/items")
    assert "manual" not in "".join(f.read_text() for f in (tmp_path / "items").glob("part*"))


def test_trace_and_metrics_sink(spark, tmp_path):
    t = spark.createDataFrame([("r1", 1, 0, "s", "v", "x")], "run_id string, qid int, round int, step string, var string, value string")
    for _ in range(2):
        readers.append_trace(t, f"file://{tmp_path}/trace")
    assert spark.read.parquet(f"file://{tmp_path}/trace").count() == 2
    m = evaluation.long_form(spark.range(1).select(F.lit(0.1234567).alias("avg_acc")))
    assert spark.read.json(readers.write_metrics(m, f"file://{tmp_path}", "t1")).first().value == 0.123457


def test_loop_and_branch(spark):
    x = spark.createDataFrame([(1, 0, True), (2, 5, False)], "qid int, n int, active boolean")
    got = loops.loop(x, lambda r, t: r.withColumn("n", F.col("n") + 1).withColumn("active", F.col("n") < 2), 9)
    assert {r.qid: r.n for r in got.collect()} == {1: 2, 2: 5}
    said = loops.generate(spark.createDataFrame([(1, "p")], "qid int, prompt string"), lambda ps: [p * 2 for p in ps]).first()
    assert said.answer == "pp"


def test_curation(spark):
    m = spark.createDataFrame([(1, 1, "user", "What now?"), (1, 2, "user", "what NOW"), (1, 3, "assistant", "none"), (2, 4, "user", "abc")], "conv_id int, msg_id int, role string, text string")
    s = spark.createDataFrame([(1, "k"), (2, "k")], "conv_id int, kb_id string")
    assert [(r.item_id, r.query) for r in curation.mine_questions(s, m, "k").collect()] == [("q001", "What now?")]


def test_ingest_stream(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    docs([(1, "one two"), (2, "three")]).coalesce(1).write.parquet(src)

    def run():
        s = spark.readStream.schema("doc_id long, text string").parquet(src)
        streams.ingest_stream(s, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", streams.chunk_tables, streams.CHUNK_SCHEMAS, buckets=8).awaitTermination()
        return {(r.doc_id, r.chunk) for r in streams.read_derived(spark, f"file://{tmp_path}/out/chunks", streams.CHUNK_SCHEMAS["chunks"]).collect()}

    assert run() == {(1, "one two"), (2, "three")}
    docs([(2, "four")]).coalesce(1).write.mode("append").parquet(src)
    assert run() == {(1, "one two"), (2, "four")}
    assert run() == {(1, "one two"), (2, "four")}
    files = {f.split("/chunks/")[1].split("/")[0].split(".")[0] for f in streams.read_derived(spark, f"file://{tmp_path}/out/chunks", streams.CHUNK_SCHEMAS["chunks"]).inputFiles()}
    assert files == {"v=0", "v=1"}  # the bucket of document 1 wasn't written again
    docs([(2, "")]).coalesce(1).write.mode("append").parquet(src)
    assert run() == {(1, "one two")}
    docs([(2, "five")]).coalesce(1).write.mode("append").parquet(src)
    assert run() == {(1, "one two"), (2, "five")}


def test_stream_mining(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([("2024-01-01 00:00:00", "What now?"), ("2024-01-01 00:10:00", "what now"), ("2024-01-01 00:20:00", "other one")], "t string, text string").select(F.col("t").cast("timestamp").alias("ts"), "text").coalesce(1).write.parquet(src)
    s = streams.mined_queries(spark.readStream.schema("ts timestamp, text string").parquet(src))
    assert streams.run_available(s, "mined", "append").count() == 2


def test_stream_tables(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    schema = "doc_id long, state string, ts timestamp, event_id long"
    parts = [[(1, "a", 1, 1), (2, "a", 2, 2)], [(1, "b", 4000, 3)], [(3, "a", 90000, 4), (1, "a", 2, 5)]]
    for part in parts:
        spark.createDataFrame(part, "doc_id long, state string, s long, event_id long").selectExpr("doc_id", "state", "timestamp_seconds(s) AS ts", "event_id").coalesce(1).write.mode("append").parquet(src)
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    latest = streams.run_available(streams.latest_states(events), "latest", "complete", f"file://{tmp_path}/cp")
    assert {(r.doc_id, r.state) for r in latest.collect()} == {(1, "b"), (2, "a"), (3, "a")} and latest.count() == 3
    counts = streams.run_available(streams.stage_counts(events), "counts", "append")
    assert {(r.state, r.n) for r in counts.collect()} >= {("b", 1)} and counts.columns == ["start", "state", "n"]
    base = spark.conf.get("spark.checkpoint.dir")
    assert latest.inputFiles() and counts.inputFiles() and all(base in f for f in counts.inputFiles())
    none = streams.run_available(streams.stage_counts(events.where("false")), "none", "append")
    assert none.count() == 0 and none.columns == counts.columns


def test_partitioning_does_not_matter(spark):
    c = spark.createDataFrame([(i, f"w{i % 7} common w{i % 3}") for i in range(200)], "chunk_id long, contents string")
    q = spark.createDataFrame([(1, "w1 common"), (2, "w2")], "qid long, question string")

    def hits(n):
        i = retrieval.bm25_index(c.repartition(n), text.ascii_tokens(F.col("contents")))
        return sorted(map(tuple, retrieval.bm25_search(i, q, text.ascii_tokens(F.col("question")), 10).collect()))

    assert hits(1) == hits(8)


def test_ingest(spark):
    from ragloom.plans import ingest

    files = [("kb", "sop", "a.txt", "Intro\nSTEP 1: open\nSTEP 2: close"), ("kb", "general", "b.md", "# H\nbody\n## I\nmore"), ("kb", "general", "c.pdf", "x"), ("kb", "sop", "d.docx", "short"), ("kb", "sop", "e.txt", " \n"), ("kb", "general", "f.txt", "word " * 400)]
    out = ingest.full_ingest(spark.createDataFrame(files, "kb_id string, kb_type string, doc_id string, contents string"), lambda ts: [[1.0] * 64 for _ in ts])
    ids = {r.chunk_id for r in out["chunks"].collect()}
    assert ids == {"a.txt_intro", "a.txt_step_1", "a.txt_step_2", "b.md_section_1", "b.md_section_2", "d.docx_intro", "f.txt_window_0"}
    assert {r.doc_id: r.n_chunks for r in out["counts"].collect()} == {"a.txt": 3, "b.md": 2, "c.pdf": 0, "d.docx": 1, "e.txt": 0, "f.txt": 1}
    assert out["job"].first().stages == ["register", "parse", "embed", "index", "counts"]
    assert out["vectors"].count() == len(ids)


def test_evaluation_report(spark):
    items = spark.createDataFrame([(k, ["a"], ["t"] if k < 3 else [], "gold") for k in range(4)], "qid int, relevant_chunk_ids array<string>, tags array<string>, gold_answer string")
    hits = spark.createDataFrame([(0, "a", 1), (1, "b", 1), (1, "a", 2), (2, "b", 1)], "qid int, chunk_id string, rank int")
    answers = spark.createDataFrame([(0, "gold"), (1, "bad")], "qid int, answer string")
    r = evaluation.evaluation_report(items, hits, answers, (1, 2))
    overall = {x.metric: x.value for x in r["overall"].collect()}
    assert (overall["mrr"], overall["recall_1"], overall["acc"]) == (0.375, 0.25, 0.25)
    assert {x.tag for x in r["per_tag"].collect()} == {"t"}
    assert {x.qid for x in r["failures"].collect()} == {1, 2, 3}


def test_whole_texts_in_queries(spark, tmp_path):
    from ragloom.plans import catalogue

    body = "A heading of quite some length, longer than thirty characters " + "zebra stripes " * 40
    for name, rows, schema in (("documents", [(1, body, "s", "en"), (2, "other words", "s", "en")], "doc_id long, text string, source string, lang string"), ("benchmark", [(7, "filler " * 20 + "zebra")], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
    run = catalogue.queries()
    titles = {r.doc_id: r.title for r in run["clean_titles"](spark, f"file://{tmp_path}").collect()}
    assert titles[1] == body.strip()
    row = run["ircot_rounds"](spark, f"file://{tmp_path}").first()
    assert row.question == "filler " * 20 + "zebra" and int(row.so_far.split()[2]) > len(body)


def test_containing(spark):
    import random

    r = random.Random(3)
    texts = ["".join(r.choice("abé中 \n") for _ in range(r.randint(0, 60))) for _ in range(60)] + [None, ""]
    needles = ["".join(r.choice("abé中 \n") for _ in range(r.randint(1, 40))) for _ in range(60)] + [t[a : a + n] for t in texts[:40] if t for a, n in ((3, 2), (1, 7), (0, 16), (5, 33))] + [None, "", "a"]
    left = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, hay string")
    got = sorted(tuple(x) for x in retrieval.containing(left, spark.createDataFrame([(n,) for n in needles], "needle string")).collect())
    assert got == sorted((i, n) for i, t in enumerate(texts) if t is not None for n in {n for n in needles if n} if n in t)
    assert retrieval.containing(left, spark.createDataFrame([("",)], "needle string")).count() == 0


def test_dense_grid_equals_one_block(spark):
    import numpy as np

    r = np.random.default_rng(5)
    v = spark.createDataFrame([(i, [float(x) for x in np.round(r.normal(size=4), 1)]) for i in range(200)], "chunk_id long, embedding array<float>")
    q = v.where("chunk_id < 40").withColumnRenamed("chunk_id", "qid")
    one, grid = (sorted(tuple(x) for x in retrieval.dense_top_k(v, q, 5, **k).collect()) for k in ({}, {"block": 7, "part": 30}))
    assert one == grid and len(one) == 200


def test_saved_index(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a b b"), (2, None), (3, "b c")], "chunk_id long, contents string")
    index = retrieval.bm25_index(chunks, text.ascii_tokens(F.col("contents")))
    retrieval.save_index(index, f"{tmp_path}/i")
    loaded = retrieval.load_index(spark, f"{tmp_path}/i")
    assert tuple(loaded[2].first()) == (3, pytest.approx(5 / 3))
    q = spark.createDataFrame([(1, "b c")], "qid long, question string")
    a, b = ([tuple(x) for x in retrieval.bm25_search(i, q, text.ascii_tokens(F.col("question"))).collect()] for i in (index, loaded))
    assert a == b and [x[1] for x in a] == [3, 1]


def test_common_subsequence():
    import random

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            above, row = row, [0]
            for j, y in enumerate(b):
                row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        return row[-1]

    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 30))] for _ in range(2))
        assert evaluation.common_subsequence(a, b) == table(a, b)


def test_extraction_run(spark):
    c = spark.createDataFrame([(1, "d1", "x"), (2, "d2", "bad"), (3, "d2", "y")], "chunk_id long, doc_id string, contents string")

    def model(pdf):
        say = lambda t: "no" if t == "bad" else '{"entities": [{"title": "%s", "type": "P"}, {"title": "Z", "type": "P"}, {"title": "W", "type": "Q"}], "relations": [{"source": "%s", "target": "Z", "type": "in"}, {"source": "W", "target": "Z", "type": "in"}]}' % (t, t)
        return pdf.assign(response=[say(t) for t in pdf["contents"]])

    e, r, n = graph.extraction_run(c, model, ("P",), "kb")
    assert {(x.entity_name, tuple(x.chunk_ids)) for x in e.collect()} == {("x", (1,)), ("y", (3,)), ("Z", (1, 3))}
    assert {(x.source_id, x.target_id, x.strength, x.doc_id) for x in r.collect()} == {("x", "Z", 5, "d1"), ("y", "Z", 5, "d2")}
    assert tuple(n.first()) == (2, 1, 4, 2)
    old = spark.createDataFrame([("kb", "Z", "P", "old", [9]), ("kb2", "V", "P", None, [8])], "kb_id string, entity_name string, entity_type string, description string, chunk_ids array<long>"), r
    full, _, _ = graph.extraction_run(c, model, ("P",), "kb", old)
    assert {x.entity_name: x.chunk_ids for x in full.collect()} == {"x": [1], "y": [3], "Z": [1, 3], "V": [8]}
    part, rels, n = graph.extraction_run(c, model, ("P",), "kb", old, spark.createDataFrame([("d1",)], "doc_id string"))
    assert {x.entity_name: x.chunk_ids for x in part.collect()} == {"x": [1], "Z": [9, 1], "V": [8]} and rels.count() == 2 and n.first().chunk_count == 1


@pytest.mark.parametrize("okapi", [False, True])
def test_posting_blocks_give_what_a_full_scan_gives(spark, tmp_path, okapi):
    import random

    from ragloom.operators import postings

    r = random.Random(7)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(600)]
    texts = [(i, " ".join(["common"] * r.randint(0, 3) + [r.choice(words) for _ in range(r.randint(0, 40))])) for i in range(900)] + [(1000, None), (1001, "")]
    asked = [(i, " ".join(["common", r.choice(words), r.choice(words), r.choice(words)])) for i in range(20)] + [(50, "rareone"), (51, ""), (52, None), (53, "nowhere w1")]
    texts[17] = (17, "rareone common")
    tok = text.ascii_tokens
    q = spark.createDataFrame(asked, "qid long, question string")
    kinds = {"string": F.concat(F.lit("c"), F.lpad(F.col("i").cast("string"), 5, "0")), "long": F.col("i"), "sparse": F.col("i") * 1_000_003}
    for name, ids in list(kinds.items())[: 1 if okapi else 3]:
        c = spark.createDataFrame(texts, "i long, contents string").select(ids.alias("chunk_id"), "contents").repartition(3)
        want = sorted(map(tuple, retrieval.bm25_search(retrieval.bm25_index(c, tok(F.col("contents"))), q, tok(F.col("question")), 5, okapi).collect()))
        path = f"{tmp_path}/{name}"
        postings.write_blocks(c, tok(F.col("contents")), path, buckets=8, cell_chunks=16)
        for full in (0, 1000) if name == "string" else (0,):
            got = postings.search_blocks(spark, path, q, tok(F.col("question")), 5, okapi, first_cells=2, full_scan_cells=full)
            assert sorted(map(tuple, got.collect())) == want and len(want) > 90
    blocks = spark.read.parquet(path + "/blocks")
    assert blocks.where("term = 'common'").count() > 40 and blocks.agg(F.max("n")).first()[0] < 100  # a hot term has many small blocks
    one = postings.read_blocks(spark, path, spark.createDataFrame([("rareone",)], "term string"))
    assert len(one.inputFiles()) < len(blocks.inputFiles()) / 4 and one.count() == 1


def test_cells_that_cannot_reach_the_threshold_are_not_scored(spark, tmp_path):
    from ragloom.operators import postings

    c = spark.range(2000).select(F.col("id").alias("chunk_id"), F.when(F.col("id") < 40, F.concat(F.lit("gold common "), F.repeat(F.lit("x "), (F.col("id") % 7).cast("int")))).otherwise(F.lit("common filler")).alias("contents"))
    tok = text.ascii_tokens
    q = spark.createDataFrame([(1, "gold common")], "qid long, question string")
    postings.write_blocks(c, tok(F.col("contents")), str(tmp_path / "i"), buckets=4, cell_chunks=20)
    stats = spark.read.parquet(str(tmp_path / "i/stats")).first()
    wanted = postings.weighted_terms(spark, str(tmp_path / "i"), q, tok(F.col("question"))).withColumnRenamed("qid", "q")
    cells = postings.bounds(postings.read_blocks(spark, str(tmp_path / "i"), wanted), wanted, F.lit(stats.avg_len)).orderBy("no").collect()
    assert len(cells) == 100 and {x.cell for x in cells[:2]} == {0, 1}
    hits = postings.search_blocks(spark, str(tmp_path / "i"), q, tok(F.col("question")), 10, first_cells=2, full_scan_cells=0).collect()
    assert min(h.score for h in hits) > cells[2].bound + 1e-6  # so the other 98 cells fall to the threshold


def test_index_of_an_empty_table(spark, tmp_path):
    from ragloom.operators import postings

    c = spark.createDataFrame([], "chunk_id long, contents string")
    postings.write_blocks(c, text.ascii_tokens(F.col("contents")), str(tmp_path / "e"))
    q = spark.createDataFrame([(1, "a")], "qid long, question string")
    for full in (0, 64):
        assert postings.search_blocks(spark, str(tmp_path / "e"), q, text.ascii_tokens(F.col("question")), full_scan_cells=full).collect() == []


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    from ragloom.plans import catalogue

    run = catalogue.queries()
    for name in ("events", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"file://{tmp_path}/{name}.parquet")
    for name in ("stream_latest_states", "stream_stage_counts", "stream_mined_questions", "stream_stale_sessions"):
        one, many = (sorted(map(tuple, run[name](spark, d).collect())) for d in ("/root/testdata/sf0.001", f"file://{tmp_path}"))
        assert one == many and one


def test_cuts_of_a_long_text_are_linear():
    import random
    import time

    from ragloom.functions import chunking

    r = random.Random(2)
    lengths = [r.randint(1, 90) for _ in range(400_000)]  # 18 million characters
    began = time.time()
    got = chunking.cuts(lengths, 256, 32)
    assert time.time() - began < 5 and got[0][0] == 0 and got[-1][1] == len(lengths) - 1
    assert all(sum(lengths[a : b + 1]) <= 256 and (c <= b + 1 and sum(lengths[c : b + 1]) <= 32) for (a, b), (c, _) in zip(got[:2000], got[1:2001]))


def test_snapshots_cover_all_tables_and_vectors_are_made_once(spark, tmp_path):
    from ragloom.streaming import streams

    at, calls = f"file://{tmp_path}", spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    def run(rows, derive=streams.chunk_tables):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{at}/in")
        s = spark.readStream.schema("doc_id long, text string").parquet(f"{at}/in")
        streams.ingest_stream(s, f"{at}/out", f"{at}/cp", derive, streams.CHUNK_SCHEMAS, buckets=4, embed=model, dim=2).awaitTermination()

    def see():
        schemas = streams.CHUNK_SCHEMAS | {streams.VECTORS: streams.VECTOR_SCHEMAS[streams.VECTORS]}
        return {n: sorted(r.doc_id for r in streams.read_derived(spark, f"{at}/out/{n}", schema).select("doc_id").distinct().collect()) for n, schema in schemas.items()}

    run([(1, "a b"), (2, "c d"), (3, "a b")])
    assert calls.value == 2 and see() == dict.fromkeys(("chunks", "postings", "vectors"), [1, 2, 3])  # equal texts go through the model once

    def broken(batch):
        tables = streams.chunk_tables(batch)
        return tables | {"postings": tables["postings"].withColumn("tf", F.raise_error(F.lit("stopped")).cast("long"))}

    with pytest.raises(Exception, match="stopped"):
        run([(2, "new text"), (4, "more")], broken)
    assert see() == dict.fromkeys(("chunks", "postings", "vectors"), [1, 2, 3])  # chunks were written, but no manifest names them
    first = streams.read_derived(spark, f"{at}/out/chunks", streams.CHUNK_SCHEMAS["chunks"])
    assert {r.chunk for r in first.collect()} == {"a b", "c d"}

    spark.createDataFrame([(1, "a b")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{at}/in")
    run([(5, "c d")])
    assert calls.value == 4 and see()["vectors"] == [1, 2, 3, 4, 5] and {r.chunk for r in streams.read_derived(spark, f"{at}/out/chunks", streams.CHUNK_SCHEMAS["chunks"]).collect()} == {"a b", "new text", "more", "c d"}
    for _ in range(2):
        run([(1, "z")])
    assert calls.value == 5
    left = {x.name for n in ("chunks", "postings", "vectors") for x in (tmp_path / "out" / n).iterdir()}
    named = {f for v in (p.name[2:] for p in (tmp_path / "out/manifest").iterdir() if p.name.startswith("v=")) for (n, _), fs in streams.snapshot(spark, f"{at}/out", int(v)).items() for f in fs}
    assert left <= named and len(list((tmp_path / "out/manifest").glob("v=*"))) == 2


def test_two_versions_in_a_batch_need_an_order(spark):
    from ragloom.streaming import streams

    rows = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, None, 1), (2, None, 1)], "doc_id long, text string, arrived long")
    assert {r.chunk for r in streams.chunk_tables(rows)["chunks"].collect()} == {"new"}
    with pytest.raises(Exception, match="two versions of document 1"):
        streams.chunk_tables(rows.drop("arrived"))["chunks"].collect()


def test_stems_of_fixed_words():
    from ragloom.functions.stemming import stem

    pairs = """caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
      falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky skies sky relational relat conditional condit rational ration valenci valenc digitizer digit operator oper
      feudalism feudal decisiveness decis hopefulness hope formaliti formal triplicate triplic formative form formalize formal electrical electr goodness good revival reviv allowance allow
      inference infer airliner airlin adjustable adjust irritant irrit replacement replac adoption adopt communism commun effective effect bowdlerize bowdler probate probat rate rate cease ceas
      controll control roll roll dying die died die spied spi news news enjoy enjoy geology geolog hopefully hope as as""".split()
    assert {w: stem(w) for w in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2]))


def test_stemmed_overlap(spark):
    a = spark.createDataFrame([(1, ["The Ponies were hopping", "x"], "a pony hops!"), (2, None, "x"), (3, [""], "")], "id long, golds array<string>, pred string")
    got = {r.id: r for r in evaluation.generation_metrics(a, ["rouge1_stem", "rouge2_stem", "rougel_stem", "rouge1"]).collect()}
    # ponies and pony share a stem, hopping and hops too (three letters and one); articles and marks go first
    assert (got[1].rouge1_stem, got[1].rouge2_stem, got[1].rougel_stem) == (0.8, 0.0, 0.8) and got[1].rouge1 == 0
    assert got[2].rouge1_stem == got[3].rougel_stem == 0


def test_collection_search_in_parts_and_blocks(spark):
    import numpy as np

    r = np.random.default_rng(4)
    rows = [("hot" if i % 3 else f"kb{i % 7}", i, [float(x) for x in r.integers(-3, 4, 3)]) for i in range(300)] + [("hot", 900, None)]
    asked = [(i, "hot" if i % 2 else "kb3", [float(x) for x in r.integers(-3, 4, 3)]) for i in range(30)] + [(70, "nowhere", [1.0, 1.0, 1.0]), (71, "hot", None)]
    v, q = spark.createDataFrame(rows, "kb_id string, chunk_id long, embedding array<float>"), spark.createDataFrame(asked, "qid long, kb_id string, embedding array<float>")
    want = []
    for qid, kb, e in asked:
        scored = sorted((-float(np.dot(e, x)), c) for k, c, x in rows if k == kb and x is not None and e is not None)[:4]
        want += [(qid, kb, c, -s, n + 1) for n, (s, c) in enumerate(scored)]
    for size in ({}, {"block": 4, "part": 16}):
        got = retrieval.search_collection(v, q, 4, **size).select("qid", "kb_id", "chunk_id", "score", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_tracked_states_in_update_mode(spark, tmp_path):
    from ragloom.streaming import tracking

    at = f"file://{tmp_path}"

    def run(rows):
        df = spark.createDataFrame(rows, "doc_id long, state string, t string, event_id long").select("doc_id", "state", F.col("t").cast("timestamp").alias("ts"), "event_id")
        df.coalesce(1).write.mode("append").parquet(f"{at}/in")
        s = spark.readStream.schema(df.schema).parquet(f"{at}/in")
        tracking.keep_tracked(tracking.tracked(s, 60, ("parsing",), "10 minutes", 2), f"{at}/out", f"{at}/cp", buckets=2)
        return [sorted((r.doc_id, r.state) for r in tracking.read_tracked(spark, f"{at}/out", n).collect()) for n in (tracking.STATES, tracking.ALARMS)]

    day = "2024-01-01 "
    states, alarms = run([(1, "parsing", day + "10:00:00", 1), (2, "parsing", day + "10:00:00", 2), (2, "done", day + "10:30:00", 3), (3, "done", day + "10:40:00", 4)])
    assert states == [(1, "parsing"), (2, "done"), (3, "done")] and alarms == []
    # an event older than the held one changes nothing, even if it isn't late; the watermark passes the alarm of document 1
    states, alarms = run([(3, "parsing", day + "10:35:00", 5), (4, "done", day + "11:30:00", 6)])
    assert states == [(1, "parsing"), (2, "done"), (3, "done"), (4, "done")] and alarms == [(1, "parsing")]
    # behind the watermark: left out
    states, alarms = run([(1, "done", day + "10:10:00", 7), (5, "parsing", day + "11:40:00", 8)])
    assert (1, "parsing") in states and (5, "parsing") in states and alarms == [(1, "parsing")]
    states, alarms = run([(5, "done", day + "11:45:00", 9), (6, "done", "2024-01-05 00:00:00", 10)])
    assert (5, "done") in states and alarms == [(1, "parsing")]  # a newer event took the alarm away


def test_segments_are_the_best_path(spark):
    import itertools
    import math
    import random

    from ragloom.functions import segmentation as sg

    r = random.Random(5)
    letters = "\u4e00\u4e8c\u4e09\u56db\u4e94"
    words = {"".join(r.choice(letters[:4]) for _ in range(r.randint(1, 4))): r.randint(1, 50) for _ in range(25)}
    table, total = sg.prefix_table(words)
    for _ in range(200):
        run = "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
        got = sg.segment(run, table, total)
        assert "".join(got) == run
        # a place where some word starts takes a word there, any other one code point
        fits = lambda i, w: w in words or (len(w) == 1 and not any(run.startswith(x, i) for x in words))
        paths = []
        for cuts in itertools.product((False, True), repeat=len(run) - 1):
            at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(run)]
            path = [run[a:b] for a, b in zip(at, at[1:])]
            if all(fits(a, w) for a, w in zip(at, path)):
                paths.append(sum(math.log(words.get(w, 1)) - total for w in path))
        assert sum(math.log(words.get(w, 1)) - total for w in got) == pytest.approx(max(paths))
    d = sg.dictionary(spark.createDataFrame([("\u542f\u52a8", 5), ("\u542f", 1), ("\u542f\u52a8", 4), ("", 3), ("x", None)], "word string, freq long"))
    x = spark.createDataFrame([("AGV \u542f\u52a8\u5668 STEP 3",), (None,)], "t string")
    assert [r.k for r in x.select(sg.segmented_tokens(F.col("t"), d).alias("k")).collect()] == [["AGV", "\u542f\u52a8", "\u5668", "STEP", "3", "agv", "step", "3"], []]
