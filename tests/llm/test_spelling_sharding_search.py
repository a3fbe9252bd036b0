"""Spelling variants, sharding and ranked search against brute force, at their sizes' limits and on odd rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ragloom.llm import lexical_ranking, queries, sharding, spelling

from ..harness import compare, duck

SF = "/root/testdata/sf0.001"
UP_LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def frame(spark, texts, ids=None):
    rows = [(i, t, "x") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, word string").withColumn("n", F.lit(1)).withColumn("shard", F.lit("y")).withColumn("terms", F.lit(None).cast("string"))


# spelling ------------------------------------------------------------------------------------------------------------


def brute_words(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP_LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 6
    return {w: c for w, c in n.items() if c >= 5}


def brute_variants(rows):
    n = brute_words(rows)
    holes, longer = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[i, w[:i], w[i + 1 :]].add(w)
            longer[w[:i] + w[i + 1 :]].add(w)
    form, found = {}, {}
    for w in n:
        cuts = {w[:i] + w[i + 1 :] for i in range(len(w))}
        found[w] = (set().union(*[holes[i, w[:i], w[i + 1 :]] for i in range(len(w))]) | longer[w] | (cuts & n.keys())) - {w}
        top = min(found[w], key=lambda x: (-n[x], x), default=None)
        form[w] = top if top is not None and n[top] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(found[w]), n[form[w]] if form[w] else None))
    return out


def variant_rows(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_variants_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = variant_rows(queries.op11_spelling_variants(spark, "/root/testdata/sf0.01"))
    want = brute_variants([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert set(got) == want and len(got) == len(want) and any(r[1] for r in got) and any(r[4] > 1 for r in got)


def typo_rows(seed=3):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdeéñÿz") for _ in range(r.randint(5, 12))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaab", "abababab", "b" * 64, "b" * 65, "b" * 66, "c" * 70, "c" * 69 + "d"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(40):
            w = r.choice(stems[: r.randint(1, len(stems))])
            kind = r.randint(0, 11)
            p = r.randrange(len(w))
            c = r.choice("abzÀ×")
            words.append(w[:p] + w[p + 1 :] if kind == 0 else w[:p] + c + w[p:] if kind == 1 else w[:p] + c + w[p + 1 :] if kind == 2 else w.upper() if kind == 3 else w)
        rows.append((None if i % 50 == 7 else i, r.choice([" ", "-", "1", "ā"]).join(words)))
    return [*rows, (1, None), (2, ""), (3, "x" * 5000), (4, "x" * 5000), (5, "x" * 5000), (5, "x" * 5000), (5, "x" * 5000), (6, ("y" * 4999 + " ") * 6), (8, "chainaa " * 6 + "chainab " * 40 + "chaincb " * 250 + "chaincbd " * 6)]


@pytest.mark.parametrize("limits", [{}, {"filter_words": 5, "max_bytes": 100}])
def test_variants_of_typos_in_one_pass_and_in_many(spark, limits):
    rows = typo_rows()
    got = variant_rows(spelling.variants(frame(spark, [t for _, t in rows], [i for i, _ in rows]), **limits))
    want = brute_variants(rows)
    assert set(got) == want and len(got) == len(want)
    assert max(r[4] for r in want) > 3 and any(r[1] and r[1] != r[2] for r in want)


def test_variants_of_an_empty_table(spark):
    assert variant_rows(spelling.variants(frame(spark, ["x"]).limit(0))) == []


def test_hashes_of_edits_are_the_hashes_of_the_edited_words():
    words = ["letters", "bookkeeping", "été-".replace("-", "ÿ") * 3, "z" * 100]
    x = spelling.Words(words)
    at = np.arange(len(x.codes))
    keys, larger = x.replacements(at)
    for i in at:
        w, p = words[x.word[i]], x.place[i]
        assert x.deletions(at)[i] == spelling.Words([w[:p] + w[p + 1 :]]).key()[0]
        for j in (0, 30, len(spelling.ALPHABET) - 1):
            c = chr(int(spelling.ALPHABET[j]))
            assert keys[i, j] == spelling.Words([w[:p] + c + w[p + 1 :]]).key()[0] and larger[i, j] == (c > w[p])
    for cls in (8, 65):
        some = np.arange(1000, dtype=np.uint64) * np.uint64(7919)
        bits = spelling.build_filter(some, cls)
        assert len(spelling.in_filter(bits, some)) == 1000
        assert len(spelling.in_filter(bits, some + np.uint64(3))) < (20 if cls == 8 else 2)


# sharding ------------------------------------------------------------------------------------------------------------


def test_sharding_of_whole_table(spark):
    rows = queries.op12_sharding(spark, SF).collect()
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    want = collections.Counter((d["doc_id"], len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = collections.defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1


def test_sharding_of_odd_rows_in_small_blocks(spark):
    df = frame(spark, [None, "", "same", "same", "same"] * 40, [None, 1, 1, 2, 2] * 40).withColumn("slot", F.lit(5)).withColumn("document", F.array(F.lit("z")))
    for parts in (1, 7):
        rows = sharding.shuffle_into_shards(df.repartition(parts), 3, block_rows=8).collect()
        assert collections.Counter(r.shard for r in rows) == {0: 67, 1: 67, 2: 66}
        assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in ((0, 67), (1, 67), (2, 66)))
        assert collections.Counter((r.document.doc_id, r.document.text) for r in rows) == collections.Counter({(None, None): 40, (1, ""): 40, (1, "same"): 40, (2, "same"): 80})
        assert all(r.document.slot == 5 and r.document.shard == "y" for r in rows)
    assert sharding.shuffle_into_shards(df.limit(0)).collect() == []
    assert {r.shard for r in sharding.shuffle_into_shards(df.limit(2)).collect()} == {0, 1}


def test_same_seed_same_order_and_shards_as_files(spark, tmp_path):
    df = spark.range(0, 500, 1, 4).withColumnRenamed("id", "doc_id")
    a, b, c = ([(r.shard, r.slot, r.document.doc_id) for r in sharding.shuffle_into_shards(df, 5, seed, 16).collect()] for seed in (1, 1, 2))
    assert sorted(a) == sorted(b) != sorted(c)
    sharding.write_shards(sharding.shuffle_into_shards(df, 5, 1, 16), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.shard, r.slot, r.document.doc_id) for r in back.collect()) == sorted(a)


def test_matrix_has_its_sums_and_is_uniform():
    rows, sizes = np.array([0, 5, 1, 30, 14]), sharding.shard_sizes(50, 7)
    before = np.concatenate(([0], np.cumsum(rows)))
    totals = np.zeros((5, 7))
    for seed in range(600):
        m = np.array([sharding.matrix_row(seed, before, sizes, p) for p in range(5)])
        assert (m.sum(axis=1) == rows).all() and (m.sum(axis=0) == sizes).all() and (m >= 0).all()
        totals += m
    assert np.abs(totals / 600 - np.outer(rows, sizes) / 50).max() < 0.25


def test_every_order_is_as_likely():
    """Four rows in two partitions, two shards: the 24 orders come equally often (chi-square with 23 degrees under 55)."""
    seen, n = collections.Counter(), 2400
    before, sizes = np.array([0, 1, 4]), np.array([2, 2])
    part, place = np.array([0, 1, 1, 1]), np.array([0, 0, 1, 2])
    for seed in range(n):
        shard, _, key = sharding.Deal(seed, np.array([0, 1]), before, sizes, 4)(part, place)
        seen[tuple(np.lexsort((key, shard)).tolist())] += 1
    assert len(seen) == 24 and sum((c - n / 24) ** 2 / (n / 24) for c in seen.values()) < 55


def test_hypergeometric_of_large_populations(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(sharding, "NUMPY_MOST", 0)
    mine = np.array([sharding.hypergeometric(rng, 30, 50, 20) for _ in range(4000)])
    numpys = rng.hypergeometric(30, 50, 20, 4000)
    assert abs(mine.mean() - numpys.mean()) < 0.15 and abs(mine.std() - numpys.std()) < 0.1
    assert [sharding.hypergeometric(rng, *x) for x in ((0, 5, 3), (5, 0, 3), (5, 5, 0), (5, 5, 10), (0, 0, 0))] == [0, 3, 0, 5, 0]
    big = sharding.hypergeometric(rng, 10**10, 3 * 10**10, 2 * 10**10)
    assert abs(big - 5 * 10**9) < 10**6


# search --------------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(rows, items, k=10):
    terms = [TERM.findall((t or "").translate(UP_LOW)) for _, t in rows]
    n_docs, n_terms = sum(map(bool, terms)), sum(map(len, terms))
    tfs = [collections.Counter(t) for t in terms]
    df = collections.Counter(t for c in tfs for t in c)
    asked = collections.defaultdict(set)
    for item_id, text in items:
        asked[item_id] |= set(TERM.findall((text or "").translate(UP_LOW)))
    out = []
    for item_id, ts in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in ts if df[t]}
        scores = []
        for (doc_id, _), c, t in zip(rows, tfs, terms):
            s = sum(w[x] * (10**9 * c[x] // (1000 * c[x] + 8 * (10 + 90 * len(t) * n_docs // n_terms))) for x in w if c[x])
            if s > 0 and doc_id is not None:
                scores.append((-s, doc_id))
        out += [(item_id, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return out


def search_rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_whole_table(spark):
    assert compare(queries.op13_ranked_search(spark, SF), duck(SF), queries.oracle_sql()["op13_ranked_search"]) == ""


@pytest.mark.parametrize("limits", [{}, {"max_terms": 12}])
def test_search_of_ties_repeats_and_odd_rows(spark, limits, monkeypatch):
    monkeypatch.setattr(lexical_ranking, "PIECE", 16)
    r = random.Random(1)
    words = ["w%d" % int(r.paretovariate(0.7)) for _ in range(400)] + ["É", "é", "x y", "日本"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(300)]
    rows = list(zip([*range(250), *range(50)], texts)) + [(900 + i, "same words W1 w2") for i in range(15)] + [(7, None), (8, ""), (9, "..,"), (None, "w1 w1 rare"), (None, None)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 30)))) for i in range(12)] + [(3, "rare W3"), (None, "same words"), (50, None), (51, "!!"), (52, "nowhere"), (53, "SAME"), (53, "SAME")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    got = search_rows(lexical_ranking.rank_documents(frame(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3), table, **limits))
    assert got == sorted(brute_search(rows, items), key=repr) and len(got) > 100


def test_search_of_empty_tables(spark):
    docs, items = frame(spark, ["a b"]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search_rows(lexical_ranking.rank_documents(docs.limit(0), items)) == []
    assert search_rows(lexical_ranking.rank_documents(docs, items.limit(0))) == []


def test_masks_stop_early_with_the_same_result():
    """A block of many documents: the best ten equal a full scoring, and few groups are scored."""
    rng = np.random.default_rng(2)
    ids = rng.permutation(20_000)
    postings = [(np.flatnonzero(rng.random(20_000) < p), None) for p in (0.5, 0.3, 0.1, 0.01, 0.001)]
    postings = [(rows, rng.integers(1, 100, len(rows)) + 200 * j) for j, (rows, _) in enumerate(postings)]
    scores = np.zeros(20_000, np.int64)
    for rows, gain in postings:
        scores[rows] += gain
    best, scored = lexical_ranking.Best(10), []
    add = best.add
    best.add = lambda d, s: (scored.append(len(d)), add(d, s))
    lexical_ranking.search_block(best, ids, postings)
    assert best.rows == sorted(zip((-scores).tolist(), ids.tolist()))[:10] and sum(scored) < 2000
