"""Answer-quality metrics, ranking metrics, significance and comparisons over tables."""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ragloom.functions.stemming import IRREGULAR_WORDS, stem
from ragloom.functions.text import eval_normalize

_ROUGE_WORD = re.compile("[a-z0-9]+")
UNTAGGED, MIN_TAGGED, LOW_F1 = "_untagged", 3, 0.3


# --- generation ------------------------------------------------------------------------------------------------------


def _words(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda w: w != "")


def _stemmed(words: list[str]) -> list[str]:
    """Words of over three letters by their stem."""
    return [stem(w) if len(w) > 3 else w for w in words]


@functools.cache
def _best_overlap(n: int, stems: bool = False):
    """Batch by batch: F1 of the ``n``-grams of space-separated words, the best of all golds; linear in the words."""

    def grams(text: str) -> Counter:
        words = [w for w in text.split(" ") if w]
        words = _stemmed(words) if stems else words
        return Counter(words if n == 1 else zip(*(words[k:] for k in range(n))))

    @F.pandas_udf(DoubleType())
    def best(golds: pd.Series, pred: pd.Series) -> pd.Series:
        def one(gs, p):
            top, mine = 0.0, grams(p or "")
            for g in gs if gs is not None and mine else ():
                if (theirs := grams(g or "")) and (both := (theirs & mine).total()):
                    top = max(top, 2.0 * both / (theirs.total() + mine.total()))
            return top

        return pd.Series([one(g, p) for g, p in zip(golds, pred)], dtype="float64")

    return best


def accuracy(golds: Column, pred: Column, empty_gold_matches: bool = False) -> Column:
    """M1 on normalised strings."""
    return F.exists(golds, lambda g: F.contains(pred, g) & ((g != "") | F.lit(empty_gold_matches))).cast("double")


def exact_match(golds: Column, pred: Column) -> Column:
    """M2."""
    return F.coalesce(F.array_contains(golds, pred), F.lit(False)).cast("double")


def cover_match(golds: Column, pred: Column, empty_gold_matches: bool = False) -> Column:
    """M3: every token of a gold is among the prediction's."""
    return F.exists(golds, lambda g: ((g != "") | F.lit(empty_gold_matches)) & (F.size(F.array_except(_words(g), _words(pred))) == 0)).cast("double")


def string_match(golds: Column, pred: Column) -> Column:
    """M4: share of golds equal to the prediction."""
    return F.when(F.size(golds) > 0, F.size(F.filter(golds, lambda g: g == pred)) / F.size(golds)).otherwise(0.0)


def token_f1(golds: Column, pred: Column) -> Column:
    """M5."""
    return _best_overlap(1)(golds, pred)


def _rouge_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), 0)


def rouge_n(golds: Column, pred: Column, n: int, stems: bool = False) -> Column:
    """M6: without stems for raw texts, as collections are evaluated; with them for normalised ones, as benchmarks are."""
    return _best_overlap(n, stems)(F.transform(golds, lambda g: F.array_join(_rouge_tokens(g), " ")), F.array_join(_rouge_tokens(pred), " "))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a row of its table is the bits of one number, so memory is linear."""
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for t in b:
        hit = row & places.get(t, 0)
        row = (row + hit | row - hit) & whole
    return len(a) - row.bit_count()


@functools.cache
def _best_rouge_l(stems: bool):
    @F.pandas_udf(DoubleType())
    def best(golds: pd.Series, pred: pd.Series) -> pd.Series:
        words = _stemmed if stems else list

        def one(gs, p):
            top, mine = 0.0, words(list(p))
            for g in gs if gs is not None else ():
                if len(g) and len(p) and (n := common_subsequence(words(list(g)), mine)):
                    top = max(top, 2.0 * n / (len(g) + len(p)))
            return top

        return pd.Series([one(g, p) for g, p in zip(golds, pred)], dtype="float64")

    return best


def rouge_l(golds: Column, pred: Column, stems: bool = False) -> Column:
    """M7, raw or stemmed as M6, batch by batch: built-in functions can't hold the table of two long texts."""
    return _best_rouge_l(stems)(F.transform(golds, _rouge_tokens), _rouge_tokens(pred))


def _stemmed_scores(golds: list[str], pred: str) -> tuple[float, float, float]:
    """F1 of stems, of pairs of stems and of the longest common subsequence, each the best of all golds.

    Only stems that a gold holds count in the prediction. Rules change endings alone and leave a word's first two letters (one, if that
    is all the stem has), so that other words needn't be stemmed; irregular words are.
    """
    words, top = _ROUGE_WORD.findall(pred), [0.0, 0.0, 0.0]
    golds = [_stemmed(_ROUGE_WORD.findall(g)) for g in golds] if words else []
    starts = {w[:2] for g in golds for w in g}
    stems = {w: w if len(w) <= 3 else stem(w) if w[:2] in starts or w[0] in starts or w in IRREGULAR_WORDS else None for w in set(words)}
    mine = [stems[w] for w in words]
    for theirs in golds:
        known = set(theirs)
        shared = [w if w in known else None for w in mine]
        inside = [w for w in shared if w is not None]
        if not inside:
            continue
        pairs = Counter(p for p in zip(shared, shared[1:]) if p[0] is not None and p[1] is not None) if len(theirs) > 1 else Counter()
        both = (Counter(theirs) & Counter(inside)).total(), (Counter(zip(theirs, theirs[1:])) & pairs).total(), common_subsequence(theirs, inside)
        for k, (n, all_of) in enumerate(zip(both, (len(theirs) + len(mine), len(theirs) + len(mine) - 2, len(theirs) + len(mine)))):
            if n:
                top[k] = max(top[k], 2.0 * n / all_of)
    return tuple(top)


@functools.cache
def _stemmed_rouge():
    """The three stemmed metrics in one pass over texts, which are split into words only here."""
    names = ("rouge1_stem", "rouge2_stem", "rougel_stem")

    @F.arrow_udf(f"struct<{', '.join(f'{n}: double' for n in names)}>")
    def scores(golds: pa.Array, pred: pa.Array) -> pa.Array:
        out = np.zeros((len(pred), 3))
        for i, (gs, p) in enumerate(zip(golds, pred)):
            if gs.is_valid:
                out[i] = _stemmed_scores([(g or "").lower() for g in gs.as_py()], (p.as_py() or "").lower())
        return pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(3)], names)

    return scores


#: M8: metric name -> column of (golds, prediction), both normalised, and whether it wants raw texts instead.
METRICS = {
    "acc": (accuracy, False), "em": (exact_match, False), "coverem": (cover_match, False), "stringem": (string_match, False), "f1": (token_f1, False),
    "rouge1": (lambda g, p: rouge_n(g, p, 1), True), "rouge2": (lambda g, p: rouge_n(g, p, 2), True), "rougel": (rouge_l, True),
    "rouge1_stem": (lambda g, p: rouge_n(g, p, 1, True), False), "rouge2_stem": (lambda g, p: rouge_n(g, p, 2, True), False), "rougel_stem": (lambda g, p: rouge_l(g, p, True), False),
}


def generation_metrics(answers: DataFrame, metrics: list[str], wide: bool = False) -> DataFrame:
    """M8: ``(id, golds array<string>, pred) -> (id, <metric>...)`` in one pass; unknown names are left out."""
    a = answers.select("id", "golds", F.coalesce("pred", F.lit("")).alias("pred"))
    a = a.withColumn("ng", F.transform(F.coalesce("golds", F.array().cast("array<string>")), lambda g: eval_normalize(g, wide))).withColumn("np", eval_normalize(F.col("pred"), wide))
    if any(m.endswith("_stem") for m in metrics if m in METRICS):
        a = a.withColumn("stemmed", _stemmed_rouge()("ng", "np"))
    of = lambda m, f, raw: F.col(f"stemmed.{m}") if m.endswith("_stem") else f(F.col("golds" if raw else "ng"), F.col("pred" if raw else "np"))
    return a.select("id", *[F.round(of(m, *METRICS[m]), 6).alias(m) for m in metrics if m in METRICS])


def averages(scores: DataFrame, key: str = "id") -> DataFrame:
    """M8: one row of ``avg_<metric>``, 0 for an empty table."""
    return scores.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"avg_{c}") for c in scores.columns if c != key])


def long_form(wide: DataFrame) -> DataFrame:
    """Metric columns as rows (metric, value)."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in wide.columns)
    return wide.selectExpr(f"stack({len(wide.columns)}, {pairs}) as (metric, value)")


# --- ranking ---------------------------------------------------------------------------------------------------------


def ranking_metrics(queries: DataFrame, gold: DataFrame, hits: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """``queries (qid)``, ``gold (qid, chunk_id)``, ``hits (qid, chunk_id, rank)`` -> one row for each question; 0 without gold."""
    g = gold.select("qid", "chunk_id").distinct()
    h = hits.groupBy("qid", "chunk_id").agg(F.min("rank").alias("rank"))
    found = g.join(h, ["qid", "chunk_id"], "left").groupBy("qid").agg(
        F.count("*").alias("n_gold"),
        F.min("rank").alias("first"),
        *[F.count_if(F.col("rank") <= k).alias(f"in_{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))).alias(f"dcg_{k}") for k in ks],
    )
    x = queries.select("qid").join(found, "qid", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    out = [zero(1 / F.col("first")).alias("mrr")]
    for k in ks:
        out += [zero(F.col(f"in_{k}") / F.col("n_gold")).alias(f"recall_{k}"), zero((F.col(f"in_{k}") > 0).cast("double")).alias(f"hit_{k}"), zero(F.when(F.col("n_gold") > 0, F.col(f"dcg_{k}") / ideal(k))).alias(f"ndcg_{k}")]
    return x.select("qid", F.coalesce("n_gold", F.lit(0)).alias("n_gold"), *out)


def trec_metrics(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """``run (qid, docid, score)``, ``qrels (qid, docid, rel)`` -> map, recip_rank, P, recall and graded ndcg for each question that both hold.
    Ties of score go by docid descending."""
    q = qrels.select("qid", "docid", "rel")
    total = q.groupBy("qid").agg(F.count_if(F.col("rel") > 0).alias("n_rel"), F.sort_array(F.collect_list(F.when(F.col("rel") > 0, F.col("rel"))), False).alias("gains"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("docid"))
    r = run.withColumn("rank", F.row_number().over(w)).join(q, ["qid", "docid"], "left").withColumn("rel", F.greatest(F.coalesce("rel", F.lit(0)), F.lit(0)))
    r = r.withColumn("seen", F.sum((F.col("rel") > 0).cast("int")).over(Window.partitionBy("qid").orderBy("rank")))
    good = F.col("rel") > 0
    per = r.groupBy("qid").agg(
        F.sum(F.when(good, F.col("seen") / F.col("rank"))).alias("ap"),
        F.min(F.when(good, F.col("rank"))).alias("first"),
        *[F.count_if(good & (F.col("rank") <= k)).alias(f"in_{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") <= k, F.col("rel") / F.log2(F.col("rank") + 1))).alias(f"dcg_{k}") for k in ks],
    )
    x = per.join(total, "qid")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    some = lambda c: F.when(F.col("n_rel") > 0, c)
    ideal = lambda k: F.aggregate(F.transform(F.slice("gains", 1, k), lambda g, i: g / F.log2(i + 2.0)), F.lit(0.0), lambda a, v: a + v)
    cols = [zero(some(F.col("ap") / F.col("n_rel"))).alias("map"), zero(1 / F.col("first")).alias("recip_rank")]
    for k in ks:
        cols += [zero(F.col(f"in_{k}") / F.lit(k)).alias(f"p_{k}"), zero(some(F.col(f"in_{k}") / F.col("n_rel"))).alias(f"recall_{k}"), zero(some(F.col(f"dcg_{k}") / ideal(k))).alias(f"ndcg_{k}")]
    return x.select("qid", *cols)


def paired_differences(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """Per question the metric in both runs and the difference; missing ones count 0."""
    x = a.select("qid", F.col(metric).alias("a")).join(b.select("qid", F.col(metric).alias("b")), "qid", "full")
    x = x.select("qid", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    return x.withColumn("diff", F.round(F.col("a") - F.col("b"), 9))


def permutation_test(diffs: DataFrame, rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """Two-sided paired test by random sign flips, hash-seeded: one row (mean_a, mean_b, diff, p_value, significant).

    Each question spreads over the rounds and adds its signed difference; partial sums shrink that to a row a round."""
    signed = diffs.select(F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("b"), "qid", "diff")
    sign = F.when(F.pmod(F.xxhash64(F.lit(seed), "b", "qid"), F.lit(2)) == 0, 1).otherwise(-1)
    flips = signed.groupBy("b").agg(F.sum(sign * F.col("diff")).alias("s"))
    seen = diffs.agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("diff").alias("diff"), F.sum("diff").alias("total"))
    p = flips.withColumn("_t", seen.select("total").scalar()).agg(F.avg((F.abs("s") >= F.abs("_t") - 1e-12).cast("double")).alias("p_value"))
    return seen.withColumn("p_value", F.round(p.scalar(), 6)).select(F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), F.round("diff", 6).alias("diff"), "p_value", (F.col("p_value") < 0.05).alias("significant"))


def tag_metrics(records: DataFrame, metrics: list[str], least: int = MIN_TAGGED) -> DataFrame:
    """I8: ``(qid, tags, <metric>...)``: averages for each tag with at least ``least`` items; items without tags share a bucket."""
    tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.col("tags")).otherwise(F.array(F.lit(UNTAGGED)))
    x = records.withColumn("tag", F.explode(F.array_distinct(tags)))
    return x.groupBy("tag").agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in metrics]).where(F.col("n") >= least)


def failures(records: DataFrame, k: int = 5) -> DataFrame:
    """``(qid, first, n_gold, f1)``: no gold in the first ``k``, or a low F1; with reasons."""
    missed = (F.col("n_gold") > 0) & (F.coalesce("first", F.lit(2**31 - 1)) > k)
    low = F.coalesce(F.col("f1") < LOW_F1, F.lit(False))
    x = records.withColumn("reasons", F.array_compact(F.array(F.when(missed, "no_gold_in_top"), F.when(low, "low_f1"))))
    return x.where(F.size("reasons") > 0)


def compare_hits(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per question new hits, promoted hits, and the Jaccard index of the two lists (1 if both are empty)."""
    x = a.select("qid", "chunk_id", F.col("rank").alias("ra")).join(b.select("qid", "chunk_id", F.col("rank").alias("rb")), ["qid", "chunk_id"], "full")
    out = x.groupBy("qid").agg(
        F.count_if(F.col("ra").isNull()).alias("new_hits"), F.count_if(F.col("rb") < F.col("ra")).alias("promoted"), F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull()).alias("common"), F.count("*").alias("either")
    )
    return out.select("qid", "new_hits", "promoted", F.round(F.col("common") / F.col("either"), 6).alias("jaccard"))


def experiment_matrix(reports: DataFrame, baseline: str) -> DataFrame:
    """``(grp, kb, metric, value)``: metrics as columns, differences from the baseline group, and a verdict."""
    wide = reports.groupBy("grp", "kb").pivot("metric", ["recall_5", "mrr"]).agg(F.first("value"))
    base = wide.where(F.col("grp") == baseline).select("kb", F.col("recall_5").alias("_r"), F.col("mrr").alias("_m"))
    x = wide.join(base, "kb", "left").withColumn("d_recall_5", F.round(F.col("recall_5") - F.col("_r"), 6)).withColumn("d_mrr", F.round(F.col("mrr") - F.col("_m"), 6))
    return x.withColumn("verdict", F.when((F.col("d_recall_5") >= 0.10) | (F.col("d_mrr") >= 0.05), "better").otherwise("no gain")).drop("_r", "_m")


def list_consistency(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per question whether both lists are equal in order, as sets, and what was added or is missing."""
    nest = lambda h, n: h.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s["chunk_id"]).alias(n))
    x = nest(a, "a").join(nest(b, "b"), "qid", "full")
    none = F.array().cast(a.schema["chunk_id"].dataType.simpleString().join(("array<", ">")))
    x = x.select("qid", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    return x.select("qid", (F.col("a") == F.col("b")).alias("same_order"), (F.array_sort("a") == F.array_sort("b")).alias("same_set"), F.size(F.array_except("b", "a")).alias("added"), F.size(F.array_except("a", "b")).alias("missing"))


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: counts, and rows of each table that the other lacks."""
    only_a, only_b = a.exceptAll(b).agg(F.count("*")), b.exceptAll(a).agg(F.count("*"))
    x = a.agg(F.count("*").alias("n_a")).withColumn("n_b", b.agg(F.count("*")).scalar())
    x = x.withColumn("only_a", only_a.scalar()).withColumn("only_b", only_b.scalar())
    return x.withColumn("ok", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def chunk_regression(chunks: DataFrame, reference: DataFrame) -> DataFrame:
    """Ids added to and missing from a reference set."""
    added = chunks.join(reference, "chunk_id", "left_anti").select("chunk_id", F.lit("added").alias("change"))
    return added.unionByName(reference.join(chunks, "chunk_id", "left_anti").select("chunk_id", F.lit("missing").alias("change")))


def kind_histogram(chunk_id: Column) -> Column:
    """Kind of a chunk by its id."""
    return F.when(chunk_id.rlike("_step_\\d+$"), "step").when(chunk_id.rlike("_section_\\d+$"), "section").when(chunk_id.rlike("_window_\\d+$"), "window").when(chunk_id.endswith("_intro"), "intro").otherwise("other")


def evaluation_report(items: DataFrame, hits: DataFrame, answers: DataFrame | None = None, ks: tuple[int, ...] = (1, 5, 10), metrics: tuple[str, ...] = ("acc", "f1")) -> dict[str, DataFrame]:
    """``items (qid, relevant_chunk_ids, tags, gold_answer)``, ``hits (qid, chunk_id, rank)``, ``answers (qid, answer)`` -> ``overall``
    and ``per_tag`` as (scope, tag, metric, value) rows, ``failures``, and ``records`` with a row for each item."""
    gold = items.select("qid", F.explode("relevant_chunk_ids").alias("chunk_id"))
    records = ranking_metrics(items, gold, hits, ks).join(items.select("qid", "tags"), "qid")
    if answers is not None:
        a = items.where("gold_answer is not null").join(answers, "qid", "left").select(F.col("qid").alias("id"), F.array("gold_answer").alias("golds"), F.col("answer").alias("pred"))
        records = records.join(generation_metrics(a, list(metrics)).withColumnRenamed("id", "qid"), "qid", "left")
    names = [c for c in records.columns if c not in ("qid", "n_gold", "tags")]
    overall = long_form(records.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in names]))
    tagged = tag_metrics(records, names)
    per_tag = tagged.selectExpr("tag", f"stack({len(names)}, {', '.join(f'{c!r}, cast(`{c}` as double)' for c in names)}) as (metric, value)")
    first = F.when(F.col("mrr") > 0, F.round(1 / F.col("mrr")).cast("int"))
    bad = failures(records.select("qid", "n_gold", first.alias("first"), (F.col("f1") if "f1" in names else F.lit(None).cast("double")).alias("f1")), min(max(ks), 5))
    scope = lambda d, s: d.select(F.lit(s).alias("scope"), (F.col("tag") if "tag" in d.columns else F.lit("")).alias("tag"), "metric", "value")
    return {"overall": scope(overall, "all"), "per_tag": scope(per_tag, "tag"), "failures": bad, "records": records}
