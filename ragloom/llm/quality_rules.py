"""Quality rules by weak supervision, in DataFrame functions only.

Rules look at counts of a whole text and vote good (+1), bad (-1) or abstain (0). Expectation-maximisation over the table
of vote patterns (at most 3 ** rules rows, whatever the corpus) estimates how often each rule votes what on good and on
bad documents, and the share of good ones; a document's posterior then replaces all-must-pass filtering. The estimate is
one ``aggregate`` expression over one row of pattern counts, with fixed pseudo-counts that anchor the two classes.

Words are runs of characters other than space and \\x09-\\x0d. Word windows are compared by 64-bit hash within a document.

Defined cases: null and empty texts have zero words and fail the base rule; repeated rows are counted and judged each;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS, materialize, scoped

SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
ROUNDS, KEEP_AT = 40, 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def text_counts(docs: DataFrame) -> DataFrame:
    """``documents -> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_letters_ascii, n_calls, n_stops)``."""
    ws = F.lit(WORD_SEPARATORS)
    d = scoped(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    t = F.col("text")
    trimmed = F.btrim(t, ws)
    d = d.select(
        "doc_id",
        F.length(F.translate(t, WORD_SEPARATORS, "")).cast("long").alias("word_chars"),
        _count_of(t, SYMBOLS).alias("n_symbols"),
        _count_of(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        _count_of(t, "!").alias("n_calls"),
        _count_of(t, ".").alias("n_stops"),
        F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, ws) != "").alias("lines"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1)).alias("words"),
    )
    counts = ["doc_id", "word_chars", "n_symbols", "n_capitals", "n_calls", "n_stops"]
    d = d.select(
        *counts,
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") > WINDOW,
            F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)])),
        ).alias("hashes"),
    )
    counts += ["n_words", "n_lines", "n_dup_lines"]
    # only texts with a repeated window are sorted
    d = d.select(
        *counts,
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ranked"),
    )
    again = F.filter("ranked", lambda x, k: (x["h"] == F.get(F.col("ranked"), k + 1)["h"]) | (x["h"] == F.get(F.col("ranked"), k - 1)["h"]))
    d = d.select(*counts, F.array_sort(F.transform(again, lambda x: x["i"])).alias("at"))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return d.select(*counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 2).otherwise(1)


def rules() -> dict[str, Column]:
    """Votes as 0 (bad), 1 (abstain) and 2 (good), over the columns of :func:`text_counts`."""
    n, chars = F.col("n_words"), F.col("word_chars")
    dup, lines, rep = F.col("n_dup_lines"), F.col("n_lines"), F.col("n_repeat_words")
    return {
        "length": _vote(n < MIN_WORDS, n >= 40),
        "word_length": _vote((chars < 2 * n) | (chars > 14 * n), (chars >= 3 * n) & (chars <= 10 * n)),
        "symbols_by_word": _vote(10 * F.col("n_symbols") > n, 100 * F.col("n_symbols") <= 3 * n),
        "symbols_by_char": _vote(50 * F.col("n_symbols") > chars, 200 * F.col("n_symbols") <= chars),
        "lines": _vote(10 * dup > 3 * lines, dup == 0),
        "repeats": _vote(5 * rep > n, 20 * rep <= n),
        "capitals": _vote(10 * F.col("n_capitals") > 3 * chars, 10 * F.col("n_capitals") <= chars),
        "calls": _vote(5 * F.col("n_calls") > n, 50 * F.col("n_calls") <= n),
        "sentences": _vote((F.col("n_stops") == 0) & (n >= 40), (F.col("n_stops") > 0) & (2 * F.col("n_stops") <= n)),
    }


#: Pseudo-counts, as shares of the corpus, of bad / abstain / good votes by class, and their total weight.
#: The anchor weighs as much as the corpus: rules that rarely fire would otherwise be learned as signs of a good text.
GOOD_VOTES, BAD_VOTES, PRIOR_WEIGHT, GOOD_SHARE = (0.01, 0.09, 0.90), (0.25, 0.05, 0.70), 1.0, 0.85


def vote_model(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> DataFrame:
    """Expectation-maximisation: ``(cells array<int>, n long) -> (cells, p_good)``.

    A cell is ``3 * rule + vote``. The table has at most ``3 ** n_rules`` rows and becomes one row's array.
    """
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("cells", F.col("n").cast("double").alias("n")))).alias("ps"))
    one = one.withColumn("total", F.aggregate("ps", F.lit(0.0), lambda a, p: a + p["n"]))
    prior_good = F.array(*[F.lit(x) for _ in range(n_rules) for x in GOOD_VOTES])
    prior_bad = F.array(*[F.lit(x) for _ in range(n_rules) for x in BAD_VOTES])
    weight = F.col("total") * PRIOR_WEIGHT + 1.0

    def posteriors(model):
        def one_pattern(p):
            odds = F.aggregate(p["cells"], F.log((1.0 - model["share"]) / model["share"]), lambda a, c: a + F.get(model["ratio"], c))
            return F.struct(p["cells"].alias("cells"), p["n"].alias("n"), (1.0 / (1.0 + F.exp(F.least(odds, F.lit(700.0))))).alias("p"))

        return F.transform("ps", one_pattern)

    def step(model, _):
        # mass of good and of all votes by cell
        scored = posteriors(model)
        mass = F.aggregate(
            scored,
            F.struct(F.lit(0.0).alias("good"), F.array_repeat(F.lit(0.0), 3 * n_rules).alias("g"), F.array_repeat(F.lit(0.0), 3 * n_rules).alias("b")),
            lambda a, p: F.struct(
                (a["good"] + p["n"] * p["p"]).alias("good"),
                F.transform(a["g"], lambda x, c: x + F.when(F.array_contains(p["cells"], c), p["n"] * p["p"]).otherwise(0.0)).alias("g"),
                F.transform(a["b"], lambda x, c: x + F.when(F.array_contains(p["cells"], c), p["n"] * (1.0 - p["p"])).otherwise(0.0)).alias("b"),
            ),
            lambda a: F.struct(
                ((a["good"] + weight * GOOD_SHARE) / (F.col("total") + weight)).alias("share"),
                F.zip_with(
                    F.zip_with(a["g"], prior_good, lambda x, q: (x + weight * GOOD_SHARE * q) / (a["good"] + weight * GOOD_SHARE)),
                    F.zip_with(a["b"], prior_bad, lambda x, q: (x + weight * (1 - GOOD_SHARE) * q) / (F.col("total") - a["good"] + weight * (1 - GOOD_SHARE))),
                    lambda g, b: F.log(b / g),
                ).alias("ratio"),
            ),
        )
        return mass

    start = F.struct(F.lit(GOOD_SHARE).alias("share"), F.zip_with(prior_good, prior_bad, lambda g, b: F.log(b / g)).alias("ratio"))
    fitted = one.withColumn("model", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))
    return fitted.select(F.explode(posteriors(F.col("model"))).alias("x")).select("x.cells", F.col("x.p").alias("p_good"))


def judge(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """``documents -> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good)``."""
    votes = rules()
    cells = F.array(*[F.lit(3 * k) + v for k, v in enumerate(votes.values())])
    counted = materialize(text_counts(docs).select("doc_id", *COUNTS, cells.alias("cells")), "quality-counts")
    model = vote_model(counted.groupBy("cells").agg(F.count("*").alias("n")), len(votes))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # the model has at most 3 ** rules rows, so it may be broadcast
    return counted.join(F.broadcast(model), "cells").select("doc_id", *COUNTS, base.alias("base_failed"), (~base & (F.col("p_good") >= keep_at)).alias("kept"), "p_good")


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents that the rules keep, columns unchanged (rows are matched by doc_id)."""
    return docs.join(judge(docs).where("kept").select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)
