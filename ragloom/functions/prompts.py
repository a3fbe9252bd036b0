"""Prompt tables: slot filling over escaped columns, and the column preparations of the prompt families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed replacements, in this order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;"))


def html_escape(x: Column) -> Column:
    for a, b in ESCAPES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def render(template: str, escape: bool = True, **slots: Column) -> Column:
    """``{name}`` slots of a fixed template; values aren't searched for slots again."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = min(((rest.find("{" + n + "}"), n) for n in slots if "{" + n + "}" in rest), default=None)
        if at is None:
            parts.append(F.lit(rest))
            break
        if at[0]:
            parts.append(F.lit(rest[: at[0]]))
        value = F.coalesce(slots[at[1]].cast("string"), F.lit(""))
        parts.append(html_escape(value) if escape else value)
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def lettered(choices: Column) -> Column:
    """``A: ...`` lines."""
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.char(i + 65), F.lit(": "), c)), "\n")


def passages(p: Column, first: int | None = None) -> Column:
    """Passages on lines, all or the first few."""
    return F.array_join(F.slice(p, 1, first) if first else p, "\n")


def reason_window(steps: Column) -> Column:
    """All of three or fewer, else the first and the last three, as ``Step i: ...`` lines."""
    kept = F.when(F.size(steps) <= 3, steps).otherwise(F.concat(F.slice(steps, 1, 1), F.slice(steps, F.greatest(F.size(steps) - 2, F.lit(1)), 3)))
    return F.array_join(F.transform(kept, lambda s, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), s)), "\n")


def interleaved(queries: Column, results: Column) -> Column:
    """P8."""
    return F.array_join(F.zip_with(queries, results, lambda q, r: F.concat(F.lit("Query: "), F.coalesce(q, F.lit("")), F.lit("\nResult: "), F.coalesce(r, F.lit("")), F.lit("\n"))), "")


def multi_round(trace: DataFrame) -> DataFrame:
    """P5: ``trace (qid, round, question, passages array<string>, answer)`` -> the first round's question, passages of all rounds, answers of
    later rounds joined by a space; rounds without question give no part."""
    ordered = F.array_sort(F.collect_list(F.struct("round", "question", "passages", "answer")))
    x = trace.where("question is not null").groupBy("qid").agg(ordered.alias("t"))
    return x.select(
        "qid",
        F.get("t", F.lit(0))["question"].alias("question"),
        F.flatten(F.transform("t", lambda r: F.coalesce(r["passages"], F.array().cast("array<string>")))).alias("passages"),
        F.array_join(F.transform(F.filter("t", lambda r: (r["round"] > 0) & r["answer"].isNotNull()), lambda r: r["answer"]), " ").alias("answers"),
    )


#: Templates of the prompt families (P1, P4, P6, P9, P10): short forms of our own; pass another to ``render``.
TEMPLATES = {
    "question": "Question: {question}\nAnswer:",
    "boxed": "Question: {question}\nPut the answer in \\boxed{}.",
    "choices": "Question: {question}\nChoices:\n{choices}\nAnswer:",
    "passages": "Passages:\n{passages}\nQuestion: {question}\nAnswer:",
    "history": "{history}{answer}\n<information>{passages}</information>\n",
    "refined": "Knowledge: {knowledge}\nQuestion: {question}\nAnswer:",
    "page_init": "Question: {question}\nPlan: {plan}\nPage:",
    "page_subq": "Question: {question}\nPlan: {plan}\nPage: {page}\nNext sub-question:",
    "page_answer": "Page: {page}\nQuestion: {question}\nAnswer:",
    "page_fill": "Question: {question}\nPlan: {plan}\nPage: {page}\nSub-question: {subq}\nPassages:\n{passages}\nPage:",
    "survey_search": "Task: {instruction}\nOutline:\n{outline}\nAt: {cursor}\nSearch for:",
    "survey_init": "Task: {instruction}\nKnown:\n{info}\nPlan:",
    "survey_write": "Task: {instruction}\nSurvey:\n{outline}\nAt: {cursor}\nKnown:\n{info}\nText:",
    "survey_extend": "Task: {instruction}\nSurvey:\n{outline}\nExtend:",
}
