"""Branches, loops and iterative retrieval recipes over keyed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.durable import materialize
from ragloom.functions import parsing

Step = Callable[[DataFrame], DataFrame]


def branch(rows: DataFrame, steps: dict[str, Step], state: str = "state") -> DataFrame:
    """Each step gets the rows of its state; rows of other states pass. Steps return the same columns."""
    out = rows.where(~F.coalesce(F.col(state).isin(*steps), F.lit(False)))
    for name, step in steps.items():
        out = out.unionByName(step(rows.where(F.col(state) == name)).select(*rows.columns))
    return out


def loop(rows: DataFrame, step: Callable[[DataFrame, int], DataFrame], times: int, active: str = "active") -> DataFrame:
    """At most ``times`` rounds; rows that are no longer active keep their values; ends when none is.

    Each round is written to the shared folder, so that models run once and lineage doesn't grow."""
    for turn in range(times):
        going = rows.where(active)
        if going.isEmpty():
            break
        rows = materialize(rows.where(f"not {active}").unionByName(step(going, turn).select(*rows.columns)), "round")
    return rows


def generate(prompts: DataFrame, fn) -> DataFrame:
    """``fn(list of prompts) -> list of answers`` on batches, keyed by qid; a failing batch gives null answers."""

    def run(batches):
        for pdf in batches:
            try:
                said = list(fn(pdf["prompt"].tolist()))
                if len(said) != len(pdf):
                    raise ValueError("answers and prompts differ in number")
            except Exception:  # a model's failure is a null answer
                said = [None] * len(pdf)
            yield pdf[["qid"]].assign(answer=said)

    return prompts.select("qid", "prompt").mapInPandas(run, f"qid {prompts.schema['qid'].dataType.simpleString()}, answer string")


#: Recipe -> (router of the answer, its state that goes on, next query of an answer, final answer of an answer).
RECIPES = {
    "ircot": ("answer_phrase", "incomplete", parsing.first_sentence, parsing.so_the_answer_is),
    "iterretgen": (None, None, lambda a: a, lambda a: a),
    "search_o1": ("search_query", "retrieve", parsing.last_search_query, parsing.boxed),
    "search_r1": ("end_token", "incomplete", parsing.last_search_tag, parsing.answer_tag),
    "r1_searcher": ("end_token_or_answer", "incomplete", parsing.last_query_tag, parsing.answer_tag),
}


def iterative_retrieval(questions: DataFrame, search: Step, fn, recipe: str, rounds: int = 3, template: str = "Passages:\n{passages}\nQuestion: {question}\nSo far: {so_far}\nAnswer:") -> DataFrame:
    """Rounds of search, prompt, answer and routing: ``questions (qid, question) -> (qid, question, query, answer, so_far, round, active, pred)``.

    ``search(df with qid, question) -> (qid, rank, passage)``.
    """
    from ragloom.functions.prompts import render

    router, goes_on, next_query, final = RECIPES[recipe]
    rows = questions.select("qid", "question", F.col("question").alias("query"), F.lit("").alias("answer"), F.lit("").alias("so_far"), F.lit(0).alias("round"), F.lit(True).alias("active"))

    def step(going: DataFrame, turn: int) -> DataFrame:
        found = search(going.select("qid", F.col("query").alias("question")))
        nested = found.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage"))), lambda s: s["passage"]), "\n").alias("passages"))
        x = going.join(nested, "qid", "left")
        said = generate(x.select("qid", render(template, passages=F.col("passages"), question=F.col("question"), so_far=F.col("so_far")).alias("prompt")), fn).withColumnRenamed("answer", "said")
        x = x.drop("passages").join(said, "qid").withColumn("answer", F.coalesce("said", F.lit("")))
        on = F.lit(True) if router is None else parsing.ROUTES[router](F.col("answer")) == goes_on
        query = next_query(F.col("answer"))
        query = F.concat_ws(" ", "question", "answer") if recipe == "iterretgen" else F.when(query == "", F.col("question")).otherwise(query)  # X9
        return x.select("qid", "question", query.alias("query"), "answer", F.trim(F.concat_ws(" ", "so_far", "answer")).alias("so_far"), F.lit(turn + 1).alias("round"), on.alias("active"))

    return loop(rows, step, rounds).withColumn("pred", final(F.col("answer")))


#: Prompts of the branching recipe.
CHECK_TEMPLATE = "Question: {question}\nDocuments:\n{documents}\nIs more needed?"
SUBQUESTION_TEMPLATE = "Question: {question}\nDocuments:\n{documents}\nNext query:"
ANSWER_TEMPLATE = "Question: {question}\nDocuments:\n{documents}\nAnswer:"


def _ask(rows: DataFrame, template: str, fn, name: str) -> DataFrame:
    """A model's answer for each row as the column ``name``."""
    from ragloom.functions.prompts import render

    prompts = rows.select("qid", render(template, question=F.col("question"), documents=F.array_join("passages", "\n")).alias("prompt"))
    said = generate(prompts, fn).withColumnRenamed("answer", name)
    return rows.drop(name).join(said, "qid").withColumn(name, F.coalesce(name, F.lit("")))


def _retrieved(found: DataFrame) -> DataFrame:
    return found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage"))), lambda s: s["passage"]).alias("_found"))


def branch_rag(questions: DataFrame, search: Step, check, subquestion, answer, times: int = 10) -> DataFrame:
    """X22 with a branch in the loop: ``questions (qid, question) -> (qid, question, passages, rounds, said, pred)``.

    All questions are searched once. In a round a model looks at each question's passages; where it asks for a search
    (the ``continue`` arm) it writes a sub-question, whose passages go behind those that the question has, and the
    question takes part in the next round; where it doesn't (``stop``) the question keeps what it has. At the end, or after ``times`` rounds, every question
    is answered from all its passages. ``search(df with qid, question) -> (qid, rank, passage)``; ``check``, ``subquestion`` and ``answer``
    take lists of prompts. Passages of a question are one array: rounds and the search's top-k bound it.
    """
    none = F.array().cast("array<string>")
    rows = questions.select("qid", "question").join(_retrieved(search(questions.select("qid", "question"))), "qid", "left")
    rows = rows.select("qid", "question", F.coalesce("_found", none).alias("passages"), F.lit(0).alias("rounds"), F.lit("continue").alias("state"), F.lit(True).alias("active"))

    def more(x: DataFrame) -> DataFrame:
        x = _ask(x, SUBQUESTION_TEMPLATE, subquestion, "subq")
        found = _retrieved(search(x.select("qid", F.col("subq").alias("question"))))
        return x.join(found, "qid", "left").withColumns({"passages": F.concat("passages", F.coalesce("_found", none)), "rounds": F.col("rounds") + 1})

    def step(going: DataFrame, turn: int) -> DataFrame:
        judged = _ask(going, CHECK_TEMPLATE, check, "judged").withColumn("state", parsing.ROUTES["search_tag"](F.col("judged"))).drop("judged")
        judged = materialize(judged, "judged")  # both arms read it, and the model runs once
        return branch(judged, {"continue": more}).withColumn("active", F.col("state") == "continue")

    done = _ask(loop(rows, step, times), ANSWER_TEMPLATE, answer, "said")
    return done.select("qid", "question", "passages", "rounds", "said", parsing.boxed(F.col("said")).alias("pred"))


def accumulate(trace: DataFrame) -> DataFrame:
    """``(qid, round, var, value)`` -> per question and variable the values of all rounds in order; absent rounds give none."""
    return trace.groupBy("qid", "var").agg(F.transform(F.array_sort(F.collect_list(F.struct("round", "value"))), lambda s: s["value"]).alias("values"))
