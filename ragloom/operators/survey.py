"""Outline state of long-form writing: a flat node table and a transition column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions import actions
from ragloom.functions.prompts import TEMPLATES, render
from ragloom.functions.text import strip

MAX_STEPS, MAX_EXTENDS = 140, 12
#: Node table: position i.j.k (0 where a level is missing) with title, plan and content.
NODE = "qid long, i int, j int, k int, title string, plan string, content string"


def initial_state(questions: DataFrame) -> DataFrame:
    """V1."""
    return questions.withColumns({"state": F.lit("search"), "cursor": F.lit("outline"), "step": F.lit(0), "extend_time": F.lit(0), "extend_result": F.lit("")})


# Names of states and of what an extension came to.
SEARCH, INIT, WRITE, EXTEND, DONE = "search", "analyst-init_plan", "write", "analyst-extend_plan", "done"
EXTENDED, NOP, RETRY = "extended", "nop", "retry"


def next_state(state: Column, cursor: Column, extends: Column, result: Column, step: Column, parsed: Column) -> Column:
    """V2: ``struct(state, extend_time, step)`` after a step.

    A search goes on to the first plan where the cursor is the outline, else to writing; a first plan is asked for until
    the cursor has left the outline; after writing the next open node is searched, and without one the plan is extended,
    which counts an attempt; an extension leads to a search, to the end (``nop``), or to another try. An unreadable answer (``parsed`` false)
    keeps its state; an unreadable extension counts an attempt. At the caps of steps and of attempts everything is done.
    """
    may_extend = F.when(extends < MAX_EXTENDS, EXTEND).otherwise(DONE)
    at_outline = cursor == "outline"
    failed = F.when(state == EXTEND, may_extend).otherwise(state)
    moved = (
        F.when(state == SEARCH, F.when(at_outline, INIT).when(cursor.isNotNull(), WRITE).otherwise(DONE))
        .when(state == INIT, F.when(~at_outline, SEARCH).otherwise(INIT))
        .when(state == WRITE, F.when(cursor.isNotNull(), SEARCH).otherwise(may_extend))
        .when(state == EXTEND, F.when(result == EXTENDED, SEARCH).when(result == NOP, DONE).otherwise(may_extend))
        .otherwise(DONE)
    )
    parsed, capped = F.coalesce(parsed, F.lit(True)), step >= MAX_STEPS
    counts = F.when(parsed, (state == WRITE) & cursor.isNull() & (extends < MAX_EXTENDS)).otherwise(state == EXTEND)
    return F.struct(
        F.when(capped, DONE).when(parsed, moved).otherwise(failed).alias("state"),
        (extends + F.when(~capped & counts, 1).otherwise(0)).alias("extend_time"),
        (step + 1).alias("step"),
    )


def position(i: Column, j: Column, k: Column) -> Column:
    """``section-i.j.k`` without missing levels."""
    p = F.concat(F.lit("section-"), i.cast("string"))
    p = F.when(j > 0, F.concat(p, F.lit("."), j.cast("string"))).otherwise(p)
    return F.when(k > 0, F.concat(p, F.lit("."), k.cast("string"))).otherwise(p)


def update_outline(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """V3: rows replace nodes at their position."""
    return nodes.join(rows.select("qid", "i", "j", "k"), ["qid", "i", "j", "k"], "left_anti").unionByName(rows)


def judge_actions(answers: DataFrame, nodes: DataFrame, hard: bool = True, allowed: tuple[str, ...] = actions.ACTIONS) -> DataFrame:
    """``answers (answer_id, qid, response, cursor, instruction, known)`` with ``thought``, ``action`` (VARIANT), ``valid`` and ``score``.

    Where an ``extend-plan`` points to is looked up in the outline table: the node must be there and have none below it. A
    question without nodes has no outline yet, and any position may stand.
    """
    a = answers.withColumns({"thought": actions.thought(F.col("response")), "action": actions.action(F.col("response"))})
    at = F.try_variant_get("action", "$.position", "string")
    part = lambda n: F.regexp_extract(at, r"^[^-]*-(\d+)(?:\.(\d+))?(?:\.(\d+))?$", n)
    level = [F.when(part(n) != "", part(n).try_cast("int")).otherwise(0).alias(c) for n, c in ((1, "i"), (2, "j"), (3, "k"))]
    a = a.select("*", *level)
    below = nodes.select("qid", "i", F.when(F.col("k") > 0, F.col("j")).otherwise(0).alias("j"), F.lit(0).alias("k")).where("j > 0").unionByName(
        nodes.where("j > 0").select("qid", "i", F.lit(0).alias("j"), F.lit(0).alias("k"))
    ).distinct().withColumn("_below", F.lit(True))
    place = nodes.select("qid", "i", "j", "k", F.lit(True).alias("_there")).distinct().join(below, ["qid", "i", "j", "k"], "left")
    outlined = nodes.select("qid", F.lit(True).alias("_outlined")).distinct()
    x = a.join(outlined, "qid", "left").join(place, ["qid", "i", "j", "k"], "left")
    is_open = F.when(F.col("_outlined"), F.coalesce("_there", F.lit(False)) & F.col("_below").isNull())
    x = x.withColumn("valid", actions.valid_action(F.col("action"), F.col("instruction"), F.col("cursor"), is_open, F.col("known"), hard, allowed))
    return x.withColumn("score", actions.step_score(F.col("thought").isNotNull(), F.col("valid"))).drop("i", "j", "k", "_outlined", "_there", "_below")


def planned_nodes(judged: DataFrame) -> DataFrame:
    """The outline rows that valid plans and extensions add, ``(qid, i, j, k, title, plan, content)``."""
    a = F.col("action")
    at = F.split(F.element_at(F.split(F.try_variant_get(a, "$.position", "string"), "-"), -1), r"\.")
    up = [F.coalesce(F.try_element_at(at, F.lit(n)).try_cast("int"), F.lit(0)) for n in (1, 2)]
    x = judged.where("valid").select("qid", F.try_variant_get(a, "$.name", "string").alias("name"), *[u.alias(f"up{n}") for n, u in enumerate(up)],
        F.posexplode(F.coalesce(F.try_variant_get(a, "$.sections", "array<variant>"), F.try_variant_get(a, "$.subsections", "array<variant>"))).alias("no", "part"))
    no = F.col("no") + 1
    return x.select(
        "qid",
        F.when(F.col("name") == "init-plan", no).otherwise(F.col("up0")).alias("i"),
        F.when(F.col("name") == "init-plan", 0).when(F.col("up1") == 0, no).otherwise(F.col("up1")).alias("j"),
        F.when((F.col("name") == "init-plan") | (F.col("up1") == 0), 0).otherwise(no).alias("k"),
        F.try_variant_get("part", "$.title", "string").alias("title"), F.try_variant_get("part", "$.plan", "string").alias("plan"), F.lit(None).cast("string").alias("content"),
    )


def cursor(nodes: DataFrame) -> DataFrame:
    """V4: first node in reading order without content, last one with it, and how many are done."""
    pos = F.struct("i", "j", "k")
    empty = F.coalesce("content", F.lit("")) == ""
    x = nodes.groupBy("qid").agg(F.min(F.when(empty, pos)).alias("c"), F.max(F.when(~empty, pos)).alias("d"), F.count_if(~empty).alias("n_done"), F.count("*").alias("n_nodes"))
    at = lambda c: F.when(F.col(c).isNotNull(), position(F.col(f"{c}.i"), F.col(f"{c}.j"), F.col(f"{c}.k")))
    return x.select("qid", at("c").alias("cursor"), at("d").alias("last_done"), "n_done", "n_nodes")


def outline_summary(nodes: DataFrame) -> DataFrame:
    """V4: one text for each survey: positions, titles, and whether a node is written."""
    done = F.when(F.coalesce("content", F.lit("")) == "", F.lit(" [open]")).otherwise(F.lit(" [OK]"))
    line = F.concat(position(F.col("i"), F.col("j"), F.col("k")), F.lit(" "), F.col("title"), done)
    x = nodes.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("i", "j", "k", line.alias("s")))).alias("ls"))
    return x.select("qid", F.array_join(F.transform("ls", lambda s: s["s"]), "\n").alias("summary"))


NO_SURVEY, NO_INFO = "There is no survey.", "<PAD>"  # fixed values


def last_done(nodes: DataFrame) -> DataFrame:
    """V4: ``(qid, now)``: the node before the first one without content in reading order, ``outline`` if that is the first of all."""
    pos = F.struct("i", "j", "k")
    first = nodes.groupBy("qid").agg(F.min(F.when(F.col("content").isNull(), pos)).alias("_open"))
    x = nodes.join(first, "qid").groupBy("qid").agg(F.max(F.when(F.col("_open").isNull() | (pos < F.col("_open")), pos)).alias("d"))
    return x.select("qid", F.when(F.col("d").isNull(), "outline").otherwise(position(F.col("d.i"), F.col("d.j"), F.col("d.k"))).alias("now"))


def outline_text(nodes: DataFrame, titles: DataFrame, detail: bool = False) -> DataFrame:
    """P10: ``(qid, outline)``: a title line, then a line for each node with its content, or its plan where it has none.

    ``titles (qid, title)``: a null title is "None". With ``detail`` nodes near the last written one show only what is written: there an
    empty content hides the plan.
    """
    line = lambda c: strip(F.replace(c, F.lit("\n"), F.lit(" ")))
    part, level = position(F.col("i"), F.col("j"), F.col("k")), 1 + (F.col("j") > 0).cast("int") + (F.col("k") > 0).cast("int")
    x = nodes
    full = F.lit(False)
    if detail:
        x = x.join(last_done(nodes), "qid")
        depth = F.size(F.split("now", r"\.", -1)) - 1
        at = [F.startswith("now", position(F.col("i"), j, F.lit(0))) for j in (F.lit(0), F.col("j"))]
        below = F.when(level == 2, (at[0] & (depth == 1)) | (at[1] & (depth == 2))).otherwise(at[1])
        full = F.when(level == 1, (depth == 0) | (at[0] & (depth == 1))).otherwise(below)
    body = F.when(F.col("content") != "", F.concat(F.lit("[OK] "), line(F.col("content")))).when(F.col("plan").isNotNull() & (F.col("content").isNull() | ~full), F.concat(F.lit("[PLAN] "), line(F.col("plan")))).otherwise("")
    shown = F.concat(F.repeat(F.lit("    "), level - 1), F.repeat(F.lit("#"), level), F.lit(" S"), F.substring(part, F.lit(2), F.length(part)), F.lit(" ["), F.coalesce("title", F.lit("")), F.lit("]: "), body, F.lit("\n"))
    lines = x.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("i", "j", "k", shown.alias("s")))).alias("ls"))
    title = F.when(F.col("title").isNull(), "None").when(F.col("title") == "", "").otherwise(F.concat(F.lit("[OK] "), line(F.col("title"))))
    return titles.join(lines, "qid", "left").select("qid", F.concat(F.lit("# Title: "), title, F.lit("\n"), F.coalesce(F.array_join(F.transform("ls", lambda s: s["s"]), ""), F.lit(""))).alias("outline"))


def survey_prompts(step: str, tasks: DataFrame, nodes: DataFrame, titles: DataFrame, template: str | None = None) -> DataFrame:
    """P10: ``tasks (qid, instruction, cursor, info)`` -> ``(qid, prompt)`` of one of the steps search, init, write and extend.

    A search sees the outline and where it goes on, a first plan what was found, writing all of these with the detail of
    ``outline_text``, an extension the outline. A task without title row says that there is no survey; padding counts as no information.
    """
    text = outline_text(nodes, titles, detail=step == "write")
    x = tasks.join(text, "qid", "left")
    slots = {
        "instruction": F.col("instruction"),
        "outline": F.coalesce("outline", F.lit(NO_SURVEY)),
        "cursor": F.concat(F.lit("You need to update "), F.coalesce("cursor", F.lit("None"))),
        "info": F.when(F.col("info") == NO_INFO, "").otherwise(F.coalesce("info", F.lit(""))),
    }
    return x.select("qid", render(template or TEMPLATES[f"survey_{step}"], **slots).alias("prompt"))


def render_outline(nodes: DataFrame) -> DataFrame:
    """V5: markdown with numbered headings; citation commands become bracketed numbers."""
    from ragloom.functions.text import clean_generated, clean_title, rewrite_citations

    number = F.concat_ws(".", F.col("i").cast("string"), F.when(F.col("j") > 0, F.col("j").cast("string")), F.when(F.col("k") > 0, F.col("k").cast("string")))
    marks = F.repeat(F.lit("#"), 2 + (F.col("j") > 0).cast("int") + (F.col("k") > 0).cast("int"))
    body = clean_generated(rewrite_citations(F.coalesce("content", F.lit(""))))
    part = F.concat(marks, F.lit(" "), number, F.lit(" "), clean_title(F.col("title")), F.when(body != "", F.concat(F.lit("\n\n"), body)).otherwise(""))
    x = nodes.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("i", "j", "k", part.alias("s")))).alias("ls"))
    return x.select("qid", F.array_join(F.transform("ls", lambda s: s["s"]), "\n\n").alias("markdown"))
