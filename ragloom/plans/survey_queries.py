"""Queries of long-form writing: actions of model answers, plans, states and prompts.

Answers are built from the tables' own rows; the SQL judges the same rows without JSON, from the parts alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import actions as ac
from ragloom.functions import parsing as ps
from ragloom.functions.text import strip
from ragloom.operators import survey as sv

from .registry import query, table

_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


# --- one answer: refusal, questions, thought and action ----------------------------------------------------------------


@query(f"""WITH x AS (SELECT conv_id, turn, turn % 3 AS k, coalesce(text, '') AS text, trim(coalesce(text, ''), {_TRIM}) AS t FROM conversations)
  SELECT conv_id, turn, turn % 2 = 0 AS refused, CASE WHEN turn % 2 = 0 THEN '根据现有文档，无法回答。' ELSE t END AS shown, k = 0 AND text <> '' AS valid,
    CAST(CASE WHEN k = 1 THEN -1 ELSE 0 END + CASE WHEN k = 0 AND text <> '' THEN 0 ELSE -2 END AS INTEGER) AS score, CASE WHEN k < 2 THEN 'search' END AS action,
    CASE WHEN k = 0 AND t <> '' THEN t WHEN k = 1 THEN 'last' END AS question, CASE WHEN k <> 1 THEN t END AS thought FROM x""")
def response_actions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    k, t = F.col("turn") % 3, F.col("text")
    asked = [F.struct(F.lit(" ").alias("query"), F.lit("g").alias("gold_answer")), F.struct(t.alias("query"), F.when(k == 0, " g ").otherwise(" ").alias("gold_answer"))]
    asked += [F.struct(F.when(k == 1, "last").alias("query"), F.lit("g").alias("gold_answer"))]
    questions = F.concat(F.lit("text "), F.when(k < 2, F.to_json(F.struct(F.array(*asked).alias("questions")))).otherwise("{none}"), F.lit(" end"))
    search = F.to_json(F.struct(F.lit("search").alias("name"), F.array(t, F.lit("b")).alias("keywords"), F.when(k == 1, F.lit(2)).alias("more")))
    answer = F.concat(F.when(k == 1, "").otherwise(F.concat(F.lit("<thought> "), t, F.lit("\n</thought>"))), F.lit("\n<action> "), F.when(k < 2, search).otherwise('{"name": "search"'), F.lit("</action>"))
    refusal = F.when(F.col("turn") % 2 == 0, F.concat(t, F.lit("\n根据现有文档，无法回答。\n 根据现有文档，无法回答。"))).otherwise("fine")
    x = x.withColumns({"a": ac.action(answer), "thought": ac.thought(answer)}).withColumn("valid", ac.valid_action(F.col("a")))
    return x.select(
        "conv_id", "turn", ps.declares_no_information(refusal).alias("refused"), ps.refusal_text(refusal, t).alias("shown"), "valid",
        ac.step_score(F.col("thought").isNotNull(), F.col("valid")).alias("score"), F.try_variant_get("a", "$.name", "string").alias("action"),
        F.get(ac.generated_questions(questions), F.lit(0))["query"].alias("question"), strip(F.col("thought")).alias("thought"),
    )


# --- the five kinds of action --------------------------------------------------------------------------------------------


def _sections(n, title, plan):
    return F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda x: F.struct(title.alias("title"), plan.alias("plan")))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """One answer for each document, of the kind that its number gives, with the faults that its number gives."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    n = (i % 15).cast("int")
    more = F.when(i % 11 == 0, F.lit("x")).alias("note")
    words = F.transform(F.sequence(F.lit(0), n), lambda x: F.concat("lang", x.cast("string")))
    search = F.struct(F.lit("search").alias("name"), F.concat(F.slice(words, 2, n), F.when(i % 7 == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))).alias("keywords"), more)
    init = F.struct(F.lit("init-plan").alias("name"), text.alias("title"), _sections(n, F.lit("part"), F.col("source")).alias("sections"), more)
    extend = F.struct(F.lit("extend-plan").alias("name"), F.col("position"), _sections((i % 9).cast("int"), F.lit("sub"), text).alias("subsections"), more)
    nop = F.struct(F.lit("nop").alias("name"), more)
    content = F.concat(text, F.when(i % 7 == 0, " #").otherwise(""), F.when(i % 13 == 0, " BibKey").otherwise(""), F.repeat(F.lit(" \\cite{k1}"), n), F.when(i % 6 == 0, "\\cite{k9}").otherwise(""))
    write = F.struct(F.lit("write").alias("name"), content.alias("content"), more)
    x = table(spark, d, "documents").withColumn("position", F.concat(F.lit("section-"), (i % 4 + 1).cast("string"), F.when(i % 3 == 1, ".1").when(i % 3 == 2, ".1.1").otherwise("")))
    kind, out = i % 5, F.lit("{").cast("string")
    for k, a in enumerate((search, init, extend, nop, write)):
        out = F.when(kind == k, F.to_json(a)).otherwise(out)
    known = F.when(i % 4 != 0, F.array(F.lit("k1"), F.lit("k2")))
    return x.select(
        i.alias("answer_id"), i.alias("qid"), F.concat(F.when(i % 2 == 0, "<thought>so</thought>").otherwise(""), F.lit("<action>"), out, F.lit("</action>")).alias("response"),
        F.when(i % 7 == 0, "section-9").when(i % 13 != 0, F.col("position")).alias("cursor"), F.when(i % 2 == 0, "Write on it").otherwise("写综述").alias("instruction"), known.alias("known"),
    )


def _outlines(spark: SparkSession, d: str) -> DataFrame:
    """Three sections for each even document; the second has a part, the third a part with a part."""
    at = F.array(*[F.struct(*map(F.lit, p)) for p in ((1, 0, 0), (2, 0, 0), (2, 1, 0), (3, 0, 0), (3, 1, 0), (3, 1, 1))]).cast("array<struct<i: int, j: int, k: int>>")
    x = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("qid"), F.explode(at).alias("at"))
    return x.select("qid", "at.*", F.lit("t").alias("title"), F.lit("p").alias("plan"), F.lit(None).cast("string").alias("content"))


_LETTERS = r"""regexp_replace({}, '[!"#$%&''()*+,\-./:;<=>?@\\\[\]^_`{{|}}~0-9 \n\t]', '', 'g')"""
_LANGUAGE = f"""CASE WHEN {_LETTERS.format('said')} = '' THEN true WHEN i % 2 = 0 THEN length(regexp_replace({_LETTERS.format('said')}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) / length({_LETTERS.format('said')}) < 0.05
  ELSE length(regexp_replace({_LETTERS.format('said')}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) / length({_LETTERS.format('said')}) > 0.6 END"""


@query(f"""WITH x AS (SELECT doc_id AS i, doc_id % 15 AS n, doc_id % 9 AS m, coalesce(text, '') AS text, source FROM documents),
  y AS (SELECT *, CASE i % 5 WHEN 1 THEN text || repeat('part' || source, CAST(n AS INTEGER)) WHEN 2 THEN repeat('sub' || text, CAST(m AS INTEGER)) ELSE text || CASE WHEN i % 13 = 0 THEN 'BibKey' ELSE '' END END AS said,
    text || CASE WHEN i % 7 = 0 THEN ' #' ELSE '' END || CASE WHEN i % 13 = 0 THEN ' BibKey' ELSE '' END || repeat(' \\cite{{k1}}', CAST(n AS INTEGER)) || CASE WHEN i % 6 = 0 THEN '\\cite{{k9}}' ELSE '' END AS content FROM x),
  z AS (SELECT i, i % 11 <> 0 AND CASE i % 5 WHEN 0 THEN n > 0 AND i % 7 <> 0 WHEN 1 THEN n > 0 AND text <> '' AND coalesce(source, '') <> '' WHEN 2 THEN m > 0 AND text <> '' AND (i % 13 = 0 OR true) AND i % 7 <> 0 AND i % 3 <> 2
      AND (i % 2 = 1 OR (i % 3 = 0 AND i % 4 = 0) OR (i % 3 = 1 AND i % 4 = 1)) ELSE true END AS easy,
    CASE i % 5 WHEN 0 THEN n <= 5 WHEN 1 THEN n BETWEEN 3 AND 12 AND {_LANGUAGE} WHEN 2 THEN m BETWEEN 2 AND 7 AND {_LANGUAGE} WHEN 3 THEN true
      ELSE NOT contains(content, '#') AND NOT contains(lower(content), 'bibkey') AND length(trim(content, {_TRIM})) > 50 AND n + CASE WHEN i % 6 = 0 THEN 1 ELSE 0 END <= 12 AND (i % 4 = 0 OR i % 6 <> 0) AND {_LANGUAGE} END AS strict FROM y)
  SELECT i AS answer_id, hard, ['search', 'init-plan', 'extend-plan', 'nop', 'write'][i % 5 + 1] AS kind, v AS valid, CAST(CASE WHEN i % 2 = 0 THEN 0 ELSE -1 END + CASE WHEN v THEN 0 ELSE -2 END AS INTEGER) AS score
  FROM (SELECT i, false AS hard, easy AS v FROM z UNION ALL SELECT i, true, easy AND strict FROM z)""")
def survey_actions(spark, d):
    answers, nodes = _answers(spark, d), _outlines(spark, d)
    both = [sv.judge_actions(answers, nodes, hard).withColumn("hard", F.lit(hard)) for hard in (False, True)]
    return both[0].unionByName(both[1]).select("answer_id", "hard", F.try_variant_get("action", "$.name", "string").alias("kind"), "valid", "score")


@query("""WITH p AS (SELECT doc_id AS qid, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no, unnest(string_split(text, chr(10))) AS line FROM documents)
  SELECT qid, CASE WHEN qid % 2 = 0 THEN no WHEN qid % 3 = 0 THEN 4 ELSE 5 END AS i, CASE WHEN qid % 2 = 0 THEN 0 WHEN qid % 3 = 0 THEN no ELSE 2 END AS j, CASE WHEN qid % 2 = 0 OR qid % 3 = 0 THEN 0 ELSE no END AS k, 'Part ' || no AS title, '- ' || line AS plan FROM p""")
def survey_plans(spark, d):
    """Each document's lines as the parts of a first plan, or of an extension at a section or below one."""
    i, text = F.col("doc_id"), F.col("text")
    parts = F.transform(F.split(text, "\n", -1), lambda ln, no: F.struct(F.concat(F.lit("Part "), (no + 1).cast("string")).alias("title"), F.concat(F.lit("- "), ln).alias("plan")))
    plan = F.to_json(F.struct(F.lit("init-plan").alias("name"), F.lit("T").alias("title"), parts.alias("sections")))
    more = F.to_json(F.struct(F.lit("extend-plan").alias("name"), F.when(i % 3 == 0, "section-4").otherwise("section-5.2").alias("position"), parts.alias("subsections")))
    answers = table(spark, d, "documents").where(text.isNotNull()).select(
        i.alias("answer_id"), i.alias("qid"), F.concat(F.lit("<action>"), F.when(i % 2 == 0, plan).otherwise(more), F.lit("</action>")).alias("response"),
        *[F.lit(None).cast(kind).alias(c) for c, kind in (("cursor", "string"), ("instruction", "string"), ("known", "array<string>"))],
    )
    x = sv.planned_nodes(sv.judge_actions(answers, spark.createDataFrame([], sv.NODE), hard=False))
    return x.select("qid", *[F.col(c).cast("long").alias(c) for c in "ijk"], "title", "plan")


# --- states ------------------------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT doc_id, ['search', 'analyst-init_plan', 'write', 'analyst-extend_plan', 'done'][doc_id % 5 + 1] AS st, ['outline', 'section-1', NULL][doc_id % 3 + 1] AS here, doc_id % 14 AS ext, ['extended', 'nop', 'retry', NULL][doc_id % 4 + 1] AS res, doc_id % 150 AS step, doc_id % 7 <> 0 AS ok FROM documents)
  SELECT doc_id, CAST(step + 1 AS BIGINT) AS step,
    CASE WHEN step >= 140 THEN 'done' WHEN NOT ok AND st <> 'analyst-extend_plan' THEN st WHEN NOT ok THEN CASE WHEN ext < 12 THEN st ELSE 'done' END
      WHEN st = 'search' AND here = 'outline' THEN 'analyst-init_plan' WHEN st = 'search' AND here = 'section-1' THEN 'write' WHEN st = 'search' THEN 'done'
      WHEN st = 'analyst-init_plan' AND here = 'section-1' THEN 'search' WHEN st = 'analyst-init_plan' THEN st
      WHEN st = 'write' AND here IS NOT NULL THEN 'search' WHEN st = 'write' AND ext < 12 THEN 'analyst-extend_plan' WHEN st = 'write' THEN 'done'
      WHEN st = 'analyst-extend_plan' AND res = 'extended' THEN 'search' WHEN st = 'analyst-extend_plan' AND res = 'nop' THEN 'done' WHEN st = 'analyst-extend_plan' AND ext < 12 THEN st ELSE 'done' END AS state,
    CAST(ext + CASE WHEN step < 140 AND ((NOT ok AND st = 'analyst-extend_plan') OR (ok AND st = 'write' AND here IS NULL AND ext < 12)) THEN 1 ELSE 0 END AS BIGINT) AS extend_time FROM x""")
def survey_state(spark, d):
    i = F.col("doc_id")
    pick = lambda names: F.element_at(F.array(*[F.lit(x).cast("string") for x in names]), (i % len(names) + 1).cast("int"))
    n = sv.next_state(pick((sv.SEARCH, sv.INIT, sv.WRITE, sv.EXTEND, sv.DONE)), pick(("outline", "section-1", None)), i % 14, pick((sv.EXTENDED, sv.NOP, sv.RETRY, None)), i % 150, i % 7 != 0)
    return table(spark, d, "documents").select("doc_id", n.alias("n")).select("doc_id", F.col("n.step").cast("long").alias("step"), "n.state", F.col("n.extend_time").cast("long").alias("extend_time"))


# --- prompts -----------------------------------------------------------------------------------------------------------

_PLACES = ((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 2, 0), (2, 0, 0), (2, 1, 0), (3, 0, 0))
_NAMES = [".".join(str(n) for n in p if n) for p in _PLACES]
_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '\"', '&#34;')"


def _outline_sql(full: str) -> str:
    body = f"CASE WHEN r < done AND NOT blank THEN '[OK] ' || trim(replace(text, chr(10), ' '), {_TRIM}) WHEN r >= done OR NOT ({full}) THEN '[PLAN] ' || source ELSE '' END"
    line = f"repeat('    ', deep) || repeat('#', deep + 1) || ' Section-' || p || ' [' || lang || r || ']: ' || {body} || chr(10)"
    return f"'# Title: ' || CASE qid % 3 WHEN 0 THEN 'None' WHEN 1 THEN '' ELSE '[OK] Survey ' || qid END || chr(10) || string_agg({line}, '' ORDER BY r)"


@query(f"""WITH n AS (SELECT *, doc_id // 7 AS qid, CAST(doc_id % 7 AS INTEGER) AS r, (doc_id // 7) % 9 AS done FROM documents),
  m AS (SELECT *, {_NAMES}[r + 1] AS p, length({_NAMES}[r + 1]) // 2 AS deep, CASE WHEN done = 0 THEN 'outline' ELSE {_NAMES}[least(done, 7)] END AS now, trim(text, {_TRIM}) = '' OR (r = 3 AND qid % 2 = 1) OR (r = 0 AND qid % 5 = 1) AS blank FROM n),
  g AS (SELECT *, CASE WHEN now = 'outline' THEN 0 ELSE length(now) // 2 END AS hire, now <> 'outline' AND starts_with(now, p[1]) AS at1, now <> 'outline' AND starts_with(now, p[1:3]) AS at2 FROM m),
  o AS (SELECT qid, {_outline_sql('false')} AS brief, {_outline_sql("CASE deep WHEN 0 THEN hire = 0 OR (at1 AND hire = 1) WHEN 1 THEN (at1 AND hire = 1) OR (at2 AND hire = 2) ELSE at2 END")} AS whole FROM g GROUP BY qid),
  t AS (SELECT item_id AS qid, {_ESCAPED.format('text')} AS task, {_ESCAPED.format("coalesce(brief, 'There is no survey.')")} AS brief, {_ESCAPED.format("coalesce(whole, 'There is no survey.')")} AS whole, 'You need to update ' || CASE WHEN item_id % 4 = 0 THEN 'None' ELSE 'section-' || item_id % 4 END AS at_node, CASE WHEN item_id % 2 = 0 THEN '' ELSE 'i' || item_id END AS info
    FROM benchmark LEFT JOIN o ON o.qid * 2 = item_id)
  SELECT qid, 'Task: ' || task || chr(10) || 'Outline:' || chr(10) || brief || chr(10) || 'At: ' || at_node || chr(10) || 'Search for:' AS search, 'Task: ' || task || chr(10) || 'Known:' || chr(10) || info || chr(10) || 'Plan:' AS init,
    'Task: ' || task || chr(10) || 'Survey:' || chr(10) || whole || chr(10) || 'At: ' || at_node || chr(10) || 'Known:' || chr(10) || info || chr(10) || 'Text:' AS write, 'Task: ' || task || chr(10) || 'Survey:' || chr(10) || brief || chr(10) || 'Extend:' AS extend FROM t""")
def survey_prompts(spark, d):
    """Seven documents are an outline's nodes, so many of them written as the outline's number says; every second task has an outline."""
    i, qid = F.col("doc_id"), F.floor(F.col("doc_id") / 7)
    r = (i % 7).cast("int")
    at = F.element_at(F.array(*[F.struct(*[F.lit(n).alias(c) for n, c in zip(p, "ijk")]) for p in _PLACES]), r + 1)
    blank = (strip(F.col("text")) == "") | ((r == 3) & (qid % 2 == 1)) | ((r == 0) & (qid % 5 == 1))
    content = F.when(r < qid % 9, F.when(blank, "").otherwise(F.col("text")))
    nodes = table(spark, d, "documents").select((qid * 2).alias("qid"), at.alias("at"), F.concat("lang", r.cast("string")).alias("title"), F.col("source").alias("plan"), content.alias("content")).select("qid", "at.*", "title", "plan", "content")
    x = nodes.select("qid").distinct()
    titles = x.select("qid", F.when(F.col("qid") / 2 % 3 == 1, "").when(F.col("qid") / 2 % 3 == 2, F.concat(F.lit("Survey "), (F.col("qid") / 2).cast("long").cast("string"))).alias("title"))
    n = F.col("item_id")
    tasks = table(spark, d, "benchmark").select(n.alias("qid"), F.col("text").alias("instruction"), F.when(n % 4 != 0, F.concat(F.lit("section-"), (n % 4).cast("string"))).alias("cursor"), F.when(n % 2 == 0, "<PAD>").otherwise(F.concat(F.lit("i"), n.cast("string"))).alias("info"))
    out = tasks.select("qid")
    for step in ("search", "init", "write", "extend"):
        out = out.join(sv.survey_prompts(step, tasks, nodes, titles).withColumnRenamed("prompt", step), "qid")
    return out
