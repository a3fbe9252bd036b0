"""Model answers that carry JSON, read as VARIANT: questions, thoughts and actions with their checks.

A VARIANT keeps what an answer really holds (its keys, and whether a value is text, a list or something else), so that
checks of form don't depend on a schema that casts. JSON that can't be read is null; of repeated keys Spark refuses what
Python's reader would take the last of.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _trimmed, citation_keys, same_language, strip

#: Kinds of actions, and the bounds that hold in hard mode.
ACTIONS = ("search", "init-plan", "extend-plan", "nop", "write")
MAX_KEYWORDS, SECTIONS, SUBSECTIONS, MIN_CONTENT, MAX_CITES = 5, (3, 12), (2, 7), 50, 12


def _field(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _list(v: Column, name: str) -> Column:
    return _field(v, name, "array<variant>")


def _text(v: Column, name: str) -> Column:
    """A field that is text, else null."""
    return F.when(F.schema_of_variant(_field(v, name)) == "STRING", _field(v, name, "string"))


def _has_keys(v: Column, *names: str) -> Column:
    """An object with these keys and no others."""
    return F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))) == F.array(*map(F.lit, sorted(names)))


def generated_questions(x: Column) -> Column:
    """``array<struct<query, gold_answer>>``: questions of the first JSON object that have both as text."""
    parsed = F.try_parse_json(F.regexp_extract(x, r"(\{[\s\S]*\})", 1))
    asked = F.transform(_list(parsed, "questions"), lambda q: F.struct(strip(_text(q, "query")).alias("query"), strip(_text(q, "gold_answer")).alias("gold_answer")))
    return F.filter(asked, lambda q: (q["query"] != "") & (q["gold_answer"] != ""))


def thought(x: Column) -> Column:
    """What stands between the first thought marks, null without them."""
    return F.when(x.rlike(r"(?s)<thought>.*?</thought>"), _trimmed(F.regexp_extract(x, r"(?s)<thought>(.*?)</thought>", 1)))


def action(x: Column, is_json: bool = True) -> Column:
    """The action as VARIANT. Without JSON the marked text (or none) is what a ``write`` action has as content."""
    inside = F.regexp_extract(x, r"(?s)<action>(.*?)</action>", 1)
    if is_json:
        return F.try_parse_json(_trimmed(inside))
    return F.to_variant_object(F.struct(F.lit("write").alias("name"), F.coalesce(_trimmed(inside), F.lit("")).alias("content")))


def step_score(has_thought: Column, valid: Column) -> Column:
    """-1 without a thought, -2 without a valid action."""
    return F.when(has_thought, 0).otherwise(-1) + F.when(valid, 0).otherwise(-2)


def _parts(sections: Column) -> Column:
    """Sections that have a title and a plan, both of them text, and nothing else."""
    return (F.size(sections) > 0) & F.forall(sections, lambda s: _has_keys(s, "title", "plan") & (_text(s, "title") != "") & (_text(s, "plan") != ""))


def _said(sections: Column) -> Column:
    return F.array_join(F.transform(sections, lambda s: F.concat_ws("\n", _text(s, "title"), _text(s, "plan"))), "\n")


def valid_action(
    a: Column, instruction: Column | None = None, cursor: Column | None = None, open_node: Column | None = None, known: Column | None = None, hard: bool = True, allowed: tuple[str, ...] = ACTIONS
) -> Column:
    """Whether an action VARIANT has the form of its kind.

    Key sets are exact. ``cursor``: where an ``extend-plan`` has to stand (null: anywhere); ``open_node``: whether its position is a
    node without parts below it (null: there is no outline). Bounds of counts, the language of ``instruction`` (null or empty: any), forbidden
    marks and ``known`` citation keys (null or none: any) are checked in hard mode only.
    """
    none = F.lit(None).cast("string")
    instruction, cursor = none if instruction is None else instruction, none if cursor is None else cursor
    open_node = F.lit(None).cast("boolean") if open_node is None else open_node
    known = F.array().cast("array<string>") if known is None else F.coalesce(known, F.array().cast("array<string>"))
    name, title, position, content = (_text(a, k) for k in ("name", "title", "position", "content"))
    keywords, sections, subsections = _list(a, "keywords"), _list(a, "sections"), _list(a, "subsections")

    def spoken(x: Column) -> Column:
        return F.when(F.coalesce(instruction, F.lit("")) == "", True).otherwise(same_language(x, instruction))

    checks = {
        "search": _has_keys(a, "name", "keywords") & (F.size(keywords) > 0) & F.forall(keywords, lambda k: (F.schema_of_variant(k) == "STRING") & (k.cast("string") != "")),
        "init-plan": _has_keys(a, "name", "title", "sections") & (title != "") & _parts(sections),
        "extend-plan": _has_keys(a, "name", "position", "subsections") & (position != "") & _parts(subsections)
        & F.coalesce(position == cursor, F.lit(True)) & (F.size(F.split(position, r"\.", -1)) <= 2) & F.coalesce(open_node, F.lit(True)),
        "nop": _has_keys(a, "name"),
        "write": _has_keys(a, "name", "content"),
    }
    if hard:
        checks["search"] &= F.size(keywords) <= MAX_KEYWORDS
        checks["init-plan"] &= F.size(sections).between(*SECTIONS) & spoken(F.concat_ws("\n", title, _said(sections)))
        checks["extend-plan"] &= F.size(subsections).between(*SUBSECTIONS) & spoken(_said(subsections))
        cites = (F.length(content) - F.length(F.replace(content, F.lit("\\cite"), F.lit("")))) / len("\\cite")
        checks["write"] &= ~content.contains("#") & ~F.lower(content).contains("bibkey") & (F.length(_trimmed(content)) > MIN_CONTENT) & spoken(content) & (cites <= MAX_CITES)
        checks["write"] &= (F.size(known) == 0) | (F.size(F.array_except(citation_keys(content), known)) == 0)
    verdict = F.lit(False)
    for kind in allowed:
        verdict = F.when(name == kind, checks[kind]).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))
