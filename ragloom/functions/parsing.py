"""Parsing and routing of model responses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Fixed markers.
BEGIN_SEARCH, END_SEARCH = "<|begin_search_query|>", "<|end_search_query|>"
BEGIN_QUERY, END_QUERY = "<|begin_of_query|>", "<|end_of_query|>"
FINAL_INFORMATION = "**Final Information**"
END_TOKENS = ("<|endoftext|>", "<|im_end|>")
NO_INFORMATION, NOT_FOUND, CANNOT_ANSWER, SKIPPED = "根据现有文档", "未找到与该问题相关的信息", "无法回答", "[跳过]"
NO_QUERY = "There is no query."


def _last(x: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), 1), F.lit(-1))


def _question(q: Column) -> Column:
    q = strip(q)
    return F.coalesce(F.when(q.endswith("?"), q).otherwise(F.concat(q, F.lit("?"))), F.lit(NO_QUERY))


def last_search_tag(x: Column) -> Column:
    """The last ``<search>`` query as a question."""
    return _question(_last(x, "<search>([^<]*)"))


def last_query_tag(x: Column) -> Column:
    """The last query between its literal tags as a question."""
    return _question(_last(x, r"(?s)<\|begin_of_query\|>(.*?)<\|end_of_query\|>"))


def last_search_query(x: Column) -> Column:
    """The last search query between its tags, spaces collapsed and quotes stripped, else empty."""
    q = strip(_last(x, r"(?s)<\|begin_search_query\|>(.*?)<\|end_search_query\|>"))
    return F.coalesce(F.btrim(F.regexp_replace(q, r"\s+", " "), F.lit(" \"'")), F.lit(""))


def reason_before_search(x: Column) -> Column:
    """X4."""
    return strip(F.substring_index(x, BEGIN_SEARCH, 1))


def final_information(x: Column) -> Column:
    """From the marker on, else empty."""
    at = F.instr(x, FINAL_INFORMATION)
    return F.when(at > 0, F.concat(F.lit(FINAL_INFORMATION + "\n"), strip(F.substring(x, at + len(FINAL_INFORMATION), F.length(x))))).otherwise("")


def boxed(x: Column) -> Column:
    """Content of the last ``\\boxed{}`` with balanced braces, without math signs; the whole text if there is none."""
    mark = "\\boxed{"
    tail = F.element_at(F.split(x, r"\\boxed\{", -1), -1)
    level = F.aggregate(
        F.split(tail, ""),
        F.struct(F.lit(1).alias("open"), F.lit(0).alias("n")),
        lambda a, c: F.when(a["open"] == 0, a).otherwise(
            F.struct((a["open"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("open"), (a["n"] + F.when(c == "", 0).otherwise(1)).alias("n"))
        ),
    )
    inner = strip(F.substring(tail, F.lit(1), F.greatest(level["n"] - 1, F.lit(0))))
    inner = strip(F.regexp_replace(inner, r"^\$+|\$+$", ""))
    inner = strip(F.regexp_replace(inner, r"^\\\(|\\\)$", ""))
    inner = F.when(inner.startswith("\\text{") & inner.endswith("}"), strip(F.substring(inner, F.lit(7), F.length(inner) - 7))).otherwise(inner)
    inner = strip(F.btrim(inner, F.lit("()")))
    found = F.when(F.instr(x, mark) > 0, inner).otherwise(strip(x))
    return F.replace(F.translate(found, "\\", " "), F.lit("  "), F.lit(" "))


def first_sentence(x: Column) -> Column:
    """X6."""
    s = F.regexp_extract(x, "(.+?[。！？.!?])", 1)
    return F.when(s != "", s).otherwise(strip(x))


def so_the_answer_is(x: Column) -> Column:
    """X7."""
    pattern = r"(?i)so the answer is[\s:]*([^\n]*)"
    return F.when(x.rlike(pattern), strip(F.regexp_extract(x, pattern, 1))).otherwise(strip(x))


def answer_tag(x: Column) -> Column:
    """X8."""
    pattern = r"(?s)<answer>(.*?)</answer>"
    return F.when(x.rlike(pattern), strip(F.regexp_extract(x, pattern, 1))).otherwise(strip(x))


def excerpt_sections(x: Column) -> Column:
    """X11: map of excerpt number to text; of repeated numbers the last stands."""
    parts = F.split(x, r"(?m)^<<<\s*EXCERPT\s*(?=\d+\s*>>>\s*$)", -1)
    pairs = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).cast("int").alias("n"), strip(F.regexp_replace(p, r"^\d+\s*>>>[ \t]*", "")).alias("t")),
    )
    numbers = F.transform(pairs, lambda p: p["n"])
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(numbers, i + 2, F.size(numbers)), p["n"]))
    return F.map_from_entries(last)


def compose_answer(raw: Column, sections: Column, n: Column) -> Column:
    """Sections 1..n that aren't empty or skipped, else the raw text."""
    kept = F.filter(
        F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.coalesce(F.try_element_at(sections, k), F.lit(""))),
        lambda s: (s != "") & (s != SKIPPED),
    )
    return F.when((n > 0) & (F.size(kept) > 0), F.array_join(kept, "\n\n")).otherwise(strip(raw))


def declares_no_information(x: Column) -> Column:
    """X13."""
    return x.contains(NO_INFORMATION) & (x.contains(NOT_FOUND) | x.contains(CANNOT_ANSWER))


def refusal_text(x: Column, plain: Column) -> Column:
    """Distinct refusing lines, else the composed text, else the raw one cut at 4000 characters."""
    lines = F.filter(F.transform(F.split(x, "\n"), strip), lambda ln: ln.contains(NO_INFORMATION) & (ln.contains("未找到") | ln.contains(CANNOT_ANSWER)))
    lines = F.array_distinct(lines)
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n\n")).when(strip(plain) != "", strip(plain)).otherwise(F.substring(strip(x), 1, 4000))


def _any(x: Column, tokens) -> Column:
    out = F.lit(False)
    for t in tokens:
        out = out | x.contains(t)
    return out


#: Router name -> state column of a text.
ROUTES = {
    "route1": lambda x: F.when(strip(x).try_cast("int") == 1, "state1").otherwise("state2"),
    "route2": lambda x: F.lit("state2"),
    "answer_phrase": lambda x: F.when(F.lower(x).contains("so the answer is"), "complete").otherwise("incomplete"),
    "end_token": lambda x: F.when(_any(x, END_TOKENS), "complete").otherwise("incomplete"),
    "end_token_or_answer": lambda x: F.when(_any(x, (*END_TOKENS, "</answer>")), "complete").otherwise("incomplete"),
    "page_filled": lambda x: F.when(F.lower(x).contains("to be filled"), "incomplete").otherwise("complete"),
    "search_query": lambda x: F.when(x.contains(BEGIN_SEARCH), "retrieve").otherwise("stop"),
    "search_tag": lambda x: F.when(x.contains("<search>"), "continue").otherwise("stop"),
}
#: Characters cut from reasoning events by type.
EVENT_CUTS = {"tool_call": 500, "tool_result": 200, "thought": 2000}


def compact_event(kind: Column, text: Column) -> Column:
    """An event's text cut by its type; other types lose theirs."""
    out = None
    for name, n in EVENT_CUTS.items():
        cut = F.substring(text, 1, n)
        out = F.when(kind == name, cut) if out is None else out.when(kind == name, cut)
    return out


