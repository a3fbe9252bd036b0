"""Queries of text functions and chunking. Markers the tables lack are put in by the same expression on both sides."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ragloom.functions import chunking, text

from .registry import query, table

_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~‘’´"
_DROP = "，。！？、；：（）【】「」《》—…!?,.;:()[]{}\"''`"
_NL = "chr(10)"


def _docs(spark, d):
    return table(spark, d, "documents")


@query(
    """SELECT doc_id, trim(regexp_replace(replace(replace(replace('　 ' || replace(text, '. ', '.' || chr(13) || chr(10) || chr(10) || chr(10) || chr(13)),
       '　', ' '), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cleaned FROM documents"""
)
def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", text.clean_text(F.concat(F.lit("　 "), F.replace("text", F.lit(". "), F.lit(".\r\n\n\n\r")))).alias("cleaned"))


@query(
    f"""SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(translate(lower(text), '{_PUNCT}', repeat(' ', 35)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '),
        lambda w: w NOT IN ('a', 'an', 'the', '')), ' ') AS normal,
        array_to_string(list_filter(string_split(regexp_replace(translate(lower(text), '{_PUNCT}，。；：、！？（）【】「」《》—…', repeat(' ', 51)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '),
        lambda w: w NOT IN ('a', 'an', 'the', '')), ' ') AS wide FROM documents"""
)
def eval_normalize(spark, d):
    return _docs(spark, d).select("doc_id", text.eval_normalize(F.col("text")).alias("normal"), text.eval_normalize(F.col("text"), wide=True).alias("wide"))


@query(f"""SELECT conv_id, turn, translate(translate(lower(text), '{_DROP}', ''), ' ' || chr(9) || chr(13) || chr(10), '') AS dedup_key,
        regexp_replace(lower(text), '[^a-z0-9一-鿿]+', '', 'g') AS compact FROM conversations""")
def dedup_keys(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.dedup_key(F.col("text")).alias("dedup_key"), text.compact(F.col("text")).alias("compact"))


@query(
    """WITH x AS (SELECT doc_id, doc_id % 3 AS k, text, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || '[IMAGES]' || chr(10) || 'a/' || doc_id || '.png' || chr(10) || ' b.png '
         WHEN doc_id % 3 = 1 THEN text || chr(10) || ' [IMG: c/' || doc_id || '.png ]' || chr(10) || 'tail' ELSE text END AS t FROM documents)
       SELECT doc_id, CASE k WHEN 0 THEN 'a/' || doc_id || '.png|b.png' WHEN 1 THEN 'c/' || doc_id || '.png' ELSE '' END AS images,
         trim(CASE k WHEN 1 THEN text || chr(10) || 'tail' ELSE text END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         trim(CASE k WHEN 1 THEN text || chr(10) || 'tail' ELSE t END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS without_lines,
         trim(CASE k WHEN 0 THEN text ELSE t END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS without_footer FROM x"""
)
def split_images(spark, d):
    i = F.col("doc_id").cast("string")
    footer = F.concat(F.col("text"), F.lit("\n[IMAGES]\na/"), i, F.lit(".png\n b.png "))
    inline = F.concat(F.col("text"), F.lit("\n [IMG: c/"), i, F.lit(".png ]\ntail"))
    x = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, footer).when(F.col("doc_id") % 3 == 1, inline).otherwise(F.col("text")).alias("t"))
    s = text.split_images(F.col("t"))
    return x.select("doc_id", F.array_join(s["images"], "|").alias("images"), s["text"].alias("body"), text.strip_image_lines(F.col("t")).alias("without_lines"), text.strip_image_footer(F.col("t")).alias("without_footer"))


@query("""SELECT page_id, 'one=a/' || page_id || '.png|=b.png' AS images FROM pages""")
def markdown_images(spark, d):
    p = F.col("page_id").cast("string")
    md = F.concat(F.col("html"), F.lit("![one](a/"), p, F.lit(".png) ![](b.png) ![two](a/"), p, F.lit(".png)"))
    x = table(spark, d, "pages").select("page_id", text.markdown_images(md).alias("m"))
    return x.select("page_id", F.array_join(F.transform("m", lambda s: F.concat(s["alt"], F.lit("="), s["path"])), "|").alias("images"))


@query("""SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest, len(m) AS n_mixed, md5(array_to_string(m, ' ')) AS mixed
          FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t, list_concat(regexp_extract_all(text, '[A-Za-z0-9]+'), ['操作', '作步', '步骤'], regexp_extract_all(lower(text), '[a-z0-9]+')) AS m FROM documents)""")
def ascii_tokens(spark, d):
    x = _docs(spark, d).select("doc_id", text.ascii_tokens(F.col("text")).alias("t"), text.mixed_tokens(F.concat(F.col("text"), F.lit(" 操作步骤"))).alias("m"))
    return x.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"), F.size("m").cast("long").alias("n_mixed"), F.md5(F.array_join("m", " ")).alias("mixed"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'about ' || source || chr(10) ELSE '' END || lang || ' ' || source || chr(10) || 'Doc ' || doc_id || chr(10) || btext AS lexical,
       CASE WHEN doc_id % 2 = 0 THEN 'about ' || source || chr(10) ELSE '' END || lang || ' > ' || source || chr(10) || 'Doc ' || doc_id || chr(10) || btext AS dense,
       CASE WHEN doc_id % 4 = 0 THEN 'Overview' ELSE 'STEP ' || doc_id || ': go' END AS heading, CAST(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id END AS INTEGER) AS step,
       'x.' || chr(10) || 'STEP ' || doc_id || ': y' AS unglued
       FROM (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS btext FROM documents)"""
)
def index_text(spark, d):
    i = F.col("doc_id").cast("string")
    x = _docs(spark, d).withColumn("context", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" about "), "source"))).withColumn("title", F.concat(F.lit("Doc "), i))
    path = F.array("lang", F.lit(" "), "source")
    raw = F.when(F.col("doc_id") % 4 == 0, F.col("source")).otherwise(F.concat("source", F.lit(" | STEP "), i, F.lit(": go")))
    return x.select(
        "doc_id", text.index_text(F.col("context"), path, F.col("title"), F.col("text")).alias("lexical"), text.index_text(F.col("context"), path, F.col("title"), F.col("text"), " > ").alias("dense"),
        text.display_heading(raw, F.col("source")).alias("heading"), text.step_number(F.when(F.col("doc_id") % 4 == 1, raw), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("d_step_"), i))).alias("step"),
        text.unglue_steps(F.concat(F.lit("x.STEP "), i, F.lit(": y"))).alias("unglued"),
    )


@query("""SELECT doc_id, 'a' || doc_id || ',b' AS keys, true AS same, doc_id % 2 = 0 AS wide_same FROM documents WHERE length(text) > 0""")
def citation_keys(spark, d):
    i = F.col("doc_id").cast("string")
    t = F.concat(F.col("text"), F.lit(" \\cite{b, a"), i, F.lit("} \\citep{#1,*,c} \\nocite{c}"))
    wide = F.when(F.col("doc_id") % 2 == 0, "电池更换步骤 1.").otherwise("battery")
    x = _docs(spark, d).where(F.length("text") > 0)
    return x.select("doc_id", F.array_join(text.citation_keys(t), ",").alias("keys"), text.same_language(F.col("text"), F.lit("write")).alias("same"), text.same_language(wide, F.lit("写")).alias("wide_same"))


@query("""SELECT doc_id, n AS no, substr(text, n * 192 + 1, 256) AS chunk FROM documents, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(greatest(0, ceil((length(text) - 256) / 192.0)) AS BIGINT) + 1 END)) AS u(n)""")
def chunk_char_window(spark, d):
    x = chunking.char_windows(_docs(spark, d).select("doc_id", F.lit(None).cast("string").alias("title"), F.col("text").alias("contents")))
    return x.select("doc_id", F.col("no").cast("long").alias("no"), "chunk")


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents)
          SELECT doc_id, n AS no, array_to_string(ws[n * 96 + 1 : n * 96 + 128], ' ') AS chunk FROM w, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 ELSE CAST(greatest(0, ceil((len(ws) - 128) / 96.0)) AS BIGINT) + 1 END)) AS u(n)""")
def chunk_token_window(spark, d):
    x = chunking.token_windows(_docs(spark, d).select("doc_id", F.lit(None).cast("string").alias("title"), F.col("text").alias("contents")), 128, 32)
    return x.select("doc_id", F.col("no").cast("long").alias("no"), "chunk")


@query("""WITH c AS (SELECT doc_id, source, n AS no, trim(substr(text, n * 384 + 1, 512), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
            FROM documents, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(greatest(0, ceil((length(text) - 512) / 384.0)) AS BIGINT) + 1 END)) AS u(n))
          SELECT row_number() OVER (ORDER BY doc_id, no) - 1 AS chunk_id, doc_id, 'Title:' || chr(10) || source || chr(10) || chr(10) || 'Content:' || chr(10) || t AS contents FROM c WHERE t <> ''""")
def chunk_finish(spark, d):
    x = chunking.char_windows(_docs(spark, d).select("doc_id", F.col("source").alias("title"), F.col("text").alias("contents")), 512, 128)
    return chunking.finish_chunks(x, wrap=True).select("chunk_id", "doc_id", "contents")


_MARKED = """ls AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS raw FROM documents)"""


@query(f"""WITH {_MARKED}, m AS (SELECT doc_id, line_no, CASE WHEN line_no % 7 = 3 THEN CAST(1 + (line_no // 7) % 3 AS INTEGER) END AS lv, raw, doc_id || '.' || line_no AS h FROM ls),
    s AS (SELECT *, sum(CASE WHEN lv IS NULL THEN 0 ELSE 1 END) OVER w AS section, max(CASE WHEN lv = 1 THEN line_no END) OVER w AS l1, max(CASE WHEN lv = 2 THEN line_no END) OVER w AS l2, max(CASE WHEN lv = 3 THEN line_no END) OVER w AS l3
      FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT doc_id, section, max(lv) AS level, max(l1) AS l1, max(l2) AS l2, max(l3) AS l3, trim(coalesce(string_agg(CASE WHEN lv IS NULL THEN raw END, chr(10) ORDER BY line_no), ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS chunk FROM s GROUP BY ALL)
    SELECT doc_id, CAST(section AS BIGINT) AS section, level AS heading_level, concat_ws(' > ', doc_id || '.' || l1, CASE WHEN l2 > coalesce(l1, -1) THEN doc_id || '.' || l2 END, CASE WHEN l3 > greatest(coalesce(l1, -1), coalesce(l2, -1)) THEN doc_id || '.' || l3 END) AS path, chunk
    FROM g WHERE chunk <> ''""")
def chunk_sections(spark, d):
    ls = chunking.lines_of(_docs(spark, d).select("doc_id", F.col("text").alias("contents")))
    mark = F.concat(F.repeat(F.lit("#"), (1 + F.floor(F.col("line_no") / 7) % 3).cast("int")), F.lit(" "), F.col("doc_id").cast("string"), F.lit("."), F.col("line_no").cast("string"))
    x = chunking.heading_sections(ls.withColumn("line", F.when(F.col("line_no") % 7 == 3, mark).otherwise(F.col("line"))))
    return x.select("doc_id", "section", "heading_level", F.array_join("heading_path", " > ").alias("path"), "chunk")


@query(f"""WITH {_MARKED}, m AS (SELECT doc_id, line_no, CASE WHEN line_no % 7 = 3 THEN CAST(line_no // 7 + 1 AS INTEGER) END AS step, CASE WHEN line_no % 7 = 3 THEN 'STEP ' || (line_no // 7 + 1) || ': do' ELSE raw END AS line FROM ls),
    s AS (SELECT *, sum(CASE WHEN step IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS part FROM m),
    g AS (SELECT doc_id, part, max(step) AS step, trim(string_agg(line, chr(10) ORDER BY line_no), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS chunk FROM s GROUP BY ALL)
    SELECT doc_id, CAST(part AS BIGINT) AS part, step, doc_id || CASE WHEN step IS NULL THEN '_intro' ELSE '_step_' || step END AS chunk_id, chunk FROM g WHERE chunk <> ''""")
def chunk_steps(spark, d):
    ls = chunking.lines_of(_docs(spark, d).select("doc_id", F.col("text").alias("contents")))
    mark = F.concat(F.lit("STEP "), (F.floor(F.col("line_no") / 7) + 1).cast("string"), F.lit(": do"))
    return chunking.step_segments(ls.withColumn("line", F.when(F.col("line_no") % 7 == 3, mark).otherwise(F.col("line"))))


@query(f"""WITH {_MARKED}, m AS (SELECT doc_id, line_no, raw, line_no % 5 = 2 AS img FROM ls WHERE line_no % 5 = 2 OR trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
    s AS (SELECT *, greatest(1, sum(CASE WHEN img THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)) AS para FROM m)
    SELECT doc_id, CAST(para AS BIGINT) AS para, max(CASE WHEN NOT img THEN raw END) AS text, coalesce(string_agg(CASE WHEN img THEN line_no || '.png' END, ',' ORDER BY line_no), '') AS imgs FROM s GROUP BY doc_id, para""")
def attach_images(spark, d):
    ls = chunking.lines_of(_docs(spark, d).select("doc_id", F.col("text").alias("contents")))
    x = chunking.attach_images(ls.withColumn("line", F.when(F.col("line_no") % 5 == 2, F.concat(F.lit("[IMG: "), F.col("line_no").cast("string"), F.lit(".png]"))).otherwise(F.col("line"))))
    return x.select("doc_id", F.col("para").cast("long").alias("para"), "text", F.array_join("imgs", ",").alias("imgs"))


@query(f"""WITH {_MARKED}, m AS (SELECT doc_id, line_no, CASE WHEN line_no % 6 = 4 THEN 'image' ELSE 'text' END AS kind, line_no % 6 = 1 AS head, raw FROM ls),
    s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM m),
    g AS (SELECT doc_id, section, max(CASE WHEN head THEN raw END) AS title, trim(coalesce(string_agg(CASE WHEN head THEN NULL WHEN kind = 'image' THEN '[IMG: ' || line_no || '.png]' ELSE raw END, chr(10) ORDER BY line_no), ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS chunk,
      count(*) FILTER (kind = 'image') AS n_images, CAST(min(CASE WHEN kind = 'image' THEN line_no // 10 END) AS INTEGER) AS page_idx FROM s GROUP BY ALL)
    SELECT doc_id, CAST(section AS BIGINT) AS section, title, chunk, n_images, page_idx FROM g WHERE title IS NOT NULL OR chunk <> ''""")
def layout_sections(spark, d):
    ls = chunking.lines_of(_docs(spark, d).select("doc_id", F.col("text").alias("contents")))
    n = F.col("line_no")
    items = ls.select(
        "doc_id", n.alias("item_no"), F.when(n % 6 == 4, "image").otherwise("text").alias("type"), F.col("line").alias("text"), F.when(n % 6 == 1, 1).alias("text_level"),
        F.floor(n / 10).cast("int").alias("page_idx"), F.concat(n.cast("string"), F.lit(".png")).alias("path"), F.lit(None).cast("string").alias("caption"),
    )
    return chunking.layout_sections(items).select("doc_id", "section", "title", "chunk", F.size("images").cast("long").alias("n_images"), "page_idx")


@query("""WITH c AS (SELECT doc_id, n AS no, trim(substr(text, n * 300 + 1, 300), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents,
            unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(greatest(0, ceil((length(text) - 300) / 300.0)) AS BIGINT) + 1 END)) AS u(n))
          SELECT doc_id, substr(string_agg(t, chr(10) || chr(10) ORDER BY no), 1, 60000) AS contents FROM c WHERE t <> '' GROUP BY doc_id""")
def rebuild_docs(spark, d):
    x = chunking.char_windows(_docs(spark, d).select("doc_id", F.lit(None).cast("string").alias("title"), F.col("text").alias("contents")), 300, 0)
    return chunking.rebuild_documents(x.select("doc_id", "no", "chunk"))


@query("""SELECT doc_id, CAST(NULL AS VARCHAR) AS context, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS context_off, doc_id % 3 <> 0 AS flipped FROM documents""")
def toggle_context(spark, d):
    x = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("context"), F.lit(None).cast("string").alias("context_off"))
    return chunking.toggle_context(x, on=False).select("doc_id", "context", "context_off", "flipped")


_END = r"'[。！？!?；;…]\s*[”’」』》）】]*\s*$'"
_START = r"""'^[\x{4e00}-\x{9fff}0-9a-zA-Z“"‘’《（(【\[「『<]'"""
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(rf"""WITH x AS (SELECT doc_id, string_split_regex(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{{2,}}') AS ps FROM documents),
  p AS (SELECT doc_id, unnest(range(len(ps))) AS pn, unnest(ps) AS para FROM x),
  l AS (SELECT doc_id, pn, unnest(range(len(string_split(para, chr(10))))) AS ln, trim(unnest(string_split(para, chr(10))), {_SPACES}) AS line FROM p),
  k AS (SELECT *, ln = max(ln) OVER (PARTITION BY doc_id, pn) AS last FROM l WHERE line <> ''),
  j AS (SELECT doc_id, pn, trim(regexp_replace(string_agg(CASE WHEN last THEN line WHEN NOT regexp_matches(line, {_END}) AND line LIKE '%-' AND length(line) > 1 THEN left(line, -1) ELSE line || ' ' END, '' ORDER BY ln), '[ \t\n\x0B\f\r]+', ' ', 'g'), {_SPACES}) AS t FROM k GROUP BY doc_id, pn),
  n AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY pn) AS after FROM j),
  t AS (SELECT doc_id, trim(string_agg(CASE WHEN after IS NULL THEN t WHEN NOT regexp_matches(t, {_END}) AND regexp_matches(after, {_START}) THEN CASE WHEN t LIKE '%-' THEN regexp_replace(t, '-+$', '') ELSE t || ' ' END ELSE t || chr(10) || chr(10) END, '' ORDER BY pn), {_SPACES}) AS text FROM n GROUP BY doc_id)
  SELECT doc_id, coalesce(t.text, '') AS text FROM documents LEFT JOIN t USING (doc_id)""")
def reflow_paragraphs(spark, d):
    return _docs(spark, d).select("doc_id", text.reflow_paragraphs(F.col("text")).alias("text"))


def _re2(pattern: str) -> str:
    """A Java pattern as RE2 reads it: flag U goes, blanks and digits are written out, a line begins after each of Java's line ends."""
    wide = pattern.startswith(("(?U)", "(?iU)"))
    pattern = pattern.replace("(?U)", "").replace("(?iU)", "(?i)")
    kinds = {r"\s": r"\t-\r\x{85}\p{Z}" if wide else r"\t-\r ", r"\d": r"\p{Nd}" if wide else "0-9"}
    out, inside = "", False
    for x in re.findall(r"\\u[0-9A-F]{4}|\\.|.", pattern, re.S):
        if x in kinds:
            out += kinds[x] if inside else f"[{kinds[x]}]"
        elif x.startswith(r"\u"):
            out += f"\\x{{{x[2:]}}}"
        else:
            inside = x == "[" or (inside and x != "]")
            out += x
    return out


def _rules_sql(x: str, rules) -> str:
    for pattern, new in rules:
        if pattern.startswith("(?m)^"):  # the line end before is taken along and put back as group 1
            pattern, new = r"(^|[\n\r\x85\x{2028}\x{2029}])" + pattern[5:], "$1" + new.replace("$1", "$2")
        x = f"regexp_replace({x}, '{_re2(pattern)}', '{new.replace('$', chr(92))}', 'g')"
    blank = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]+"
    return f"regexp_replace({x}, '^{blank}|{blank}$', '', 'g')"


#: Headings before a text, and what the title rules leave of them, worked out by hand.
_HEADINGS = (
    ("Section-1.2. ", ".2. "), ("第三章 第1节：", ""), ("3.4.2，", ""), ("12、", ""), ("(4) ", ""), ("二.3 ", ""), ("十、", ""), ("（七） ", ""), ("一 ", ""), ("Plain ", "Plain "),
    ("Section Overview ", "Section Overview "), ("Sections of law ", "Sections of law "), ("Section 1.2 Intro ", ".2 Intro "), ("Section 7 ", ""), ("SECTION-[]] 3. ", ""), ("section．5", "5"), ("3. (2) 五. ", ""), ("　 4. ", ""), ("1.2", ""), ("12", "12"),
)


@query(f"""WITH h AS (SELECT doc_id, coalesce(CASE doc_id % {len(_HEADINGS)} {" ".join(f"WHEN {k} THEN '{h[0]}'" for k, h in enumerate(_HEADINGS))} END || text, '') AS title,
    coalesce('  ## Head' || chr(10) || text || ' see Section-2.1 there' || chr(10) || '# Next' || chr(10) || chr(10) || chr(10) || text, '') AS contents, text FROM documents)
  SELECT doc_id, {_rules_sql('title', [(p, '') for p in text.TITLE_RULES])} AS title, {_rules_sql('contents', text.CONTENT_RULES)} AS contents,
    text || ' [' || least(3, doc_id) || ']' || CASE WHEN doc_id <> 3 THEN '[' || greatest(3, doc_id) || ']' ELSE '' END || ' y' AS cited FROM h""")
def clean_titles(spark, d):
    i, t = F.col("doc_id"), F.col("text")
    head = F.element_at(F.array(*[F.lit(h) for h, _ in _HEADINGS]), (i % len(_HEADINGS) + 1).cast("int"))
    contents = F.concat(F.lit("  ## Head\n"), t, F.lit(" see Section-2.1 there\n# Next\n\n\n"), t)
    cited = F.concat(t, F.lit(" \\cite{textid3, textid"), i.cast("string"), F.lit("} y"))
    return _docs(spark, d).select("doc_id", text.clean_title(F.concat(head, t)).alias("title"), text.clean_generated(contents).alias("contents"), text.rewrite_citations(cited).alias("cited"))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _packed_sql(parts: str, size: int, overlap: int) -> str:
    """Greedy packing of the lists of ``l (doc_id, ps)``: a start's furthest end and an end's tail are looked up, and a recursion walks from chunk to chunk."""
    return f"""WITH RECURSIVE l AS ({parts}), p AS (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS part FROM l),
  e AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS e, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) - length(part) AS s, count(*) OVER (PARTITION BY doc_id) AS n FROM p),
  far AS (SELECT a.doc_id, a.i AS a, coalesce(min(b.i) FILTER (b.e - a.s > {size}), any_value(a.n)) AS nx, any_value(a.n) AS n FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + {size} GROUP BY a.doc_id, a.i),
  tail AS (SELECT b.doc_id, b.i AS b, coalesce(min(a.i) FILTER (b.e - a.s <= {overlap}), any_value(b.i) + 1) AS ts FROM e b JOIN e a ON a.doc_id = b.doc_id AND a.i BETWEEN b.i - {overlap} AND b.i GROUP BY b.doc_id, b.i),
  c AS (SELECT doc_id, 0 AS no, a, greatest(nx, 1) - 1 AS b, n FROM far WHERE a = 0
    UNION ALL SELECT c.doc_id, no + 1, f.a, greatest(f.nx, c.b + 2) - 1, c.n FROM c JOIN tail USING (doc_id, b) JOIN far f ON f.doc_id = c.doc_id AND f.a = least(greatest(tail.ts, c.a + 1), c.b + 1) WHERE c.b < c.n - 1),
  t AS (SELECT doc_id, CAST(no AS INTEGER) AS no, trim(array_to_string(ps[a + 1 : least(b, n - 1) + 1], ''), {_BLANK}) AS chunk FROM c JOIN l USING (doc_id))
  SELECT doc_id, CAST(NULL AS VARCHAR) AS title, no, chunk FROM t"""


_SENTENCES = "regexp_extract_all({}, '[^.!?。！？\n]*[.!?。！？\n]|[^.!?。！？\n]+')"


@query(_packed_sql(f"SELECT doc_id, list_filter({_SENTENCES.format('text')}, lambda x: trim(x, {_BLANK}) <> '') AS ps FROM documents", 512, 64))
def chunk_sentences(spark, d):
    return chunking.sentence_chunks(_docs(spark, d).select("doc_id", F.lit(None).cast("string").alias("title"), F.col("text").alias("contents")), 512, 64)


def _split_long(parts: str, pattern: str) -> str:
    return f"flatten(list_transform({parts}, lambda x: CASE WHEN length(x) > 512 THEN {pattern} ELSE [x] END))"


# a mark after each line end that follows another one
_PARAGRAPHS = r"string_split(regexp_replace(regexp_replace(replace(x, chr(10), chr(10) || chr(1)), '([^\n\x01])\n\x01', '\1' || chr(10), 'g'), '^\n\x01', chr(10)), chr(1))"
_RECURSIVE = _split_long(_split_long(_split_long(_split_long("[text]", _PARAGRAPHS), _SENTENCES.format("x")), "regexp_extract_all(x, '[^ \t\n\x0B\f\r]*[ \t\n\x0B\f\r]|[^ \t\n\x0B\f\r]+')"), "regexp_extract_all(x, '(?s).{1,512}')")


@query(_packed_sql(f"SELECT doc_id, list_filter({_RECURSIVE}, lambda x: x <> '') AS ps FROM documents", 512, 0) + " WHERE length(chunk) >= CASE WHEN no = 0 THEN 1 ELSE 12 END")
def chunk_recursive(spark, d):
    return chunking.recursive_chunks(_docs(spark, d).select("doc_id", F.lit(None).cast("string").alias("title"), F.col("text").alias("contents")), 512)


@query("""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents), p AS (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS part FROM l),
  e AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS e, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) - length(part) AS s, count(*) OVER (PARTITION BY doc_id) AS n FROM p),
  far AS (SELECT a.doc_id, a.i AS a, coalesce(min(b.i) FILTER (b.s > a.s AND b.e - a.s > 800), any_value(a.n)) AS nx, any_value(a.n) AS n FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.i >= a.i GROUP BY a.doc_id, a.i),
  c AS (SELECT doc_id, 0 AS no, a, greatest(nx, 1) - 1 AS b, n, false AS carried FROM far WHERE a = 0
    UNION ALL SELECT c.doc_id, no + 1, f.a, greatest(f.nx, c.b + 2) - 1, c.n, length(e.part) <= 100 FROM c JOIN e ON e.doc_id = c.doc_id AND e.i = c.b JOIN far f ON f.doc_id = c.doc_id AND f.a = CASE WHEN length(e.part) <= 100 THEN c.b ELSE c.b + 1 END WHERE c.b < c.n - 1)
  SELECT doc_id, CAST(no AS INTEGER) AS no, array_to_string(ps[a + 1 : least(b, n - 1) + 1], chr(10)) AS chunk, [CAST(i AS VARCHAR) FOR i IN range(a + CAST(carried AS INTEGER), least(b, n - 1) + 1) IF i % 4 = 1] AS images FROM c JOIN l USING (doc_id)""")
def sliding_windows(spark, d):
    x = _docs(spark, d).select("doc_id", F.transform(F.split("text", "\n"), lambda p, i: F.struct(p.alias("text"), F.when(i % 4 == 1, F.array(i.cast("string"))).otherwise(F.array().cast("array<string>")).alias("imgs"))).alias("parts"))
    return chunking.sliding_windows(x)


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'steps' WHEN doc_id % 4 = 1 THEN 'sections' WHEN length(text) >= 800 THEN 'windows' ELSE 'intro' END AS route FROM documents""")
def route_documents(spark, d):
    t = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\n step 3: go"))).when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("\n## Head"))).otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", chunking.route_document(t).alias("route"))


#: Ideographs that stand for the letters a to z, so that texts of letters become runs without spaces.
_IDEOGRAPHS = "".join(chr(0x4E00 + i) for i in range(26))
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query()
def segmented_words(spark, d):
    """Letters become ideographs and everything between them goes, then words are found again with a dictionary of the benchmark's words."""
    from ragloom.functions import segmentation as sg

    said = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("w"))
    words = sg.dictionary(said.groupBy(F.translate("w", _LETTERS, _IDEOGRAPHS).alias("word")).agg(F.count("*").alias("freq")))
    run = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]+", ""), _LETTERS, _IDEOGRAPHS)
    x = _docs(spark, d).select("doc_id", run.alias("run")).select("doc_id", F.length("run").alias("n_letters"), sg.segmented_tokens(F.col("run"), words).alias("ts"))
    return x.select("doc_id", "n_letters", F.size("ts").alias("n_words"), F.array_join("ts", "").alias("joined")).select("doc_id", "n_letters", "n_words", (F.length("joined") == F.col("n_letters")).alias("whole"))
