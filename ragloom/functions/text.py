"""Text cleaning and normalisation as column expressions (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed character sets.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
QUOTES = "‘’´`"
WIDE_PUNCTUATION = "，。；：、！？（）【】「」《》—…"
DEDUP_DROP = " \t\r\n，。！？、；：（）【】「」《》—…!?,.;:()[]{}\"'`"
SPACE = " \t\n\x0b\x0c\r"
IMAGE_LINE = r"^\s*\[IMG:\s*([^\]]+)\]\s*$"
IMAGE_FOOTER = "\n[IMAGES]\n"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACE))


def collapse(x: Column) -> Column:
    """Runs of space become one, none at the ends."""
    return strip(F.regexp_replace(x, r"[ \t\n\x0B\f\r]+", " "))


def clean_text(x: Column) -> Column:
    """Ideographic space, line ends, runs of three or more newlines, ends."""
    x = F.translate(F.coalesce(x, F.lit("")), "\u3000", " ")
    x = F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


# Fixed values (T2): how a sentence ends and how the next one starts.
_SENTENCE_END = r"[。！？!?；;…]\s*[”’」』》）】]*\s*$"
_NEXT_START = r"^[\u4e00-\u9fff0-9a-zA-Z“\"‘’《（(【\[「『<]"


def _join_lines(para: Column) -> Column:
    """Lines of a paragraph, joined where the one before doesn't end a sentence; ``-`` joins without a space."""
    lines = F.filter(F.transform(F.split(para, "\n"), strip), lambda x: x != "")
    # a piece carries its own separator, so the text is put together once
    pieces = F.transform(
        lines,
        lambda x, i: F.when(i == F.size(lines) - 1, x)
        .when(~x.rlike(_SENTENCE_END) & x.endswith("-") & (F.length(x) > 1), F.substring(x, F.lit(1), F.length(x) - 1))
        .otherwise(F.concat(x, F.lit(" "))),
    )
    return collapse(F.array_join(pieces, ""))


def reflow_paragraphs(x: Column) -> Column:
    """Undo hard line breaks, first inside paragraphs, then across blank lines that split a sentence."""
    x = F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    paras = F.transform(F.filter(F.split(x, r"\n{2,}"), lambda p: strip(p) != ""), _join_lines)
    pieces = F.transform(
        paras,
        lambda p, i: F.when(i == F.size(paras) - 1, p)
        .when(~p.rlike(_SENTENCE_END) & F.get(paras, i + 1).rlike(_NEXT_START), F.when(p.endswith("-"), F.regexp_replace(p, "-+$", "")).otherwise(F.concat(p, F.lit(" "))))
        .otherwise(F.concat(p, F.lit("\n\n"))),
    )
    return strip(F.array_join(pieces, ""))


def _to_spaces(x: Column, characters: str) -> Column:
    return F.translate(x, characters, " " * len(characters))


def eval_normalize(x: Column, wide: bool = False) -> Column:
    """T3, and T4 with ``wide`` punctuation: booleans, underscores, case, punctuation, articles, spaces."""
    x = F.when(x == "True", "yes").when(x == "False", "no").otherwise(x)
    x = _to_spaces(F.lower(x), ASCII_PUNCTUATION + "‘’´" + (WIDE_PUNCTUATION if wide else ""))
    return collapse(F.regexp_replace(x, r"(?U)\b(a|an|the)\b", " "))


def dedup_key(x: Column) -> Column:
    """T5: lower case without spaces and punctuation."""
    return F.translate(F.lower(x), DEDUP_DROP, "")


def compact(x: Column) -> Column:
    """Only a-z, 0-9 and ideographs."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9\u4e00-\u9fff]+", "")


def strip_image_lines(x: Column) -> Column:
    """T7."""
    return strip(F.array_join(F.filter(F.split(F.coalesce(x, F.lit("")), "\n"), lambda ln: ~ln.rlike(IMAGE_LINE)), "\n"))


def strip_image_footer(x: Column) -> Column:
    """T8."""
    return strip(F.substring_index(F.coalesce(x, F.lit("")), IMAGE_FOOTER, 1))


def split_images(x: Column) -> Column:
    """struct(text, images): footer form first, else placeholder lines."""
    x = F.coalesce(x, F.lit(""))
    tail = F.substring(x, F.instr(x, IMAGE_FOOTER) + len(IMAGE_FOOTER), F.length(x))
    footer = F.struct(
        strip(F.substring_index(x, IMAGE_FOOTER, 1)).alias("text"),
        F.filter(F.transform(F.split(tail, "\n"), strip), lambda ln: ln != "").alias("images"),
    )
    marked = F.filter(F.split(x, "\n"), lambda ln: ln.rlike(IMAGE_LINE))
    inline = F.struct(strip_image_lines(x).alias("text"), F.transform(marked, lambda ln: strip(F.regexp_extract(ln, IMAGE_LINE, 1))).alias("images"))
    return F.when(F.instr(x, IMAGE_FOOTER) > 0, footer).otherwise(inline)


def image_markdown(x: Column, base: str = "") -> Column:
    """Placeholder lines become markdown images with an encoded path."""
    return F.array_join(
        F.transform(
            F.split(x, "\n"),
            lambda ln: F.when(ln.rlike(IMAGE_LINE), F.concat(F.lit(f"![]({base}"), F.url_encode(strip(F.regexp_extract(ln, IMAGE_LINE, 1))), F.lit(")"))).otherwise(ln),
        ),
        "\n",
    )


def markdown_images(x: Column) -> Column:
    """Array of struct(alt, path), first occurrence of each path."""
    pattern = F.lit(r"!\[([^\]]*)\]\(([^)\s]+)\)")
    pairs = F.zip_with(F.regexp_extract_all(x, pattern, 1), F.regexp_extract_all(x, pattern, 2), lambda a, p: F.struct(a.alias("alt"), p.alias("path")))
    paths = F.regexp_extract_all(x, pattern, 2)
    return F.filter(pairs, lambda p, i: F.array_position(paths, p["path"]) == i + 1)


def ascii_tokens(x: Column) -> Column:
    """T12."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def mixed_tokens(x: Column) -> Column:
    """ASCII words as written and in lower case, and bigrams of ideograph runs (single ones as they are)."""
    x = F.coalesce(x, F.lit(""))
    runs = F.regexp_extract_all(x, F.lit(r"[\u4e00-\u9fff]+"), 0)
    grams = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
    return F.concat(F.regexp_extract_all(x, F.lit("[A-Za-z0-9]+"), 0), grams, ascii_tokens(x))


def index_text(context: Column, heading_path: Column, title: Column, contents: Column, separator: str = " ") -> Column:
    """T14 (separator space) and T15 (separator ``' > '``): parts on lines, blank ones left out."""
    blank = lambda c: F.nullif(strip(c), F.lit(""))
    heads = F.array_join(F.filter(F.transform(heading_path, strip), lambda h: h != ""), separator)
    return F.concat_ws("\n", blank(context), blank(heads), blank(title), blank(strip_image_lines(contents)))


def display_heading(title: Column, doc: Column, generic: str = "Overview") -> Column:
    """The title without the document's name before a bar; a generic label where nothing else is left."""
    t = strip(F.coalesce(title, F.lit("")))
    d = strip(F.coalesce(doc, F.lit("")))
    prefix = F.concat(d, F.lit(" | "))
    t = F.when((d != "") & F.startswith(t, prefix), strip(F.substring(t, F.length(prefix) + 1, F.length(t)))).otherwise(t)
    return F.when((t == "") | (t == d), F.lit(generic)).otherwise(t)


def step_number(title: Column, chunk_id: Column) -> Column:
    """From the title, else from the id."""
    number = lambda c, p: F.regexp_extract(F.coalesce(c, F.lit("")), p, 1).try_cast("int")
    return F.coalesce(number(title, r"(?i)STEP\s*(\d+)"), number(chunk_id, r"(?i)_step_(\d+)"))


def unglue_steps(x: Column) -> Column:
    """A newline before ``STEP n:`` that follows other text directly."""
    return F.regexp_replace(x, r"(?i)([a-zA-Z0-9.);}\]])(\s*)(STEP\s+\d+\s*:)", "$1$2\n$3")


# Fixed values (T19): what is removed from titles and changed in contents, in this order. The first one takes a single
# digit, bracket or dot after "section"; letters, digits and blanks are those of Unicode.
TITLE_RULES = (
    r"(?iU)^\s*section[-\s]*[\d\[.\uFF0E\u3002]\]*\s*",
    r"(?U)^(?:第\s*[0-9一二三四五六七八九十百千]+\s*(?:章|节|部(?:分)?|篇|卷)\s*[-—:：\.、，,]?\s*)+",
    r"(?U)^\s*\d+(?:[.\uFF0E\u3002]\d+)+[\.、，,]?\s*",
    r"(?U)^\s*\d+[.、，,]\s*",
    r"(?U)[\(（]\d+[\)）]\s*",
    r"(?U)^\s*[一二三四五六七八九十]+(?:[.\uFF0E\u3002]\d+)+[\.、，,]?\s*",
    r"(?U)^\s*[一二三四五六七八九十]+[.、，,]\s*",
    r"(?U)[\(（][一二三四五六七八九十]+[\)）]\s*",
    r"(?U)^[一二三四五六七八九十]+\s+",
)
CONTENT_RULES = (
    (r"\bSection-(\d+(?:\.\d+)*)\b", ""),
    (r"(?m)^[ \t]+(#{1,6})\s+", "$1 "),
    (r"\n{3,}", "\n\n"),
    (r"([^\n])\n(#{1,6}\s)", "$1\n\n$2"),
    (r"(#{1,6}\s[^\n]+)\n([^\n#])", "$1\n\n$2"),
)


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_title(x: Column) -> Column:
    """T19, titles: section prefixes and numbering in two scripts go."""
    x = F.coalesce(x, F.lit(""))
    for pattern in TITLE_RULES:
        x = F.regexp_replace(x, pattern, "")
    return _trimmed(x)


def clean_generated(x: Column) -> Column:
    """T19, contents: section references go, headings start their line and have blank lines around them."""
    x = F.coalesce(x, F.lit(""))
    for pattern, new in CONTENT_RULES:
        x = F.regexp_replace(x, pattern, new)
    return _trimmed(x)


_UNCOUNTED = r"[!\"#$%&'()*+,\-./:;<=>?@\\\[\]^_`{|}~0-9 \n\t]"


def same_language(x: Column, instruction: Column) -> Column:
    """Ideographs are over 0.6 of the letters for an instruction that has some, under 0.05 otherwise."""
    left = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?s)\\cite\{.*?\}", ""), _UNCOUNTED, "")
    share = F.length(F.regexp_replace(left, r"[^\u4e00-\u9fff]", "")) / F.length(left)
    return F.when(left == "", True).when(instruction.rlike(r"[\u4e00-\u9fff]"), share > 0.6).otherwise(share < 0.05)


def citation_keys(x: Column) -> Column:
    """Distinct keys of cite commands but for ``#n``, ``*`` and keys of nocite, sorted."""

    def keys(pattern):
        return F.transform(F.filter(F.flatten(F.transform(F.regexp_extract_all(x, F.lit(pattern), 1), lambda k: F.split(k, ","))), lambda k: ~k.rlike(r"^#\d+$")), strip)

    cited = F.filter(keys(r"\\\w*cite(?!style)\w*\{(.+?)\}"), lambda k: (k != "") & (k != "*"))
    return F.array_sort(F.array_except(F.array_distinct(cited), keys(r"\\nocite\{(.+?)\}")))


def rewrite_citations(x: Column) -> Column:
    """``\\cite{textid2, textid1}`` becomes ``[1][2]``, distinct and ascending."""
    parts = F.split(x, r"\\cite\{", -1)

    def one(part, i):
        inside = F.substring_index(part, "}", 1)
        rest = F.substring(part, F.length(inside) + 2, F.length(part))
        ids = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(inside, F.lit(r"textid(\d+)"), 1), lambda n: n.cast("int"))))
        return F.when((i == 0) | (F.instr(part, "}") == 0), part).otherwise(F.concat(F.array_join(F.transform(ids, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ""), rest))

    return F.array_join(F.transform(parts, one), "")
