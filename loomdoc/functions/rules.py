"""More rules of chunks, glyphs and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, strip

# A block of a table of contents, and the title of an article of a statute.
CONTENTS_BLOCK = r"(?U)[·]{3,}|(?:\.{4,})\s*\p{Nd}+\s*$|[가-힣?)\]】』]\p{Nd}{1,3}\s*$"
ARTICLE_TITLE = r"^(제\p{Nd}+조(?:의\p{Nd}+)?(?:\([^)]{1,30}\))?)"
# What opens a block that was cut inside brackets, or inside a Korean word, and the end of the block before.
BRACKET_GOES_ON = r"^(\([A-Za-z]|[A-Z][a-z]+\))"
WORD_GOES_ON = r"^[가-힣]{1,4}(?:[\s.,。;!?]|$)"
WORD_TAIL = r"[가-힣][\s\x{2460}-\x{2473}\x{3251}-\x{325F}\x{32B1}-\x{32BF}]*$"
CIRCLED_TAIL = r"([\s\x{2460}-\x{2473}\x{3251}-\x{325F}\x{32B1}-\x{32BF}]+)$"
# Intents of first importance by a word of the domain, the first word that is found.
DOMAIN_INTENTS = {
    "법령": ["purpose", "condition", "list"],
    "규정": ["purpose", "condition", "list"],
    "법규": ["condition", "list", "fact"],
    "계약": ["condition", "comparison", "list"],
    "기술": ["how", "fact", "condition"],
    "매뉴얼": ["how", "condition", "list"],
    "가이드": ["how", "purpose", "condition"],
    "연구": ["purpose", "fact", "comparison"],
    "보고서": ["fact", "comparison", "purpose"],
    "ai": ["how", "fact", "condition"],
    "데이터": ["how", "list", "condition"],
}
# Labels of intents, failures and states in reports, and the rank of grades.
INTENT_LABELS = {"fact": "사실형", "purpose": "원인형", "how": "방법형", "condition": "조건형", "comparison": "비교형", "list": "열거형"}
FAILURE_LABELS = {
    "hallucination": "환각오류",
    "faithfulness_error": "근거오류",
    "poor_context": "문맥부족",
    "retrieval_miss": "검색오류",
    "ambiguous_question": "질문모호",
    "bad_chunk": "불량청크",
    "evaluation_error": "평가오류",
    "low_quality": "품질미달",
    "syntax_error": "구문오류",
}
STATUS_LABELS = {"success": "성공", "hold": "보류", "fail": "실패"}
GRADE_RANKS = {"A+": 6, "A": 5, "B+": 4, "B": 3, "C": 2, "F": 1}


def lookup(key: Column, table: dict) -> Column:
    """The table's value for the key, else null."""
    return F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), key)


def label(key: Column, table: dict[str, str]) -> Column:
    """The label of a key, else the key itself."""
    return F.coalesce(lookup(key, table), key)


def context_prefix(file: Column, section: Column, page: Column) -> Column:
    """What goes before a chunk's text: file, section and page."""
    return F.concat(F.lit("문서: "), file, F.lit("\n섹션: "), section, F.lit("\n페이지: "), page.cast("string"), F.lit("\n\n"))


def article_title(title: Column) -> Column:
    """The number and name of a statute's article at the start of a title, else the title."""
    found = F.regexp_extract(title, ARTICLE_TITLE, 1)
    return F.when(found != "", found).otherwise(title)


def one_line(heading: Column) -> Column:
    return strip(F.replace(F.replace(heading, F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" ")))


def with_table_mark(text: Column) -> Column:
    """A chunk that starts with a table row gets the mark of tables."""
    t = F.regexp_replace(text, r"(?U)^\s+", "")
    return F.when(t.startswith("|") & F.contains(t, F.lit("---")), F.concat(F.lit("[표]\n"), t)).otherwise(text)


def resolved_page(chunk: Column, section: Column, offsets: Column, default: Column) -> Column:
    """Page of the last block that starts at or before the chunk's first 60 characters in its section. ``offsets``: ascending structs of off, page."""
    at = F.instr(section, strip(F.substring(chunk, 1, 60))) - 1
    before = F.filter(offsets, lambda o: o["off"] <= at)
    return F.when(at < 0, default).otherwise(F.coalesce(F.try_element_at(before, F.lit(-1))["page"], default))


def in_a_table(x0: Column, y0: Column, x1: Column, y1: Column, tables: Column) -> Column:
    """Whether the middle of a box is inside one of the tables (structs of x0, y0, x1, y1), borders included."""
    x, y = (x0 + x1) / 2, (y0 + y1) / 2
    return F.exists(tables, lambda t: (t["x0"] <= x) & (x <= t["x1"]) & (t["y0"] <= y) & (y <= t["y1"]))


def is_block_noise(text: Column) -> Column:
    """Up to 15 characters with hardly any letter or digit, or up to 12 that open with one or two letters and a bracket."""
    letters = F.regexp_count(text, F.lit("[가-힣a-zA-Z0-9]"))
    n = F.length(text)
    return ((n <= 15) & (letters / F.greatest(n, F.lit(1)) < 0.3)) | ((n <= 12) & F.rlike(text, F.lit(r"^[A-Za-z]{1,2}[)（\]】]")))


def is_contents_block(text: Column) -> Column:
    return F.rlike(text, F.lit(CONTENTS_BLOCK))


def glyph_text(glyphs: Column) -> Column:
    """Text of glyphs (structs of c, x0, x1). With Hangul among them, a gap of over 0.4 of the mean width is a space.

    Glyphs, those with a character and the mean are computed once a text, not once a glyph, so the work grows with the glyphs."""

    def known(glyphs: Column) -> Column:
        wide = F.filter(glyphs, lambda g: g["x1"] > g["x0"])
        sums = F.aggregate(wide, F.struct(F.lit(0.0).alias("width"), F.lit(0).alias("n")), lambda a, g: F.struct((a["width"] + (g["x1"] - g["x0"])).alias("width"), (a["n"] + 1).alias("n")))
        hangul = F.exists(glyphs, lambda g: F.rlike(g["c"], F.lit("[가-힣]")))
        return F.struct(F.filter(glyphs, lambda g: g["c"] != "").alias("own"), sums.alias("sums"), hangul.alias("hangul"))

    def put(own: Column, mean: Column, hangul: Column) -> Column:
        gap = lambda g, i: g["x0"] - F.get(own, i - 1)["x1"] > mean * 0.4
        spaced = F.transform(own, lambda g, i: F.when((i > 0) & (g["c"] != " ") & gap(g, i), F.concat(F.lit(" "), g["c"])).otherwise(g["c"]))
        plain = F.array_join(F.transform(own, lambda g: g["c"]), "")
        return F.when(hangul & mean.isNotNull(), F.array_join(spaced, "")).otherwise(plain)

    of = lambda k: bound(F.struct(k["own"].alias("own"), (k["sums"]["width"] / F.nullif(k["sums"]["n"], F.lit(0))).alias("mean")), lambda m: put(m["own"], m["mean"], k["hangul"]))
    return bound(bound(glyphs, known), of)


def continued(items: Column) -> Column:
    """Items (structs of text, y0, y1, font, is_table, in page order) with those that go on with the one before joined to it.

    One that opens in brackets is joined with a space. One that opens with the end of a Korean word is joined to a Korean end without a space,
    before the circled numbers there; not if it is over 15 lower and the fonts differ by over 1.5. Tables stay."""

    def step(out: Column, item: Column) -> Column:
        last, text = F.try_element_at(out, F.lit(-1)), strip(item["text"])
        before = F.regexp_replace(last["text"], r"(?U)\s+$", "")
        apart = (item["y0"] - last["y1"] > 15.0) & (F.abs(last["font"] - item["font"]) > 1.5)
        korean = F.rlike(text, F.lit(WORD_GOES_ON)) & F.rlike(before, F.lit(WORD_TAIL)) & ~apart
        circled = F.regexp_extract(before, CIRCLED_TAIL, 1)
        joined = F.when(korean, F.concat(F.substr(before, F.lit(1), F.length(before) - F.length(circled)), text, circled)).otherwise(F.concat(before, F.lit(" "), text))
        goes_on = (F.size(out) > 0) & ~F.coalesce(item["is_table"], F.lit(False)) & (korean | F.rlike(text, F.lit(BRACKET_GOES_ON)))
        return F.when(F.coalesce(goes_on, F.lit(False)), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(last.withField("text", joined)))).otherwise(F.concat(out, F.array(item)))

    kind = "array<struct<text:string,y0:double,y1:double,font:double,is_table:boolean>>"
    return F.aggregate(items.cast(kind), F.array().cast(kind), step)


def domain_intents(domain: Column) -> Column:
    """Intents of first importance in a domain; none if no word is found."""
    d, out = F.lower(domain), None
    for word, intents in DOMAIN_INTENTS.items():
        found = F.array(*[F.lit(x) for x in intents])
        out = F.when(F.contains(d, F.lit(word)), found) if out is None else out.when(F.contains(d, F.lit(word)), found)
    return out.otherwise(F.array().cast("array<string>"))


def error_class(message: Column) -> Column:
    """quota, auth or other, by what the message of a failed call holds."""
    low = F.lower(message)
    quota = F.contains(message, F.lit("429")) | F.contains(low, F.lit("quota")) | F.contains(low, F.lit("resource_exhausted"))
    auth = F.contains(message, F.lit("401")) | F.contains(low, F.lit("api_key")) | F.contains(low, F.lit("invalid"))
    return F.when(quota, "quota").when(auth, "auth").otherwise("other")


def secret_mark(secret: Column) -> Column:
    return F.substring(F.sha2(secret, 256), 1, 10)


def model_of_file(file: Column) -> Column:
    """The model's part of a result file's name, else an empty string."""
    return F.regexp_extract(file, r"^qa_(.+?)_[a-z]{2}_", 1)


def escaped(text: Column) -> Column:
    """Text for HTML; a dash for none."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(text.isNull() | (text == ""), "-").otherwise(out)


def band(score: Column) -> Column:
    """Colour band of a score."""
    return F.when(score >= 0.85, "high").when(score >= 0.7, "mid").otherwise("low")


ANSWER = "array<struct<text:string,section_title:string,source_blocks:array<int>>>"


def answered_chunks(answer: Column, blocks: Column) -> Column:
    """Chunks (structs of text, section_title, source_blocks, page) of a model's answer about ``blocks`` (structs of index, page, text).

    Only source blocks among the given ones count, in the answer's order; a chunk without any goes; the page is that of the first. A missing
    title is the first line's first 30 characters. An answer that is not a JSON list falls back to one chunk a block."""
    raw = F.when(answer.startswith("```"), strip(F.regexp_replace(F.regexp_replace(answer, r"^[^\n]*\n", ""), r"(?s)```(?!.*```).*$", ""))).otherwise(answer)
    parsed = F.from_json(raw, ANSWER)
    title = lambda text: F.substring(strip(F.element_at(F.split(text, "\n"), 1)), 1, 30)
    known = F.transform(blocks, lambda b: b["index"])
    made = lambda text, name, sources, page: F.struct(text.alias("text"), name.alias("section_title"), sources.alias("source_blocks"), page.alias("page"))

    def chunk(c: Column) -> Column:
        own = F.filter(c["source_blocks"], lambda s: F.array_contains(known, s))
        page = F.try_element_at(F.filter(blocks, lambda b: b["index"] == F.try_element_at(own, F.lit(1))), F.lit(1))["page"]
        return made(c["text"], F.coalesce(F.nullif(c["section_title"], F.lit("")), title(F.coalesce(c["text"], F.lit("")))), own, F.when(F.size(own) > 0, page))

    good = F.filter(F.transform(F.filter(parsed, lambda c: F.exists(c["source_blocks"], lambda s: F.array_contains(known, s))), chunk), lambda c: F.size(c["source_blocks"]) > 0)
    fallback = F.transform(blocks, lambda b: made(b["text"], title(b["text"]), F.array(b["index"]), b["page"]))
    return F.when(parsed.isNull() | ~F.ltrim(raw).startswith("["), fallback).otherwise(good)
