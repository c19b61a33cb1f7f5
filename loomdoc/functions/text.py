"""Text normalisation, noise predicates and parsers as column expressions (no Python in the tasks)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points of a word in the normal form used for hashing.
NOT_WORD = r"[^\p{L}\p{N}_]"
# Notes in stars by their first letter, and rules of tables.
NOTE, TABLE_RULE = r"\*[닫열변삭기시구기터이][^*]*\*", r"(?Umd)^\|[-\s|]+\|$"
# Colophon keywords.
COLOPHON = ["발행일", "발행처", "발행인", "편집", "인쇄", "ISBN"]


def normal_for_hash(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), NOT_WORD, "")


def content_hash(text: Column) -> Column:
    """SHA-1 of the letters, digits and underscores, in lower case."""
    return F.sha1(normal_for_hash(text))


def occurrences(text: Column, piece: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / F.lit(len(piece))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, which Spark does not promise for a column that is named several times."""
    return F.get(F.transform(F.array(value), use), 0)


def is_contents_legacy(text: Column) -> Column:
    """Table-of-contents chunk by its dots: many leaders, or most lines with leaders and a final digit."""
    lines = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    dotted = lambda x: ((occurrences(x, "·") > 5) | (occurrences(x, ".") > 5)) & F.rlike(F.regexp_replace(x, r"(?U)\s+$", ""), F.lit(r"[0-9]$"))
    most = bound(lines, lambda own: (F.size(own) > 0) & (F.size(F.filter(own, dotted)) > 0.5 * F.size(own)))
    return (occurrences(text, "·") > 20) | (occurrences(text, ".") > 50) | most


def is_contents(text: Column) -> Column:
    """Table-of-contents chunk in five layers; lines with table bars only by leader runs and keyword."""
    n, table = F.length(text), occurrences(text, "|") >= 4
    dots = occurrences(text, "·")
    lines = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    led = lambda x: ((occurrences(x, "·") > 3) | (occurrences(x, ".") > 5)) & F.rlike(F.substring(x, -5, 5), F.lit(r"[0-9]"))
    by_lines = bound(lines, lambda own: (F.size(own) > 0) & (F.size(F.filter(own, led)) >= 0.6 * F.size(own)))
    numbers = F.regexp_count(text, F.lit(r"\b[0-9]+\.[0-9]+"))
    words = F.greatest(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(1))
    sentences = F.regexp_count(text, F.lit(r"다\."))
    many = bound(numbers, lambda n: (n >= 8) & (n / words >= 0.05) & (sentences <= 2))
    keyword = F.rlike(text, F.lit(r"(?U)목\s*차")) & (numbers >= 5)
    dotty = bound(dots, lambda d: (d > 10) & (d > 0.05 * n))
    return F.when(n < 20, False).otherwise((~table & dotty) | F.rlike(text, F.lit("·{4,}")) | (~table & by_lines) | keyword | (~table & many))


def is_colophon(text: Column) -> Column:
    """Two or more of the colophon keywords."""
    found = F.lit(0)
    for k in COLOPHON:
        found = found + F.contains(text, F.lit(k)).cast("int")
    return found >= 2


def is_symbol_noise(text: Column) -> Column:
    """Hardly any letter or digit in a text of ten characters or more."""
    few = lambda b: F.when(F.length(b) == 0, True).otherwise((F.length(b) >= 15) & (F.regexp_count(b, F.lit(r"[0-9A-Za-z가-힣]")) / F.length(b) < 0.15))
    return F.when(F.length(text) < 10, False).otherwise(bound(F.regexp_replace(text, r"(?U)[\s|]", ""), few))


def chunk_type(text: Column) -> Column:
    """heading, list, table or body."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 2), "\n")
    return (
        F.when((F.length(text) < 150) & ~F.contains(text, F.lit("- ")), "heading")
        .when(F.contains(head, F.lit("- ")), "list")
        .when(F.contains(text, F.lit("|")) & F.contains(text, F.lit("-")), "table")
        .otherwise("body")
    )


def strip(text: Column) -> Column:
    """Without white space at both ends (all Unicode white space)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_markup(text: Column) -> Column:
    """Markdown without starred notes of an editor, table rules, links and blank lines; each line stripped."""
    out = F.regexp_replace(F.regexp_replace(text, NOTE, ""), TABLE_RULE, "")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]+\)", "$1")
    out = F.replace(F.replace(out, F.lit("\\\\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), strip), lambda x: x != ""), "\n")


def score_in(text: Column) -> Column:
    """Score of a free-text verdict, 0 to 1: the last line that is a number from 0 to 10 or holds one; 0.5 without any."""
    lines = F.reverse(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""))
    found = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"\b(10|[0-9])\b", 1)), lambda x: x != "")
    return F.coalesce(F.try_element_at(found, F.lit(1)).cast("double") / 10, F.lit(0.5))


def hierarchy_path(*levels: Column) -> Column:
    """Non-empty levels joined, or Uncategorized."""
    path = F.concat_ws(" > ", *[F.nullif(x, F.lit("")) for x in levels])
    return F.coalesce(F.nullif(path, F.lit("")), F.lit("Uncategorized"))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Estimated cost of tokens at prices a million, rounded to four places."""
    return F.round((tokens_in * price_in + tokens_out * price_out) / F.lit(1e6), 4)


# Title patterns and the section level of each, in order of precedence.
SECTION_LEVELS = [
    (r"^[0-9]+\.[0-9]+\.[0-9]+", 3),
    (r"^[0-9]+\.[0-9]+", 2),
    (r"^제\s*[0-9]+\s*장", 1),
    (r"^제\s*[0-9]+\s*절", 2),
    (r"^제\s*[0-9]+\s*조", 2),
    (r"^[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]", 1),
    (r"^\[[^\]]{2,}\]", 1),
    (r"^\p{Nd}+\s+\S", 2),
]
# What a heading starts with.
HEADING_STARTS = r"^([ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]|제\s*\p{Nd}+\s*[장절조]|\p{Nd}+\.\p{Nd}+|부\s*칙)"
# What no heading starts with, or holds.
NO_HEADING_START = r"^([-•Ÿ∙]\s|\([가-힣a-zA-Z])"
LEADERS = r"[·.]{3,}"
AMENDMENT, ARTICLE_START = r"<(신설|개정|삭제)", r"^제\s*\p{Nd}+"


def section_level(title: Column) -> Column:
    """Level of the first title pattern that fits, else null."""
    t, out = strip(title), None
    for pattern, level in SECTION_LEVELS:
        hit = F.rlike(t, F.lit(pattern))
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out


def is_heading(text: Column, font: Column, font_before: Column) -> Column:
    """Whether a block is a heading, by its start at a font of 10 or more, or by a font 1.5 larger than before and over 12.5."""
    t = strip(text)
    ruled_out = (
        (F.length(t) < 2) | (F.length(t) > 100) | F.rlike(t, F.lit(NO_HEADING_START)) | F.rlike(t, F.lit(LEADERS)) | F.rlike(t, F.lit(r"^\p{Nd}+$"))
        | (F.rlike(t, F.lit(AMENDMENT)) & ~F.rlike(t, F.lit(ARTICLE_START))) | ((F.length(t) >= 15) & (occurrences(t, "·") / F.length(t) > 0.2))
    )
    return F.coalesce(~ruled_out & ((F.rlike(t, F.lit(HEADING_STARTS)) & (font >= 10.0)) | ((font > font_before + 1.5) & (font > 12.5))), F.lit(False))


def join_lines(text: Column) -> Column:
    """Lines joined with a space, unless the text so far ends a sentence or the line opens a list item, table row, heading or number;
    blank lines stay."""
    lines = F.transform(F.split(text, "\n", -1), strip)

    def joined(own: Column) -> Column:
        # what is before a line ends as the line before it does, so neighbours tell
        def placed(line: Column, i: Column) -> Column:
            last = F.get(own, i - 1)
            goes_on = (line != "") & (last != "") & ~F.rlike(last, F.lit(r"[.!?。]$")) & ~F.rlike(line, F.lit(r"^[-•|\[#\p{Nd}]"))
            return F.concat(F.when(i == 0, "").when(goes_on, " ").otherwise("\n"), line)

        return F.array_join(F.transform(own, placed), "")

    return bound(lines, joined)


def normalised(text: Column) -> Column:
    """Broken bullets and boxes replaced, ellipsis marks dropped, list marks and blanks made uniform, lines joined, ends stripped."""
    t = F.coalesce(text, F.lit(""))
    for pattern, by in [("[Ÿÿ�]", "-"), ("[□☐]", "[ ]"), ("[☑✓✔]", "[v]"), ("[⋮⋯⋰⋱]", ""), (r"(?m)^[ \t]*[•*l][ \t]+", "- "), (r"[ \t]+", " ")]:
        t = F.regexp_replace(t, pattern, by)
    return strip(join_lines(t))


def is_admin(text: Column) -> Column:
    """Short text (under 400 characters) that is mostly not Hangul, or has no sentence."""
    t = strip(text)
    hangul = F.regexp_count(t, F.lit("[가-힣]")) / F.greatest(F.length(t), F.lit(1))
    return (F.length(t) < 400) & ((hangul < 0.3) | ~F.rlike(t, F.lit(r"(?U)[가-힣]{2,}[^.\n]{5,}[다요]\b")))


def without_footers(text: Column, repeated: Column) -> Column:
    """Without lines that are one to three digits or among the repeated lines (an array)."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~F.rlike(strip(x), F.lit(r"^\p{Nd}{1,3}$")) & ~F.coalesce(F.array_contains(repeated, strip(x)), F.lit(False)))
    return F.array_join(lines, "\n")


def without_title(text: Column, title: Column) -> Column:
    """Without a first line that is the title, if something is left; numbered items keep theirs."""
    t = strip(title)
    lines = F.split(text, "\n", -1)
    rest = strip(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), "\n"))
    cut = ~F.rlike(t, F.lit(r"^(\p{Nd}+[.의]|[가-힣]\.)\s")) & (strip(F.element_at(lines, 1)) == t) & (rest != "")
    return F.when(cut, rest).otherwise(text)
