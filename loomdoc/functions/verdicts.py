"""Parsers of model answers in JSON, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, strip

QA_LIST = "array<struct<q:string,a:string,intent:string>>"


def without_fences(text: Column) -> Column:
    """Without the code fence around an answer."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")


def unfenced(text: Column) -> Column:
    """An answer without any code fences."""
    return strip(F.regexp_replace(text, "```(?:json)?", ""))


def _point(parsed: Column, key: str, missing: float) -> Column:
    """Whole number of a key (of a number, a truth value or a text that is a whole number), held in 0 to 10; ``missing`` where there is none, null where it is something else."""
    own = F.try_variant_get(parsed, f"$.{key}", "variant")
    kind, text = F.schema_of_variant(own), strip(F.try_variant_get(parsed, f"$.{key}", "string"))
    number = F.when(F.rlike(kind, F.lit("^(BIGINT|DECIMAL|DOUBLE)")), F.try_variant_get(parsed, f"$.{key}", "double")).when(kind == "BOOLEAN", F.try_variant_get(parsed, f"$.{key}", "boolean").cast("double"))
    number = number.when((kind == "STRING") & F.rlike(text, F.lit(r"^[+-]?\p{Nd}+$")), text.cast("double"))
    # greatest and least pass over nulls
    return F.when(own.isNull(), missing).when(number.isNotNull(), F.greatest(F.least(F.floor(number).cast("double"), F.lit(10.0)), F.lit(0.0)))


def _number(parsed: Column, key: str, missing: float) -> Column:
    return F.coalesce(F.try_variant_get(parsed, f"$.{key}", "double"), F.lit(missing))


def triad(text: Column) -> Column:
    """Struct of relevance, groundedness and context_relevance, 0 to 1: whole points of ten, 6 where one is missing; 0.65 each if the
    answer is not a JSON object, or any of them is no number."""
    keys = ("relevance", "groundedness", "context_relevance")

    def points(parsed: Column) -> Column:
        own = [_point(parsed, k, 6.0) for k in keys]
        ok = F.schema_of_variant(parsed).startswith("OBJECT") & own[0].isNotNull() & own[1].isNotNull() & own[2].isNotNull()
        return F.struct(*[F.coalesce(F.when(ok, x / 10), F.lit(0.65)).alias(k) for k, x in zip(keys, own)])

    return bound(F.try_parse_json(unfenced(text)), points)


def completeness(text: Column) -> Column:
    """Struct of completeness (points of ten, 5 where missing, held in 0 to 10) and coverage (0.5 where missing); 0.5 each without JSON."""
    parsed = F.try_parse_json(without_fences(text))
    ok = F.schema_of_variant(parsed).startswith("OBJECT")
    score = F.greatest(F.least(_number(parsed, "completeness", 5.0), F.lit(10.0)), F.lit(0.0)) / 10
    return F.struct(F.coalesce(F.when(ok, score), F.lit(0.5)).alias("completeness"), F.coalesce(F.when(ok, _number(parsed, "coverage", 0.5)), F.lit(0.5)).alias("coverage"))


def qa_list(text: Column) -> Column:
    """The pairs of an answer: an object with qa_list or a list, else such an object anywhere in the text, else none."""
    t = without_fences(text)
    wrapped = f"struct<qa_list:{QA_LIST}>"
    inner = F.regexp_extract(t, r"(?s)(\{.*\"qa_list\".*\})", 1)
    return F.coalesce(
        F.when(t.startswith("{"), F.from_json(t, wrapped)["qa_list"]),
        F.when(t.startswith("["), F.from_json(t, QA_LIST)),
        F.when(inner != "", F.from_json(inner, wrapped)["qa_list"]),
        F.array().cast(QA_LIST),
    )


def provider(model: Column) -> Column:
    """Provider of a model by its name."""
    m = F.lower(model)
    return F.when(m.contains("claude"), "anthropic").when(m.contains("gemini"), "google").otherwise("openai")


def chunking_tier(pages: Column) -> Column:
    """Tier 1 to 5 of a document by its pages (up to 20, 50, 100, 200, more)."""
    return F.when(pages <= 20, 1).when(pages <= 50, 2).when(pages <= 100, 3).when(pages <= 200, 4).otherwise(5)


# Workers of each provider.
WORKERS = {"generation": {"anthropic": 2, "google": 5, "openai": 5}, "evaluation": {"anthropic": 2, "google": 10, "openai": 8}}


def workers(provider_name: Column, kind: str) -> Column:
    """Workers for calls to a provider; ``kind`` is generation or evaluation."""
    own = WORKERS[kind]
    return F.when(provider_name == "anthropic", own["anthropic"]).when(provider_name == "google", own["google"]).otherwise(own["openai"])


def chunking_tier_of_blocks(blocks: Column) -> Column:
    """Tier 1 to 4 of a Word document by its blocks (up to 60, 150, 300, more)."""
    return F.when(blocks <= 60, 1).when(blocks <= 150, 2).when(blocks <= 300, 3).otherwise(4)


def output_cap(batch: Column) -> Column:
    """Tokens that an answer about a batch may have, by its size (up to 30, 40, more)."""
    return F.when(batch <= 30, 8192).when(batch <= 40, 12288).otherwise(16384)
