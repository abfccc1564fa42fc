"""Text functions: tokens, Jaccard, answers, responses, redaction."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words dropped from token sets, and words mapped to one name.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "by", "does", "from", "in",
    "is", "it", "of", "on", "or", "the", "to", "two", "which", "with",
)
SYNONYMS = {
    "above": "order",
    "below": "order",
    "circle": "disk",
    "circles": "disk",
    "cross": "intersection",
    "crossing": "intersection",
    "dot": "point",
    "dots": "point",
    "height": "length",
    "heights": "length",
    "inside": "containment",
    "intersect": "intersection",
    "larger": "magnitude",
    "largest": "maximum",
    "left": "order",
    "longer": "length",
    "longest": "maximum",
    "marker": "point",
    "markers": "point",
    "rectangle": "shape",
    "right": "order",
    "square": "shape",
    "tall": "length",
    "taller": "length",
    "tallest": "maximum",
    "width": "proportion",
    "wider": "proportion",
}
# Characters stripped from both ends of an answer.
ANSWER_EDGE = " \t\r\n\"'`.,:;!?"
# end of fixed values


def words(text: Column) -> Column:
    """All runs of ASCII letters and digits, lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def token_set(found: Column) -> Column:
    """Distinct words without stop words, synonyms folded."""
    kept = F.array_except(found, F.array(*[F.lit(w) for w in STOP_WORDS]))
    folded = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.array_distinct(F.transform(kept, lambda w: F.coalesce(F.try_element_at(folded, w), w)))


def tokens(text: Column) -> Column:
    """Token set of a text."""
    return token_set(words(text))


def jaccard(left: Column, right: Column) -> Column:
    """Overlap over union of two sets; 0 when both are empty."""
    union = F.size(F.array_union(left, right))
    shared = F.size(F.array_intersect(left, right))
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)


def jaccard_of_sets(left: Column, right: Column) -> Column:
    """As ``jaccard`` for arrays already known to hold distinct members: one intersection suffices."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)


def padded_words(text: Column) -> Column:
    """Words joined by single spaces with a space at both ends, for whole-word search."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether the normalised phrase occurs in the normalised text as whole words."""
    needle = padded_words(phrase)
    return (F.length(needle) > 2) & F.contains(padded_words(text), needle)


@F.pandas_udf(T.StringType())
def _nfkc_casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


def _fold(text: Column) -> Column:
    """Compatibility composition and case folding.

    Plain ASCII stays in the JVM; only other rows carry their text to Python.
    """
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.coalesce(F.when(plain, F.lower(text)), _nfkc_casefold(F.when(~plain, text)))


def _tidy(folded: Column) -> Column:
    return F.btrim(F.regexp_replace(F.trim(folded), r"\s+", " "), F.lit(ANSWER_EDGE))


def normalize_answer(text: Column) -> Column:
    """Compatibility-normalised, case-folded, single-spaced answer without edge punctuation."""
    return _tidy(_fold(text))


_SEPARATOR = "\x01"


def _normalize_all(values: Column) -> Column:
    """Every text of an array, folded in one call."""
    folded = F.split(_fold(F.array_join(values, _SEPARATOR)), _SEPARATOR)
    return F.transform(folded, _tidy)


def score_responses(
    rows: DataFrame, content: str = "content", candidates: str = "candidates", gold: str = "gold", refusal: str = "refusal"
) -> DataFrame:
    """Strict two-key JSON answers to ``status, prediction, confidence, correct``.

    The content is parsed once per row.  Of two candidates with the same normal
    form the later one is taken.
    """
    parsed = rows.withColumn("__v", F.try_parse_json(content))
    variant = lambda path: F.try_variant_get("__v", path, "variant")
    fields = (
        parsed.withColumn("__answer", variant("$.answer"))
        .withColumn("__confidence", variant("$.confidence"))
        .withColumn("__keys", F.array_sort(F.json_object_keys(F.when(F.col("__v").isNotNull(), F.col(content)))))
    )
    typed = (
        fields.withColumn("__at", F.schema_of_variant("__answer"))
        .withColumn("__ct", F.schema_of_variant("__confidence"))
        .withColumn("__conf", F.try_variant_get("__confidence", "$", "double"))
        .withColumn("__text", normalize_answer(F.try_variant_get("__answer", "$", "string")))
        .withColumn("__forms", _normalize_all(F.col(candidates)))
    )
    number = F.col("__ct").isin("BIGINT", "DOUBLE", "FLOAT") | F.col("__ct").startswith("DECIMAL")
    well_formed = (
        (F.col("__keys") == F.array(F.lit("answer"), F.lit("confidence")))
        & (F.col("__at") == "STRING")
        & number
        & F.col("__conf").between(0, 1)
    )
    position = F.array_position(F.reverse("__forms"), F.col("__text"))
    picked = F.when(position > 0, F.try_element_at(F.reverse(candidates), position.cast("int")))
    judged = typed.withColumn("__pick", F.when(F.coalesce(well_formed, F.lit(False)), picked)).withColumn(
        "__refused", F.coalesce(refusal, F.lit("")) != ""
    )
    scored = ~F.col("__refused") & F.col("__pick").isNotNull()
    return judged.select(
        *rows.columns,
        F.when(F.col("__refused"), "refused").when(F.col("__pick").isNotNull(), "scored").otherwise("unparseable").alias("status"),
        F.when(scored, F.col("__pick")).alias("prediction"),
        F.when(scored, F.col("__conf")).alias("confidence"),
        F.when(scored, F.col("__pick") == F.col(gold)).alias("correct"),
    )


def redact(text: Column, replacements: list[tuple[Column, str]]) -> Column:
    """Ordered literal replacements; an empty or missing key leaves the text as it is."""
    for old, new in replacements:
        text = F.when(F.coalesce(old, F.lit("")) == "", text).otherwise(F.replace(text, old, F.lit(new)))
    return text


def truncate(text: Column, limit: int) -> Column:
    return F.left(text, F.lit(limit))


def effort_signals(completion: Column, reasoning: Column, budget: int, rationale: Column) -> Column:
    """Visible tokens, budget and reasoning fractions, rationale size."""
    trimmed = F.trim(F.regexp_replace(rationale, r"\s+", " "))
    return F.struct(
        F.when(completion.isNotNull() & reasoning.isNotNull(), F.greatest(completion - reasoning, F.lit(0))).alias(
            "visible_output_tokens"
        ),
        F.round(completion / budget, 6).alias("budget_fraction"),
        F.round(F.try_divide(reasoning, completion), 6).alias("reasoning_fraction"),
        F.length(rationale).cast("bigint").alias("rationale_characters"),
        F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " "))).cast("bigint").alias("rationale_words"),
    )


def _number_text(raw: Column) -> Column:
    """The shortest JSON text of a finite number, integers as written."""
    short = raw.cast("double").cast("string")
    plain = F.regexp_replace(raw.cast("double").cast("decimal(38,19)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    size = F.abs(raw.cast("double"))
    mantissa = F.regexp_replace(F.substring_index(short, "E", 1), r"\.0$", "")
    power = F.substring_index(short, "E", -1).try_cast("int")
    scientific = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return (
        F.when(raw.rlike(r"^-?(0|[1-9][0-9]*)$"), raw)
        .when(~short.contains("E"), short)
        .when(size.between(1e-4, 1e15), plain)
        .otherwise(scientific)
    )


def choice_text(json_value: Column) -> Column:
    """Closed-choice label of a JSON value: text kept, finite number as JSON text, else null."""
    value = F.try_parse_json(json_value)
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when((kind == "STRING") & (F.trim(text) != ""), text).when(
        numeric, _number_text(F.when(numeric, F.trim(json_value)))
    )
