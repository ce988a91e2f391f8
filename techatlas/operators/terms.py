"""Suggested search terms from titles, and scans of run warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from techatlas.functions.labels import is_stopword, title_case_smart
from techatlas.functions.text import title_words, word_ngrams
from techatlas.operators.ranking import top_k


def term_counts(matches: DataFrame, typed: DataFrame, title: str = "title") -> DataFrame:
    """(tech, norm, form, n): 2- and 3-grams of matching titles that contain the typed text.

    Equal titles are counted first, so copies are cut into n-grams once.
    """
    titles = (
        matches.where(F.col(title).isNotNull())
        .groupBy("tech", F.col(title).alias("title"))
        .agg(F.count("*").alias("copies"))
    )
    typed = typed.select("tech", F.lower(F.trim("query")).alias("_typed"))
    grams = titles.select("tech", "copies", F.explode(word_ngrams(title_words("title"))).alias("form")).withColumn(
        "norm", F.lower("form")
    )
    words = F.split("norm", " ")
    return (
        grams.join(typed, "tech")
        .where(F.col("norm").contains(F.col("_typed")))
        .where(~is_stopword(F.element_at(words, 1)) & ~is_stopword(F.element_at(words, -1)))
        .groupBy("tech", "norm", "form")
        .agg(F.sum("copies").alias("n"))
    )


def best_surface_form(counts: DataFrame) -> DataFrame:
    """Most common spelling per normalised term (tie: alphabetical) and the total count."""
    best = F.min_by("form", F.struct(-F.col("n"), F.col("form")))
    return counts.groupBy("tech", "norm").agg(best.alias("form"), F.sum("n").alias("n"))


def suggest_terms(matches: DataFrame, typed: DataFrame, title: str = "title", limit: int = 30) -> DataFrame:
    """Top terms per typed text, in title case."""
    ranked = top_k(best_surface_form(term_counts(matches, typed, title)), limit, "n", ["norm"])
    return ranked.select("tech", "norm", title_case_smart("form").alias("term"), "n")


# Text in a warning that tells which source failed.
FAILURE_PATTERNS = [
    ("paper query failed", "papers"),
    ("entity resolution failed", "legal entities"),
    ("publication_years", "publications"),
]


def source_failures(warnings: DataFrame, patterns: DataFrame) -> DataFrame:
    """One alert per (tech, source) whose pattern occurs in any warning.

    ``patterns(pattern, source)`` is a short list: it is folded into one array and tested row
    by row, and repeated warnings are merged before the shuffle.
    """
    folded = patterns.select(F.collect_set(F.struct("pattern", "source"))).scalar()
    hits = F.filter("_patterns", lambda p: F.contains(F.col("warning"), p["pattern"]))
    return (
        warnings.withColumn("_patterns", folded)
        .select("tech", F.explode(F.transform(hits, lambda p: p["source"])).alias("source"))
        .distinct()
        .withColumn("message", F.concat("source", F.lit(": no data")))
    )


def dedupe_ordered(values: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position of their first appearance."""
    return values.groupBy("tech", value).agg(F.min(position).alias("first_position"))
