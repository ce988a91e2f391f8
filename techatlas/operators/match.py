"""Search predicates: which rows of a corpus match which search phrases.

The corpus is read once for all technologies. Rows are joined with the phrases on words they
share, never crossed, and Spark decides by the size of ``terms`` whether to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from techatlas.functions.text import normalize_text, phrase_heads, phrases, tokens


def year_window(year: Column | str, start: Column | str = "start_year", end: Column | str = "end_year") -> Column:
    """Inclusive year bounds; a null bound is no bound, and then undated rows pass too."""
    y = F.col(year) if isinstance(year, str) else year
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return (s.isNull() | (y >= s)) & (e.isNull() | (y <= e))


#: Up to this many phrases are looked up row by row; more are joined with all word windows.
MANY = 2000


def _asked(terms: DataFrame) -> DataFrame:
    """Normalised phrases with their bounds; the longest word of a phrase is its anchor."""
    words = F.split("_phrase", " ")
    longest = F.array_sort(words, lambda a, b: F.length(b) - F.length(a))
    return (
        terms.select(
            "tech",
            F.col("start_year").alias("_from"),
            F.col("end_year").alias("_to"),
            normalize_text("query").alias("_phrase"),
        )
        .where(F.col("_phrase") != "")
        .withColumn("_anchor", F.element_at(longest, 1))
    )


def _look(asked: DataFrame):
    """(whether the phrases fit in one array, earliest start, latest end).

    Reads the requests, not the corpus. A bound is null if any request has none.
    """
    row = asked.agg(
        F.count("*").alias("n"),
        F.when(F.count("_from") == F.count("*"), F.min("_from")).alias("low"),
        F.when(F.count("_to") == F.count("*"), F.max("_to")).alias("high"),
    ).first()
    return row["n"] <= MANY, row["low"], row["high"]


def _within(corpus: DataFrame, year: str | None, low, high) -> DataFrame:
    """The years any request covers, as plain comparisons that reach the scan."""
    if year is not None and low is not None:
        corpus = corpus.where(F.col(year) >= low)
    if year is not None and high is not None:
        corpus = corpus.where(F.col(year) <= high)
    return corpus


def _in_window(found: DataFrame, year: str | None) -> DataFrame:
    return found if year is None else found.where(year_window(year, "_from", "_to"))


def _candidates(corpus: DataFrame, asked: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    """Rows paired with the phrases whose anchor they contain, with their text in ``_text``.

    Fields are set apart by a line break, which no phrase contains. Rows without any anchor
    end here, so for selective phrases little more than the tokenisation is left to do.
    """
    parts = [F.coalesce(normalize_text(f), F.lit("")) for f in fields]
    text = F.concat(F.lit(" "), F.concat_ws(" \n ", *parts), F.lit(" "))
    anchors = asked.select(F.collect_set("_anchor")).scalar()
    return (
        corpus.select(*keep, text.alias("_text"))
        .withColumn("_anchors", anchors)
        .select(
            *keep, "_text", F.explode(F.array_intersect(F.split("_text", " "), "_anchors")).alias("_anchor")
        )
        .join(asked, "_anchor")
    )


def _window_join(corpus, asked, shapes, windows, fields, keep):
    """Equi-join the windows of all fields with the phrases asked for; carries no text.

    ``shapes`` is aggregated over the terms into one row: which window sizes to cut at all.
    """
    texts = [f"_tokens{i}" for i in range(len(fields))]
    rows = corpus.select(*keep, *[tokens(f).alias(t) for f, t in zip(fields, texts)]).withColumn(
        "_shapes", asked.select(F.collect_set(shapes)).scalar()
    )
    cut = F.array_distinct(F.concat(*[windows(F.col(t), F.col("_shapes")) for t in texts]))
    return rows.select(*keep, F.explode(cut).alias("_phrase")).join(asked, "_phrase")


def match_phrase(
    corpus: DataFrame, terms: DataFrame, fields: list[str], keep: list[str], year: str | None = None
) -> DataFrame:
    """(tech, *keep) for rows where one field holds the whole phrase as consecutive tokens.

    ``keep`` lists the columns to carry along (with ``year`` among them if bounds apply).
    """
    asked = _asked(terms)
    few, low, high = _look(asked)
    corpus = _within(corpus, year, low, high)
    if few:
        phrase = F.concat(F.lit(" "), F.col("_phrase"), F.lit(" "))
        found = _candidates(corpus, asked, fields, keep).where(F.contains(F.col("_text"), phrase))
    else:
        length = F.size(F.split("_phrase", " "))
        found = _window_join(corpus, asked, length, phrases, fields, keep)
    return _in_window(found, year).select("tech", *keep)


def match_prefix(
    corpus: DataFrame, terms: DataFrame, fields: list[str], keep: list[str], year: str | None = None
) -> DataFrame:
    """Like ``match_phrase``, but the last token of the phrase may be the start of a word."""
    shape = F.struct(
        F.size(F.split("_phrase", " ")).alias("words"), F.length("_phrase").alias("chars")
    )
    asked = _asked(terms)
    _, low, high = _look(asked)
    found = _window_join(_within(corpus, year, low, high), asked, shape, phrase_heads, fields, keep)
    return _in_window(found, year).select("tech", *keep)


def match_all_terms(
    corpus: DataFrame, terms: DataFrame, fields: list[str], row_id: str
) -> DataFrame:
    """(tech, row_id) for rows holding every token of the query anywhere in any field."""
    asked = _asked(terms)
    if _look(asked)[0]:
        every = F.forall(
            F.split("_phrase", " "), lambda t: F.contains(F.col("_text"), F.concat(F.lit(" "), t, F.lit(" ")))
        )
        return _candidates(corpus, asked, fields, [row_id]).where(every).select("tech", row_id)
    wanted = asked.select("tech", F.explode(F.array_distinct(F.split("_phrase", " "))).alias("_token"))
    needed = wanted.groupBy("tech").agg(F.count("*").alias("_needed"))
    present = F.array_distinct(F.concat(*[tokens(f) for f in fields]))
    return (
        corpus.select(row_id, F.explode(present).alias("_token"))
        .join(wanted, "_token")
        .groupBy("tech", row_id)
        .agg(F.count("*").alias("_found"))
        .join(needed, "tech")
        .where("_found = _needed")
        .select("tech", row_id)
    )


def contains_text(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows where any of the columns contains the text, ignoring case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(needle.lower()), F.lit(False))
    return df.where(hit)
