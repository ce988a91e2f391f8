"""Classification codes: rankings, co-occurrence (Jaccard) overall, per year and per window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from techatlas.functions.names import code_set
from techatlas.functions.text import blank_to_null, split_list
from techatlas.operators.pairs import pairs_codes, pairs_codes_of
from techatlas.operators.ranking import top_k


def code_sets_of(matches: DataFrame, level: int = 4, min_codes: int = 2) -> DataFrame:
    """(tech, record_id, pub_year, code_list) of dated matches with at least two codes."""
    return (
        matches.where("pub_year is not null")
        .select("tech", "record_id", "pub_year", code_set("codes", level).alias("code_list"))
        .where(F.size("code_list") >= min_codes)
    )


def links_of_sets(sets: DataFrame) -> DataFrame:
    """(tech, record_id, code, pub_year) from ``code_sets_of``."""
    return sets.select("tech", "record_id", F.explode("code_list").alias("code"), "pub_year")


def code_links_of(matches: DataFrame, level: int = 4, min_codes: int = 2) -> DataFrame:
    """(tech, record_id, code, pub_year) of matches that carry their code text; no join."""
    return links_of_sets(code_sets_of(matches, level, min_codes))


def records_codes(matches: DataFrame) -> DataFrame:
    return matches.where(blank_to_null("codes").isNotNull()).select("tech", "record_id", "codes")


def records_codes_years(matches: DataFrame) -> DataFrame:
    return matches.where(blank_to_null("codes").isNotNull() & F.col("pub_year").isNotNull()).select(
        "tech", "record_id", "codes", F.col("pub_year").alias("year")
    )


def code_ranking(links: DataFrame) -> DataFrame:
    """Records per code. Links are unique per (tech, record, code), as ``code_links_of`` makes them."""
    return links.groupBy("tech", "code").agg(F.count("*").alias("n"))


def top_codes(links: DataFrame, n: int = 15) -> DataFrame:
    return top_k(code_ranking(links), n, "n", ["code"])


def codes_by_year(links: DataFrame) -> DataFrame:
    """Records per code and year of unique links."""
    return links.groupBy("tech", "code", "pub_year").agg(F.count("*").alias("n"))


def analysed_records(links: DataFrame) -> DataFrame:
    return links.groupBy("tech").agg(F.countDistinct("record_id").alias("records"))


def jaccard(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Add Jaccard = n / (n_a + n_b - n) to pair counts; no sets of ids are compared."""
    a = counts.select("tech", F.col("code").alias("a"), F.col("n").alias("n_a"))
    b = counts.select("tech", F.col("code").alias("b"), F.col("n").alias("n_b"))
    union = F.col("n_a") + F.col("n_b") - F.col("n")
    return (
        pairs.join(a, ["tech", "a"])
        .join(b, ["tech", "b"])
        .select(
            "tech",
            F.col("a").alias("code_a"),
            F.col("b").alias("code_b"),
            "n",
            union.alias("union_n"),
            F.round(F.coalesce(F.try_divide(F.col("n"), union), F.lit(0.0)), 4).alias("jaccard"),
        )
    )


def code_jaccard(links: DataFrame, n: int = 15) -> DataFrame:
    """Jaccard of all co-occurring pairs among the top codes, long form."""
    top = top_codes(links, n)
    return jaccard(pairs_codes(links, top), top)


def code_jaccard_of(matches: DataFrame, n: int = 15, level: int = 4) -> DataFrame:
    """``code_jaccard`` for matches that carry their code text."""
    top = top_codes(code_links_of(matches, level), n)
    return jaccard(pairs_codes_of(matches, top, level), top)


def code_jaccard_window(
    pair_year: DataFrame, code_year: DataFrame, first: int, last: int, n: int = 15
) -> DataFrame:
    """Jaccard of any year window from the yearly cube alone, without the records.

    A record has one publication year, so yearly distinct counts add up.
    """
    inside = F.col("pub_year").between(first, last)
    top = top_k(
        code_year.where(inside).groupBy("tech", "code").agg(F.sum("n").alias("n")), n, "n", ["code"]
    )
    kept = (
        pair_year.where(inside)
        .join(top.select("tech", F.col("code").alias("a")), ["tech", "a"], "left_semi")
        .join(top.select("tech", F.col("code").alias("b")), ["tech", "b"], "left_semi")
        .groupBy("tech", "a", "b")
        .agg(F.sum("n").alias("n"))
    )
    return jaccard(kept, top)


def code_jaccard_matrix(pairs: DataFrame) -> DataFrame:
    """Dense symmetric matrix in long form, zero on the diagonal and where codes never meet.

    Labels are the codes of ``pairs``, at most the top codes it was made of.
    """
    both = pairs.select("tech", "code_a", "code_b", "jaccard").unionAll(
        pairs.select("tech", "code_b", "code_a", "jaccard")
    )
    labels = both.select("tech", "code_a").distinct()
    cells = labels.join(labels.withColumnRenamed("code_a", "code_b"), "tech")
    return cells.join(both, ["tech", "code_a", "code_b"], "left").fillna(0.0, ["jaccard"])


def connections(pairs: DataFrame) -> DataFrame:
    """Co-occurring pairs, and those whose rounded Jaccard is above zero."""
    return pairs.groupBy("tech").agg(
        F.count("*").alias("pairs"), F.count_if(F.col("jaccard") > 0).alias("visible_pairs")
    )


def jaccard_top_pairs(pairs: DataFrame, n: int = 8) -> DataFrame:
    return top_k(pairs.where("jaccard > 0"), n, "jaccard", ["code_a", "code_b"])


def jaccard_summary(pairs: DataFrame) -> DataFrame:
    used = pairs.where("jaccard > 0").groupBy("tech")
    return used.agg(
        F.max("jaccard").alias("max_jaccard"),
        F.round(F.sum(F.col("jaccard").cast("decimal(20,4)")).cast("double") / F.count("*"), 4).alias("mean_jaccard"),
    )


def jaccard_confidence(inter: Column, union: Column, sample: Column, population: Column) -> Column:
    """Struct of standard error and 95 % interval of a Jaccard estimated from a sample."""
    p = F.coalesce(F.try_divide(inter, union), F.lit(0.0))
    exact = (sample >= population) | (union <= 1)
    fpc = F.sqrt(F.greatest(F.lit(0.0), 1 - sample / population))
    se = F.when(exact, F.lit(0.0)).otherwise(F.sqrt(p * (1 - p) / F.nullif(union - 1, F.lit(0))) * fpc)
    moe = se * 1.96
    return F.struct(
        F.round(p, 6).alias("jaccard"),
        F.round(se, 6).alias("standard_error"),
        F.round(moe, 6).alias("margin"),
        F.round(F.greatest(F.lit(0.0), p - moe), 6).alias("ci_lower"),
        F.round(F.least(F.lit(1.0), p + moe), 6).alias("ci_upper"),
        union.alias("effective_n"),
    )


def describe_code(codes: DataFrame, dimension: DataFrame) -> DataFrame:
    """Description of each code by its first 4, else 3, else 1 characters, else blank.

    The dimension is joined once: every code asks for its three prefixes, longest hit wins.
    """
    clean = F.trim("code")
    asked = codes.select(
        "code",
        F.explode(
            F.filter(
                F.transform(
                    F.array(F.lit(4), F.lit(3), F.lit(1)),
                    lambda n: F.when(F.length(clean) >= n, F.substring(clean, F.lit(1), n)),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("_prefix"),
    )
    hits = asked.join(dimension.withColumnRenamed("code", "_prefix"), "_prefix")
    best = hits.groupBy("code").agg(F.max_by("description", F.length("_prefix")).alias("description"))
    return codes.join(best, "code", "left").withColumn("description", F.coalesce("description", F.lit("")))


def technology_breadth(matches: DataFrame) -> DataFrame:
    """Distinct sections (1 character) and subclasses (4 characters) per year."""
    seen = (
        matches.where("pub_year is not null")
        .select("tech", F.col("pub_year").alias("year"), F.explode(split_list("codes")).alias("code"))
        .select("tech", "year", F.substring("code", 1, 4).alias("head"))
        .distinct()
    )
    return seen.groupBy("tech", "year").agg(
        F.countDistinct(F.substring("head", 1, 1)).alias("sections"),
        F.count_if(F.length("head") >= 4).alias("subclasses"),
    )
