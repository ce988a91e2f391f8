"""Which members occur together in a group (applicants on a record, codes on a record …).

Three rules keep this safe on hot groups, without ever dropping a pair that counts:

* groups of up to ``BLOCK`` members are joined with themselves, their pairs are counted before
  they are shuffled;
* larger groups are cut into hash blocks; a task sees one pair of blocks, never the group;
* where only the top ``k`` pairs are asked for, members of large groups that occur too rarely
  to be in any top pair are left out before pairs are formed (``top_pairs``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from techatlas.functions.names import code_set
from techatlas.operators.ranking import top_k
from techatlas.session import materialize

#: Members up to which a group counts as small.
BLOCK = 64


def _all_pairs(members: Column) -> Column:
    """All (a, b) with a before b in a sorted array."""
    return F.flatten(
        F.transform(
            members,
            lambda x, i: F.transform(
                F.slice(members, i + 2, F.size(members)), lambda y: F.struct(x.alias("a"), y.alias("b"))
            ),
        )
    )


def _exploded(df: DataFrame, keys: list[str], weight: Column, pairs: Column) -> DataFrame:
    return (
        df.select(*keys, weight.alias("_w"), F.explode(pairs).alias("_p"))
        .groupBy(*keys, F.col("_p.a").alias("a"), F.col("_p.b").alias("b"))
        .agg(F.sum("_w").alias("n"))
    )


def bounded_pair_counts(links: DataFrame, group: str, member: str, keys: list[str]) -> DataFrame:
    """(keys, a, b, n) where every group holds few members, e.g. of a fixed vocabulary.

    An equi-join of the links with themselves on the group; with few members per group no
    group is heavy, and pairs are counted before they are shuffled.
    """
    one = (
        links.select(*keys, F.col(group).alias("_group"), F.col(member).alias("a")).where("a is not null").distinct()
    )
    return (
        one.join(one.withColumnRenamed("a", "b"), [*keys, "_group"])
        .where("a < b")
        .groupBy(*keys, "a", "b")
        .agg(F.count("*").alias("n"))
    )


def set_pair_counts(sets: DataFrame, members: str, keys: list[str]) -> DataFrame:
    """(keys, a, b, n) from one short sorted array of members per row.

    Equal arrays are counted first, so copies of a row cost one row.
    """
    counted = sets.where(F.size(members) >= 2).groupBy(*keys, members).agg(F.count("*").alias("_copies"))
    return _exploded(counted, keys, F.col("_copies"), _all_pairs(F.col(members)))


def _blocked_pair_counts(links: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Pairs inside large groups; ``links`` carries the group size in ``_size``."""
    blocks = F.ceil(F.col("_size") / block).cast("int")
    own = F.pmod(F.xxhash64("_m"), blocks).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda j: F.struct(F.least(F.col("_own"), j).alias("i"), F.greatest(F.col("_own"), j).alias("j")),
    )
    spread = (
        links.withColumn("_blocks", blocks)
        .withColumn("_own", own)
        .select(*keys, "_g", "_m", "_own", F.explode(cells).alias("_cell"))
        # spread the cells of one group over all tasks; the grouping below alone would keep
        # the partitioning by group that the join before it left behind
        .repartition(*keys, "_g", "_cell")
    )
    cell_members = spread.groupBy(*keys, "_g", "_cell").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_m").alias("m"), F.col("_own").alias("o")))).alias("_ms")
    )
    same_block = F.col("_cell.i") == F.col("_cell.j")
    pairs = F.transform(
        F.filter(
            _all_pairs(F.col("_ms")), lambda p: same_block | (p["a"]["o"] != p["b"]["o"])
        ),
        lambda p: F.struct(p["a"]["m"].alias("a"), p["b"]["m"].alias("b")),
    )
    return _exploded(cell_members, keys, F.lit(1), pairs)


def _links(links: DataFrame, group: str, member: str, keys: list[str], block: int):
    """The distinct links, and (keys, _g, _size) of the groups above ``block`` or None.

    The links are those of the search hits only; they are used several times, so they are
    written once. Whether there are large groups at all is looked up, and most often there are
    none: then one aggregate does the whole job.
    """
    one = materialize(
        links.select(*keys, F.col(group).alias("_g"), F.col(member).alias("_m"))
        .where("_m is not null")
        .distinct(),
        "links",
    )
    sizes = one.groupBy(*keys, "_g").agg(F.count("*").alias("_size"))
    large = materialize(sizes.where(F.col("_size") > block), "large-groups")
    return one, None if large.isEmpty() else large


def pair_counts(
    links: DataFrame, group: str, member: str, keys: list[str], block: int = BLOCK
) -> DataFrame:
    """(keys, a, b, n): in how many groups a < b occur together. Exact, all pairs."""
    one, hot = _links(links, group, member, keys, block)
    if hot is None:
        return bounded_pair_counts(one, "_g", "_m", keys)
    on = [*keys, "_g"]
    counts = bounded_pair_counts(one.join(hot, on, "left_anti"), "_g", "_m", keys).unionAll(
        _blocked_pair_counts(one.join(hot, on), keys, block)
    )
    return counts.groupBy(*keys, "a", "b").agg(F.sum("n").alias("n"))


def _first_pairs(members: Column, k: int) -> Column:
    """The first ``k`` pairs of a sorted array in (a, b) order, without listing the others."""
    size = F.size(members)
    firsts = F.filter(
        F.sequence(F.lit(0), F.greatest(size - 2, F.lit(0))),
        # pairs that start before position i
        lambda i: i * (size - 1) - (i * (i - 1) / 2) < k,
    )
    nested = F.transform(
        firsts,
        lambda i: F.transform(
            F.slice(members, i + 2, F.least(size, F.lit(k))),
            lambda y: F.struct(F.element_at(members, i + 1).alias("a"), y.alias("b")),
        ),
    )
    return F.slice(F.flatten(nested), 1, k)


def top_pairs(links: DataFrame, group: str, member: str, k: int, block: int = BLOCK) -> DataFrame:
    """The ``k`` most frequent pairs per technology, ties by name; the same rows as
    ``top_k(pair_counts(...))``.

    Small groups give a lower bound t for the k-th best count. A pair counts at most as often
    as its rarer member, so in large groups only members of at least max(t, 2) groups can make
    a pair that beats it. Pairs that occur once can only be needed as ties, in name order, and
    then they are among the first 2k pairs of their group.
    """
    keys = ["tech"]
    one, hot = _links(links, group, member, keys, block)
    if hot is None:
        return top_k(bounded_pair_counts(one, "_g", "_m", keys), k, "n", ["a", "b"])
    large = one.join(hot, ["tech", "_g"])
    small = one.join(hot, ["tech", "_g"], "left_anti")
    small_counts = materialize(bounded_pair_counts(small, "_g", "_m", keys), "small-pairs")
    bound = (
        top_k(small_counts, k, "n", ["a", "b"])
        .groupBy("tech")
        .agg(F.when(F.count("*") == k, F.min("n")).otherwise(F.lit(1)).alias("_t"))
    )
    in_large = large.select("tech", "_m").distinct()
    degree = (
        one.join(in_large, ["tech", "_m"], "left_semi")
        .groupBy("tech", "_m")
        .agg(F.count("*").alias("_degree"))
    )
    sized = large.join(degree, ["tech", "_m"]).join(bound, "tech", "left")
    frequent = sized.where(F.col("_degree") >= F.greatest(F.coalesce("_t", F.lit(1)), F.lit(2)))
    often = _blocked_pair_counts(frequent.select("tech", "_g", "_m", "_size"), keys, block)

    w = Window.partitionBy("tech", "_g").orderBy("_m")
    ties = (
        sized.withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= 2 * k + 1)
        .groupBy("tech", "_g")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("_m").alias("m"), F.col("_degree").alias("d")))).alias("_ms"))
        .select("tech", F.explode(_first_pairs(F.col("_ms"), 2 * k)).alias("_p"))
        .where("least(_p.a.d, _p.b.d) = 1")
        .select("tech", F.col("_p.a.m").alias("a"), F.col("_p.b.m").alias("b"), F.lit(1).cast("long").alias("n"))
    )
    counts = (
        small_counts.unionByName(often).unionByName(ties).groupBy("tech", "a", "b").agg(F.sum("n").alias("n"))
    )
    return top_k(counts, k, "n", ["a", "b"])


# --- named forms ---------------------------------------------------------------------


def pairs_actors(actor_matches: DataFrame, limit: int = 200) -> DataFrame:
    """Applicants that appear on the same records."""
    return top_pairs(actor_matches, "record_id", "actor", limit)


def pairs_orgs(orgs: DataFrame, limit: int = 200) -> DataFrame:
    """Organisations in the same projects."""
    return top_pairs(orgs, "project_id", "name", limit)


def pairs_countries(orgs: DataFrame, limit: int = 30) -> DataFrame:
    """Countries with organisations in the same projects (country codes are few)."""
    return top_k(bounded_pair_counts(orgs, "project_id", "country", ["tech"]), limit, "n", ["a", "b"])


def pairs_countries_of(sets: DataFrame, limit: int = 30) -> DataFrame:
    """``pairs_countries`` from ``country_sets``: no links are joined, equal sets are counted first."""
    return top_k(set_pair_counts(sets, "countries", ["tech"]), limit, "n", ["a", "b"])


def pairs_codes(links: DataFrame, top: DataFrame) -> DataFrame:
    """Codes on the same records, among the top codes only."""
    kept = links.join(top.select("tech", "code"), ["tech", "code"], "left_semi")
    return bounded_pair_counts(kept, "record_id", "code", ["tech"])


def pairs_codes_of(
    matches: DataFrame, top: DataFrame, level: int = 4, min_codes: int = 2, yearly: bool = False
) -> DataFrame:
    """``pairs_codes`` for matches that carry their code text: every row cuts its codes down to
    the top codes by itself, so neither records nor links are shuffled. ``yearly``: per pub_year."""
    sets = matches.where("pub_year is not null").select("tech", "pub_year", code_set("codes", level).alias("code_list"))
    return pairs_codes_in(sets.where(F.size("code_list") >= min_codes), top, yearly)


def pairs_codes_in(sets: DataFrame, top: DataFrame, yearly: bool = False) -> DataFrame:
    """``pairs_codes_of`` from ``code_sets_of``."""
    keys = ["tech", "pub_year"] if yearly else ["tech"]
    labels = top.groupBy("tech").agg(F.collect_list("code").alias("_labels"))
    kept = sets.join(labels, "tech").select(*keys, F.array_intersect("code_list", "_labels").alias("_kept"))
    return set_pair_counts(kept, "_kept", keys)


def pairs_codes_year(links: DataFrame) -> DataFrame:
    """Codes on the same records per year, all codes."""
    return pair_counts(links, "record_id", "code", ["tech", "pub_year"])


def pairs_codes_year_of(matches: DataFrame, level: int = 4, min_codes: int = 2) -> DataFrame:
    """``pairs_codes_year`` for matches that carry their code text: pairs are formed in each row, equal
    sets of a year are counted first."""
    sets = matches.where("pub_year is not null").select("tech", "pub_year", code_set("codes", level).alias("_all"))
    return set_pair_counts(sets.where(F.size("_all") >= min_codes), "_all", ["tech", "pub_year"])
