"""Exact duplicates: 128-bit content hashes, smallest id stays, bytes compared inside groups.

Texts are equal when they are identical after every run of ASCII white space (0x09-0x0D, 0x20) became one space;
null counts as the empty text. Of equal texts the row with the smallest ``doc_id`` stays (rows without an id
come after all others; of rows with the same id one stays, the first in the written table).

1. Every text is read once and leaves an id, a 128-bit hash and a digest; only these are kept.
2. Hashes are counted, combined before the shuffle, so a group of any size is a few rows.
3. Texts whose hash occurs twice are grouped by hash *and bytes*; copies fold into one before the shuffle. A hash
   with more than one text is a collision, and its rows are then grouped by hash and number of the text.
4. Groups that hold more than 1 in SHARE rows are fewer than SHARE, so they are broadcast; all others join by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from techatlas.llm.shared import split_by
from techatlas.session import materialize

#: A group with more than this share of all rows (1 in SHARE) counts as hot.
SHARE = 1000


def normal(text: Column) -> Column:
    """The text that is compared: runs of ASCII white space as one space, null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def content_hash(text: Column) -> Column:
    """128 bits of a normalised text."""
    return F.unhex(F.md5(text.cast("binary")))


def _texts(docs: DataFrame, hash_of: Callable[[Column], Column], carry: Sequence[str]) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text")).alias("own"), *carry)
    return rows.select("doc_id", "own", hash_of(F.col("own")).alias("key"), *carry)


def _digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("own").cast("binary"), 256)))


def _groups(rows: DataFrame) -> DataFrame:
    """Per key that occurs twice: group_size and the row that stays (id and place)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))
    found = rows.groupBy("key").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
    return found.where("group_size > 1").select(
        "key", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row")
    )


def _split(texts: DataFrame, groups: DataFrame, carry: Sequence[str]) -> tuple[DataFrame, DataFrame] | None:
    """Keys that stand for more than one text, and their rows under keys that name the text; None if there are none."""
    keys = groups.select("key")
    maybe, _ = split_by(texts, keys, "key")
    kinds = maybe.groupBy("key", "own").agg(F.count(F.lit(1)).alias("copies"))
    numbers = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    several = materialize(numbers.select("key"), "collisions")
    if several.isEmpty():
        return None
    maybe, _ = split_by(texts, several, "key")
    maybe = maybe.join(several.hint("merge"), "key", "left_semi")
    kinds = maybe.select("key", "own").distinct()
    place = F.row_number().over(Window.partitionBy("key").orderBy("own"))
    kinds = materialize(kinds.withColumn("kind", place), "kinds")
    named = _digest(maybe).join(kinds.hint("merge"), ["key", "own"])
    key = F.concat("key", F.lit(b":"), F.col("kind").cast("string").cast("binary"))
    return several, named.select("doc_id", key.alias("key"), "digest", *carry)


def duplicates(
    docs: DataFrame, hash_of: Callable[[Column], Column] = content_hash, carry: Sequence[str] = ()
) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text), columns of ``carry``.

    ``hash_of``: binary hash of a normalised text. A weak one costs time and changes no result.
    An empty table gives an empty result. Other columns of docs are not read.
    """
    texts = _texts(docs, hash_of, carry)
    row = F.monotonically_increasing_id().alias("row")
    rows = materialize(_digest(texts).select("doc_id", "key", "digest", row, *carry), "hashes")
    groups = materialize(_groups(rows), "groups")
    split = _split(texts, groups, carry)
    if split is not None:
        several, named = split
        sure = rows.drop("row").join(several.hint("merge"), "key", "left_anti").unionByName(named)
        rows = materialize(sure.withColumn("row", F.monotonically_increasing_id()), "hashes")
        groups = materialize(_groups(rows), "groups")
    least = rows.count() // SHARE
    hot = F.broadcast(groups.where(F.col("group_size") > least))  # fewer than SHARE + 1
    rest = groups.where(F.col("group_size") <= least)
    copies = rows.join(hot, "key")
    others = rows.join(hot.select("key"), "key", "left_anti").join(rest.hint("merge"), "key", "left")
    found = copies.unionByName(others)
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *carry,
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs; a copy of docs with row numbers is written."""
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("whole")
    rows = materialize(docs.select(whole, F.monotonically_increasing_id().alias("place")), "rows")
    judged = duplicates(rows.select("whole.doc_id", "whole.text", "place"), carry=("place",))
    gone = materialize(judged.where("not kept").select("place"), "copies")
    maybe, kept = split_by(rows, gone, "place")
    kept = kept.unionByName(maybe.join(gone.hint("merge"), "place", "left_anti").select("whole", "place"))
    return kept.select("whole.*")
