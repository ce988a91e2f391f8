"""K-d tree sharding by distributed weighted medians.

A document's size is the bytes of its text plus 1. Its place in metadata space: logarithm of the size,
source, language, each scaled to 0 .. 2^30 - 1 (categories by checksum, so that equal ones are
together; null counts as the empty name). The node of all documents is to become ``shards``
leaves; a node of m leaves is cut along its widest dimension so that m // 2 leaves' share of its
bytes lies below, until every node is one leaf, which holds about ``leaf_bytes`` bytes.

A dimension's key carries 20 bits of a hash of the text and 12 of one of the id and the row's number below the
coordinate, so any number of equal coordinates, and of equal rows, can be cut, and equal texts lie side by side. Row
numbers are fixed once ``points`` are written. Weighted medians of all nodes of a level
are found at once: sizes are summed in BINS equal intervals of the keys, the interval that holds the
median is cut anew, and so on until it weighs at most ``TOLERANCE`` of the node. Nodes are a
distributed table too; to the driver comes one number per round.

Null texts weigh 1 byte. Repeated rows are sharded once each. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from techatlas.llm.shared import numbered
from techatlas.session import materialize

BINS = 1024
TOLERANCE = 1e-4
DIMENSIONS = ("d0", "d1", "d2")
_TOP = (1 << 30) - 1


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, coordinates d0, d1, d2, tie."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1

    def category(name: str) -> Column:
        value = F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")
        return F.shiftright(F.crc32(F.coalesce(value, F.lit(""))), 2).cast("long")

    tie = F.shiftleft(F.xxhash64(text).bitwiseAND((1 << 20) - 1), 12).bitwiseOR(
        F.xxhash64("doc_id", F.monotonically_increasing_id()).bitwiseAND((1 << 12) - 1)
    )
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text).alias("text_crc32"),
        # 2^40 bytes are as far as one text goes
        F.least(F.log2(size.cast("double")) * (_TOP / 40.0), F.lit(float(_TOP))).cast("long").alias("d0"),
        category("source").alias("d1"),
        category("lang").alias("d2"),
        tie.alias("tie"),
    )


def _key() -> Column:
    chosen = F.lit(None).cast("long")
    for d in DIMENSIONS:
        chosen = F.when(F.col("dim") == d, F.col(d)).otherwise(chosen)
    return F.shiftleft(chosen, 32).bitwiseOR(F.col("tie"))


def _cuts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The cut key of each node: rows (node, coordinates, size), nodes (node, dim, lo, hi, below, target, weight)."""
    while True:
        width = F.greatest(F.ceil((F.col("hi") - F.col("lo")) / F.lit(float(BINS))).cast("long"), F.lit(1))
        inside = rows.join(nodes, "node").withColumn("key", _key()).where("key >= lo and key < hi")
        bins = inside.withColumn("width", width).select("node", F.expr("(key - lo) div width").alias("bin"), "size")
        sums = bins.groupBy("node", "bin").agg(F.sum("size").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
        sums = sums.withColumn("upto", upto).join(nodes, "node")
        sums = sums.where(F.col("below") + F.col("upto") >= F.col("target"))
        crossing = sums.groupBy("node").agg(
            F.min_by(F.struct("dim", "lo", "hi", "below", "target", "weight", "bin", "w", "upto", width.alias("width")), "bin").alias("c")
        ).select("node", "c.*")
        low = F.col("lo") + F.col("bin") * F.col("width")
        nodes = materialize(
            crossing.select(
                "node",
                "dim",
                low.alias("lo"),
                F.least(F.col("hi"), low + F.col("width")).alias("hi"),
                (F.col("below") + F.col("upto") - F.col("w")).alias("below"),
                "target",
                "weight",
                "w",
            ),
            "nodes",
        )
        open_ = nodes.where((F.col("w") > F.col("weight") * TOLERANCE) & (F.col("hi") - F.col("lo") > 1))
        if open_.isEmpty():
            break
        nodes = nodes.drop("w")
    # the nearer edge of the last interval
    near = F.col("target") - F.col("below") <= F.col("below") + F.col("w") - F.col("target")
    return nodes.select("node", F.col("dim").alias("cut_dim"), F.when(near, F.col("lo")).otherwise(F.col("hi")).alias("cut"))


def shard(docs: DataFrame, leaf_bytes: int | None = None, shards: int | None = None) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard (0 ..), slot (gapless per shard).

    Give ``leaf_bytes``, or the number of ``shards`` to use an equal part of all bytes.
    """
    rows = materialize(points(docs), "points")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(1, math.ceil(total / leaf_bytes))
    # a node is named by its first shard
    rows = rows.withColumn("node", F.lit(0)).withColumn("leaves", F.lit(shards))
    while not rows.where("leaves > 1").isEmpty():
        split = rows.where("leaves > 1")
        ranges = [F.max(d) - F.min(d) for d in DIMENSIONS]
        stats = split.groupBy("node").agg(
            F.sum("size").alias("weight"),
            F.first("leaves").alias("m"),
            # the widest dimension, the first of equals
            F.greatest(*(F.struct(r.alias("w"), F.lit(-k).alias("k"), F.lit(d).alias("dim")) for k, (d, r) in enumerate(zip(DIMENSIONS, ranges, strict=True)))).alias("widest"),
        )
        nodes = stats.select(
            "node",
            F.col("widest.dim").alias("dim"),
            F.lit(0).cast("long").alias("lo"),
            F.lit(1 << 62).cast("long").alias("hi"),
            F.lit(0).cast("long").alias("below"),
            (F.col("weight") * F.floor(F.col("m") / 2) / F.col("m")).alias("target"),
            "weight",
        )
        cuts = _cuts(split, materialize(nodes, "nodes"))
        rows = rows.join(cuts, "node", "left").withColumn("dim", F.col("cut_dim"))
        upper = F.col("cut").isNotNull() & (_key() >= F.col("cut"))
        left = F.floor(F.col("leaves") / 2).cast("int")
        rows = rows.withColumn("__left", left).withColumn("__upper", upper)
        rows = rows.select(
            "doc_id", "size", "text_crc32", *DIMENSIONS, "tie",
            F.when(F.col("__upper"), F.col("node") + F.col("__left")).otherwise(F.col("node")).alias("node"),
            F.when(F.col("leaves") <= 1, F.col("leaves"))
            .when(F.col("__upper"), F.col("leaves") - F.col("__left"))
            .otherwise(F.col("__left"))
            .alias("leaves"),
        )
        rows = materialize(rows, "points")
    out = rows.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"))
    return numbered(out, ["shard"], "slot")
