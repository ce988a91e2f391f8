"""Near-duplicate embeddings by int8 tile products with exact error bounds.

Vectors are compared within one label (and one length) by cosine in double precision; components are
kept as given, single for array<float> and double for all others. Equal vectors form one class, and one
of each class goes on. Classes of a label are cut into tiles of
``TILE`` vectors, whatever the label's share of all rows, and a task compares two tiles:

* a unit vector u is kept as s * q, q in -127 .. 127, with e >= |u - s q|. For two vectors,
  |u.v - s q . t r| <= |s q| e_v + e_u, so one product of small integers (exact in single precision)
  bounds every cosine of the tile pair;
* only pairs whose bound reaches the threshold are computed in double precision.

A tile pair gives back one row per linked vector: its number of links and the smallest member of its
component within the pair, never the links themselves; components are joined from those.

Vectors that are null, zero, or hold null or non-finite components, and rows without label or vec_id,
link with nothing: n_links 0, component_id the own vec_id. Rows that share a vec_id count as vectors of their own
in n_links, but are one vertex of the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from techatlas.llm.shared import components, numbered
from techatlas.session import materialize

TILE = 1024
PAIRS_AT_ONCE = 1 << 15
SLACK = 1e-5


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows that aren't zero: int8 values, scales, lengths of scale * values, error bounds (all of unit rows)."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    error = np.linalg.norm(unit - back, axis=1)
    return q, scale, np.linalg.norm(back, axis=1), error


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs with cosine >= threshold; y None: pairs i < j within x."""
    qx, sx, lx, ex = quantised(x)
    qy, sy, _, ey = (qx, sx, lx, ex) if y is None else quantised(y)
    other = x if y is None else y
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(other, axis=1)
    # sums of products of int8 are exact in float32 up to 2^24, in float64 beyond
    kind = np.float32 if x.shape[1] <= 1024 else np.float64
    right = qy.astype(kind).T
    for low in range(0, len(x), 256):
        part = slice(low, low + 256)
        product = (qx[part].astype(kind) @ right) * sx[part, None] * sy
        bound = product + lx[part, None] * ey + ex[part, None] + SLACK
        i, j = np.nonzero(bound >= threshold)
        i += low
        if y is None:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), PAIRS_AT_ONCE):
            a, b = i[k : k + PAIRS_AT_ONCE], j[k : k + PAIRS_AT_ONCE]
            cosine = np.einsum("ij,ij->i", x[a], other[b]) / (nx[a] * ny[b])
            yield a[cosine >= threshold], b[cosine >= threshold]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each, by minima over links and jumps."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _vectors(values: bytes, dim: int, kind: str) -> np.ndarray:
    """Vectors of a tile; doubles times a power of two each, so that no square leaves the range."""
    x = np.frombuffer(values, kind).reshape(-1, dim).astype(np.float64)
    return x if kind == "<f4" else np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _tile_pairs(threshold: float, element: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                x = _vectors(row["x"], dim, element)
                y = None if row["y"] is None else _vectors(row["y"], dim, element)
                ids = np.concatenate([row["x_ids"], row["y_ids"] or []]).astype(np.int64)
                times = np.concatenate([row["x_times"], row["y_times"] or []]).astype(np.int64)
                shift = 0 if y is None else len(x)
                links, a_all, b_all = np.zeros(len(ids), np.int64), [], []
                for a, b in tile_links(x, y, threshold):
                    b = b + shift
                    np.add.at(links, a, times[b])
                    np.add.at(links, b, times[a])
                    a_all.append(a)
                    b_all.append(b)
                # positions by ascending id, so that the smallest position is the smallest id
                by = np.argsort(ids, kind="stable")
                rank = np.empty(len(ids), np.int64)
                rank[by] = np.arange(len(ids))
                a = rank[np.concatenate(a_all)] if a_all else np.empty(0, np.int64)
                b = rank[np.concatenate(b_all)] if b_all else np.empty(0, np.int64)
                root = ids[by][_roots(len(ids), a, b)][rank]
                linked = links > 0
                yield pa.record_batch(
                    [pa.array(np.concatenate([row["x_keys"], row["y_keys"] or []]).astype(np.int64)[linked]), pa.array(ids[linked]), pa.array(links[linked]), pa.array(root[linked])],
                    names=["key", "id", "links", "root"],
                )

    return run


def _tiles(element: str):
    """One row per tile: its vectors as one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.array([m["embedding"] for m in ms], element).tobytes() for ms in batch["members"].to_pylist()]
            ids = [[m["vec_id"] for m in ms] for ms in batch["members"].to_pylist()]
            times = [[m["times"] for m in ms] for ms in batch["members"].to_pylist()]
            keys = [[m["key"] for m in ms] for ms in batch["members"].to_pylist()]
            kind = pa.list_(pa.int64())
            yield pa.record_batch(
                [batch["label"], batch["dim"], batch["tile"], pa.array(values, pa.binary()), pa.array(ids, kind), pa.array(times, kind), pa.array(keys, kind)],
                names=["label", "dim", "tile", "x", "ids", "times", "keys"],
            )

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    element = "<f4" if single else "<f8"
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"),
        F.col("label").alias("label"),
    )
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    rows = materialize(rows.withColumn("usable", F.coalesce(usable, F.lit(False))), "vectors")

    classes = rows.where("usable").groupBy("label", "embedding").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("times")
    )
    classes = classes.withColumn("dim", F.size("embedding"))
    classes = numbered(classes, ["label", "dim"], "number").withColumn("key", F.monotonically_increasing_id())
    classes = materialize(classes, "classes")
    members = F.collect_list(F.struct("embedding", "vec_id", "times", "key")).alias("members")
    tiles = classes.groupBy("label", "dim", F.floor(F.col("number") / TILE).alias("tile")).agg(members)
    label = rows.schema["label"].dataType.simpleString()
    tiles = tiles.select("label", "dim", "tile", "members").mapInArrow(
        _tiles(element), f"label {label}, dim int, tile long, x binary, ids array<long>, times array<long>, keys array<long>"
    )
    tiles = materialize(tiles, "tiles")

    one = tiles.select("label", "dim", "tile", "x", *(F.col(c).alias(f"x_{c}") for c in ("ids", "times", "keys")))
    two = tiles.select(
        F.col("label").alias("l2"), F.col("dim").alias("d2"), F.col("tile").alias("tile2"), F.col("x").alias("y"),
        *(F.col(c).alias(f"y_{c}") for c in ("ids", "times", "keys")),
    )
    # every task gets few tile pairs: they are dealt by their own numbers, not by label
    names = tiles.select("label", "dim", "tile")
    pairs = names.join(names.withColumnRenamed("tile", "tile2"), ["label", "dim"]).where("tile < tile2")
    pairs = pairs.join(one, ["label", "dim", "tile"]).join(
        two, (F.col("label") == F.col("l2")) & (F.col("dim") == F.col("d2")) & (pairs["tile2"] == two["tile2"])
    )
    columns = ["dim", "x", "y", "x_ids", "y_ids", "x_times", "y_times", "x_keys", "y_keys"]
    none = {"y": "binary", "y_ids": "array<long>", "y_times": "array<long>", "y_keys": "array<long>"}
    alone = one.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    work = pairs.select(columns).unionByName(alone.select(columns))
    found = work.mapInArrow(_tile_pairs(threshold, element), "key long, id long, links long, root long")
    found = materialize(found, "found")

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    per_class = classes.join(links, "key", "left").select(
        F.col("label").alias("c_label"),
        F.col("embedding").alias("c_embedding"),
        F.col("vec_id").alias("rep"),
        (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
    )
    mine = rows.where("usable").join(
        per_class, (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("c_embedding"))
    )
    mine = materialize(mine.select("vec_id", "rep", "n_links"), "linked")
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(
        mine.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    )
    every = mine.select("vec_id", "n_links").unionByName(
        rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    )
    out = every.join(components(edges), F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        "n_links",
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
