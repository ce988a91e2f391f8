"""Helpers of the operators: whitespace words, connected components, gapless numbering, memory of workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from techatlas.session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space (0x09-0x0D, 0x20), A-Z in lower case; none for null."""
    return text.lower().split() if text else []


def utf8(text: Column) -> Column:
    """The text's UTF-8 bytes, for Python tasks that work on bytes."""
    return text.cast("binary")


def doc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def give_back() -> None:
    """Return memory that this process has freed, but still holds, to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not everywhere
    if trim:
        trim(0)


_kept: dict = {}
_stage: list = [None]


def forget_other_stages() -> None:
    """Drop what this worker has kept for another stage."""
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if _stage[0] != stage:
        _stage[0] = stage
        _kept.clear()
        give_back()


def kept(key, make: Callable):
    """An object that this worker makes once a stage; its tasks share it."""
    forget_other_stages()
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for ``mapInArrow``, with memory given back at the end of each task: workers serve many tasks and stages."""

    def wrapped(batches: Iterator) -> Iterator:
        forget_other_stages()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


class Known:
    """What a worker remembers of things met before: values by key, in at most ``limit`` bytes.

    Two generations: new keys go into the young one; when it is half the limit the old one is dropped and the
    young one takes its place. Keys that come back move to the young one, so frequent ones stay.
    ``size``: bytes that a key and its value take.
    """

    def __init__(self, limit: int, size: Callable) -> None:
        self.limit, self.size = limit, size
        self.young, self.old, self.held = {}, {}, 0

    def put(self, key, value) -> None:
        if self.held > self.limit // 2:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[key] = value
        self.held += self.size(key, value)

    def among(self, keys) -> dict:
        """Those of keys that are known, with their values."""
        young, old = self.young, self.old
        found = {k: young[k] for k in keys if k in young}
        again = [k for k in keys if k in old and k not in found]
        for k in again:
            found[k] = old[k]
        for k in again:
            self.put(k, found[k])
        return found


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, behind more underscores than any column of df begins with: none of them clashes."""
    most = max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0)
    return ["_" * (most + 1) + n for n in names]


def grows(df: DataFrame) -> DataFrame:
    """df as one side of a join, where both sides grow with the corpus: neither is ever broadcast.

    Spark sizes what it has not shuffled by the files below, and files hold columns that repeat in a hundredth of
    their memory, arrays that an explode turns into many rows, and rows that a join before this one has widened.
    """
    return df.hint("merge")


#: Buckets of the filter that spares rows a shuffle.
FILTER_BUCKETS = 1 << 20


def split_by(df: DataFrame, keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """df in two: rows whose value of ``name`` may be among those of keys, and rows for which it can't.

    Values are hashed into FILTER_BUCKETS buckets and those that keys use are broadcast, so at most
    FILTER_BUCKETS numbers whatever the size of keys. Wide rows that need no join are not shuffled; with very
    many keys the first part is most of df, and still right.
    """
    used = keys.select(F.pmod(F.xxhash64(F.col(name)), F.lit(FILTER_BUCKETS)).alias("__bucket")).distinct()
    same = F.pmod(F.xxhash64(df[name]), F.lit(FILTER_BUCKETS)) == used["__bucket"]
    return df.join(F.broadcast(used), same, "left_semi"), df.join(F.broadcast(used), same, "left_anti")


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest id reachable from each id that occurs in an edge: (id, component).

    Alternating large-star and small-star steps: every step replaces the edges of a vertex by
    edges to its smallest neighbour, and the number of edges never grows. A step costs one
    min per vertex (combined before the shuffle) and one equi-join. Each round is written to
    the shared folder, so a lost executor repeats one round at most. Ends when a round changes
    nothing; only a count and a checksum come to the driver. Null ends and loops are ignored.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .where("u <> v")
        .distinct()
    )
    e = materialize(e, "edges")
    seen = _signature(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(grows(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(grows(low), "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("p")
        )
        e = materialize(small.select("p.u", "p.v").where("u <> v").distinct(), "edges")
        now = _signature(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def numbered(df: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: numbers 0, 1, 2 … without gaps within each group, in no promised order.

    A group may hold any share of all rows: rows are numbered within the piece of the group that
    lies in one written partition, and pieces are offset by the small table of their sizes. The
    rows are written first, so that numbers and sizes refer to the same partitions.
    """
    keys = list(group)
    rows = materialize(
        df.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "rows"
    )
    sizes = rows.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(
        Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = sizes.select(*keys, "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__row"))
    joined = rows.withColumn("__local", local).join(sizes, [*keys, "__part"])
    return joined.withColumn(name, (F.col("__before") + F.col("__local") - 1).cast("long")).select(*df.columns, name)
