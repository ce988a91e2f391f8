"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words: runs of letters and digits in lower case. A text is contaminated by a benchmark item where
``RUN`` consecutive words of it and of the item agree in all but ``SUBSTITUTIONS`` places. An item of n < RUN
words is found as a whole, in n consecutive words that agree in all but n * SUBSTITUTIONS // RUN places: one for 7 to 12
words, none below, so that an item of one word is found wherever that word stands. An item without words is found nowhere.

``MASKS`` mark which words of a window count (1) and which are ignored (0). They were chosen
so that any RUN words with any SUBSTITUTIONS of them replaced hold a place where one mask meets no
replaced word; so hashing the marked words of every window finds every overlap. Windows of
texts and items with equal hashes are aligned, and the words around the hit are compared in
place. Shorter items have masks of their own length, which ignore every third word in turn, so that one of the three
meets no replaced word; where none may be replaced one mask marks all words. Items of equal words are one while they are searched.

The item side is broadcast up to ``BROADCAST_SEEDS`` seeds (counted first); beyond that it is an
ordinary join. Null and empty texts hold nothing. Rows without an item_id are items too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from techatlas.llm.shared import free_names, grows, split_by
from techatlas.session import materialize

MASKS = ("11101011", "110100111")
RUN = 13
SUBSTITUTIONS = 2
BROADCAST_SEEDS = 2_000_000


def tolerance(n: int) -> int:
    """How many of n words in a row may be replaced."""
    return min(n, RUN) * SUBSTITUTIONS // RUN


def short_masks(n: int) -> list[str]:
    """Masks for whole items of n < RUN words."""
    if not tolerance(n):
        return ["1" * n]
    return ["".join("0" if k % 3 == gone else "1" for k in range(n)) for gone in range(3)]


def words(text: Column) -> Column:
    """Words of a text; an empty list for null."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(plain) > 0, F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def _seed_at(number: int, mask: str) -> Callable[[Column], Column]:
    marked = [i for i, c in enumerate(mask) if c == "1"]
    return lambda at: F.xxhash64(F.lit(number), *(F.get("codes", at + i) for i in marked))


def _seeds(df: DataFrame, masks: list[str]) -> DataFrame:
    """One row per window and mask of the words in ``own``, which is dropped: at (from 0), span, seed.

    Words are hashed once; a window's seed is the hash of its marked words' hashes and the mask's
    number. Only numbers leave the array functions, so that rows stay small.
    """
    keys = [c for c in df.columns if c != "own"]
    df = df.withColumn("n", F.size("own")).withColumn("codes", F.transform("own", lambda w: F.xxhash64(w)))
    lists = []
    for k, mask in enumerate(masks):
        starts = F.sequence(F.lit(0), F.col("n") - len(mask))
        none = F.array().cast("array<long>")
        lists.append(F.when(F.col("n") >= len(mask), F.transform(starts, _seed_at(k, mask))).otherwise(none))
    # a list for each mask, then a row for each window
    rows = df.select(*keys, F.posexplode(F.array(*lists)).alias("mask", "seeds"))
    span = F.get(F.array(*(F.lit(len(mask)) for mask in masks)), F.col("mask"))
    return rows.select(*keys, span.alias("span"), F.posexplode("seeds").alias("at", "seed")).select(*keys, "at", "span", "seed")


def _stretch() -> list[Column]:
    """Of a hit's item only what is compared: ``near``, its words from ``ahead`` (RUN - 1 at most) before the seed on."""
    ahead = F.least(F.lit(RUN - 1), F.col("item_at"))
    near = F.slice("item_words", F.col("item_at") - ahead + 1, ahead + F.col("span") + RUN - 1)
    return [ahead.alias("ahead"), near.alias("near"), F.least(F.lit(RUN), F.size("item_words")).alias("n")]


def _around() -> Column:
    """Which words around a hit are equal, as 1 and 0: up to RUN - 1 words before and after the seed, as far as both texts go."""
    before = F.least(F.col("at"), F.col("ahead"))
    after = F.least(F.size("own") - F.col("at"), F.size("near") - F.col("ahead")) - F.col("span")
    n = before + F.col("span") + after
    mine = F.slice("own", F.col("at") - before + 1, n)
    theirs = F.slice("near", F.col("ahead") - before + 1, n)
    return F.zip_with(mine, theirs, lambda a, b: (a == b).cast("int"))


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        words(F.col("text")).alias("own"),
    )


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps, one row per (doc_id, text_hash, item_id).

    ``matched``: most equal words in a stretch of RUN words (or the whole of a shorter item); ``at``: the
    first seed's position among the text's words; ``seeds``: hits that were verified. Texts of one item_id count together.
    """
    own = benchmark.select("item_id", words(F.col("text")).alias("own")).where(F.size("own") > 0)
    own = own.withColumn("item", F.xxhash64("own"))
    items = own.select("item", "own").dropDuplicates(["item"])
    # the lengths of short items, RUN - 1 at most
    short = sorted(r["n"] for r in items.where(F.size("own") < RUN).select(F.size("own").alias("n")).distinct().collect())
    masks = [*MASKS, *(m for n in short for m in short_masks(n))]
    seeds = _seeds(items.withColumn("words", F.size("own")), masks)
    # a short item is met by masks of its length only
    long = (F.col("words") >= RUN) & F.col("span").isin([len(m) for m in MASKS])
    seeds = seeds.where(long | (F.col("words") == F.col("span")))
    seeds = materialize(seeds.select("seed", "item", F.col("at").alias("item_at")), "seeds")
    known = F.broadcast if seeds.count() <= BROADCAST_SEEDS else grows
    hits = materialize(_seeds(_own(docs), masks).join(known(seeds), "seed").drop("seed"), "hits")

    same = ["doc_id", "text_hash"]
    needed = materialize(hits.select(*same).distinct(), "hit")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    texts, _ = split_by(texts, needed, "text_hash")
    texts = _null_safe(texts, needed, same, "left_semi").dropDuplicates(same)
    texts = texts.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), words(F.col("text")).alias("own"))
    texts = materialize(texts, "texts")
    n, equal = F.col("n"), F.col("equal")
    starts = F.sequence(F.lit(1), F.greatest(F.size(equal) - n + 1, F.lit(1)))
    best = F.array_max(
        F.transform(starts, lambda k: F.aggregate(F.slice(equal, k, n), F.lit(0), lambda x, y: x + y))
    )
    least = n - F.floor(n * SUBSTITUTIONS / RUN).cast("int")
    # hits take little room in files, and with words of their items much in memory
    found = (
        hits.join(known(items.select("item", F.col("own").alias("item_words"))), "item")
        .select("doc_id", "text_hash", "item", "at", "span", *_stretch())
        .join(grows(texts), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))
        .select("doc_id", "text_hash", "item", "at", "n", _around().alias("equal"))
        .select("doc_id", "text_hash", "item", "at", least.alias("least"), best.alias("matched"))
        .where("matched >= least")
    )
    found = found.groupBy("doc_id", "text_hash", "item").agg(
        F.max("matched").alias("matched"), F.min("at").alias("at"), F.count(F.lit(1)).alias("seeds")
    )
    named = found.join(own.select("item", "item_id").distinct(), "item")
    return named.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max("matched").alias("matched"), F.min("at").alias("at"), F.sum("seeds").alias("seeds")
    )


def _null_safe(df: DataFrame, keys: DataFrame, names: list[str], how: str) -> DataFrame:
    """A join with keys that grow with the corpus."""
    k = grows(keys.select(*(F.col(c).alias(f"__key_{c}") for c in names)))
    return df.join(k, [df[c].eqNullSafe(k[f"__key_{c}"]) for c in names], how)


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that overlap with no item, with the columns of docs, whatever their names."""
    name, check = free_names(docs, "id", "hash")
    bad = overlaps(docs, benchmark).select(F.col("doc_id").alias(name), F.col("text_hash").alias(check)).distinct()
    bad = materialize(bad, "contaminated")
    own = docs.withColumn(name, F.col("doc_id").cast("long")).withColumn(check, F.xxhash64("text"))
    maybe, clean = split_by(own, bad, check)
    return clean.unionByName(_null_safe(maybe, bad, [name, check], "left_anti")).select(*docs.columns)
