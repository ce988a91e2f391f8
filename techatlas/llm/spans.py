"""Substring dedup on sliding sentence spans.

A text is cut into sentences: after ``.``, ``!`` or ``?`` before white space, and at line ends;
sentences of over ``LONGEST`` words are cut at places that depend on the words nearby (``_cuts``), so that equal passages are cut alike whatever stands before them. Where ``RUN`` sentences have under ``LEAST_WORDS`` words, they and
their like beside them are joined to longer ones by the same rule, so that no run is too short. Every run of ``RUN`` consecutive sentences
with at least ``LEAST_WORDS`` words is hashed (128 bits; A-Z in lower case, white space as one blank); a text of fewer
than ``RUN`` sentences is one run, so that its copies are found too.
Of each hash the occurrence with the smallest (doc_id, hash of the text, sentence number) is the
first; sentences covered by any other occurrence, in the same or another text, are removed.
A repeated passage of 2 * LONGEST + 1 words or more that begins and ends at sentence ends always
holds a run. One from the middle of a longer sentence is cut alike but for some words at either end:
of 3,000 passages of 50 random words without a full stop, set between other words twice, all held a
common run, and 83 % of their words lay in one.

Rows equal in doc_id and text are one document: they lose the same sentences. A null doc_id is
smaller than all others. Null and empty texts stay as they are; a text that loses every sentence
becomes empty, its row stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from techatlas.llm.shared import free_names, grows, split_by, tidy, utf8
from techatlas.session import materialize

RUN = 3
LEAST_WORDS = 10
LONGEST = 24
SHORTEST = 4
NEAR = 2
NEVER = 1 << 64
_END = re.compile(rb"[.!?]+(?=[\x20\x09-\x0D])|\n")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cuts(marks: list[int]) -> list[int]:
    """Numbers of words after which a range is cut; marks: hash of each place, NEVER where it can't be cut.

    Cuts are places with the smallest hash among those up to NEAR words away, so they depend on the words
    around them alone. Equal hashes are cut at SHORTEST words at least; pieces never exceed LONGEST words.
    """
    cuts, last = [0], 0
    for k, mark in enumerate(marks):
        if k + 1 - cuts[-1] > LONGEST:
            cuts.append(last)
        if mark == NEVER or k + 1 == len(marks):
            continue
        last = k + 1
        if last - cuts[-1] >= SHORTEST and mark <= min(marks[max(0, k - NEAR) : k + NEAR + 1]):
            cuts.append(last)
    if len(cuts) > 1 and len(marks) - cuts[-1] < SHORTEST and len(marks) - cuts[-2] <= LONGEST:
        cuts.pop()
    return cuts[1:]


def _thin(words: list[int]) -> list[bool]:
    """Which sentences lie in RUN consecutive ones of under LEAST_WORDS words, from the words of each."""
    thin = [False] * len(words)
    for i in range(len(words) - RUN + 1):
        if sum(words[i : i + RUN]) < LEAST_WORDS:
            thin[i : i + RUN] = [True] * RUN
    return thin


def sentences(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the sentences that hold a word; together with the white space between them they are the text."""
    pieces = []
    low = 0
    for high in [*(m.end() for m in _END.finditer(text)), len(text)]:
        part = text[low:high]
        n = len(part.split())
        if n > LONGEST:
            begins = [m.start() for m in _WORD.finditer(part)]
            ends = _cuts([xxhash.xxh3_64_intdigest(w) for w in part.lower().split()])
            cuts = [low, *(low + begins[k] for k in ends), high]
            pieces += zip(cuts, cuts[1:], (b - a for a, b in pairwise([0, *ends, n])), strict=False)
            low = high
        elif n:
            pieces.append((low, high, n))
            low = high
        # a range without words goes with the next sentence
    out = []
    for thin, group in groupby(zip(pieces, _thin([n for _, _, n in pieces]), strict=True), lambda x: x[1]):
        ranges = [r for r, _ in group]
        if thin:
            marks, ends = [], {}
            for a, b, n in ranges:
                marks += [NEVER] * (n - 1)
                marks.append(xxhash.xxh3_64_intdigest(b" ".join(text[a:b].lower().split())))
                ends[len(marks)] = b
            cuts = [ranges[0][0], *(ends[k] for k in _cuts(marks)), ranges[-1][1]]
            out += pairwise(cuts)
        else:
            out += [(a, b) for a, b, _ in ranges]
    return out


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, numbers, sizes, hashes = [], [], [], []
        for k, text in enumerate(batch["text"]):
            text = text.as_py()
            if not text:
                continue
            own = [text[a:b].lower().split() for a, b in sentences(text)]
            size = min(RUN, len(own))
            for i in range(len(own) - size + 1):
                if sum(map(len, own[i : i + size])) >= LEAST_WORDS:
                    rows.append(k)
                    numbers.append(i)
                    sizes.append(size)
                    hashes.append(xxhash.xxh3_128_digest(b" ".join(w for s in own[i : i + RUN] for w in s)))
        at = pa.array(rows, pa.int64())
        yield pa.record_batch(
            [
                batch["doc_id"].take(at),
                batch["text_hash"].take(at),
                pa.array(numbers, pa.int32()),
                pa.array(sizes, pa.int32()),
                pa.array(hashes, pa.binary()),
            ],
            names=["doc_id", "text_hash", "sentence", "size", "span"],
        )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        utf8(F.col("text")).alias("text"),
    )


def repeated(docs: DataFrame) -> DataFrame:
    """All non-first occurrences of repeated runs: doc_id, text_hash, sentence, size (of the run), first_doc_id, first_sentence.

    Only hashes that occur more than once are joined back; a frequent one is counted before the
    shuffle, and its many occurrences are split by the adaptive skew join.
    """
    spans = _keyed(docs).mapInArrow(tidy(_span_rows), "doc_id long, text_hash long, sentence int, size int, span binary")
    spans = materialize(spans, "spans")
    place = F.struct("doc_id", "text_hash", "sentence")
    first = spans.groupBy("span").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    first = materialize(first.where("n > 1").select("span", "first"), "repeated")
    again = spans.join(grows(first), "span").where(~place.eqNullSafe(F.col("first")))
    return again.select(
        "doc_id",
        "text_hash",
        "sentence",
        "size",
        F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.sentence").alias("first_sentence"),
    )


def covered(docs: DataFrame) -> DataFrame:
    """Per document that loses sentences: doc_id, text_hash, removed (their numbers, ascending), first_doc_ids."""
    again = repeated(docs).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("sentence", "size")).alias("runs"), F.array_sort(F.collect_set("first_doc_id")).alias("first_doc_ids")
    )
    each = F.flatten(F.transform("runs", lambda r: F.sequence(r["sentence"], r["sentence"] + r["size"] - 1)))
    return again.select("doc_id", "text_hash", F.array_sort(F.array_distinct(each)).alias("removed"), "first_doc_ids")


def without(text: bytes, removed: np.ndarray | list[int]) -> bytes:
    """A text without some of its sentences."""
    gone = set(removed)
    return b"".join(text[a:b] for k, (a, b) in enumerate(sentences(text)) if k not in gone).strip()


@F.pandas_udf(StringType())
def _without(texts, removed):
    import pandas as pd

    out = [without(t, r).decode("utf-8", "replace") for t, r in zip(texts, removed, strict=True)]
    return pd.Series(out, dtype=object)


def changed(docs: DataFrame) -> DataFrame:
    """Documents that lose sentences: doc_id, text_hash, removed, first_doc_ids, text (what is left)."""
    cut = covered(docs)
    cut = materialize(cut, "covered")
    texts, _ = split_by(_keyed(docs), cut, "text_hash")
    keys = cut.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "removed", "first_doc_ids")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("text_hash").eqNullSafe(F.col("__hash"))
    joined = texts.dropDuplicates(["doc_id", "text_hash"]).join(grows(keys), same)
    return joined.select("doc_id", "text_hash", "removed", "first_doc_ids", _without("text", "removed").alias("text"))


def cut_rows(docs: DataFrame) -> DataFrame:
    """All rows of docs, repeated passages cut from the texts; columns as in docs, n_chars (if any) counted anew."""
    name, check, removed = free_names(docs, "id", "hash", "removed")
    cut = materialize(covered(docs), "covered")
    cut = cut.select(F.col("doc_id").alias(name), F.col("text_hash").alias(check), F.col("removed").alias(removed))
    own = docs.withColumn(check, F.xxhash64("text"))
    maybe, same = split_by(own, cut, check)
    keys = grows(cut)
    equal = maybe[check].eqNullSafe(keys[check]) & maybe["doc_id"].cast("long").eqNullSafe(keys[name])
    joined = maybe.join(keys, equal, "left").drop(keys[check])
    kept = same.select(*docs.columns).unionByName(joined.where(F.col(removed).isNull()).select(*docs.columns))
    less = joined.where(F.col(removed).isNotNull()).withColumn("text", _without(utf8(F.col("text")), F.col(removed)))
    if "n_chars" in docs.columns:
        less = less.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.unionByName(less.select(*docs.columns))
