"""Toxicity by a factorization machine over hashed terms.

A text's terms: its words (lower case, cut at ASCII punctuation, digits and white space) and their
beginnings of ``PREFIXES`` bytes, which catch inflected and compounded words; a term that occurs at least
2 or 4 times is a further term each. Terms are hashed to ``SLOTS`` numbers. With weight w and vector v per term, a text scores

    sigmoid(bias + sum of w + sum over pairs of terms of v . v')

so that two terms can weigh more together than their weights add up to. Learned by mini-batch
AdaGrad on the logistic loss from at most about ``TRAIN_ROWS`` labelled rows (a documented bound;
rows are chosen by a hash of their id, so every class and source is met in proportion).

Labels are noisy and texts have hundreds of terms, so a term's input is not 1 but its relevance
c / (c + DOUBT), c being the chi-square statistic of term and label among these rows. Terms in fewer than
``MIN_ROWS`` of them, or with c below ``LEAST``, carry no weight. The model is at most
SLOTS * (FACTORS + 1) numbers.

Null texts count as empty and get the score of the bias. Of several labels for one id, toxic
wins; null labels say nothing. Without both classes to learn from, every score is their share of toxic rows
(0 without any row).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from techatlas.llm.shared import doc_remainder, forget_other_stages, give_back, tidy, utf8

SLOTS = 1 << 18
FACTORS = 8
TRAIN_ROWS = 12_000
MIN_ROWS = 5
LEAST = 4.0
DOUBT = 30.0
EPOCHS = 20
BATCH = 256
RATE = 0.1
SHRINK = 1e-4
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7, 8)
OFTEN = (2, 4)
WORD_CACHE = 50_000
ROWS_AT_ONCE = 500
_BUCKETS = 1 << 30
_CUT = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


class Slots(dict):
    """Slots of each word seen and of its beginnings; emptied when it holds too many."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= WORD_CACHE:
            self.clear()
        parts = [b"=" + word, *(word[:n] for n in PREFIXES if n < len(word))]
        slots = self[word] = tuple(xxhash.xxh32_intdigest(p) % SLOTS for p in parts)
        return slots


def terms(text: bytes, slots: Slots) -> np.ndarray:
    """Sorted distinct slots of a text in lower case."""
    words = text.translate(_CUT).split()
    found = np.fromiter(chain.from_iterable(map(slots.__getitem__, words)), np.int64)
    found, times = np.unique(found, return_counts=True)
    often = [(found[times >= n] + n * 0x9E3779B1) % SLOTS for n in OFTEN]
    return np.unique(np.concatenate([found, *often]))


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots = Slots()
    for batch in batches:
        found = [terms(t.as_py(), slots) for t in batch["text"]]
        yield pa.record_batch([batch["toxic"], pa.array(found, pa.list_(pa.int64()))], names=["toxic", "terms"])


@dataclass
class Machine:
    """bias, and weight and vector by slot (zero where nothing was learned)."""

    bias: float
    slots: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        lengths = np.array([len(t) for t in texts])
        flat = np.concatenate(texts).astype(np.int64)
        at = np.full(len(flat), -1)
        if len(self.slots):
            place = np.minimum(np.searchsorted(self.slots, flat), len(self.slots) - 1)
            at = np.where(self.slots[place] == flat, place, -1)
        row = np.repeat(np.arange(len(texts)), lengths)[at >= 0]
        at = at[at >= 0]
        y = np.full(len(texts), self.bias) + np.bincount(row, self.weights[at], len(texts))
        for k in range(self.vectors.shape[1]):
            v = self.vectors[at, k]
            y += 0.5 * (np.bincount(row, v, len(texts)) ** 2 - np.bincount(row, v * v, len(texts)))
        return 1 / (1 + np.exp(-np.clip(y, -60, 60)))


def chi_square(both: np.ndarray, with_term: np.ndarray, toxic: float, rows: float) -> np.ndarray:
    """Chi-square of the two-by-two table of term and label."""
    a, b, c = both, with_term - both, toxic - both
    d = rows - a - b - c
    return rows * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)


def fit(texts: list[np.ndarray], toxic: np.ndarray, seed: int = 7) -> Machine:
    """Learns from a bounded list of term lists and labels."""
    empty = np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS))
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return Machine(60.0 if share else -60.0, *empty)
    slots, place, rows = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    labels = np.repeat(toxic, [len(t) for t in texts])
    chi = chi_square(np.bincount(place, labels, len(slots)), rows, toxic.sum(), len(toxic))
    kept = (rows >= MIN_ROWS) & (chi >= LEAST)
    slots, x = slots[kept], (chi / (chi + DOUBT))[kept]
    if not len(slots):
        return Machine(float(np.log(share / (1 - share))), *empty)
    lists = [np.searchsorted(slots, t[np.isin(t, slots, assume_unique=True)]) for t in texts]
    rnd = np.random.default_rng(seed)
    n = len(slots)
    w, v = np.zeros(n), rnd.normal(0, 0.01, (n, FACTORS))
    gw, gv, gb, bias = np.full(n, 1e-3), np.full((n, FACTORS), 1e-3), 1e-3, float(np.log(share / (1 - share)))
    for _ in range(EPOCHS):
        order = rnd.permutation(len(lists))
        for low in range(0, len(order), BATCH):
            part = order[low : low + BATCH]
            lengths = np.array([len(lists[k]) for k in part])
            at = np.concatenate([lists[k] for k in part])
            row = np.repeat(np.arange(len(part)), lengths)
            y = bias + np.bincount(row, x[at] * w[at], len(part))
            sums = np.empty((len(part), FACTORS))
            own = v[at] * x[at, None]
            for k in range(FACTORS):
                sums[:, k] = np.bincount(row, own[:, k], len(part))
                y += 0.5 * (sums[:, k] ** 2 - np.bincount(row, own[:, k] ** 2, len(part)))
            error = 1 / (1 + np.exp(-np.clip(y, -60, 60))) - toxic[part]
            used, back = np.unique(at, return_inverse=True)
            e = error[row] * x[at]
            # the mean over the batch would starve rare terms: AdaGrad scales by each one's own history
            d = np.bincount(back, e, len(used)) + SHRINK * len(part) * w[used]
            gw[used] += d * d
            w[used] -= RATE * d / np.sqrt(gw[used])
            for k in range(FACTORS):
                d = np.bincount(back, e * (sums[row, k] - own[:, k]), len(used)) + SHRINK * len(part) * v[used, k]
                gv[used, k] += d * d
                v[used, k] -= 0.3 * RATE * d / np.sqrt(gv[used, k])
            gb += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(gb)
    return Machine(float(bias), slots, x * w, x[:, None] * v)


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fits on the one partition of the bounded sample; a row per term and one (slot -1) for the bias."""
    texts, labels = [], []
    for batch in batches:
        texts += [t.values.to_numpy(zero_copy_only=False).astype(np.int32) for t in batch["terms"]]
        labels += batch["toxic"].to_pylist()
    m = fit(texts, np.array(labels, np.float64))
    flat = np.concatenate([np.zeros((1, FACTORS)), m.vectors])
    yield pa.record_batch(
        [
            pa.array(np.concatenate([[-1], m.slots]).astype(np.int64)),
            pa.array(np.concatenate([[m.bias], m.weights])),
            pa.array(list(flat), pa.list_(pa.float64())),
        ],
        names=["slot", "weight", "vector"],
    )


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """A machine from docs (doc_id, text) joined with labels (doc_id, toxic) by id."""
    known = labels.where("toxic is not null and doc_id is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("double")).alias("toxic"))
    known = known.where(doc_remainder(F.col("doc_id"), 3) != 1)
    share = min(1.0, rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(_BUCKETS)) < int(_BUCKETS * share))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.lower(F.coalesce("text", F.lit("")))).alias("text"))
    found = texts.join(chosen, "doc_id").select("doc_id", "toxic", "text")
    found = found.mapInArrow(tidy(_term_rows), "toxic double, terms array<long>")
    # a bounded sample: one task may hold it; sorted, so that the model is the same each time
    sample = found.repartition(1).sortWithinPartitions(F.xxhash64("terms", "toxic"), "toxic")
    rows_ = sample.mapInArrow(tidy(_fit_rows), "slot long, weight double, vector array<double>").toArrow()
    slot = np.array(rows_["slot"].to_pylist(), np.int64)
    weight = np.array(rows_["weight"].to_pylist())
    vector = np.array(rows_["vector"].to_pylist()).reshape(len(slot), FACTORS)
    if not len(slot):  # no partition had a row
        return fit([], np.empty(0))
    return Machine(float(weight[0]), slot[1:], weight[1:], vector[1:])


def _score(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, m = Slots(), machine.value
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch["text"].slice(low, ROWS_AT_ONCE).to_pylist()
                scores[low : low + len(part)] = m.scores([terms(t, slots) for t in part])
            yield pa.record_batch([batch["doc_id"], batch["text_hash"], pa.array(scores, pa.float64())], names=["doc_id", "text_hash", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row: doc_id, text_hash, held_out, score, predicted."""
    machine = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, rows))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        utf8(F.lower(F.coalesce("text", F.lit("")))).alias("text"),
    )
    scored = base.mapInArrow(tidy(_score(machine)), "doc_id long, text_hash long, score double")
    return scored.select(
        "doc_id",
        "text_hash",
        (doc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def clean_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs whose score is below the threshold, with the columns of docs."""
    machine = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, rows))

    @F.pandas_udf(DoubleType())
    def toxicity(texts):
        forget_other_stages()
        slots = Slots()
        parts = [texts[k : k + ROWS_AT_ONCE] for k in range(0, len(texts), ROWS_AT_ONCE)]
        scores = [machine.value.scores([terms(t, slots) for t in p]) for p in parts]
        del slots, parts
        give_back()
        return _series(np.concatenate([np.empty(0), *scores]))

    text = utf8(F.lower(F.coalesce(F.col("text"), F.lit(""))))
    return docs.where(toxicity(text) < THRESHOLD)


def _series(values: np.ndarray):
    import pandas as pd

    return pd.Series(values)
