"""Language identification by prediction by partial matching over bytes.

For each language a context tree holds how often each byte followed each context of up to
``ORDER`` bytes. A byte's probability in the longest context that occurs: n / (t + d), where t bytes
of d kinds followed it; with d / (t + d) the coder escapes to the context without its first byte,
from whose distribution the kinds already seen are excluded. Below the empty context all 256
bytes are alike. The trees are frozen after training, so a text's code length in each language is a sum of
fixed numbers, one per (context, byte), and these are tabulated once.

Trees are learned from whole texts (in lower case) of at most about ``TRAIN_ROWS`` rows per language,
chosen by a hash, so the tables don't grow with the corpus. Every text is scored whole.

Null texts and texts without a letter are ``und`` with score 0; with no training rows all are.
The score is the share of the best language if all languages are equally likely beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from techatlas.llm.shared import doc_remainder, utf8

ORDER = 3
TRAIN_ROWS = 2000
BYTES_AT_ONCE = 1 << 19
UNDETERMINED = "und"
_BUCKETS = 1 << 30


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each run of ORDER + 1 bytes occurs, per language; texts begin after zero bytes."""
    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            by.setdefault(lang, []).append(b"\0" * ORDER + text)
        for lang, texts in by.items():
            keys = []
            for text in texts:
                b = np.frombuffer(text, np.uint8).astype(np.int64)
                key = np.zeros(len(b) - ORDER, np.int64)
                for k in range(ORDER + 1):
                    key = key * 256 + b[k : len(b) - ORDER + k]
                keys.append(key)
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.record_batch(
                [pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n.astype(np.int64))],
                names=["lang", "key", "n"],
            )


class Trees:
    """Frozen code lengths of all languages.

    ``symbol``: byte -> column (the last column: bytes never seen). ``state``: columns of the last
    ORDER bytes -> longest known context. ``bits``: (context, column) -> code length per language.
    """

    def __init__(self, languages: list[str], keys: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.languages = languages
        seen = np.unique(np.concatenate([(k >> (8 * p)) & 255 for k in keys for p in range(ORDER + 1)]))
        self.width = len(seen) + 1
        self.symbol = np.full(256, len(seen), np.int64)
        self.symbol[seen] = np.arange(len(seen))
        columns = []
        for key in keys:
            code = np.zeros(len(key), np.int64)
            for p in range(ORDER, -1, -1):
                code = code * self.width + self.symbol[(key >> (8 * p)) & 255]
            columns.append(code)
        # contexts of n bytes, in any language; state 0 is the empty one
        contexts = [np.zeros(1, np.int64)]
        for n in range(1, ORDER + 1):
            contexts.append(np.unique(np.concatenate([c // self.width % self.width**n for c in columns])))
        first = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
        state = np.zeros(1, np.int64)
        for n in range(1, ORDER + 1):
            state = np.tile(state, self.width)  # without the first byte
            state[contexts[n]] = first[n] + np.arange(len(contexts[n]))
        self.state = state.astype(np.int32)
        self.bits = np.empty((first[-1] * self.width, len(languages)), np.float32)
        for k, (code, n) in enumerate(zip(columns, counts, strict=True)):
            self.bits[:, k] = -np.log2(self._tree(code, n, contexts, first)).ravel()

    def _tree(self, code: np.ndarray, n: np.ndarray, contexts: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        p = np.empty((first[-1], self.width))
        for order, known in enumerate(contexts):
            size = self.width ** (order + 1)
            table = np.zeros((len(known), self.width))
            inside = code % size
            at = np.searchsorted(known, inside // self.width)
            np.add.at(table, (at, inside % self.width), n)
            if order == 0:
                lower = np.full((1, self.width), 1 / 256)
            else:
                # the context without its first byte, or the longest known end of it
                lower = p[self._suffix(known, order, contexts, first)]
            total, kinds = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
            left = 1 - (lower * (table > 0)).sum(axis=1, keepdims=True)
            escaped = lower * kinds / np.maximum(total + kinds, 1) / np.maximum(left, 1e-9)
            own = np.where(table > 0, table / np.maximum(total + kinds, 1), escaped)
            p[first[order] : first[order + 1]] = np.where(total > 0, own, lower)
        return np.maximum(p, 1e-30)

    def _suffix(self, known, order: int, contexts, first) -> np.ndarray:
        state = np.zeros(len(known), np.int64)
        for n in range(1, order):
            end = known % self.width**n
            at = np.minimum(np.searchsorted(contexts[n], end), len(contexts[n]) - 1)
            state = np.where(contexts[n][at] == end, first[n] + at, state)
        return state

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits, per text and language."""
        out = np.zeros((len(texts), len(self.languages)))
        stream = np.frombuffer(b"".join(b"\0" * ORDER + t for t in texts), np.uint8)
        starts = np.cumsum([0] + [len(t) + ORDER for t in texts])
        for low in range(0, len(stream), BYTES_AT_ONCE):
            high = min(low + BYTES_AT_ONCE, len(stream))
            begin = max(low - ORDER, 0)
            s = self.symbol[stream[begin:high]]
            context = np.zeros(len(s) - ORDER, np.int64)
            for k in range(ORDER):
                context = context * self.width + s[k : len(s) - ORDER + k]
            bits = self.bits[self.state[context] * np.int64(self.width) + s[ORDER:]]
            offset = begin + ORDER  # of bits[0] in the stream
            one = int(np.searchsorted(starts, offset, "right")) - 1
            two = int(np.searchsorted(starts, high, "left"))
            # cut at texts' padding and at their first bytes, so that padding is left out
            cuts = np.empty(2 * (two - one), np.int64)
            cuts[0::2], cuts[1::2] = starts[one:two], starts[one:two] + ORDER
            cuts = np.clip(cuts - offset, 0, len(bits))
            sums = np.concatenate([np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0, dtype=np.float64)])
            ends = np.append(cuts[2::2], len(bits))
            out[one:two] += sums[ends] - sums[np.minimum(cuts[1::2], ends)]
        return out


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> Trees | None:
    """Trees of all non-null languages of docs (text, lang); None without any."""
    usable = docs.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, int(_BUCKETS * min(1.0, rows / n)))))
    chosen = usable.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(_BUCKETS)) < share[F.col("lang")])
    counts = chosen.select("lang", utf8(F.lower("text")).alias("text")).mapInArrow(_count, "lang string, key long, n long")
    counts = counts.groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    languages, keys, times = [], [], []
    for lang, part in sorted(counts.groupby("lang"), key=lambda x: x[0]):
        part = part.sort_values("key")
        languages.append(lang)
        keys.append(part["key"].to_numpy(np.int64))
        times.append(part["n"].to_numpy(np.int64))
    return Trees(languages, keys, times)


def _score(trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trees.value
        for batch in batches:
            bits = model.lengths(batch["text"].to_pylist())
            best = bits.argmin(axis=1) if len(bits) else np.empty(0, np.int64)
            odds = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)) if len(bits) else bits
            yield pa.record_batch(
                [
                    batch["doc_id"],
                    batch["held_out"],
                    batch["letters"],
                    pa.array([model.languages[k] for k in best], pa.string()),
                    pa.array(1 / odds.sum(axis=1) if len(bits) else [], pa.float64()),
                ],
                names=["doc_id", "held_out", "letters", "lang", "score"],
            )

    return run


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    held_out = doc_remainder(F.col("doc_id"), 3) == 1
    text = F.coalesce("text", F.lit(""))
    trees = learn(docs.select("doc_id", "text", "lang").where(~held_out), rows)
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out.alias("held_out"),
        text.rlike(r"\p{L}").alias("letters"),
        utf8(F.lower(text)).alias("text"),
    )
    if trees is None:
        return base.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    out = base.mapInArrow(
        _score(spark.sparkContext.broadcast(trees)),
        "doc_id long, held_out boolean, letters boolean, lang string, score double",
    )
    return out.select(
        "doc_id",
        "held_out",
        F.when(F.col("letters"), F.col("lang")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
    )
