"""Packing by powers of two.

A document's ids (those of the tokenizer, then the end id) are cut into as many pieces of LENGTH as
go, and the rest into pieces whose lengths are the binary digits of its length, largest first.
Every piece is a sequence of its own: no sequence crosses documents, none needs padding, and
sequences of one length form a bucket (``bucket``: log2 of the length) that is batched together.

The tokenizer's words end at white space, so the ids of a text are those of its white-space-separated parts in a
row. A part of letters before signs has the ids of its letters, then those of its signs, where the tokenizer parts the two.
Letters are encoded many words at once: a tokenizer that marks words' ends tells where each one's ids end. Each Python worker
keeps the ids of the parts and letters it meets most, in MEMORY bytes. Special tokens' strings in a text are ordinary text. Null texts count as empty: the end id alone. Rows are packed as often as they occur.
sequence_id: the task's number and a running number, the same whenever the same files are read.
"""

from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase, punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from techatlas.llm.shared import Known, kept, tidy, utf8

LENGTH = 4096
END = 2
#: Bytes of known parts that a worker keeps during a stage; 130 for Python's own needs of each.
MEMORY = 96 << 20
CACHED_BYTES = 64
TEXT_AT_ONCE = 6 << 20
WORDS_AT_ONCE = 1000
LETTERS_AT_ONCE = 4000
SIGNS = punctuation.replace("'", "")
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


class Ids:
    """Ids of texts, as little-endian unsigned 32-bit numbers; keeps those of frequent parts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known = Known(MEMORY, lambda part, ids: 130 + len(part) + len(ids))
        self.normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        #: whether A-Z count as a-z
        self.folds = self.normal is not None and self.normal.normalize_str(ascii_uppercase) == ascii_lowercase
        #: signs that never share a word with a letter before them; an apostrophe may go with letters after it
        self.signs = b"".join(c.encode() for c in SIGNS if cut is not None and len(cut.pre_tokenize_str(f"a{c}")) == 2)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab() if suffix else {}
        #: of every id, whether a word ends with it
        self.ends = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def is_letters(self, part: bytes) -> bool:
        """Whether the tokenizer sees nothing but letters, and some; it may write one as a letter and a mark."""
        if part.isascii():
            return part.isalpha()
        text = part.decode("utf-8", "replace")
        return text.isalpha() and (self.normal is None or self.normal.normalize_str(text).isalpha())

    def encoded(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of any parts."""
        out = {}
        for k in range(0, len(parts), WORDS_AT_ONCE):
            some = parts[k : k + WORDS_AT_ONCE]
            found = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in some], add_special_tokens=False)
            for part, e in zip(some, found, strict=True):
                out[part] = _bytes(e.ids)
        return out

    def encoded_letters(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of parts that hold nothing but letters."""
        if not len(self.ends):
            return self.encoded(parts)
        out = {}
        for k in range(0, len(parts), LETTERS_AT_ONCE):
            some = parts[k : k + LETTERS_AT_ONCE]
            (found,) = self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)
            raw = _bytes(found.ids)
            stops = 4 * np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 4
            if len(stops) != len(some):  # not one word each
                out |= self.encoded(some)
                continue
            stops = stops.tolist()
            out |= {p: raw[a:b] for p, a, b in zip(some, [0, *stops], stops, strict=False)}
        return out

    def remembered(self, parts: Iterable[bytes], encode: Callable[[list[bytes]], dict[bytes, bytes]]) -> dict[bytes, bytes]:
        """Ids of parts, of those that are not known by ``encode``."""
        ids = self.known.among(parts)
        new = encode([p for p in parts if p not in ids])
        for p, i in new.items():
            if len(p) <= CACHED_BYTES:
                self.known.put(p, i)
        return ids | new

    def documents(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, with the end id."""
        split = [t.split() for t in texts]
        parts = set().union(*split)
        ids = self.known.among(parts)
        whole, letters, cut = [], set(), []
        for p in parts:
            if p not in ids:
                a = p.rstrip(self.signs)
                if not self.is_letters(a):
                    whole.append(p)
                    continue
                own = a.lower() if self.folds else a
                letters.add(own)
                if own != p:
                    cut.append((p, own, p[len(a) :]))
        ids |= self.remembered(whole, self.encoded)
        ids |= self.remembered(letters, self.encoded_letters)
        signs = self.remembered({b for _, _, b in cut}, self.encoded)
        for p, own, b in cut:
            ids[p] = ids[own] + signs[b]
        end = np.array([END], "<u4").tobytes()
        return [b"".join(map(ids.__getitem__, s)) + end for s in split]


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()


def lengths(n: int, longest: int) -> list[int]:
    """Powers of two that add up to n, none over ``longest`` (a power of two), descending."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _grouped(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t or b"")
        size += len(held[-1])
        if size >= TEXT_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _pieces(path: str, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = kept(("packing", path), lambda: Ids(path))
        sequence = TaskContext.get().partitionId() << 33
        for batch in batches:
            at = 0
            for group in _grouped(batch["text"].to_pylist()):
                rows, starts, sizes, totals, values = [], [], [], [], []
                for own in ids.documents(group):
                    n, start = len(own) // 4, 0
                    for size in lengths(n, longest):
                        rows.append(at)
                        starts.append(start)
                        sizes.append(size)
                        totals.append(n)
                        values.append(own[4 * start : 4 * (start + size)])
                        start += size
                    at += 1
                yield pa.record_batch(
                    [
                        batch["doc_id"].take(pa.array(rows, pa.int64())),
                        pa.array(starts, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(totals, pa.int64()),
                        pa.array(np.arange(sequence, sequence + len(rows))),
                        pa.array(values, pa.binary()),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "ids"],
                )
                sequence += len(rows)

    return run


def pack(docs: DataFrame, tokenizer: str, longest: int = LENGTH) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, sequence_id, offset (0), bucket, ids.

    ``tokenizer``: path of a tokenizer file that every executor can open. ``ids``: bytes of
    little-endian unsigned 32-bit numbers.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    pieces = rows.mapInArrow(
        tidy(_pieces(tokenizer, longest)),
        "doc_id long, start long, length long, doc_tokens long, sequence_id long, ids binary",
    )
    return pieces.withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", F.log2("length").cast("int"))


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per sequence length."""
    pieces.write.partitionBy("bucket").parquet(path)
