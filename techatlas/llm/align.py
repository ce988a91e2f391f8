"""Alignment of two tokenizers over every text: lockstep merging of their tokens.

A: a byte-level BPE file (tokens of a space and the text), B: a sentence-piece model (which adds that space itself).
Every token has its bytes: A's entry decoded, B's piece in UTF-8 with U+2581 as a space and <0xHH> as that byte. A text
that is null, empty, or whose joined bytes of either side differ from space and text, has no tokens.

* ``Pair``: tokens of texts. A text is cut before single spaces between characters that are no white space; neither
  tokenizer's tokens cross such a place (A's words begin there, and no piece of B holds a space after another
  character, which is looked at when a model is loaded). A worker tokenizes each part once while it remembers it; its memory is bounded.
* ``merge``: one vector holds the pointers of all lanes (documents, or stretches of long ones between two such places);
  every step emits a link per lane, moves A, B or both on to whichever ends first, notes a cut where both end, and
  drops finished lanes.
* Links are counted over the whole corpus by pair of ids, folded in the tasks before the shuffle. A pair's count meets
  the links in slices of B's ids: a slice holds at most SLICE pairs, so it is bounded whatever the corpus is.

Special tokens' strings in texts are plain text. Rows are aligned as often as they occur; ids may be null.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from techatlas.llm.shared import Known, kept, tidy, utf8
from techatlas.session import materialize

#: The word rule of A's file type: fixed values of the public format.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"
#: Bytes of known parts that a worker keeps; 300 for Python's own needs of each.
MEMORY = 48 << 20
CACHED_LETTERS = 64
#: Longer parts go through the plain library, which copes with any length.
LONG_PART = 2000
TEXT_AT_ONCE = 2 << 20
#: Parts to a lane.
LANE = 128
#: Pairs of ids in one slice.
SLICE = 4_000_000
PAIR_ID = 1 << 16


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in A's file: printable ones for themselves, the others from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    out = {chr(b): b for b in own}
    for k, b in enumerate(b for b in range(256) if b not in set(own)):
        out[chr(256 + k)] = b
    return out


class Pair:
    """Both tokenizers of a Python worker."""

    def __init__(self, a: str, b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(a)
        self.plain.encode_special_tokens = True
        with open(a, encoding="utf-8") as f:
            file = json.load(f)
        letters = _byte_letters()
        vocabulary = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items()}
        special = {t["id"]: t["content"] for t in file.get("added_tokens", [])}
        self.bytes_a = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = token
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in file["model"]["merges"]]
        ordered = all(file["model"]["vocab"].get(m) == 256 + k for k, m in enumerate(merged))
        # where ids are in merge order they are ranks, and the faster library gives the same ids
        self.fast = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=vocabulary, special_tokens={}) if ordered else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)
        ]
        self.parted = not any(SPACE in p.lstrip(SPACE) for p in names)
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int32)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int32)
        self.known = Known(MEMORY, lambda part, found: 300 + 2 * len(part) + len(found[0]) + len(found[1]))

    def parts(self, text: str) -> list[str]:
        """The text without the space before each part."""
        if not self.parted:
            return [text]
        out = text.split(" ")
        odd = [k for k, p in enumerate(out) if not p or p[0].isspace() or p[-1].isspace()]
        if odd:
            # white space beside the space: such parts stay together with their neighbours
            joined, after = [], False
            for k, p in enumerate(out):
                before = not p or p[0].isspace()
                if k and (before or after):
                    joined[-1] += " " + p
                else:
                    joined.append(p)
                after = not p or p[-1].isspace()
            return joined
        return out

    def tokens(self, parts: list[str]) -> dict[str, tuple[bytes, bytes, bool]]:
        """A's and B's ids (32-bit, as bytes), and whether both sides' bytes are those of a space and the part."""
        found = {}
        fast = self.fast.encode_ordinary if self.fast else None
        slow = [p for p in parts if fast is None or len(p) > LONG_PART]
        slow_a = dict(zip(slow, self.plain.encode_batch_fast([" " + p for p in slow], add_special_tokens=False), strict=True))
        for part, b in zip(parts, self.pieces.encode(parts, num_threads=1), strict=True):
            a = slow_a[part].ids if part in slow_a else fast(" " + part)
            own = b" " + part.encode()
            right = b"".join([self.bytes_a[x] for x in a]) == own and b"".join([self.bytes_b[x] for x in b]) == own
            found[part] = array("I", a).tobytes(), array("I", b).tobytes(), right
        return found

    def of(self, texts: list[list[str]]) -> dict[str, tuple[bytes, bytes, bool]]:
        parts = set().union(*texts)
        out = self.known.among(parts)
        new = self.tokens([p for p in parts if p not in out])
        for p, found in new.items():
            if len(p) <= CACHED_LETTERS:
                self.known.put(p, found)
        return out | new


def merge(
    end_a: np.ndarray, end_b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of all lanes, lane after lane: place of A's token, of B's token, and whether both end there.

    ``end_a``, ``end_b``: offsets where the tokens of all lanes end, counted on from lane to lane; ``start_a``,
    ``start_b``: first tokens of the lanes, and the number of tokens at last. Lanes hold the same bytes on both sides.
    """
    out = start_a[:-1] + start_b[:-1]
    size = int(start_a[-1] + start_b[-1])
    link_a, link_b = np.full(size, -1, np.int32), np.empty(size, np.int32)
    cut = np.zeros(size, bool)
    i, j, stop = start_a[:-1].copy(), start_b[:-1].copy(), start_a[1:]
    live = i < stop
    while True:
        if not live.all():
            i, j, out, stop = i[live], j[live], out[live], stop[live]
        if not len(i):
            break
        a, b = end_a[i], end_b[j]
        link_a[out] = i
        link_b[out] = j
        on_a, on_b = a <= b, b <= a
        cut[out] = on_a & on_b
        out += 1
        i += on_a
        j += on_b
        live = i < stop
    real = link_a >= 0
    return link_a[real], link_b[real], cut[real]


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below n as decimal digits, one row each with room for a separator, and how many digits."""
    text = [str(k).encode() for k in range(n)]
    width = len(text[-1]) + 1
    return np.frombuffer(b"".join(t.ljust(width) for t in text), np.uint8).reshape(n, width), np.array([len(t) for t in text])


def written_groups(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, digits) -> tuple[np.ndarray, np.ndarray]:
    """Groups as text, ``a1,a2|b1;`` one after the other, and the end of each group in it.

    ``a``, ``b``: ids; ``last_a``, ``last_b``: place of the last token of every group.
    """
    rows, size = digits
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    begins_b = last_b + 1 - n_b
    ends_a = last_a + 1
    total = len(a) + len(b)
    ids, mark = np.empty(total, np.int32), np.full(total, ord(","), np.uint8)
    place_a = np.arange(len(a)) + np.repeat(begins_b, n_a)
    place_b = np.arange(len(b)) + np.repeat(ends_a, n_b)
    ids[place_a], ids[place_b] = a, b
    mark[place_a[last_a]] = ord("|")
    mark[place_b[last_b]] = ord(";")
    width = size[ids]
    found = rows[ids]
    found[np.arange(total), width] = mark
    text = found[np.arange(rows.shape[1])[None, :] <= width[:, None]]
    return text, np.cumsum(width + 1)[place_b[last_b]]


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("groups_sha256", pa.string()),
        ("pairs", pa.binary()),
        ("cuts", pa.binary()),
    ]
)


def _own_bytes(pair: Pair, found: Sequence[tuple[bytes, bytes, bool]], text: str) -> bool:
    """Whether a text's joined bytes are those of space and text, where some part's are not."""
    own = b" " + text.encode()
    return all(
        b"".join([table[x] for f in found for x in np.frombuffer(f[side], "=u4")]) == own
        for side, table in ((0, pair.bytes_a), (1, pair.bytes_b))
    )


def _aligned(pair: Pair, digits, ids: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
    decoded = [t.decode("utf-8", "replace") if t else "" for t in texts]
    split = [pair.parts(t) if t else [] for t in decoded]
    tokens = pair.of(split)
    side_a, side_b, doc_lanes = [], [], []
    lanes = 0
    sizes_a, sizes_b = [], []
    for raw, text, parts in zip(texts, decoded, split, strict=True):
        found = [tokens[p] for p in parts]
        exact = text.encode() == (raw or b"")
        if not exact or not all(f[2] for f in found):
            # lanes need equal bytes part by part; a text that is equal only as a whole is one lane
            whole = exact and bool(found) and _own_bytes(pair, found, text)
            found = [(b"".join(f[0] for f in found), b"".join(f[1] for f in found), True)] if whole else []
        for k in range(0, len(found), LANE):
            some = found[k : k + LANE]
            a, b = b"".join([f[0] for f in some]), b"".join([f[1] for f in some])
            side_a.append(a)
            side_b.append(b)
            sizes_a.append(len(a) >> 2)
            sizes_b.append(len(b) >> 2)
            lanes += 1
        doc_lanes.append(lanes)
    a, b = np.frombuffer(b"".join(side_a), "=u4").astype(np.int32), np.frombuffer(b"".join(side_b), "=u4").astype(np.int32)
    start_a = np.concatenate([[0], np.cumsum(sizes_a, dtype=np.int64)]).astype(np.int64)
    start_b = np.concatenate([[0], np.cumsum(sizes_b, dtype=np.int64)]).astype(np.int64)
    link_a, link_b, cut = merge(
        np.cumsum(pair.length_a[a], dtype=np.int64), np.cumsum(pair.length_b[b], dtype=np.int64), start_a, start_b
    )
    last_a, last_b = link_a[cut].astype(np.int64), link_b[cut].astype(np.int64)
    # per document: from its lanes to its tokens, links and groups
    bounds = np.concatenate([[0], doc_lanes]).astype(np.int64)
    tokens_a, tokens_b = start_a[bounds], start_b[bounds]
    links = np.searchsorted(link_a, tokens_a)
    groups = np.searchsorted(last_a, tokens_a)
    written, ends = written_groups(a, b, last_a, last_b, digits)
    ends = np.concatenate([[0], ends])
    keys = (b[link_b].astype(np.uint32) * np.uint32(PAIR_ID) + a[link_a].astype(np.uint32)).astype("<u4")
    hashes, pairs, cuts = [], [], []
    for k in range(len(texts)):
        g, h = groups[k], groups[k + 1]
        hashes.append(hashlib.sha256(written[ends[g] : ends[h] - 1]).hexdigest() if h > g else "")
        pairs.append(keys[links[k] : links[k + 1]].tobytes())
        cuts.append(np.packbits(cut[links[k] : links[k + 1]]).tobytes())
    columns = [
        ids,
        pa.array(np.diff(tokens_a)),
        pa.array(np.diff(tokens_b)),
        pa.array(np.diff(groups)),
        pa.array(np.diff(links)),
        pa.array(hashes, pa.string()),
        pa.array(pairs, pa.binary()),
        pa.array(cuts, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def _aligned_rows(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = kept(("align", path_a, path_b), lambda: Pair(path_a, path_b))
        digits = _decimals(max(len(pair.bytes_a), len(pair.bytes_b)))
        for batch in batches:
            sizes = batch["text"].fill_null(b"").to_pandas().str.len().to_numpy()
            at, size = 0, 0
            for k, n in enumerate(sizes):
                size += int(n)
                if size >= TEXT_AT_ONCE or k + 1 == len(sizes):
                    some = batch.slice(at, k + 1 - at)
                    yield _aligned(pair, digits, some["doc_id"], some["text"].to_pylist())
                    at, size = k + 1, 0

    return run


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, cuts.

    ``pairs``: the links in order, 32-bit little-endian numbers B id * 65536 + A id; ``cuts``: a bit for each link,
    set where both tokens end. ``a``, ``b``: paths of the tokenizers' files that every executor can open.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text").cast("string")).alias("text"))
    return rows.mapInArrow(
        tidy(_aligned_rows(a, b)),
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, cuts binary",
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
    for batch in batches:
        own = np.frombuffer(b"".join(batch["pairs"].to_pylist()), "<u4")
        new, n = np.unique(own, return_counts=True)
        both, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
        summed = np.zeros(len(both), np.int64)
        np.add.at(summed, inverse, np.concatenate([counts, n]))
        keys, counts = both, summed
        if len(keys) > SLICE:
            yield _pair_rows(keys, counts)
            keys, counts = keys[:0], counts[:0]
    yield _pair_rows(keys, counts)


def _pair_rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Per pair of ids that is linked anywhere: pair, b_id, a_id, n (links), best (no other A id has more with this B id)."""
    rows = aligned.select("pairs").mapInArrow(tidy(_counted), "pair long, n long")
    n = rows.groupBy("pair").agg(F.sum("n").alias("n"))
    n = materialize(n.withColumn("b_id", F.shiftright("pair", 16)), "pair_counts")
    # A's vocabulary bounds the pairs of a B id, and with it this join
    most = n.groupBy("b_id").agg(F.max("n").alias("most"))
    return n.join(most, "b_id").select(
        "pair", "b_id", F.col("pair").bitwiseAND(PAIR_ID - 1).alias("a_id"), "n", (F.col("n") == F.col("most")).alias("best")
    )


def _slices(counts: DataFrame) -> list[tuple[int, int]]:
    """Ranges of B ids (from, before) with at most SLICE pairs each; one row per B id comes to the driver."""
    out, first, size = [], 0, 0
    for r in counts.groupBy("b_id").count().orderBy("b_id").collect():
        if size and size + r["count"] > SLICE:
            out.append((first, r["b_id"]))
            first, size = r["b_id"], 0
        size += r["count"]
    return [*out, (first, PAIR_ID)]


def _weighed(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, value, best = model.value
        low, high = int(keys[0]), int(keys[-1])
        for batch in batches:
            lists = batch["pairs"].to_pylist()
            own = np.frombuffer(b"".join(lists), "<u4")
            ends = np.concatenate([[0], np.cumsum([len(x) >> 2 for x in lists], dtype=np.int64)])
            at = np.searchsorted(keys, own)
            inside = (own >= low) & (own <= high)
            at[~inside] = 0
            sums = []
            for what in (value, best):
                found = np.where(inside, what[at], 0)
                sums.append(np.diff(np.concatenate([[0], np.cumsum(found, dtype=np.int64)])[ends]))
            yield pa.record_batch([batch["row"], pa.array(sums[0]), pa.array(sums[1])], names=["row", "count_sum", "n_best"])

    return run


def weighed(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """aligned (written, with a number ``row``) and per row n_best and count_sum over its links."""
    spark = aligned.sparkSession
    parts = None
    for low, high in _slices(counts):
        table = counts.where((F.col("b_id") >= low) & (F.col("b_id") < high)).select("pair", "n", "best").toArrow()
        if not table.num_rows:
            continue
        table = table.sort_by("pair")
        model = spark.sparkContext.broadcast(
            (
                table["pair"].to_numpy().astype(np.uint32),
                table["n"].to_numpy().astype(np.int64),
                table["best"].to_numpy().astype(np.int8),
            )
        )
        part = aligned.select("row", "pairs").mapInArrow(tidy(_weighed(model)), "row long, count_sum long, n_best long")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    sums = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.join(sums.hint("merge"), "row")


def alignment(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Per row of docs the figures of ``align`` with n_best and count_sum, without its lists. Runs jobs."""
    rows = align(docs, a, b).drop("cuts").withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "aligned", compression="zstd")
    counts = materialize(pair_counts(rows), "pairs")
    found = weighed(rows, counts)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
