"""N-gram language model as a weighted backoff automaton.

Tokens of a text: its whitespace words (A-Z in lower case), then one end token. States and arcs are all n-grams
that occur twice in the training rows, whatever the size of the corpus. A state's failure arc leads to the state of
its words but the first, at the price of the backoff weight. A text is read once from left to right: from the current
state follow the arc of the next word, or failure arcs until there is one; log-probabilities add up on the way.

Probabilities: words as in the base score, (c + ADD) / (N + ADD * (V + 1)); longer n-grams by
absolute discounting, the rest of the mass going to the shorter context, so that every state's
probabilities sum to 1.

The model is never gathered. Texts are dealt into blocks of about ``BLOCK_TOKENS`` tokens; longer texts go on in the next
block, after the words that their state depends on. For every order a block names its distinct n-grams once, with their
counts in its training texts. Keys travel in ranges: a row holds, sorted and packed, all keys of a block in one range. A range
is summed by one task and answered to each block in the order of its keys; ranges grow in number with the blocks. An n-gram is named only where both shorter n-grams in it occur twice, which loses
none. Weights travel the same way: of all blocks that hold an n-gram the first adds its probability to its
context. Then each block holds the part of the automaton that its texts can meet, and is walked alone. N-grams are
keyed by 64-bit hashes; two with one hash, as unlikely as that is, would count as one. A key has at most one row per block, so no key is hot.

Null texts count as empty: one end token. Rows without doc_id are held out. Repeated rows are
scored, and trained on, once each. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from techatlas.llm.shared import doc_remainder, tidy, utf8, words_of
from techatlas.session import discard, materialize, shuffles_released

ADD = 0.1
DISCOUNT = 0.5
END, START = 0, 1
#: Stand for the two marks among words; no word holds a space.
MARKS = (b" end", b" start")
BLOCK_TOKENS = 1_500_000
#: Bytes of a text that are split into words at once.
TEXT_BYTES = 1 << 20
#: Tokens whose n-grams make up a range of keys.
RANGE_TOKENS = 4_000_000
#: Tokens that one lane of the traversal reads.
STRETCH = 1024
#: Blocks are wide rows: each has a row group of its own.
WRITER = {"compression": "zstd", "parquet.block.row.count.limit": "1"}
BLOCK = (
    "block long, words binary, ids binary, rows array<long>, doc_ids array<long>, held_out array<boolean>, "
    "sizes array<int>, warm array<int>, train long, types long, ends long, counts array<binary>, own array<binary>, "
    "weights array<binary>"
)
_ZSTD = pa.Codec("zstd")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, about TEXT_BYTES at a time."""
    if text is None:
        return
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + TEXT_BYTES)
        end = space.end() if space else len(text)
        yield words_of(text[at:end])
        at = end


def _packed(values: np.ndarray) -> bytes:
    """An array's bytes, those of equal place side by side and compressed, after their number."""
    raw = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unpacked(packed: bytes, dtype) -> np.ndarray:
    size, dtype = int.from_bytes(packed[:8], "little"), np.dtype(dtype)
    raw = np.frombuffer(_ZSTD.decompress(packed[8:], size, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted and once each; ``np.unique`` of values alone hashes them, which takes many times as long."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def _mixed(keys: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Keys of n-grams from those of their first n - 1 words and the hashes of their last words."""
    x = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + last * np.uint64(0xD6E8FEB86659FD93)
    x += np.uint64(n)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class _Dealt:
    """A block while texts are dealt to it."""

    def __init__(self, number: int) -> None:
        self.number = number
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        for mark in MARKS:
            self.words[mark]
        self.ids: list[np.ndarray] = []
        self.pieces: list[tuple] = []
        self.tokens = 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.words.__getitem__
        return np.fromiter(map(get, words), np.int32, len(words))

    def add(self, row: int, doc_id, held_out: bool, parts: list[np.ndarray], warm: int) -> None:
        ids = np.concatenate(parts)
        self.ids.append(ids)
        self.pieces.append((row, doc_id, held_out, len(ids), warm))
        self.tokens += len(ids)

    def batch(self) -> pa.RecordBatch:
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], np.uint64)
        row, doc_id, held_out, size, warm = zip(*self.pieces, strict=True)
        values = {
            "block": self.number,
            "words": _packed(hashes),
            "ids": _packed(np.concatenate(self.ids).astype("<i4")),
            "rows": row,
            "doc_ids": doc_id,
            "held_out": held_out,
            "sizes": size,
            "warm": warm,
        }
        return _row(values | {"train": 0, "types": 0, "ends": 0, "counts": [], "own": [], "weights": []})


_LISTS = {"rows": pa.int64(), "doc_ids": pa.int64(), "held_out": pa.bool_(), "sizes": pa.int32(), "warm": pa.int32()}
_TYPES = {"words": pa.binary(), "ids": pa.binary()} | {k: pa.list_(t) for k, t in _LISTS.items()}
_TYPES |= {k: pa.list_(pa.binary()) for k in ("counts", "own", "weights")}


def _row(values: dict) -> pa.RecordBatch:
    """One row of the table of blocks."""
    names = [part.split()[0] for part in BLOCK.split(", ")]
    return pa.record_batch([pa.array([values[k]], _TYPES.get(k, pa.int64())) for k in names], names=names)


def _deal(order: int):
    """Texts to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = number = TaskContext.get().partitionId() << 33
        block = _Dealt(number)
        for batch in batches:
            for doc_id, held_out, text in zip(*(batch[k] for k in ("doc_id", "held_out", "text")), strict=True):
                own = row, doc_id.as_py(), held_out.as_py()
                parts, warm, n = [block.numbers([MARKS[START]])], 1, 1
                before = [MARKS[START]]
                for words in _word_lists(text.as_py()):
                    parts.append(block.numbers(words))
                    n += len(words)
                    before = [*before, *words[-order:]][-(order - 1) :] if order > 1 else []
                    if block.tokens + n >= BLOCK_TOKENS:
                        block.add(*own, parts, warm)
                        yield block.batch()
                        number += 1
                        block = _Dealt(number)
                        # a state depends on the last order - 1 words
                        parts, warm, n = [block.numbers(before)], len(before), len(before)
                block.add(*own, [*parts, np.array([END], np.int32)], warm)
                row += 1
                if block.tokens >= BLOCK_TOKENS:
                    yield block.batch()
                    number += 1
                    block = _Dealt(number)
        if block.pieces:
            yield block.batch()

    return tidy(run)


class Grams:
    """The distinct n-grams of one order in a block, sorted by key; what costs more than a sort is made when asked for."""

    counts: np.ndarray | None = None
    own: np.ndarray | None = None

    def __init__(self, values: np.ndarray, ends: np.ndarray, tokens: int) -> None:
        self.values, self.ends, self.tokens = values, ends, tokens

    @cached_property
    def _all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.unique(self.values, return_index=True, return_inverse=True)

    @cached_property
    def keys(self) -> np.ndarray:
        return self._all[0] if "_all" in self.__dict__ else _distinct(self.values)

    @cached_property
    def first(self) -> np.ndarray:
        """A token where each n-gram ends."""
        return self.ends[self._all[1]]

    @cached_property
    def place(self) -> np.ndarray:
        """Of every token: the n-gram that ends there, or -1."""
        place = np.full(self.tokens, -1, np.int32)
        place[self.ends] = self._all[2]
        return place

    def times(self, tokens: np.ndarray) -> np.ndarray:
        """How often each n-gram ends at a marked token."""
        keys, n = np.unique(self.values[tokens[self.ends]], return_counts=True)
        out = np.zeros(len(self.keys), np.int64)
        out[np.searchsorted(self.keys, keys)] = n
        return out


class Words(Grams):
    """The words of a block, by number."""

    def __init__(self, words: np.ndarray, ids: np.ndarray) -> None:
        self.keys, self.place = words, ids

    def times(self, tokens: np.ndarray) -> np.ndarray:
        return np.bincount(self.place[tokens], minlength=len(self.keys))


class Block:
    """Texts of a block and what is known of their n-grams, up to the order that has no counts yet or to ``upto``."""

    def __init__(self, row: dict, order: int, least: float = 2.0, upto: int | None = None) -> None:
        self.row, self.order, self.least = row, order, least
        self.words = _unpacked(row["words"], "<u8")
        self.ids = _unpacked(row["ids"], "<i4")
        self.sizes, self.warm = (np.array(row[k], np.int64) for k in ("sizes", "warm"))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.at = (np.arange(len(self.ids)) - np.repeat(self.begins, self.sizes)).astype(np.int32)
        self.scored = self.at >= np.repeat(self.warm, self.sizes)
        self.grams: list[Grams] = [Words(self.words, self.ids)]
        known = len(row["counts"])
        self._known(0, known)
        hashes = keys = self.words[self.ids]
        for n in range(2, min(order, known + 1, upto or order) + 1):
            longer = np.zeros_like(keys)
            longer[1:] = _mixed(keys[:-1], hashes[1:], n)
            keys = longer
            kept = self.kept(n - 1)
            ends = np.flatnonzero(kept[1:] & kept[:-1] & (self.at[1:] >= n - 1)) + 1
            self.grams.append(Grams(keys[ends], ends, len(self.ids)))
            self._known(n - 1, known)

    def _known(self, k: int, known: int) -> None:
        if k < known:
            self.grams[k].counts = _unpacked(self.row["counts"][k], "<i8")
            self.grams[k].own = _unpacked(self.row["own"][k], bool)

    def kept(self, n: int) -> np.ndarray:
        """Of every token: whether the n words that end there are a state or an arc; a text's start always is."""
        g = self.grams[n - 1]
        kept = np.append(g.counts >= self.least, False)
        if n == 1:
            kept[START] = True
        return kept[g.place]

    def train(self) -> np.ndarray:
        """Of every token: whether it counts."""
        return self.scored & ~np.repeat(np.array(self.row["held_out"], bool), self.sizes)

    def count(self, n: int, tokens: np.ndarray) -> np.ndarray:
        """Counts of the n words that end at some tokens."""
        g = self.grams[n - 1]
        return g.counts[g.place[tokens]]

    def named(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the n-grams without counts yet, and their counts in the block's training texts."""
        g, by = self.grams[-1], self._sorted()
        return g.keys[by], g.times(self.train())[by]

    def _sorted(self):
        """The n-grams without counts yet, sorted by key; a text's start is no word."""
        if len(self.grams) > 1:
            return slice(None)
        by = np.argsort(self.words, kind="stable")
        return by[by != START]

    def filled(self, counts: np.ndarray, own: np.ndarray, ends: int) -> dict:
        """The row, with the counts of one more order, as they come for the keys of ``named``."""
        g, by = self.grams[-1], self._sorted()
        got, mine = np.zeros(len(g.keys), np.int64), np.zeros(len(g.keys), bool)
        got[by], mine[by] = counts, own
        row = dict(self.row)
        if len(self.grams) == 1:
            train = self.train()
            row["train"], row["types"] = int(train.sum()), int(mine.sum())
            row["ends"] = int((self.ids[train] == END).sum())
        elif len(self.grams) == 2:
            # as often as a text begins
            started = self.grams[0].counts.copy()
            started[START] = ends
            row["counts"] = [_packed(started)]
        row["counts"] = [*row["counts"], _packed(got)]
        row["own"] = [*row["own"], _packed(mine)]
        return row

    def masses(self, norm: float) -> Iterator[tuple[np.ndarray, ...]]:
        """Per order of contexts: keys, probability of own arcs, the same in the shorter context, whether a text falls back."""
        for n in range(2, self.order + 1):
            g, heads = self.grams[n - 1], self.grams[n - 2]
            ends = g.first[(g.counts >= self.least) & g.own]
            p = (self.count(n, ends) - DISCOUNT) / self.count(n - 1, ends - 1)
            if n == 2:
                lower = (self.count(1, ends) + ADD) / norm
            else:
                lower = (self.count(n - 1, ends) - DISCOUNT) / self.count(n - 2, ends - 1)
            head = heads.place[ends - 1]
            mass, low = (np.bincount(head, x, len(heads.keys)).astype(np.float64) for x in (p, lower))
            kept = self.kept(n - 1)
            falls = np.flatnonzero(kept[:-1] & (self.at[1:] >= n - 1) & ~self.kept(n)[1:])
            needs = np.zeros(len(heads.keys), bool)
            needs[heads.place[falls]] = True
            some = needs | (mass > 0)
            yield heads.keys[some], mass[some], low[some], needs[some]

    def weighted(self, keys: np.ndarray, weights: np.ndarray) -> dict:
        """The row, with the backoff weights of all contexts that have any."""
        out = []
        for g in self.grams[: self.order - 1]:
            own = np.zeros(len(g.keys))
            at, there = _places(g.keys, keys)
            own[at[there]] = weights[there]
            out.append(_packed(own))
        return {**self.row, "weights": out}


def _places(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in an array, and whether it is there."""
    by = np.argsort(known, kind="stable")
    at = by[np.minimum(np.searchsorted(known, keys, sorter=by), max(len(known) - 1, 0))] if len(known) else np.zeros(len(keys), np.int64)
    return at, known[at] == keys if len(known) else np.zeros(len(keys), bool)


class Automaton:
    """The states and arcs that the texts of a block can meet. State 0 has no words."""

    def __init__(self, block: Block, norm: float) -> None:
        self.block = block
        self.width = len(block.words)
        order, grams, ids, least = block.order, block.grams, block.ids, block.least
        single = np.log10((grams[0].counts + ADD) / norm)
        single[START] = 0.0  # read, not scored
        # states: the words and n-grams shorter than the order
        base, states = [], 1
        for g in grams[: order - 1]:
            base.append(states)
            states += len(g.keys)

        def state(n: int, tokens: np.ndarray) -> np.ndarray:
            return base[n - 1] + grams[n - 1].place[tokens].astype(np.int64)

        self.fail = np.zeros(states, np.int64)
        self.weight = np.zeros(states)
        self.root = single
        self.root_to = np.zeros(self.width, np.int64)
        if order > 1:
            kept = (grams[0].counts >= least) | (np.arange(self.width) == START)
            self.root_to[kept] = base[0] + np.flatnonzero(kept)
        froms, tos, logs = [], [], []
        for n in range(2, order + 1):
            g = grams[n - 1]
            ends = g.first[g.counts >= least]
            froms.append(state(n - 1, ends - 1) * self.width + ids[ends])
            tos.append(state(n if n < order else n - 1, ends))
            logs.append(np.log10((block.count(n, ends) - DISCOUNT) / block.count(n - 1, ends - 1)))
            self.weight[base[n - 2] : base[n - 2] + len(grams[n - 2].keys)] = _unpacked(block.row["weights"][n - 2], "<f8")
            if n < order:
                self.fail[state(n, ends)] = state(n - 1, ends)
        arcs = np.concatenate([np.zeros(0, np.int64), *froms])
        by = np.argsort(arcs)
        self.arcs = arcs[by]
        self.to = np.concatenate([np.zeros(0, np.int64), *tos])[by]
        self.log = np.concatenate([np.zeros(0), *logs])[by]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state and log-probability of a word, for many texts at once."""
        to, log = np.empty_like(state), np.zeros(len(state))
        left, at, w = np.arange(len(state)), state, word
        while len(left):
            key = at * self.width + w
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            found = self.arcs[arc] == key if len(self.arcs) else np.zeros(len(key), bool)
            root = at == 0
            met, hit = left[found], arc[found]
            to[met] = self.to[hit]
            log[met] += self.log[hit]
            met, own = left[root], w[root]
            to[met] = self.root_to[own]
            log[met] += self.root[own]
            on = ~(found | root)
            left, at, w = left[on], at[on], w[on]
            log[left] += self.weight[at]
            at = self.fail[at]
        return to, log

    def scores(self) -> np.ndarray:
        """Log-probabilities of the block's pieces, by one traversal in lanes of at most STRETCH scored tokens.

        A lane begins at state 0 with the order - 1 tokens before its own, which lead to the state it goes on from.
        """
        block = self.block
        n = np.maximum(-(-(block.sizes - block.warm) // STRETCH), 0)
        piece = np.repeat(np.arange(len(n)), n)
        number = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        begin = block.begins[piece] + block.warm[piece] + number * STRETCH
        stop = np.minimum(begin + STRETCH, (block.begins + block.sizes)[piece])
        at = np.maximum(begin - max(block.order - 1, 0), block.begins[piece])
        state, total = np.zeros(len(piece), np.int64), np.zeros(len(piece))
        lane = np.arange(len(piece))
        while len(lane):
            state, log = self.step(state, block.ids[at])
            total[lane] += np.where(at >= begin, log, 0.0)
            at = at + 1
            on = at < stop
            if not on.all():
                lane, state, at, begin, stop = (x[on] for x in (lane, state, at, begin, stop))
        return np.bincount(piece, total, len(n)).astype(np.float64)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch[name][k].as_py() for name in batch.schema.names}


def _in_ranges(block: int, ranges: int, keys: np.ndarray, **others: np.ndarray) -> pa.RecordBatch:
    """One row per range of sorted keys: their steps and their other columns, packed."""
    number = (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    begins = np.flatnonzero(np.append(True, number[1:] != number[:-1])[: len(keys)])
    cuts = list(zip(begins, np.append(begins, len(keys))[1:], strict=True))
    columns = {"range": pa.array(number[begins].astype(np.int64)), "block": pa.array(np.full(len(cuts), block))}
    columns["key"] = pa.array([_packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in cuts], pa.binary())
    columns |= {k: pa.array([_packed(x[a:b]) for a, b in cuts], pa.binary()) for k, x in others.items()}
    return pa.record_batch(list(columns.values()), names=list(columns))


def _name(order: int, least: float, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            keys, counts = Block(row, order, least).named()
            yield _in_ranges(row["block"], ranges, keys, n=counts)

    return tidy(run)


class Range:
    """The keys of one range, of all blocks."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table.sort_by("block")
        self.number = table["range"][0].as_py()
        parts = [np.cumsum(_unpacked(x, "<u8"), dtype=np.uint64) for x in self.table["key"].to_pylist()]
        self.keys = np.concatenate(parts)
        self.stops = np.cumsum([len(x) for x in parts])
        # parts are sorted and stay in order, so the first of equal keys is that of the first block
        self.by = np.argsort(self.keys, kind="stable")
        own = self.keys[self.by]
        self.new = np.append(True, own[1:] != own[:-1])

    def column(self, name: str, dtype) -> np.ndarray:
        return np.concatenate([_unpacked(x, dtype) for x in self.table[name].to_pylist()])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of every key: the sum over all blocks."""
        out = np.empty(len(values), values.dtype)
        out[self.by] = np.add.reduceat(values[self.by], np.flatnonzero(self.new))[np.cumsum(self.new) - 1]
        return out

    def first(self) -> np.ndarray:
        """Of every key: whether no earlier block holds it."""
        out = np.empty(len(self.keys), bool)
        out[self.by] = self.new
        return out

    def answers(self, cut) -> pa.Table:
        """One row per block: ``cut`` gives its packed columns from the slice of its keys."""
        blocks = self.table["block"].to_pylist()
        rows = [cut(slice(a, b)) for a, b in zip([0, *self.stops[:-1]], self.stops, strict=True)]
        columns = {"block": blocks, "range": [self.number] * len(blocks)} | {k: [r[k] for r in rows] for k in rows[0]}
        return pa.table({k: pa.array(v, pa.binary() if k in rows[0] else pa.int64()) for k, v in columns.items()})


def _sum(once: float):
    def run(table: pa.Table) -> pa.Table:
        own = Range(table)
        counts = own.sums(own.column("n", "<i8"))
        counts[counts < once] = 0
        mine = own.first() & (counts > 0)
        return own.answers(lambda at: {"c": _packed(counts[at]), "own": _packed(mine[at])})

    return run


def _backoff(table: pa.Table) -> pa.Table:
    own = Range(table)
    mass, low = (own.sums(own.column(c, "<f8")) for c in ("mass", "low"))
    falls = own.column("needs", bool) & (mass > 0)
    weights = np.log10(np.maximum(1 - mass, 1e-12) / np.maximum(1 - low, 1e-12))

    def cut(at: slice) -> dict:
        keys, some = own.keys[at][falls[at]], weights[at][falls[at]]
        return {"key": _packed(np.diff(keys, prepend=np.uint64(0))), "weight": _packed(some)}

    return own.answers(cut)


def _answered(table: pa.Table, name: str, dtype) -> np.ndarray:
    """A column of the answers to one block."""
    parts = [_unpacked(x, dtype) for x in table.sort_by("range")[name].to_pylist()]
    if name == "key":
        parts = [np.cumsum(x, dtype=np.uint64) for x in parts]
    return np.concatenate([np.zeros(0, dtype), *parts])


def _fill(order: int, least: float, ends: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        counts, own = (_answered(right, k, t) for k, t in (("c", "<i8"), ("own", bool)))
        filled = Block(row, order, least).filled(counts, own, ends)
        return pa.Table.from_batches([_row(filled)])

    return run


def _masses(order: int, least: float, norm: float, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            for keys, mass, low, needs in Block(row, order, least).masses(norm):
                by = np.argsort(keys)
                yield _in_ranges(row["block"], ranges, keys[by], mass=mass[by], low=low[by], needs=needs[by])

    return tidy(run)


def _weigh(order: int, least: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        keys, weights = (_answered(right, k, t) for k, t in (("key", "<u8"), ("weight", "<f8")))
        return pa.Table.from_batches([_row(Block(row, order, least, order - 1).weighted(keys, weights))])

    return run


_SCORES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _walk(order: int, least: float, norm: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            block = Block(row, order, least)
            automaton = Automaton(block, norm)
            piece = np.repeat(np.arange(len(block.sizes)), block.sizes)[block.scored]
            word = block.ids[block.scored]
            known = np.bincount(piece, block.grams[0].counts[word] > 0, len(block.sizes))
            base = np.bincount(piece, automaton.root[word], len(block.sizes)).astype(np.float64)
            columns = [
                pa.array(row["rows"], pa.int64()),
                pa.array(row["doc_ids"], pa.int64()),
                pa.array(row["held_out"], pa.bool_()),
                pa.array(block.sizes - block.warm),
                pa.array(known.astype(np.int64)),
                pa.array(base),
                pa.array(automaton.scores()),
            ]
            yield pa.record_batch(columns, names=[part.split()[0] for part in _SCORES.split(", ")])

    return tidy(run)


def _answers(named: DataFrame, answer, columns: str) -> DataFrame:
    """The answers to what blocks have named, written, so that the named keys are gone before blocks move.

    named: range, block, key and other columns; a task answers one range at a time.
    """
    return materialize(named.groupBy("range").applyInArrow(answer, f"block long, range long, {columns}"), "answers")


def _brought(blocks: DataFrame, answers: DataFrame, fill) -> DataFrame:
    """Blocks with what is known of their keys."""
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(fill, BLOCK)


def _counted(blocks: DataFrame, order: int, least: float, once: float, ends: int, ranges: int) -> DataFrame:
    """Blocks with the counts of one more order, written anew; n-grams that occur less than ``once`` times count as 0."""
    named = blocks.mapInArrow(_name(order, least, ranges), "range long, block long, key binary, n binary")
    answers = _answers(named, _sum(once), "c binary, own binary")
    new = materialize(_brought(blocks, answers, _fill(order, least, ends)), "blocks", **WRITER)
    discard(blocks)
    discard(answers)
    return new


def automata(docs: DataFrame, order: int = 3, floor: float = 0.0) -> tuple[DataFrame, int, float, float]:
    """Blocks of texts with their parts of the model; training tokens, least count of an n-gram, norm of the words."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (doc_remainder(F.col("doc_id"), 10) == 0).alias("held_out"),
        utf8(F.col("text")).alias("text"),
    )
    blocks = materialize(rows.mapInArrow(_deal(order), BLOCK), "blocks", **WRITER)
    ranges = -(-blocks.count() * BLOCK_TOKENS // RANGE_TOKENS) or 1
    blocks = _counted(blocks, order, 1.0, 1.0, 0, ranges)
    total = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("train", "types", "ends"))).first()
    tokens, ends = total["train"], total["ends"]
    norm = tokens + ADD * (total["types"] + 1)
    least = max(2.0, floor * tokens)
    for _ in range(2, order + 1):
        blocks = _counted(blocks, order, least, least, ends, ranges)
    if order > 1:
        columns = "range long, block long, key binary, mass binary, low binary, needs binary"
        masses = blocks.mapInArrow(_masses(order, least, norm, ranges), columns)
        blocks = _brought(blocks, _answers(masses, _backoff, "key binary, weight binary"), _weigh(order, least))
    return blocks, tokens, least, norm


def score(docs: DataFrame, order: int = 3, floor: float = 0.0) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``floor``: n-grams are kept from this share of all tokens, and from two occurrences.
    """
    with shuffles_released(docs.sparkSession):
        blocks, tokens, least, norm = automata(docs, order, floor)
        pieces = materialize(blocks.mapInArrow(_walk(order, least, norm), _SCORES), "scores")
        discard(blocks)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    found = pieces.groupBy("row", "doc_id", "held_out").agg(*sums)
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
