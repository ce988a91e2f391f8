"""Ranked lexical search by a dual tree: items (queries) against all documents, exactly.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. With N documents
that hold a term, L terms in all of them, n terms in a document, df documents that hold a term and tf its occurrences
in the document: a term weighs floor(1000 ln((2N + 2) / (2 df + 1))), its value in a document is
(10^9 tf) div (1000 tf + 20 (50 + (50 n N) div L)), and a document's score is the sum of weight times value over the
item's terms. The K best documents per item with a score above 0 are returned, equal scores by ascending id.

* Items are dealt into blocks of bounded size, counted before anything of them is broadcast; each block meets all documents.
* ``vectors``: every text is read once per block and leaves its values' ingredients for the block's terms.
* Both sides are hierarchies whose nodes hold the coordinate maxima of what lies below: of the items' weights, and of
  the documents' values (a task builds the tree of some thousand documents at a time). The product of two nodes'
  maxima bounds every score between them; a pair of nodes goes where it is below the weakest k-th score of its
  items. What is left at the leaves is computed in full.
* The first of WAVES parts of the documents is searched first; its k-th scores are lower bounds for the rest, so
  that the rest returns little more than the result.

Sums are exact: products are whole numbers, added as doubles only where no sum can pass 2^53, else as 64-bit integers.

Null or empty texts hold nothing. Every row of a table is a document or an item of its own, also where ids repeat;
documents without an id come last among equal scores. Items without terms, or whose terms are in no document, return nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from techatlas.llm.shared import tidy, utf8
from techatlas.session import materialize

K = 50
ITEM_LEAF = 8
DOC_LEAF = 64
FAN = 4
#: Limits of one block of items: terms with repeats over items, as counted before it is collected.
BLOCK_TERMS = 32_768
#: Limits of one document tree.
TREE_DOCS = 4096
TREE_VALUES = 1_500_000
#: The first of so many parts is searched first.
WAVES = 16
#: Sums below this are exact in doubles.
EXACT = 1 << 53

_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_FOLD = bytes(0x20 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in order."""
    return text.translate(_FOLD).split() if text else []


# ---------------------------------------------------------------- documents as rows of numbers


def _vector_rows(known):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("idx", pa.binary()), ("tf", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            sizes, idx, tf = [], [], []
            for text in batch["text"]:
                counts = Counter(terms_of(text.as_py()))
                sizes.append(counts.total())
                found = [(k, c) for k, c in ((get(t), c) for t, c in counts.items()) if k is not None]
                own = np.array(found, np.int32).reshape(-1, 2)
                idx.append(own[:, 0].tobytes())
                tf.append(own[:, 1].tobytes())
            columns = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(idx, pa.binary()), pa.array(tf, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def vectors(docs: DataFrame, known) -> DataFrame:
    """Per document with a term: doc_id, n, and of the block's terms in it the numbers and counts (32-bit, as bytes).

    ``known``: broadcast numbers of the block's terms.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text").cast("string")).alias("text"))
    rows = rows.mapInArrow(tidy(_vector_rows(known)), "doc_id long, n long, idx binary, tf binary")
    first = F.pmod(F.xxhash64("doc_id", "n"), F.lit(WAVES)) == 0
    return rows.where("n > 0").withColumn("part", F.when(first, 0).otherwise(1))


def _counted(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            own = np.frombuffer(b"".join(batch["idx"].to_pylist()), np.int32)
            df += np.bincount(own, minlength=size)
        k = np.flatnonzero(df)
        yield pa.record_batch([pa.array(k, pa.int64()), pa.array(df[k])], names=["k", "df"])

    return run


# ---------------------------------------------------------------- trees


class Sparse:
    """Rows of whole numbers: of row r, the places ``start[r]:start[r + 1]`` of idx (coordinates) and of value."""

    def __init__(self, start: np.ndarray, idx: np.ndarray, value: np.ndarray) -> None:
        self.start, self.idx, self.value = start, idx, value

    def __len__(self) -> int:
        return len(self.start) - 1

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of some rows' numbers, and for each its row's position in ``rows``."""
        n = self.start[rows + 1] - self.start[rows]
        own = np.repeat(np.arange(len(rows)), n)
        before = np.cumsum(n) - n
        return np.arange(n.sum()) - before[own] + self.start[rows][own], own


class Node:
    """Rows below, their coordinate maxima (coordinates and values), and children if it is no leaf."""

    __slots__ = ("rows", "idx", "top", "below")

    def __init__(self, rows: np.ndarray, idx: np.ndarray, top: np.ndarray, below: list[Node]) -> None:
        self.rows, self.idx, self.top, self.below = rows, idx, top, below


def _halves(data: Sparse, rows: np.ndarray, scale: np.ndarray) -> list[np.ndarray]:
    """Two parts of at least a quarter each, apart in the coordinate that varies most (times its scale)."""
    at, own = data.places(rows)
    idx, value = data.idx[at], data.value[at].astype(np.float64)
    size = len(scale)
    mean = np.bincount(idx, value, size) / len(rows)
    spread = (np.bincount(idx, value * value, size) / len(rows) - mean * mean) * scale * scale
    widest = int(spread.argmax())
    mine = idx == widest
    column = np.zeros(len(rows))
    column[own[mine]] = value[mine]
    low = int((column <= mean[widest]).sum())
    cut = min(max(low, len(rows) // 4), len(rows) - len(rows) // 4)
    order = np.argsort(column, kind="stable")
    return [rows[order[:cut]], rows[order[cut:]]]


def tree(data: Sparse, rows: np.ndarray, leaf: int, scale: np.ndarray) -> Node:
    """A hierarchy of rows; parts that belong together are cut apart last."""
    if len(rows) <= leaf:
        at, _ = data.places(rows)
        idx, inverse = np.unique(data.idx[at], return_inverse=True)
        top = np.zeros(len(idx), data.value.dtype)
        np.maximum.at(top, inverse, data.value[at])
        return Node(rows, idx, top, [])
    parts = [rows]
    while len(parts) < FAN and max(map(len, parts)) > leaf:
        parts.sort(key=len)
        parts.extend(_halves(data, parts.pop(), scale))
    below = [tree(data, p, leaf, scale) for p in parts]
    top = np.zeros(len(scale), data.value.dtype)
    for b in below:
        top[b.idx] = np.maximum(top[b.idx], b.top)
    idx = np.flatnonzero(top)
    return Node(rows, idx, top[idx], below)


# ---------------------------------------------------------------- search


class Search:
    """Items of one block against documents, some at a time; keeps the best of all seen.

    ``items``: rows of weights. ``scale``: the weight of every coordinate. ``least``: known lower bounds of the
    items' k-th scores.
    """

    def __init__(self, items: Sparse, scale: np.ndarray, least: np.ndarray, k: int = K) -> None:
        size = len(scale)
        self.size, self.scale, self.k = size, scale, k
        # no value of a document is above 10^6, and no bound above the sum over all coordinates
        most = np.zeros(size, np.int64)
        np.maximum.at(most, items.idx, items.value)
        self.number = np.float64 if int(most.sum()) * 1_000_000 < EXACT else np.int64
        self.items = items
        self.root = tree(items, np.arange(len(items)), ITEM_LEAF, np.ones(size))
        self.least = least.copy()
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(len(items))]
        self.computed = 0
        self.weights: dict[int, np.ndarray] = {}

    def leaf_weights(self, node: Node) -> np.ndarray:
        """Weights of a leaf's items (columns) at its coordinates (rows)."""
        if id(node) not in self.weights:
            at, own = self.items.places(node.rows)
            found = np.zeros((len(node.idx), len(node.rows)), self.number)
            found[np.searchsorted(node.idx, self.items.idx[at]), own] = self.items.value[at]
            self.weights[id(node)] = found
        return self.weights[id(node)]

    def add(self, ids: np.ndarray, docs: Sparse) -> None:
        """Search documents; ids: their ids, for ties."""
        if len(docs):
            self.visit(tree(docs, np.arange(len(docs)), DOC_LEAF, self.scale), [self.root], docs, ids)

    def survivors(self, top: np.ndarray, items: list[Node], leaves: bool) -> list[Node]:
        """Item nodes that may still gain from documents with these maxima; down to the leaves if asked."""
        out, todo = [], list(items)
        while todo:
            node = todo.pop()
            bound = top[node.idx] @ node.top.astype(self.number)
            if bound <= 0 or bound < self.least[node.rows].min():
                continue
            if node.below and leaves:
                todo.extend(node.below)
            else:
                out.append(node)
        return out

    def visit(self, node: Node, items: list[Node], docs: Sparse, ids: np.ndarray) -> None:
        top = np.zeros(self.size, self.number)
        top[node.idx] = node.top
        # one step down on both sides
        items = self.survivors(top, [c for i in items for c in (i.below or [i])], not node.below)
        if not items:
            return
        if not node.below:
            self.compute(node, items, docs, ids)
            return
        for child in sorted(node.below, key=lambda c: -float(c.top @ self.scale[c.idx])):
            self.visit(child, items, docs, ids)

    def compute(self, node: Node, items: list[Node], docs: Sparse, ids: np.ndarray) -> None:
        at, own = docs.places(node.rows)
        values = np.zeros((len(node.rows), self.size), self.number)
        values[own, docs.idx[at]] = docs.value[at]
        for leaf in items:
            scores = (values[:, leaf.idx] @ self.leaf_weights(leaf)).astype(np.int64)
            self.computed += scores.size
            for column, item in enumerate(leaf.rows):
                mine = scores[:, column]
                good = np.flatnonzero((mine >= self.least[item]) & (mine > 0))
                if len(good):
                    self.merge(item, mine[good], ids[node.rows[good]])

    def merge(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.best[item][0], scores]), np.concatenate([self.best[item][1], ids])
        order = np.lexsort((i, -s))[: self.k]
        self.best[item] = s[order], i[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], s[order[-1]])


#: Stands for documents without an id: after all others.
LAST = np.iinfo(np.int64).max


def _values(n: np.ndarray, tf: np.ndarray, own: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = np.array([50 + 50 * int(x) * documents // length for x in n], np.int64)
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m[own])


def _searched(model):
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, idx, weight, scale, least, documents, length, k = model.value
        search = Search(Sparse(start, idx, weight), scale, least, k)
        held, values = [], 0

        def some() -> None:
            ids = np.concatenate([h[0] for h in held])
            n = np.concatenate([h[1] for h in held])
            own_n = np.concatenate([h[2] for h in held])
            idx = np.concatenate([h[3] for h in held])
            tf = np.concatenate([h[4] for h in held])
            start = np.concatenate([[0], np.cumsum(own_n)])
            own = np.repeat(np.arange(len(n)), own_n)
            search.add(ids, Sparse(start, idx, _values(n, tf, own, documents, length)))

        for batch in batches:
            for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                lists = part["idx"].to_pylist()
                ids = part["doc_id"].fill_null(LAST).to_numpy(zero_copy_only=False)
                own_n = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
                idx = np.frombuffer(b"".join(lists), np.int32)
                tf = np.frombuffer(b"".join(part["tf"].to_pylist()), np.int32)
                held.append((ids, part["n"].to_numpy(), own_n, idx, tf))
                values += len(idx)
                if values >= TREE_VALUES or sum(len(h[0]) for h in held) >= TREE_DOCS:
                    some()
                    held, values = [], 0
        if held:
            some()
        for item, (scores, ids) in enumerate(search.best):
            if len(scores):
                columns = [pa.array(np.full(len(scores), item)), pa.array(ids, mask=ids == LAST), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(spark, docs: DataFrame, items: list, k: int) -> DataFrame | None:
    """Ranks of the items (id, text as bytes) of one block."""
    own = [sorted(set(terms_of(text))) for _, text in items]
    words = {t: i for i, t in enumerate(sorted(set().union(*own)))}
    if not words:
        return None
    known = spark.sparkContext.broadcast(words)
    rows = materialize(vectors(docs, known), "vectors", by="part")
    total = rows.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    if not total["documents"]:
        return None
    df = np.zeros(len(words), np.int64)
    counts = rows.select("idx").mapInArrow(_counted(len(words)), "k long, df long").groupBy("k").agg(F.sum("df").alias("df"))
    for r in counts.collect():  # as many rows as the block has terms at most
        df[r["k"]] = r["df"]
    n = total["documents"]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) if x else 0 for x in df], np.int64)
    start = np.concatenate([[0], np.cumsum([len(o) for o in own])])
    idx = np.array([words[t] for o in own for t in o], np.int32)
    least = np.zeros(len(items), np.int64)
    found = None
    for first in (True, False):
        model = spark.sparkContext.broadcast(
            (start, idx, weight[idx], weight.astype(np.float64), least, n, total["length"], k)
        )
        part = rows.where(F.col("part") == 0 if first else F.col("part") > 0).select("doc_id", "n", "idx", "tf")
        part = part.mapInArrow(tidy(_searched(model)), "item long, doc_id long, score long")
        found = materialize(_best(part if first else part.unionByName(found), k).drop("rank"), "ranked")
        if first:
            for r in found.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).collect():
                if r["n"] >= k:  # one number per item of the block
                    least[r["item"]] = r["least"]
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(items)], "item long, item_id long")
    return _best(found, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def _blocks(items: DataFrame) -> Iterator[list]:
    """Items in blocks of at most BLOCK_TERMS terms, or of one item.

    The table's size is counted first; then hash parts of about a block's size come to the driver, row by row.
    """
    size = (F.expr("length(text) div 2") + 1).alias("size")  # at least its terms
    rows = items.select("item_id", "text", size, F.xxhash64("item_id", "text").alias("h"))
    parts = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // BLOCK_TERMS))
    block = F.pmod("h", F.lit(parts))
    for k in range(parts):
        held, size = [], 0
        for r in rows.where(block == k).select("item_id", "text").orderBy("item_id").toLocalIterator():
            n = len(r["text"] or b"") // 2 + 1
            if held and size + n > BLOCK_TERMS:
                yield held
                held, size = [], 0
            held.append((r["item_id"], bytes(r["text"] or b"")))
            size += n
        if held:
            yield held


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The k best documents of every item: item_id, rank (from 1), doc_id, score. Runs jobs, two or three per block."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), utf8(F.col("text").cast("string")).alias("text"))
    out = None
    for block in _blocks(items):
        found = _search_block(spark, docs, block, k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out.withColumn("rank", F.col("rank").cast("int"))
