"""MinHash near-duplicates with b-bit signatures.

The set of a document: its distinct shingles of ``size`` words; with fewer words the whole
sequence is its only shingle, without words the set is empty. Shingles are 64-bit hashes.

1. ``signatures``: full minima of ``HASHES`` permutations per document give band keys; of every
   minimum only the low ``BITS`` bits are kept, packed into one binary value.
2. Documents with equal sets form one class, and one text per class goes on.
3. ``families``: within every bucket (equal band key) all packed signatures are compared; similarities are
   estimated from bit counts, corrected for chance agreement of the kept bits. Classes that are
   joined by estimates not far below the threshold form a family.
4. ``confirmed``: within a family, pairs are confirmed on full sets in order of their estimates, until none
   is left that could join two components.

Pairs never become rows: a task compares up to ``TILE`` classes with each other and returns at most one
edge per class. Buckets and families beyond that are cut into tiles, which meet two by two; a family's tiles
are of similar set sizes, since sets of very different sizes can't be linked.

Rows without ``doc_id`` are returned, linked with nothing. Rows that share a doc_id are one
document whose links are those of all its rows. Empty sets are linked with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from techatlas.llm.shared import components, free_names, grows, split_by, tidy, utf8, words_of
from techatlas.session import materialize

HASHES = 112
BAND_ROWS = 4
BITS = 4
TILE = 1024
TILE_SHINGLES = 1 << 19
WORD_CACHE = 200_000
CHUNK = 2048

_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of each word seen; emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None, size: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = max(len(h) - size + 1, 1)
    out = np.full(n, len(h[:size]), np.uint64)
    for k in range(min(size, len(h))):
        out = _mixed(out * _MIX + h[k : k + n])
    return np.unique(out)


def minima(hashes: np.ndarray) -> np.ndarray:
    """Smallest value of each permutation over a set that isn't empty, as 32-bit numbers."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), CHUNK):
        part = hashes[None, k : k + CHUNK] * _A[:, None] + _B[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return _mixed(low) >> np.uint64(32)


def packed(low: np.ndarray) -> bytes:
    """The low BITS bits of every minimum, packed."""
    bits = (low[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8)).tobytes()


def bands(low: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of the key."""
    rows = low.reshape(-1, BAND_ROWS)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = _mixed(key * _MIX + rows[:, k])
    return key.view(np.int64)


def _signature_rows(size: int):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("text_hash", pa.int64()),
            ("n_shingles", pa.int64()),
            ("set_id", pa.binary()),
            ("signature", pa.binary()),
            ("bands", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            n, ids, sig, keys = [], [], [], []
            for text in batch["text"]:
                s = shingles(text.as_py(), size, cache)
                n.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                low = minima(s) if len(s) else None
                sig.append(packed(low) if len(s) else None)
                keys.append(bands(low) if len(s) else None)
            columns = [
                batch["doc_id"],
                batch["text_hash"],
                pa.array(n, pa.int64()),
                pa.array(ids, pa.binary()),
                pa.array(sig, pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, and a hash of the text that tells rows of one doc_id apart."""
    text = F.col("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).select(
        "doc_id", utf8(text).alias("text"), F.xxhash64(text).alias("text_hash")
    )


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Per row: n_shingles, set_id (128-bit hash of the set), packed signature, band keys."""
    return keyed(docs).mapInArrow(
        tidy(_signature_rows(size)),
        "doc_id long, text_hash long, n_shingles long, set_id binary, signature binary, bands array<long>",
    )


_FOLD = np.uint64(sum(1 << k for k in range(0, 64, BITS)))


def unpacked(signatures: list[bytes]) -> np.ndarray:
    """Packed signatures as rows of 64-bit numbers."""
    return np.frombuffer(b"".join(signatures), np.uint64).reshape(len(signatures), -1)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of every signature of a with every one of b, from the number of equal b-bit values.

    Differing bits of a value are folded onto its lowest bit and counted; agreement by chance,
    2^-BITS, is taken out.
    """
    differ = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        x = a[:, None, k] ^ b[None, :, k]
        folded = x.copy()
        for s in range(1, BITS):
            folded |= x >> np.uint64(s)
        differ += np.bitwise_count(folded & _FOLD)
    chance = 2.0**-BITS
    return ((HASHES - differ) / HASHES - chance) / (1 - chance)


def estimate_floor(percent: int) -> float:
    """Five standard deviations below the threshold."""
    j, c = percent / 100, 2.0**-BITS
    p = c + (1 - c) * j
    return j - 5 * (p * (1 - p) / HASHES) ** 0.5 / (1 - c)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``part``, which lie side by side."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch["part"].to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if held and part[low] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = part[low]
    if held:
        yield pa.Table.from_batches(held)


def _near(sigs: np.ndarray, sides: np.ndarray, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(estimate, i, j), i < j, of pairs not far below the threshold; with two sides only across them."""
    across = sides.min() != sides.max()
    for low in range(0, len(sigs), 128):
        e = estimates(sigs[low : low + 128], sigs[low:])
        i, j = np.nonzero(e >= floor)
        keep = i < j
        if across:
            keep &= sides[low + i] != sides[low + j]
        i, j = i[keep], j[keep]
        yield e[i, j], i + low, j + low


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A member of each one's component."""
    root = np.arange(n)
    while len(i):
        new = root.copy()
        low = np.minimum(root[i], root[j])
        for k in (i, j, root[i], root[j]):
            np.minimum.at(new, k, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _family_edges(floor: float):
    """Per group of classes (part, side, class, signature): edges that join those with near signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in _groups(batches):
            ids = group["class"].to_numpy()
            found = list(_near(unpacked(group["signature"].to_pylist()), group["side"].to_numpy(), floor))
            root = _joined(len(ids), np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found]))
            moved = np.flatnonzero(root != np.arange(len(ids)))
            a += ids[moved].tolist()
            b += ids[root[moved]].tolist()
            if len(a) > 50_000:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirm(sets: list[np.ndarray], sigs: np.ndarray, sides: np.ndarray, comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links at or above the threshold that join all components that any such link joins."""
    size = np.array([len(s) for s in sets])
    _, comp = np.unique(comp, return_inverse=True)
    comp = comp.copy()
    found = []
    for e, i, j in _near(sigs, sides, estimate_floor(percent)):
        few, many = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        open_ = (comp[i] != comp[j]) & (few * 100 >= many * percent)
        found.append((e[open_], i[open_], j[open_]))
    e, i, j = (np.concatenate([f[k] for f in found]) for k in range(3))
    order = np.argsort(-e, kind="stable")
    i, j = i[order], j[order]
    links = []
    for low in range(0, len(i), 4096):
        a, b = i[low : low + 4096], j[low : low + 4096]
        open_ = comp[a] != comp[b]
        for x, y in zip(a[open_].tolist(), b[open_].tolist(), strict=True):
            if comp[x] == comp[y]:
                continue
            shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if shared * 100 >= (size[x] + size[y] - shared) * percent:
                links.append((x, y))
                comp[comp == comp[y]] = comp[x]
    return links


def _links(percent: int):
    """Per group of classes (part, side, class, comp, signature, shingles): confirmed links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            ids = group["class"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
            sigs = unpacked(group["signature"].to_pylist())
            links = confirm(sets, sigs, group["side"].to_numpy(), group["comp"].to_numpy(), percent)
            a, b = ids[[x for x, _ in links]], ids[[y for _, y in links]]
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            sets = [shingles(text.as_py(), size, cache).tobytes() for text in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], pa.array(sets, pa.binary())],
                names=["doc_id", "text_hash", "shingles"],
            )

    return run


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of one group side by side in one task; ``part`` names the group."""
    return df.withColumn("part", F.xxhash64(*keys)).repartition(*keys).sortWithinPartitions(*keys).drop(*keys)


def families(classes: DataFrame, percent: int) -> DataFrame:
    """(class, family) of classes in a family of two or more."""
    members = classes.select("class", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = members.join(grows(buckets), "bucket").join(grows(classes.select("class", "signature")), "class")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    members = members.withColumn("tiles", tiles).withColumn("side", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    # a tile meets itself and every other tile of its bucket
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    members = members.select(
        "bucket", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"), "side", "class", "signature"
    )
    edges = _dealt(members, "bucket", "one", "two").select("part", "side", "class", "signature")
    edges = edges.mapInArrow(tidy(_family_edges(estimate_floor(percent))), "a long, b long")
    return components(edges).select(F.col("id").alias("class"), F.col("component").alias("family"))


def confirmed(docs: DataFrame, classes: DataFrame, family: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between classes of one family; they join the same components as all links do."""
    own = classes.select("class", "doc_id", "text_hash", "signature", "n_shingles").join(grows(family), "class")
    # classes whose sizes differ by more than one step of the threshold can't be linked
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    own = materialize(own.withColumn("step", step), "members")
    whole = own.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    whole = whole.select("family", ((F.col("n") <= TILE) & (F.col("s") <= 2 * TILE_SHINGLES)).alias("small"))
    tiles = own.groupBy("family", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    tiles = tiles.join(grows(whole), "family").select(
        "family",
        F.when(F.col("small"), F.lit(-1)).otherwise(F.col("step")).alias("row"),
        "step",
        F.when(F.col("small"), F.lit(1))
        .otherwise(F.ceil(F.greatest(F.col("n") / TILE, F.col("s") / TILE_SHINGLES)).cast("int"))
        .alias("tiles"),
    )
    needed = grows(own.select("doc_id", "text_hash"))
    texts, _ = split_by(keyed(docs), own, "text_hash")
    sets = texts.join(needed, ["doc_id", "text_hash"], "left_semi")
    sets = sets.mapInArrow(tidy(_set_rows(size)), "doc_id long, text_hash long, shingles binary")
    sets = sets.dropDuplicates(["doc_id", "text_hash"])
    own = own.join(grows(tiles), ["family", "step"]).join(grows(sets), ["doc_id", "text_hash"])
    own = own.withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    own = materialize(own.select("family", "row", "tile", "class", "signature", "shingles"), "sets")

    columns = ["part", "side", "class", "comp", "signature", "shingles"]
    alone = own.withColumn("side", F.lit(0)).withColumn("comp", F.col("class"))
    links = _dealt(alone, "family", "row", "tile").select(columns).mapInArrow(tidy(_links(percent)), "a long, b long")
    links = materialize(links, "links")
    large = tiles.where("row >= 0").select("family", "row", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    if large.isEmpty():
        return links

    # large families: tiles of equal or neighbouring sizes meet, where more than one component is left
    parts = own.select("family", "row", "tile", "class").where("row >= 0").join(
        grows(components(links).select(F.col("id").alias("class"), "component")), "class", "left"
    )
    parts = parts.select("family", "row", "tile", "class", F.coalesce("component", "class").alias("comp"))
    parts = materialize(parts, "parts")
    several = parts.groupBy("family").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("family")
    large = materialize(large.join(several, "family", "left_semi"), "tiles")
    one = large.select("family", F.col("row").alias("row1"), F.col("tile").alias("tile1"))
    two = large.select("family", F.col("row").alias("row2"), F.col("tile").alias("tile2"))
    meet = one.join(two, "family").where("(row1 = row2 and tile1 < tile2) or row2 = row1 + 1")
    meet = meet.withColumn("pair", F.xxhash64("family", "row1", "tile1", "row2", "tile2"))
    sides = meet.select("pair", "family", F.col("row1").alias("row"), F.col("tile1").alias("tile"), F.lit(0).alias("side"))
    sides = sides.unionByName(
        meet.select("pair", "family", F.col("row2").alias("row"), F.col("tile2").alias("tile"), F.lit(1).alias("side"))
    )
    dealt = own.join(grows(parts.select("class", "comp")), "class").join(sides, ["family", "row", "tile"])
    more = _dealt(dealt, "pair").select(columns).mapInArrow(tidy(_links(percent)), "a long, b long")
    return links.unionByName(materialize(more, "links"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, component_id, kept.

    component_id: the smallest doc_id reachable over links of similarity >= percent / 100.
    kept: whether the row's doc_id is that. Both are null and true for rows without doc_id.
    """
    rows = materialize(signatures(docs, size), "signatures")
    sets = rows.where("set_id is not null and doc_id is not null")
    classes = sets.groupBy("set_id").agg(
        F.min(F.struct("doc_id", "text_hash", "n_shingles", "signature", "bands")).alias("c")
    )
    classes = materialize(classes.select("set_id", "c.*", F.monotonically_increasing_id().alias("class")), "classes")
    links = confirmed(docs, classes, families(classes, percent), size, percent)

    reps = classes.select("set_id", "class", F.col("doc_id").alias("rep"))
    one = reps.select(F.col("class").alias("a"), F.col("rep").alias("x"))
    two = reps.select(F.col("class").alias("b"), F.col("rep").alias("y"))
    edges = links.join(grows(one), "a").join(grows(two), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    copies = sets.select("set_id", "doc_id").join(grows(reps), "set_id").where("doc_id <> rep")
    copies = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    found = components(edges.unionByName(copies))
    out = rows.join(grows(found), rows["doc_id"] == found["id"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def one_per_group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near-copies: of each component the row(s) with the smallest doc_id.

    Of rows that share a doc_id one stays. Rows without doc_id all stay. Columns are as in docs.
    """
    found = near_duplicates(docs, size, percent).where("doc_id is not null")
    name, check, kept, best, rows = free_names(docs, "id", "hash", "kept", "best", "rows")
    # what is to be looked at: documents that go, and those of several rows
    some = found.groupBy(F.col("doc_id").alias(name)).agg(
        F.first("kept").alias(kept), F.min("text_hash").alias(best), F.count(F.lit(1)).alias(rows)
    )
    some = materialize(some.where(~F.col(kept) | (F.col(rows) > 1)), "copies")
    own = docs.withColumn(check, F.xxhash64("text")).withColumn(name, F.col("doc_id").cast("long"))
    maybe, single = split_by(own, some, name)
    joined = maybe.join(grows(some), name, "left")
    others = joined.where(F.col(kept).isNull())
    # rows that are equal in doc_id and text
    several = joined.where(F.col(kept) & (F.col(check) == F.col(best))).dropDuplicates([name])
    parts = [p.select(*docs.columns) for p in (single, others, several)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
