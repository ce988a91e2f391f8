import hashlib
import re

from pyspark.sql import functions as F

from techatlas.llm import exact

from . import brute


def plain(rows):
    """(doc_id, keep_id, group_size, kept, sha) of rows (doc_id, text)."""
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(normal[k], []).append(((i is None, i or 0), k))
    out, stays = [], set()
    for k, (i, _) in enumerate(rows):
        g = groups[normal[k]]
        first = min(g)
        stays.add(first[1])
        keep = rows[first[1]][0]
        out.append((i, keep, len(g), hashlib.sha256(normal[k].encode()).hexdigest()))
    return out, stays


TEXTS = ["a b", "a  b", "a\t\x0bb", "a b ", " a b", "a b", "A b", "", None, " ", "\n\n", "é", "é", "a b", "x" * 300_000, "x" * 300_000]


def rows():
    found = [(i, t) for i, t in enumerate(TEXTS)]
    found += [(3, "a b"), (100, "a b"), (None, "a b"), (None, "only nameless"), (None, "only nameless"), (-5, "é")]
    return found + [(1000 + k, "copy  of\none") for k in range(200)] + [(7, "twice"), (7, "twice")]


def frame(spark, found):
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in found], brute.DOCS)
    return df.selectExpr("*", "1 as key", "2 as row", "3 as place", "4 as digest", "5 as group_size").repartition(5)


def check(got, want, stays):
    key = lambda r: repr(r)
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=key) == sorted(want, key=key)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(stays) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_equal_to_a_dictionary_of_texts(spark):
    want, stays = plain(rows())
    check(exact.duplicates(frame(spark, rows())).collect(), want, stays)


def test_a_hash_that_collides_changes_nothing(spark):
    """Hashes of few values: groups hold several texts, which only their bytes tell apart."""
    want, stays = plain(rows())
    weak = lambda text: F.unhex(F.hex(F.length(text) % 3))
    check(exact.duplicates(frame(spark, rows()), weak).collect(), want, stays)
    check(exact.duplicates(frame(spark, rows()), lambda text: F.lit(b"")).collect(), want, stays)


def test_keep_first_returns_rows_as_they_were(spark):
    df = frame(spark, rows())
    got = exact.keep_first(df)
    assert got.columns == df.columns
    _, stays = plain(rows())
    normal = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows()}
    got = got.collect()
    assert len(got) == len(stays) == len(normal)
    assert {r["doc_id"] for r in got} == {rows()[k][0] for k in stays}
    assert {(r["key"], r["row"], r["group_size"]) for r in got} == {(1, 2, 5)}


def test_empty_table(spark):
    df = frame(spark, rows()).limit(0)
    assert exact.duplicates(df).count() == 0 and exact.keep_first(df).count() == 0
