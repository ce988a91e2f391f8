import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from techatlas.llm import lm

from . import brute


def corpus(seed, n=400):
    rnd = random.Random(seed)
    vocab = [f"V{k}" for k in range(30)] + [f"r{k}" for k in range(200)]
    rows = []
    for i in range(n):
        w = [rnd.choice(vocab[: rnd.choice([5, 30, 230])]) for _ in range(rnd.randint(0, 30))]
        rows.append((i, " \t".join(w)))
    rows += [(900, None), (901, ""), (902, "\n"), (None, "v1 v2"), (3, rows[3][1]), (903, "never seen words"), (904, "v1 " * 9000)]
    return rows


def model(rows, order, floor):
    """Plain dictionaries: probability of a word after a history."""
    train = [brute.words(t) + ["</s>"] for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    one = Counter(w for s in train for w in s)
    total, types = sum(one.values()), len(one)
    z = total + 0.1 * (types + 1)
    least = max(2.0, floor * total)
    grams = Counter()
    starts = len(train)
    for s in train:
        s = ["<s>", *s]
        for n in range(2, order + 1):
            grams.update(tuple(s[k : k + n]) for k in range(len(s) - n + 1))
    frequent = {w for w, c in one.items() if w == "</s>" or c >= least} | {"<s>"}
    kept = {g: c for g, c in grams.items() if c >= least and set(g) <= frequent}
    after = {}
    for g in kept:
        after.setdefault(g[:-1], []).append(g[-1])

    def count(h):
        return kept[h] if len(h) > 1 else starts if h[0] == "<s>" else one[h[0]]

    def p(w, h):
        if not h:
            return (one[w] + 0.1) / z
        if (*h, w) in kept:
            return (kept[(*h, w)] - 0.5) / count(h)
        if h not in after:
            return p(w, h[1:])
        rest = 1 - sum((kept[(*h, x)] - 0.5) / count(h) for x in after[h])
        return rest / (1 - sum(p(x, h[1:]) for x in after[h])) * p(w, h[1:])

    return p, one, total, z


@pytest.mark.parametrize("order,floor", [(1, 1e-6), (2, 1e-6), (3, 1e-6), (3, 5e-3), (4, 1e-3)])
def test_scores_equal_plain_dictionaries(spark, order, floor):
    rows = corpus(order)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], brute.DOCS).selectExpr("*", "1 as row", "2 as words", "3 as n")
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm.score(df.repartition(5), order, floor).collect()}
    p, one, total, z = model(rows, order, floor)
    for i, t in rows:
        words = [*brute.words(t), "</s>"]
        r = got[i, len(words)]
        assert r["held_out"] == (zlib.crc32(str("" if i is None else i).encode()) % 10 == 0)
        assert r["train_tokens"] == total and r["n_known"] == sum(one[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((one[w] + 0.1) / z) for w in words), rel=1e-9)
        history = ["<s>"]
        score = 0.0
        for w in words:
            score += math.log10(p(w, tuple(history[-(order - 1) :]) if order > 1 else ()))
            history.append(w)
        assert r["score"] == pytest.approx(score, rel=1e-9)


def test_every_state_sums_to_one(spark):
    rows = corpus(8)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], brute.DOCS)
    blocks, tokens, least, norm = lm.automata(df.coalesce(1), 3)
    (row,) = [r.asDict() for r in blocks.collect()]
    block = lm.Block(row, 3, least)
    a = lm.Automaton(block, norm)
    counts = block.grams[0].counts
    words = np.array([w for w in range(a.width) if w != lm.START and counts[w] > 0])
    assert counts[words].sum() == tokens
    unseen = math.log10(0.1 / norm)
    with_arcs = set((a.arcs // a.width).tolist())
    checked = 0
    for state in range(len(a.fail)):
        if state == 1 + lm.START or state in with_arcs and a.weight[state] == 0:
            continue  # no text falls back from it: its weight was not asked for
        walk, down = state, unseen
        while walk:
            down, walk = down + a.weight[walk], a.fail[walk]
        _, log = a.step(np.full(len(words), state), words)
        below, through = state, True
        while below:
            through, below = through and not (below in with_arcs and a.weight[below] == 0), a.fail[below]
        if through:
            checked += 1
            assert (10**log).sum() + 10**down == pytest.approx(1.0, abs=1e-9)
    assert checked > 20


@pytest.mark.parametrize("order,tokens,stretch", [(1, 40, 3), (2, 40, 3), (3, 500, 1), (4, 7, 5)])
def test_blocks_and_lanes_of_any_size_give_the_same(spark, monkeypatch, order, tokens, stretch):
    """Texts go on in the next block and the next lane with the state they would have had."""
    rows = corpus(9, 60)[:-1] + [(904, "v1 r2 v2 v1 " * 50)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], brute.DOCS).coalesce(2)

    def result():
        return sorted(((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["score"], r["base_score"]) for r in lm.score(df, order).collect()))

    whole = result()
    small = {"BLOCK_TOKENS": tokens, "STRETCH": stretch, "TEXT_BYTES": 11}
    deal, walk = lm._deal, lm._walk

    def patched(make):
        def made(*args):
            def run(batches):
                for name, value in small.items():
                    setattr(lm, name, value)
                yield from make(*args)(batches)

            return run

        return made

    monkeypatch.setattr(lm, "_deal", patched(deal))
    monkeypatch.setattr(lm, "_walk", patched(walk))
    cut = result()
    assert [r[:3] for r in cut] == [r[:3] for r in whole]
    for got, want in zip(cut, whole, strict=True):
        assert got[3:] == pytest.approx(want[3:], rel=1e-9)


def test_no_rows_and_no_training_rows(spark):
    df = spark.createDataFrame([(None, "a b", "en", "s", 3)], brute.DOCS)
    r = lm.score(df).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (True, 3, 0, 0)
    assert lm.score(df.limit(0)).count() == 0


def test_held_out_texts_gain_over_the_base(spark):
    df = lm.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out")
    r = df.selectExpr("sum(score) as s", "sum(base_score) as b", "sum(n_tokens) as n").first()
    assert r["s"] / r["n"] > r["b"] / r["n"] + 0.1


def test_model_does_not_shrink_as_the_corpus_grows(spark):
    """A trigram that occurs twice counts among 1.5 million tokens as among a few."""
    rare = [(i, "one rare trigram") for i in (1, 3)]
    rows = [*rare, *((10 + i, "filler " * 30000) for i in range(55))]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], brute.DOCS)
    got = {r["doc_id"]: r for r in lm.score(df).collect()}
    p, one, total, z = model(rows, 3, 0.0)
    assert got[1]["train_tokens"] == total > 1.1e6 and one["rare"] == 2
    want = sum(math.log10(p(w, h)) for w, h in [("one", ("<s>",)), ("rare", ("<s>", "one")), ("trigram", ("one", "rare")), ("</s>", ("rare", "trigram"))])
    assert got[1]["score"] == pytest.approx(want, rel=1e-9)


def test_named_keys_travel_packed_in_ranges():
    """A block's keys are a few bytes each and one row a range; answers come in their order, without keys."""
    rnd = np.random.default_rng(5)
    pool = np.unique(rnd.integers(0, 2**63, 60_000).astype(np.uint64) * np.uint64(2))
    parts = {b: np.sort(rnd.choice(pool, 40_000, False)) for b in (7, 1 << 33)}
    counts = {b: rnd.integers(0, 3, len(k)) for b, k in parts.items()}
    table = lm.pa.Table.from_batches([lm._in_ranges(b, 5, k, n=counts[b]) for b, k in parts.items()])
    assert table.num_rows == 10 and table["key"].nbytes + table["n"].nbytes < 9 * 80_000
    total = Counter()
    for b, k in parts.items():
        total.update(dict(zip(k.tolist(), counts[b].tolist())))
    ranges = [table.filter(lm.pa.array([x == r for x in table["range"].to_pylist()])) for r in range(5)]
    answers = lm.pa.concat_tables([lm._sum(2.0)(t) for t in reversed(ranges)])
    first = set()
    for b, k in parts.items():
        own = answers.filter(lm.pa.array([x == b for x in answers["block"].to_pylist()]))
        want = [total[x] if total[x] >= 2 else 0 for x in k.tolist()]
        assert lm._answered(own, "c", "<i8").tolist() == want
        assert lm._answered(own, "own", bool).tolist() == [c > 0 and x not in first for x, c in zip(k.tolist(), want)]
        first |= set(k.tolist())
    assert "key" not in answers.column_names
    assert lm._in_ranges(7, 5, pool[:0], n=counts[7][:0]).num_rows == 0
    same = lm._distinct(np.repeat(parts[7], 2)[::-1])
    assert (same == parts[7]).all() and len(lm._distinct(pool[:0])) == 0
