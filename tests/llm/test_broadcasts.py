"""What grows with the corpus is joined without broadcasts, however small Spark takes it to be from its files."""

from techatlas.llm import minhash, shared, spaced, spans

from . import brute

#: Broadcasts of bounded size: buckets of the filter, seeds and items of a counted benchmark.
BOUNDED = ("__bucket", "seed#", "item#")


def test_stages_broadcast_only_what_is_bounded(spark, monkeypatch):
    """Plans as they are before anything is shuffled, that is sized by files."""
    joins = []

    def recorded(df, purpose, *args, **options):
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins.extend((purpose, line) for line in plan.splitlines() if "Join" in line)
        return materialize(df, purpose, *args, **options)

    materialize = shared.materialize
    for module in (shared, minhash, spans, spaced):
        monkeypatch.setattr(module, "materialize", recorded)
    # two near copies in families too large for one tile, exact copies, repeated passages and a leak
    monkeypatch.setattr(minhash, "TILE", 2)
    words = [" ".join(f"w{k}x{d}" for k in range(40)) for d in range(4)]
    docs = [(10 * d + k, f"{text}. And more {k} here. {words[0]}.", "en", "s", 1) for d, text in enumerate(words) for k in range(4)]
    docs += [(100 + i, text, *rest) for i, text, *rest in docs]
    df = spark.createDataFrame(docs, brute.DOCS)
    kept = minhash.one_per_group(df)
    kept = recorded(kept, "kept")
    recorded(spans.cut_rows(kept), "cut")
    recorded(spaced.clean_rows(kept, spark.createDataFrame([(1, words[1])], "item_id long, text string")), "clean")
    assert {p for p, _ in joins} >= {"edges", "members", "sets", "cut", "clean", "kept"}
    joins = [(p, line) for p, line in joins if not any(b in line for b in BOUNDED)]
    # tiles of families of over a thousand members each
    joins = [(p, line) for p, line in joins if p not in ("tiles", "links") or "family#" not in line]
    wide = [(p, line) for p, line in joins if "Broadcast" in line]
    assert not wide, wide
