import random

from techatlas.llm import queries, spans

from . import brute


def plain(docs):
    """Removed sentences of every distinct document, by a table of all runs."""
    places = {}
    for d, text in sorted(set(docs), key=repr):
        own = [text.encode()[a:b].lower().split() for a, b in spans.sentences((text or "").encode())] if text else []
        size = min(spans.RUN, len(own))
        for i in range(len(own) - size + 1):
            run = own[i : i + size]
            if sum(map(len, run)) >= spans.LEAST_WORDS:
                places.setdefault(tuple(w for s in run for w in s), []).append((d, text, i, size))
    return places


def removed_of(spark, docs):
    """With the first occurrence by (doc_id, hash of the text, sentence), as the operator defines it."""
    hashes = {
        r["text"]: r["h"]
        for r in spark.createDataFrame([(t,) for t in {t for _, t in docs}], "text string").selectExpr("text", "xxhash64(text) as h").collect()
    }
    out = {}
    for found in plain(docs).values():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]], x[2]))
        for d, text, i, size in found[1:]:
            out.setdefault((d, text), set()).update(range(i, i + size))
    return out


def fixture(seed):
    rnd = random.Random(seed)

    def sentence():
        return " ".join(rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 40))).capitalize() + rnd.choice([".", "!", "?", "...\n"])

    shared = [" ".join(sentence() for _ in range(rnd.randint(3, 8))) for _ in range(6)]
    docs = []
    for d in range(120):
        parts = [sentence() for _ in range(rnd.randint(0, 12))]
        if d % 2:
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice(shared))
        docs.append((d, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, " \n "), (None, shared[0]), (203, shared[1] + " " + shared[1]), docs[1], (3, docs[5][1])]
    docs += [(204, "no end " * 20000), (205, "Short. One. Two."), (206, "Short. One. Two."), (207, ("é è. " * 9))]
    two = " ".join(f"t{k}" for k in range(15)) + ". And " + " ".join(f"u{k}" for k in range(7)) + "."
    docs += [(d, two) for d in range(210, 214)] + [(214, two + " More words follow."), (215, "One sentence of nine words only, no more here."), (216, "One sentence of nine words only, no more here.")]
    return docs


def test_removal_equals_plain_table(spark):
    docs = fixture(2)
    df = spark.createDataFrame([(d, t, "en", "s", -1) for d, t in docs], brute.DOCS).selectExpr("*", "1 as sentence", "2 as span", "3 as removed")
    want = removed_of(spark, docs)
    got = {(r["doc_id"], r["text_hash"]): list(r["removed"]) for r in spans.covered(df.repartition(4)).collect()}
    assert sorted(map(sorted, want.values())) == sorted(got.values()) and len(want) > 30
    df = df.selectExpr("*", "7 as __hash", "8 as __id", "9 as ___removed")
    cut = spans.cut_rows(df)
    assert cut.columns == df.columns
    assert {tuple(r) for r in cut.select("__hash", "__id", "___removed").distinct().collect()} == {(7, 8, 9)}
    rows = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in cut.collect()), key=repr)
    left = []
    for d, t in docs:
        gone = want.get((d, t))
        text = spans.without(t.encode(), list(gone)).decode() if gone else t
        left.append((d, text, len(text) if gone else -1))
    assert rows == sorted(left, key=repr)


def test_texts_of_few_sentences_are_cut_once(spark):
    """Copies of one and two sentences lose everything, but for the first."""
    texts = ["alpha " + " ".join(f"a{k}" for k in range(12)), " ".join(f"b{k}" for k in range(9)) + ". Second one: " + " ".join(f"c{k}" for k in range(9)) + "."]
    docs = [(10 * i + d, t) for i, t in enumerate(texts) for d in range(4)]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], brute.DOCS)
    left = {r["doc_id"]: r["text"] for r in spans.cut_rows(df).collect()}
    assert left == {d: t if d in (0, 10) else "" for d, t in docs}
    assert sorted(r["removed"] for r in spans.changed(df).collect()) == [[0]] * 3 + [[0, 1]] * 3


def test_passages_of_fifty_words_are_cut_once(spark):
    """However a passage is punctuated, only its first place keeps it."""
    rnd = random.Random(5)
    for ends in (51, 26, 9):
        passage = " ".join(f"p{k}q{ends}" + ("." if k % ends == ends - 1 or k == 50 else "") for k in range(51))
        docs = [(d, f"Own start {d} {rnd.random()}.\n{passage}\nOwn end {d} {rnd.random()} here.") for d in range(5)]
        df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], brute.DOCS)
        left = {r["doc_id"]: r["text"] for r in spans.cut_rows(df).collect()}
        assert left[0] == docs[0][1]
        assert all(f"p0q{ends}" not in left[d] and f"p50q{ends}" not in left[d] for d in range(1, 5))
        assert all(f"Own start {d}" in left[d] and "here." in left[d] for d in range(5))


def test_passages_inside_long_sentences_are_cut_at_any_offset(spark):
    """60 words without a full stop after 1 to 30 other words: all but some words at the ends go."""
    passage = [f"p{k}q" for k in range(60)]
    docs = [(d, " ".join([*(f"b{d}x{k}" for k in range(1 + d)), *passage, *(f"e{d}x{k}" for k in range(30 - d))])) for d in range(30)]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], brute.DOCS)
    left = {r["doc_id"]: r["text"].split() for r in spans.cut_rows(df).collect()}
    assert left[0] == docs[0][1].split()
    for d in range(1, 30):
        own = [w for w in docs[d][1].split() if w not in passage]
        assert [w for w in left[d] if w not in passage] == own
        assert len(left[d]) - len(own) <= 20


def test_passages_of_short_sentences_are_cut_once(spark):
    """60 words in sentences of one and two words: all but some words at the ends go, equal texts lose everything."""
    one = " ".join(f"p{k}!!" for k in range(60))
    two = " ".join(f"p{k} q{k}." for k in range(30))
    same = "word!! " * 60
    for passage in (one, two, same):
        docs = [(d, f"Own start {d}{d}a {d}b {d}c.\n{passage}\nOwn end {d}a {d}b {d}c here.") for d in range(3)]
        docs += [(10, passage), (11, passage)]
        df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], brute.DOCS)
        left = {r["doc_id"]: r["text"].split() for r in spans.cut_rows(df).collect()}
        assert left[11] == []
        for d in (1, 2):
            own = [w for w in docs[d][1].split() if w not in passage.split()]
            assert [w for w in left[d] if w not in passage.split()] == own
            assert len(left[d]) - len(own) <= 20


def test_no_run_is_too_short():
    rnd = random.Random(9)
    for _ in range(300):
        text = " ".join(" ".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([1, 1, 2, 3, 5, 9, 30]))) + "." for _ in range(rnd.randint(0, 40)))
        words = [len(text[a:b].split()) for a, b in spans.sentences(text.encode())]
        assert sum(words) == len(text.split()) and max(words, default=0) <= spans.LONGEST
        assert all(sum(words[i : i + spans.RUN]) >= spans.LEAST_WORDS for i in range(len(words) - spans.RUN + 1))
        assert len(words) >= spans.RUN or sum(words) <= 2 * spans.LONGEST


def test_sentences_make_up_the_text():
    for _, t in fixture(3):
        text = (t or "").encode()
        parts = spans.sentences(text)
        assert b"".join(text[a:b] for a, b in parts).split() == text.split()
        assert all(0 < len(text[a:b].split()) <= spans.LONGEST for a, b in parts)


def test_empty_table_and_query(spark):
    df = spark.createDataFrame([], brute.DOCS)
    assert spans.cut_rows(df).count() == 0 and spans.changed(df).count() == 0
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: sorted(v) for (d, _), v in removed_of(spark, docs).items()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_sentence_spans"](spark, sf).collect()}
    assert {d: list(r["removed"]) for d, r in got.items()} == want
    texts = dict(docs)
    assert all(r["text"] == spans.without(texts[d].encode(), want[d]).decode() for d, r in got.items())
