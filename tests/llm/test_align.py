import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from techatlas.llm import align, queries

from . import brute

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _letters():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in keep}, 256
    for b in range(256):
        if b not in keep:
            out[chr(n)] = b
            n += 1
    return out


def plain(rows):
    """Figures of rows (doc_id, text), from whole-text tokenizing and all overlapping ranges."""
    ta, tb, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), _letters()
    ta.encode_special_tokens = True
    docs = []
    for doc_id, text in rows:
        a = ta.encode(" " + (text or ""), add_special_tokens=False).ids
        b = tb.encode(text or "")
        bytes_a = [bytes(letters[c] for c in ta.id_to_token(x)) for x in a]
        names = [tb.id_to_piece(x) for x in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if tb.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b, names)]
        own = b" " + (text or "").encode()
        if not text or b"".join(bytes_a) != own or b"".join(bytes_b) != own:
            docs.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        begins_a, begins_b = ends_a - [len(x) for x in bytes_a], ends_b - [len(x) for x in bytes_b]
        links = []
        for i in range(len(a)):
            first = int(np.searchsorted(ends_b, begins_a[i], side="right"))
            while first < len(b) and begins_b[first] < ends_a[i]:
                links.append((a[i], b[first]))
                first += 1
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        groups, i, j = [], 0, 0
        for p, q in zip(np.searchsorted(ends_a, cuts) + 1, np.searchsorted(ends_b, cuts) + 1):
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        docs.append((doc_id, a, b, groups, links))
    counts = Counter(x for d in docs for x in d[4])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(
        (
            (
                i,
                len(a),
                len(b),
                len(g),
                len(links),
                sum(counts[x] == most[x[1]] for x in links),
                sum(counts[x] for x in links),
                hashlib.sha256(";".join(g).encode()).hexdigest() if g else "",
            )
            for i, a, b, g, links in docs
        ),
        key=repr,
    )


def texts():
    rnd = random.Random(2)
    signs = "aAbé ÉßİΣσς́  　中文字123'sl'LL\t\n\r\x0b\x0c\x1c\x85  😀.,!?_-  "
    odd = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(250)]
    words = ["".join(rnd.choice("abcdeéthing") for _ in range(rnd.randint(1, 9))) for _ in range(200)]
    lines = [rnd.choice([" ", "\n", "  ", " \n"]).join(rnd.choices(words, k=rnd.randint(1, 400))) for _ in range(40)]
    named = ["<|endoftext|> and <s>x</s> <unk> <0x41>", "has ▁ inside", "▁", " ", "  ", " x", "x ", "\nx", "it's we'll I'M", "\u0000 zero"]
    return [*odd, *lines, *named, "", None, "x" * 5000, "ab " * 3000, "same text", "same text", "a" + " " * 500 + "b"]


@pytest.fixture
def frame(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "nameless one"), (3, "other text of three")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], brute.DOCS)
    return rows, df.selectExpr("*", "1 as row", "2 as pairs", "3 as n_a").repartition(3)


@pytest.mark.parametrize("tight", [False, True])
def test_equal_to_comparing_all_ranges(frame, monkeypatch, tight):
    rows, df = frame
    if tight:
        for name, value in (("SLICE", 300), ("LANE", 2), ("TEXT_AT_ONCE", 2000), ("LONG_PART", 5), ("MEMORY", 3000)):
            monkeypatch.setattr(align, name, value)
    got = sorted((tuple(r) for r in align.alignment(df, A, B).collect()), key=repr)
    assert got == plain(rows)


def test_links_and_cuts_of_a_row(frame):
    rows, df = frame
    got = {r["doc_id"]: r for r in align.align(df.where("doc_id = 5 or text = 'x '"), A, B).collect()}
    for r in got.values():
        links = np.frombuffer(r["pairs"], "<u4")
        cuts = np.unpackbits(np.frombuffer(r["cuts"], np.uint8))[: len(links)]
        assert len(links) == r["n_links"] and cuts.sum() == r["n_groups"] and (not len(cuts) or cuts[-1])


def test_merge_by_hand():
    # lanes "abc" (ab|c and a|bc) and "de" (de and d|e)
    a, b, cut = align.merge(np.array([2, 3, 5]), np.array([1, 3, 4, 5]), np.array([0, 2, 3]), np.array([0, 2, 4]))
    assert list(zip(a.tolist(), b.tolist(), cut.tolist())) == [(0, 0, False), (0, 1, False), (1, 1, True), (2, 2, False), (2, 3, True)]


def test_memory_of_a_worker_is_bounded(monkeypatch):
    monkeypatch.setattr(align, "MEMORY", 100_000)
    pair = align.Pair(A, B)
    for k in range(20):
        pair.of([["w%d" % (100 * k + j) for j in range(100)]])
        assert pair.known.held <= 50_500 and len(pair.known.young) + len(pair.known.old) < 400
    assert pair.known.among(["w1999", "w0"]).keys() == {"w1999"}


def test_query_and_empty_table(spark, frame):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_lockstep"](spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)
    empty = align.alignment(frame[1].limit(0), A, B)
    assert empty.count() == 0 and empty.columns == got.columns
