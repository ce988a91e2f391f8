import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from techatlas.llm import packing, queries
from techatlas.llm.queries import tokenizer_path

from . import brute


def expected(texts):
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, packing.END] for x in texts]


def odd_texts():
    rnd = random.Random(1)
    signs = "aAé ÉßİΣσς́  　中文字123'sl'LL\t\n\r\x0b\x0c\x1c\x85😀.,!?<|endoftext|>_-"
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 80))) for _ in range(300)] + [
        "<|startoftext|> it's <|endoftext|>", "I'LL we've", "x" * 20000, "word " * 30000, "", None, " ", "ΟΔΥΣΣΕΥΣ ΣΑΣ. ΣΑΣ",
    ]


def test_ids_equal_the_tokenizers_for_whole_texts():
    texts = odd_texts()
    ids = packing.Ids(tokenizer_path())
    got = ids.documents([(t or "").encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == expected(texts)


def test_letters_and_their_signs_are_encoded_apart_and_many_at_once(monkeypatch):
    """A word costs one encoding whatever its case and the signs behind it; letters written with marks are left whole."""
    ids = packing.Ids(tokenizer_path())
    calls, batches = [], []
    plain, letters = ids.encoded, ids.encoded_letters
    monkeypatch.setattr(ids, "encoded", lambda parts: calls.extend(parts) or plain(parts))
    monkeypatch.setattr(ids, "encoded_letters", lambda parts: batches.append(sorted(parts)) or letters(parts))
    texts = ["Word word. WORD, word?! (word) Über über- ", "it's \u0130- \u0958. \ufb2a! \u03a3\u03a3. \u03a3\u03a3 e\u0301. H\u0331 h\u0331 \u01f0."]
    got = ids.documents([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == expected(texts)
    assert batches == [sorted(x.encode() for x in ["word", "Über", "über", "ΣΣ", "\u01f0"])]
    assert not {b"Word", b"word.", b"WORD,", b"word?!"} & set(calls) and {b"(word)", b"it's", "\u0130-".encode(), "\u0958.".encode()} <= set(calls)


def test_memory_of_a_worker_is_bounded_and_changes_no_ids(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 20_000)
    ids, texts = packing.Ids(tokenizer_path()), odd_texts()
    for k in range(0, len(texts), 20):
        some = texts[k : k + 20]
        got = ids.documents([(t or "").encode() for t in some])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == expected(some)
        assert ids.known.held <= 10_500


def test_pieces_are_an_exact_round_trip(spark):
    texts = [*odd_texts(), "twice", "twice"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "nameless", "en", "s", 1)]
    df = spark.createDataFrame(rows, brute.DOCS).selectExpr("*", "1 as ids", "2 as start", "3 as length").repartition(3)
    got = packing.pack(df, tokenizer_path(), 256).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    want = dict(zip([r[0] for r in rows], expected([r[1] for r in rows])))
    assert set(by) == set(want)
    for d, pieces in by.items():
        pieces.sort(key=lambda r: r["start"])
        flat = [x for r in pieces for x in np.frombuffer(r["ids"], "<u4").tolist()]
        assert flat == want[d]
        at = 0
        for r in pieces:
            n = r["length"]
            assert r["start"] == at and n & (n - 1) == 0 and n <= 256 and 1 << r["bucket"] == n and r["offset"] == 0
            assert r["doc_tokens"] == len(flat)
            at += n
        rest = [r["length"] for r in pieces if r["length"] < 256]
        assert len(set(rest)) == len(rest)
    assert len({r["sequence_id"] for r in got}) == len(got)
    assert packing.pack(df.limit(0), tokenizer_path()).count() == 0


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(docs, expected(docs.values())))
    got = queries.QUERIES["op8_powers_of_two"](spark, sf).collect()
    assert sum(r["length"] for r in got) == sum(map(len, want.values()))
    for r in got:
        ids = np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes()) and r["doc_tokens"] == len(want[r["doc_id"]])


def test_buckets_are_written_by_length(spark, tmp_path):
    df = spark.createDataFrame([(1, "one two three four five", "en", "s", 1)], brute.DOCS)
    packing.write_buckets(packing.pack(df, tokenizer_path()), str(tmp_path / "out"))
    assert {r["bucket"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 2}
