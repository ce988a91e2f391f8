import hashlib
import random

from techatlas.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The same by plain loops over sorted rows."""

    def first(x):
        return (x is not None, x if x is not None else 0)

    convs = {}
    for c, turn, who, text in rows:
        text = text or ""
        key = (first(turn), (who is not None, who or ""), hashlib.md5(text.encode()).hexdigest())
        convs.setdefault(c, []).append((key, who, text))
    out = []
    for c, messages in convs.items():
        messages.sort(key=lambda m: m[0])
        for p in {who for _, who, _ in messages} - {None, "system"}:
            start = 0
            for k, (_, who, text) in enumerate(messages):
                role = "assistant" if who == p else "system" if who == "system" else "user"
                name = who if role == "user" else None
                head = "<|im_start|>" + role + (f" name={name}" if name else "") + "\n"
                full = head + text + "<|im_end|>\n"
                own = role == "assistant"
                mask = (start + len(head), len(text) + len("<|im_end|>")) if own else (None, 0)
                out.append((c, p, k, role, name, full, start, own, *mask))
                start += len(full)
    return sorted(out, key=repr)


def test_rotation_equals_plain_loops(spark):
    rnd = random.Random(4)
    people = ["ann", "bob", "cé", None, "system"]
    rows = [(c, t, rnd.choice(people), rnd.choice(["", None, "hi", "ünï\nx", "long " * 50])) for c in range(12) for t in range(rnd.randint(0, 9))]
    rows += [(99, t % 700, rnd.choice(people), f"m{t % 5}") for t in range(1500)]  # hot, with ties and repeats
    rows += [(None, 1, "ann", "a"), (None, None, "bob", "b"), (50, 1, "system", "alone"), (51, 0, None, "nobody")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "'x' as perspective", "2 as size")
    got = sorted((tuple(r) for r in chat.rotate(df.repartition(6)).collect()), key=repr)
    assert got == brute(rows)


def test_masks_cover_exactly_the_assistants_texts(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello"), (1, 3, "ann", "bye")]
    got = chat.rotate(spark.createDataFrame(rows, SCHEMA)).orderBy("perspective", "position").collect()
    for p, said in (("ann", ["hi", "bye"]), ("bob", ["hello"])):
        mine = [r for r in got if r["perspective"] == p]
        whole = "".join(r["rendered"] for r in mine)
        cut = [whole[r["mask_start"] : r["mask_start"] + r["mask_length"]] for r in mine if r["trained"]]
        assert cut == [s + "<|im_end|>" for s in said]


def test_empty_table(spark):
    assert chat.rotate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op1_perspectives"](spark, sf).collect()), key=repr)
    assert got == brute(rows)
