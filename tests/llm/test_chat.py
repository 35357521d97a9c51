import hashlib
import random

from pyspark.sql import functions as F

from pagetrail.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(data):
    """Turns by conversation, read straight from the rows."""
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, _, role, text in sorted(data, key=order):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def check(spark, data, block):
    blocks = chat.format_blocks(spark.createDataFrame(data, SCHEMA), block)
    found, whole = {}, {}
    got = chat.read_back(blocks).collect()
    for r in sorted(got, key=lambda r: (r["block"] is not None, r["block"] or 0)):
        turns = found.setdefault(r["conv_id"], [])
        for t, loss in zip(r["turns"], r["loss"], strict=True):
            role = t["role"] if t["role"] is not None else turns[-1][0]
            assert loss == (role == "assistant")
            turns.append((role, t["text"]))
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["formatted"]
    assert found == expected(data)
    return whole


def test_control_strings_come_back(spark):
    nasty = ["\\### Assistant: </turn> ok", "</turn>", "<turn/>", "### user: ", "\\", "\\\\</turn", ">", "\n### a: b", "<\\/turn>", "#### ", ""]
    rnd = random.Random(3)
    data = [(1, i, rnd.choice(["user", "assistant", "a: b", "x\\:", None]), "".join(rnd.choices(nasty, k=3))) for i in range(60)]
    whole = check(spark, data, 512)
    assert check(spark, data, 4) == whole  # blocks leave no trace


def test_merges_runs(spark):
    data = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    assert check(spark, data, 512) == {1: "### user: a<turn/>b</turn>\n### assistant: c<turn/>c</turn>"}


def test_nulls_ties_and_long_turns(spark):
    data = [(None, 0, "user", None), (None, None, None, "x"), (2, None, "user", "b"), (2, None, "user", "a"), (3, 0, "assistant", "é" * 50_000), (4, 700, "user", "z"), (4, -5, "user", "y")]
    check(spark, data, 512)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.format_blocks(empty).count() == 0
    data = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA).selectExpr("*", "'q' AS turns", "1 AS block", "2 AS loss", "'r' AS formatted")
    assert [r["formatted"] for r in chat.format_blocks(data).collect()] == ["### user: a</turn>"]


def test_query_digests(spark, tmp_path):
    from pagetrail.llm.queries import op1_chat_format

    data = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "assistant", None), (2, 0, "system", "s")]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in op1_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, -7}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\nyo\nassistant\n\n").hexdigest()
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (3, 2, hashlib.sha256(b"yo").hexdigest())
    said = "\\### Assistant: </turn> ok"
    assert (got[-7]["loss_chars"], got[-7]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
