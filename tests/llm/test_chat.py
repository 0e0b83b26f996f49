import random

from pyspark.sql import functions as F

from orderscope.llm import chat as C
from orderscope.llm.queries import ORACLES, QUERIES

from ..conftest import SF_SMALL
from .oracle import same

P = "conv_id long, turn long, role string, parts " + f"array<{C.PART}>, formatted string"
text = lambda t: ("text", t, None, None, None, None, None)


def test_query_matches_sql_and_plan_is_native(spark):
    assert same(spark, QUERIES["op3_chat_format"], ORACLES["op3_chat_format"], SF_SMALL)
    talks = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").withColumn("parts", C.text_parts(F.col("text")))
    plan = C.read_back(C.format_conversations(talks))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_any_text_comes_back(spark):
    rng = random.Random(7)
    bits = ["<", "[", "\\", "s>", "/s>", "</s>", "[INST]", "[/INST]", "<|", "|", "<\\|", "<\\\\/s>", "\n", "é", "🙂", "a",
            "$1", "<|image:0|>", "INST]"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "a b\n/é", ""]), [text(t)], "x"))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = {r.conv_id: r for r in C.read_back(C.format_conversations(spark.createDataFrame(shuffled, P))).collect()}
    for conv in range(40):
        want = [(r[2], r[3][0][1]) for r in rows if r[0] == conv]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        assert got[conv].loss_texts == [t for role, t in want if role == "assistant"]


def test_typed_parts(spark):
    parts = [text("see <|image:0|> "), ("image", None, "a.png", 57, 28, None, None), ("audio", "ignored", "b.wav", None, None, 2.01, None),
             text(" and "), ("document", None, None, None, None, None, 3), ("image", None, "c.png", None, None, None, None),
             ("table", "t", None, None, None, None, None)]
    rows = [(1, 0, "user", parts, ""), (1, 1, "assistant", [text("ok")], ""), (1, 2, "user", parts[1:2], "")]
    r = C.read_back(C.format_conversations(spark.createDataFrame(rows, P))).first()
    first = "[INST]user\nsee <\\|image:0|> <|image:0|><|audio:1|> and <|document:2|><|image:3|>t[/INST]"
    assert r.formatted == first + "<s>assistant\nok</s>[INST]user\n<|image:0|>[/INST]"
    assert [tuple(a) for a in r.attachments] == [
        (0, 0, "image", "a.png", 3), (0, 1, "audio", "b.wav", 26), (0, 2, "document", None, 768), (0, 3, "image", "c.png", 0),
        (2, 0, "image", "a.png", 3)]
    assert r.expanded_tokens == 3 + 26 + 768 + 3 and r.loss_texts == ["ok"]


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None, None, None, ""), (1, 1, "user", [text(None)], ""), (1, 1, "user", [text(None)], ""),
            (1, None, "assistant", [], "")]
    df = spark.createDataFrame(rows, P)
    got = {r.conv_id: r for r in C.read_back(C.format_conversations(df)).collect()}
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant", ""), ("user", ""), ("user", "")]
    assert got[1].loss_texts == [""] and C.format_conversations(df.limit(0)).count() == 0
