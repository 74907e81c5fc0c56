import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import chat

HOSTILE = ["", "plain", "<|turn|>", "a<", "|x", "<\\|end|>", "<\\\\|", "</s>[INST] ok [/INST]", "[\\INST]<s>", "<<|<|", "\\", "[/INST", "é日本😀<|text|>é", "\n\r\n", "<\\", "$1\\$2"]
SCHEMA = "conv_id long, turn long, role string, text string"


def digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        under = "".join(r[3] or "" for r in own if r[2] == "assistant")
        marked = lambda x: len(x or "") + len(re.findall(r"[<\[]\\*(?=\||/?s>|/?INST\])", x or ""))
        size = sum(marked(r[2]) + marked(r[3]) + len(chat.TURN + chat.TEXT + chat.END) for r in own)
        out[conv] = (len(own), hashlib.sha256(told.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), size)
    return out


def result(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in df.collect()}


def test_hostile_texts_come_back(spark):
    rows = [(i % 5, i, ("user", "assistant")[i % 2], a + b) for i, (a, b) in enumerate((a, b) for a in HOSTILE for b in HOSTILE)]
    assert result(chat.chat_digests(spark.createDataFrame(rows, SCHEMA))) == digests(rows)


def test_odd_rows(spark):
    long = "x<|y " * 200_000
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "a"), (1, 3, "assistant", "b"), (1, 3, "assistant", "b"), (None, 0, "assistant", "c"), (None, 1, "we<|turn|>ird\n", ""), (2, 0, "assistant", long), (3, 1, "assistant", "z"), (3, 1, "assistant", "y"), (3, 1, "assistant", None)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "conv_id as formatted", "turn as loss", "text as parts", "1 as no", "2 as starts", "3 as rendered")
    assert result(chat.chat_digests(frame)) == digests(rows)
    assert chat.chat_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_positions_hold_in_the_whole_string(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(HOSTILE)]
    row = chat.format_chat(spark.createDataFrame(rows, SCHEMA)).first()
    under = [row["formatted"][row["turn_starts"][s["turn"]] + s["start"] :][: s["length"]] for s in row["loss"]]
    back = [re.sub(r"([<\[])\\(\\*)(?=\||/?s>|/?INST\])", r"\1\2", x) for x in under]
    assert back == [t for i, t in enumerate(HOSTILE) if i % 2]


def test_typed_parts_become_placeholders(spark):
    content = """[{"type":"text","text":"see <|image|>"},{"type":"image","ref":"a.png","width":57,"height":28},
        {"type":"text","text":"|>"},{"type":"audio","ref":"b.wav","seconds":2.0},{"type":"document","ref":"c.pdf","pages":["one",null]},
        {"type":"video","ref":"d.mp4"},{"type":"image","width":-5},null]"""
    rows = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", "[1] no list of parts"), (2, 0, "assistant", None)], SCHEMA)
    made = chat.format_chat(rows, chat.json_parts(F.col("text")))
    first, second = made.orderBy("conv_id").collect()
    assert first["formatted"] == (
        "<|turn|>user<|text|>see <\\|image|><|image|><|text|>|><|audio|><|page|><|text|>one<|page|><|text|><|other|><|image|><|end|>"
        "<|turn|>assistant<|text|>[1] no list of parts<|end|>"
    )
    assert [(a["turn"], a["kind"], a["ref"], a["tokens"]) for a in first["attachments"]] == [
        (0, "image", "a.png", 3), (0, "audio", "b.wav", 25), (0, "page", "c.pdf", 256), (0, "page", "c.pdf", 256), (0, "other", "d.mp4", 1), (0, "image", None, 1)]
    for a in first["attachments"]:
        assert first["formatted"][a["start"] :].startswith(f"<|{a['kind']}|>")
    assert first["expanded_tokens"] == 542 and second["expanded_tokens"] == 0
    assert second["formatted"] == "<|turn|>assistant<|text|><|end|>"
    back = chat.read_chat(made).orderBy("conv_id").first()
    assert [(p["kind"], p["text"]) for p in back["turns"][0]["parts"]][:3] == [("text", "see <|image|>"), ("image", ""), ("text", "|>")]
    assert back["loss_texts"] == ["[1] no list of parts"]


@pytest.mark.parametrize("parts", [[], None])
def test_no_parts(spark, parts):
    rows = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    assert chat.format_chat(rows, "parts").first()["formatted"] == "<|turn|>assistant<|end|>"


def test_no_python_in_the_plan(spark):
    from ledgerline.llm.queries import QUERIES

    plan = QUERIES["op11_chat_format"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)
