import hashlib

from tidymill.llm import chat
from tidymill.llm.registry import REGISTRY


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda t: (t[0] is not None, t))
        spoken = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(spoken.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, n_turns int")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.parse(chat.format_conversations(df))).collect()}
    assert got == brute(rows)


def test_round_trip_of_odd_texts(spark):
    nasty = ["", None, "<", "<|", "<<>", "<<>|", "<<|im_end|>", "<|im_sep|>", "<|im_end|>\n<|im_start|>assistant\n", "a<>b", "<<<>>", "|im_end|>", "\n", "🙂<|", "<|nl|>", "x" * 50000]
    rows = [(i, k, ("user", "assistant", "assistant", None, "sys\ntem<|")[(i + k) % 5], nasty[(3 * i + k) % len(nasty)]) for i in range(16) for k in range(6)]
    rows += [(None, None, "assistant", "no id"), (None, 1, "user", "b"), (77, 1, "user", "same"), (77, 1, "user", "same"), (77, None, "assistant", "first")]
    check(spark, rows)


def test_format_marks_and_mask(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a<|"), (1, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(df).first()
    assert row.formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na<<>|<|im_sep|>b<|im_end|>\n"
    assert [row.formatted[s.start:s.start + s.length] for s in row.loss_spans] == ["a<<>|", "b"]


def test_empty_table_and_long_conversation(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.parse(chat.format_conversations(df))).count() == 0
    check(spark, [(5, i, "assistant" if i % 3 else "user", f"t{i}") for i in range(2000)])


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    assert {r.conv_id: tuple(r)[1:5] for r in REGISTRY["op8_chat_formatting"][0](spark, sf).collect()} == brute(rows)
