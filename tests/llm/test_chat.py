import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from newsignal.llm import chat
from pyspark.sql import functions as F

TURNS = f"conv_id long, turn long, role string, parts {chat.PARTS}"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
CONTROLS = st.lists(st.sampled_from(["<|", "<", "|", "\\", "</s>", "<s>", "[INST]", "[/INST]", "[", "end|>", "<|end|>\n", "x", "\n"])).map("".join)


@settings(max_examples=1500, deadline=None)
@given(CONTROLS | st.text())
def test_escape_is_reversible_and_leaves_no_control_string(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


@settings(max_examples=500, deadline=None)
@given(CONTROLS, st.lists(CONTROLS, max_size=3))
def test_turn_round_trip(role, texts):
    parts = []
    for i, t in enumerate(texts):
        parts += [{"type": "text", "text": t}, {"type": "image", "ref": f"r{i}"}]
    made = chat.format_turn(role, parts, len, chat.Sizes(), (role,))
    assert chat.read_turn(made["formatted"])[0] == role
    body = chat.read_turn(made["formatted"])[1]
    assert body == made["formatted"][made["loss_start"] : made["loss_end"]]
    wanted = [p for p in parts if p["type"] != "text" or p["text"]]
    assert chat.read_parts(body, made["attachments"]) == wanted


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["text", "image", "odd"]), CONTROLS), max_size=6))
def test_neighbouring_texts_forge_nothing(drawn):
    parts = [{"type": k, "ref": t} if k == "image" else {"type": k, "text": t} for k, t in drawn]
    made = chat.format_turn("user", parts, len, chat.Sizes(), ())
    body = chat.read_turn(made["formatted"])[1]
    read = chat.read_parts(body, made["attachments"])
    assert [p["ref"] for p in read if p["type"] == "image"] == [t for k, t in drawn if k == "image"]
    joined, wanted = [], []
    for k, t in drawn:
        if k == "image":
            wanted += ["".join(joined), None]
            joined = []
        else:
            joined.append(t)
    wanted.append("".join(joined))
    assert [p.get("text") for p in read] == [w for w in wanted if w != ""]


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def test_parts_placeholders_and_tokens(spark):
    parts = [
        part("text", "see <|image:0|>"), part("image", ref="a.png", width=56, height=29), part("audio", ref="b.wav", seconds=1.5),
        part("document", ref="c.pdf", pages=3), part("image"), None, part(None, "end"),
    ]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [part("text", "yes")]), (2, None, None, None), (2, 3, "tool", [])]
    got = {(r.conv, r.turn): r for r in chat.format_turns(spark.createDataFrame(rows, TURNS)).collect()}
    first = got[1, 0]
    assert first.formatted == "<|turn|>user\nsee <\\|image:0|><|image:0|><|audio:1|><|document:2|><|image:3|>end<|end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in first.attachments] == [
        ("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 3072), ("image", None, 256)
    ]
    assert first.tokens == 2 + 4 + 38 + 3072 + 256 + 1 and first.loss_start == first.loss_end
    learned = got[1, 1]
    assert learned.formatted[learned.loss_start : learned.loss_end] == "yes"
    assert got[2, None].formatted == "<|turn|>\n<|end|>\n"


def test_tokenizer_file_counts(spark):
    rows = [(1, 0, "user", [part("text", "Hello world <|endoftext|>")])]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    found = chat.format_turns(spark.createDataFrame(rows, TURNS), vocabulary=VOCABULARY).first()
    assert found.tokens == len(tokenizer.encode("Hello world <|endoftext|>", add_special_tokens=False).ids)


def test_unknown_part_is_text(spark):
    rows = [(1, 0, "user", [part("video", "a <"), part("text", "s> b"), part("video")])]
    row = chat.format_turns(spark.createDataFrame(rows, TURNS)).first()
    assert chat.read_turn(row.formatted)[1] == chat.escape("a <s> b") and row.tokens == 3


def test_digests_over_batches_and_ties(spark):
    import hashlib

    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(c, t, "assistant" if t % 2 else "user", f"{c} <|{t}") for c in range(5) for t in range(10)]
        rows += [(0, 3, "assistant", "0 <|3"), (None, 0, "user", "x"), (9, 0, None, None)]
        turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
        found = chat.digests(chat.format_turns(turns.withColumn("parts", chat.text_parts(F.col("text")))))
        got = {r.conv: r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == 7
    for conv, r in got.items():
        own = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv))
        whole = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_no_turns(spark):
    assert chat.digests(chat.format_turns(spark.createDataFrame([], TURNS))).count() == 0
