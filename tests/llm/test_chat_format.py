import hashlib

from pyspark.sql import functions as F

from rentweave.llm import chat_format as C

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_end|> [INST] </s>"), (1, 2, "assistant", "é\\<|im_sep|> <\\|im_end|>"), (1, 3, "user", None),
    (1, 4, "assistant", ""), (2, 0, "assistant", "only"), (2, None, "user", "first"), (2, 5000, "assistant", "far off"), (3, 0, "user", "no reply"),
    (None, 0, "assistant", "lost"), (4, 1, "a\nb<|im_sep|>", "odd role"), (4, 1, "a\nb<|im_sep|>", "odd role"), (5, 0, None, "no role"), (6, 0, "assistant", "x" * 50_000),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(turns):
    groups = {}
    for conv, turn, role, text in turns:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, rows in groups.items():
        rows.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
        loss = "".join(t for _, _, r, t in rows if r == "assistant")
        out[conv] = (len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests_match_brute_force_whatever_the_run_size(spark, monkeypatch):
    turns = spark.createDataFrame([(*t, "extra", 0) for t in TURNS], SCHEMA + ", piece string, start long")
    for run in (1024, 2):
        monkeypatch.setattr(C, "RUN", run)
        got = {r["conv_id"]: r for r in C.digests(C.format_turns(turns)).collect()}
        assert {k: tuple(r)[1:5] for k, r in got.items()} == brute(TURNS)
        assert got[1]["n_examples"] == 2 and got[3]["loss_chars"] == 0


def test_examples_hold_all_that_came_before_and_train_on_the_reply_alone(spark):
    stream = C.format_turns(spark.createDataFrame(TURNS, SCHEMA)).cache()
    texts = {(r["conv_id"], r["turn"]): r for r in C.example_texts(stream).collect()}
    assert len(texts) == 6
    first, last = texts[(1, 2)], texts[(1, 4)]
    assert last["text"].startswith(first["text"]) and first["text"].count(C.OPEN) == 3 and last["text"].count(C.CLOSE) == 5
    reply = first["text"][first["loss_start"] : first["loss_stop"]]
    assert spark.range(1).select(C.unescape(F.lit(reply))).first()[0] == TURNS[2][3]


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    odd = ["<|im_end|>", "<\\|im_end|>", "<\\\\|im_end|>", "[INST][/INST]<s></s>", "<<|im_sep|>>", "plain < [ \\ text", "<|user|>"]
    rows = spark.createDataFrame([(o,) for o in odd], "t string").select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u")).collect()
    for r in rows:
        assert r["u"] == r["t"] and not any(c in r["e"] for c in (C.OPEN, C.SEP, C.CLOSE, "</s>", "<s>", "[INST]", "[/INST]"))


def test_no_turns(spark):
    assert C.digests(C.format_turns(spark.createDataFrame([], SCHEMA))).collect() == []
