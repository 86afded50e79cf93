import hashlib
import random

from geomatch.llm import chat

COLUMNS = "conv_id long, turn long, role string, text string, formatted string, t string"


def plain(rows):
    by: dict = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, own in by.items():
        own.sort()
        turns = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def rows_of(seed=1, n=200):
    rng = random.Random(seed)
    part = ["<", "|", "0", ">", "<|end|>", "<|turn|>", "<|role|>", "<|text|>", "<0|", "a", "é", "🙂", "\n", "</s>[INST] ok [/INST]"]
    text = lambda: rng.choice([None, "", "".join(rng.choices(part, k=rng.randint(1, 8)))])
    roles = ["user", "assistant", "assistant", "system", None, "us<|text|>er<"]
    return [(rng.choice([None, *range(12)]), rng.choice([None, *range(6)]), rng.choice(roles), text()) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "f", "t") for r in rows], COLUMNS)


def test_what_is_read_back_is_what_was_said(spark):
    rows = rows_of()
    got = chat.digests(chat.format_conversations(table(spark, rows))).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == plain(rows)


def test_marks_stand_only_where_the_template_puts_them(spark):
    rows = rows_of(2)
    formatted = {r.conv_id: r for r in chat.format_conversations(table(spark, rows)).collect()}
    by: dict = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, own in by.items():
        own.sort()
        blocks = sum(i == 0 or own[i][2] != own[i - 1][2] for i in range(len(own)))
        said = formatted[conv].formatted
        assert said.count("<|") == 3 * blocks + len(own) - blocks
        masked = [said[s.start : s.start + s.length].replace("<0", "<") for s in formatted[conv].loss]
        assert masked == [t for _, _, r, t in own if r == "assistant"]


def test_only_native_operators(spark):
    frame = chat.digests(chat.format_conversations(table(spark, rows_of())))
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_edge_cases(spark):
    rows = [(1, 0, "user", "x" * 1_000_000), (1, 0, "user", "x" * 1_000_000), (1, 1, "assistant", None)] + [(2, i, "assistant", str(i)) for i in range(3000)]
    assert {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.format_conversations(table(spark, rows))).collect()} == plain(rows)
    empty = chat.format_conversations(table(spark, rows).filter("false"))
    assert chat.digests(empty).count() == 0


def test_control_conversation_is_added(spark):
    rows = chat.with_control_conversation(spark, table(spark, [(1, 0, "user", "a")])).collect()
    assert [(r.turn, r.role, r.text) for r in rows if r.conv_id == -7] == [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
