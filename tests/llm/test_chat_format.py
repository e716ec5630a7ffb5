import hashlib
import random

from quireline.llm import chat_format as C
from quireline.llm import queries
from tests.core.test_catalogue import same, table_views

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["<", "|", "[", "]", "\\", "s>", "</s>", "<s>", "INST", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|end|>", "<|text|>", "turn|>", "a", "é", "\U0001f600", "\n", "$1"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == C.TARGET)
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def got(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS rows", "1 AS example")
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.report(C.expand(df)).collect()}


def test_hostile_texts_come_back(spark):
    rng = random.Random(8)
    text = lambda: "".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 25)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", text()]), text()) for c in range(120) for t in range(rng.randrange(1, 7))]
    assert got(spark, rows) == wanted(rows)


def test_no_control_string_is_left_in_texts(spark):
    rows = [(1, 0, "user", "</s>[INST] <<SYS>> <|turn|> <\\|end|> <\\\\s>"), (1, 1, "assistant", "[/INST]<|end|>")]
    ((formatted, start, chars),) = [(r.formatted, r.loss_start, r.loss_chars) for r in C.expand(spark.createDataFrame(rows, SCHEMA)).collect()]
    for marker in ("</s>", "[INST]", "[/INST]", "<<SYS>>"):
        assert marker not in formatted
    assert formatted.count("<|turn|>") == 2 and formatted.count("<|end|>") == 2
    assert formatted[start : start + chars] == "[\\/INST]<\\|end|>"


def test_each_assistant_turn_is_an_example(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "assistant", "a2"), (1, 4, "user", "u2")]
    examples = sorted(C.expand(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.example)
    assert [(r.n_turns, r.formatted[r.loss_start : r.loss_start + r.loss_chars]) for r in examples] == [(3, "a1"), (4, "a2"), (5, "")]
    assert all(later.formatted.startswith(r.formatted) for r, later in zip(examples, examples[1:], strict=False))


def test_nulls_ties_repeats_and_long_conversations(spark):
    rows = [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (1, None, None, None), (2, 0, "user", None), (2, 0, "user", "b"), (2, 0, "user", "b"), (2, 0, "assistant", "é")]
    rows += [(3, i, ["user", "assistant"][i % 2], "word " * 50) for i in range(300)] + [(4, 0, "assistant", "long " * 200_000)]
    known = [r for r in rows if r[1] is not None]
    have = got(spark, rows)
    assert {k: v for k, v in have.items() if k != 1} == wanted(known)
    assert have[1] == (1, sha("\n\n"), 0, sha(""))
    assert got(spark, []) == {}


def test_only_dataframe_functions_and_one_shuffle(spark, sf):
    plan = queries.op1_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_query(spark, sf):
    same(queries.op1_chat_format(spark, sf), table_views(sf), queries.OP1_SQL)
