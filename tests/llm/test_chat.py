"""Formatted conversations against a plain formatter, and read back."""

import hashlib
import random

import oracle
from holdline.llm import chat, common, queries
from pyspark.sql import functions as F

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[IS]", "[SEP]"]


def plain_escape(text):
    """A backslash between a bracket and what ends a control string."""
    out, ends = "", [slash + end for slash in ("", "/") for end in ("INST]", "ROLE]", "IS]", "SEP]", "s>")]
    for i, c in enumerate(text):
        out += c
        if c in "[<":
            k = i + 1
            while text[k : k + 1] == "\\":
                k += 1
            if text.startswith(tuple(ends), k):
                out += "\\"
    return out


def plain_format(turns):
    out, last = "<s>", None
    for k, (role, text) in enumerate(turns):
        following = turns[k + 1][0] if k + 1 < len(turns) else None
        if role != last:
            out += {"user": "[INST] ", "assistant": ""}.get(role, f"[ROLE] {plain_escape(role)} [IS] ")
        out += plain_escape(text)
        out += "[SEP]" if following == role else {"user": " [/INST]", "assistant": "</s>"}.get(role, " [/ROLE]")
        last = role
    return out


def run(spark, rows, ddl="conv_id long, turn long, role string, text string"):
    got = chat.formatted(spark.createDataFrame(rows, ddl))
    read = got.select("conv_id", chat.text_of().alias("formatted"), chat.loss_text().alias("loss"), "pieces")
    return {r["conv_id"]: r for r in read.withColumn("turns", chat.turns_of(F.col("formatted"))).collect()}


def check(got, want):
    assert set(got) == set(want)
    for i, turns in want.items():
        assert got[i]["formatted"] == plain_format(turns)
        assert [tuple(t) for t in got[i]["turns"]] == turns
        assert got[i]["loss"] == "".join(t for r, t in turns if r == "assistant")
        assert "".join(p["text"] for p in got[i]["pieces"]) == got[i]["formatted"]


def test_op12(spark, sf_dir):
    table = common.table(spark, sf_dir, "conversations").collect()
    turns = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(table, key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in turns.items():
        loss = "".join(x for r, x in t if r == "assistant")
        told = "".join(f"{r}\n{x}\n" for r, x in t)
        want.append((i, len(t), digest(told), len(loss), digest(loss), len(plain_format(t))))
    got = queries.op12_chat_format(spark, sf_dir)
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    con = oracle.connect(sf_dir)
    assert oracle.spark_rows(got) == oracle.sql_rows(con, queries.ORACLES["op12_chat_format"])


def test_control_strings_in_texts_and_roles(spark):
    rng = random.Random(5)
    bits = [*CONTROL, "[\\INST]", "\\", "[", "<", "</", "]", ">", "/", " ", "s>", "INST]", "[[INST]", "é", "\n", "$1"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
    rows, want = [], {}
    for i in range(300):
        turns = []
        for _ in range(rng.randrange(1, 7)):
            turns.append((rng.choice(["user", "assistant", "assistant", "system", "", text()]), text()))
        want[i] = turns
        rows += [(i, k, r, t) for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    check(run(spark, rows), want)


def test_merged_turns(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c"), (1, 4, "assistant", "d")]
    got = run(spark, rows)[1]
    assert got["formatted"] == "<s>[INST] a[SEP]b [/INST]c[SEP]d</s>"
    assert got["loss"] == "cd"
    assert [p["text"] for p in got["pieces"] if p["loss"]] == ["c", "d"]


def test_odd_rows(spark):
    rows = [
        (1, 1, "assistant", None), (1, None, None, "first"),
        (2, 5, "user", "same"), (2, 5, "user", "same"), (2, 5, "assistant", "tie"),
        (None, 1, "user", "no id"), (None, 2, "assistant", "x" * 1_000_000 + "[SEP]"),
    ]
    want = {
        1: [("", "first"), ("assistant", "")],
        2: [("assistant", "tie"), ("user", "same"), ("user", "same")],
        None: [("user", "no id"), ("assistant", "x" * 1_000_000 + "[SEP]")],
    }
    check(run(spark, rows), want)
    assert run(spark, []) == {}


def test_long_conversation_and_long_runs_of_backslashes(spark):
    turns = [(("user", "assistant")[k // 3 % 2], f"turn {k}") for k in range(20_000)]
    turns[7] = ("user", "[" + "\\" * 200_000 + "INST]" + "[" * 100_000 + "<" + "\\" * 100_000)
    check(run(spark, [(1, k, r, t) for k, (r, t) in enumerate(turns)]), {1: turns})


def test_clashing_columns_and_other_names(spark):
    rows = [(1, "user", "hi", "p", "t", "r", 4), (2, "assistant", "yo", "p", "t", "r", 4)]
    df = spark.createDataFrame(rows, "turn int, who string, said string, pieces string, turns string, t string, conv int")
    got = chat.formatted(df, "conv", "turn", "who", "said").collect()
    assert [(r["conv"], "".join(p["text"] for p in r["pieces"])) for r in got] == [(4, "<s>[INST] hi [/INST]yo</s>")]


def test_plan_has_spark_expressions_only(spark, sf_dir):
    df = chat.formatted(common.table(spark, sf_dir, "conversations"))
    df = df.select("conv_id", chat.turns_of(chat.text_of()), chat.loss_text())
    oracle.check_batch_plan(df)
