from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from adcorpus.functions import chat
from adcorpus.operators import conversations as conv
from adcorpus.operators.topn import take_first

MSGS = "m array<struct<role:string,content:string>>"


def records(spark, *conversations):
    return spark.createDataFrame([(i, c) for i, c in enumerate(conversations)], f"i int, {MSGS}")


def evaluate(df, expression):
    return [r.v for r in sorted(df.select("i", expression.alias("v")).collect())]


def test_last_content(spark):
    df = records(spark, [("user", "u1"), ("assistant", "a1"), ("user", "u2")], [], None)
    assert evaluate(df, chat.last_content(F.col("m"), "user")) == ["u2", None, None]
    assert evaluate(df, chat.last_content(F.col("m"), "assistant")) == ["a1", None, None]


def test_prompt_and_truth(spark):
    df = records(
        spark, [("user", "u"), ("assistant", " X ")], [("user", "u")], [], None,
        [("assistant", "only")],
    )
    assert evaluate(df, chat.ground_truth(F.col("m"))) == ["x", None, None, None, "only"]
    prompts = evaluate(df, chat.prompt_messages(F.col("m")))
    assert [p and [tuple(m) for m in p] for p in prompts] == [[("user", "u")], None, None, None, []]


def test_validity(spark):
    df = records(spark, [("user", "u")], [("user", None)], [(None, "x"), ("user", "y")], [], None)
    assert evaluate(df, chat.is_valid(F.col("m"))) == [True, False, False, True, False]


def test_render(spark):
    df = records(spark, [("system", "s"), ("user", "u")], [])
    want = "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n"
    assert evaluate(df, chat.render(F.col("m"))) == [want, ""]
    opened = "<|im_start|>assistant\n"
    assert evaluate(df, chat.render(F.col("m"), generation_prompt=True)) == [want + opened, opened]


def test_expected_is_omitted_when_blank(spark):
    df = records(spark, [("user", "u")])
    for value, shown in ((None, False), (F.lit(""), False), (F.lit("e"), True)):
        text = df.select(F.to_json(chat.chat_record(F.col("m"), value)).alias("j")).first().j
        assert ("expected" in text) is shown


def test_budget(spark):
    df = spark.createDataFrame([(0, " a b\tc\n"), (1, ""), (2, "a b")], "i int, c string")
    got = [tuple(v) for v in evaluate(df, chat.budget(F.col("c"), 2))]
    assert got == [("a b", 3, 2, True), ("", 0, 0, False), ("a b", 2, 2, False)]


def long_form(spark, seed=3):
    rng = random.Random(seed)
    rows = []
    for c in range(12):
        for turn in range(rng.randrange(1, 40) if c else 3000):
            role = rng.choice(["user", "assistant", "system"])
            content = " ".join(rng.choice(["a", "b", "C", ""]) for _ in range(rng.randrange(4)))
            rows.append((c, turn, role, content))
    rng.shuffle(rows)
    schema = "conv_id int, turn bigint, role string, text string"
    return rows, spark.createDataFrame(rows, schema).repartition(5)


def grouped(rows):
    groups = {}
    for c, turn, role, content in sorted(rows):
        groups.setdefault(c, []).append((turn, role, content))
    return groups


def rendered(messages):
    return "".join(f"<|im_start|>{role}\n{content}<|im_end|>\n" for _, role, content in messages)


def test_long_conversations_render_in_parts_that_join_to_the_whole(spark):
    rows, df = long_form(spark)
    for opened in (False, True):
        got = {}
        for r in sorted(conv.render_conversations(df, 256, generation_prompt=opened).collect()):
            got.setdefault(r.conv_id, []).append(r.text)
            assert r.n_parts == (12 if r.conv_id == 0 else 1)
        assert len(got[0]) == 12 and all(len(parts) == 1 for c, parts in got.items() if c)
        suffix = "<|im_start|>assistant\n" if opened else ""
        assert {c: "".join(p) for c, p in got.items()} == {
            c: rendered(m) + suffix for c, m in grouped(rows).items()
        }


@pytest.mark.parametrize("n", [1, 64, 1500, 100_000])
def test_conversation_budget_matches_brute_force(spark, n):
    rows, df = long_form(spark)
    got = {r.conv_id: r for r in conv.conversation_budget(df, max_tokens=n).collect()}
    assert len(got) == 12
    for c, messages in grouped(rows).items():
        toks = rendered(messages).split()
        assert (got[c].head, got[c].n_tokens, got[c].n_kept, got[c].truncated) == (
            " ".join(toks[:n]), len(toks), min(n, len(toks)), len(toks) > n,
        )


def test_first_rows_per_group(spark):
    df = long_form(spark)[1].drop("role", "text")
    got = take_first(df, "conv_id", "turn", 100, bucket=32)
    want = {(c, t) for c, m in grouped(long_form(spark)[0]).items() for t, _, _ in m[:100]}
    assert {tuple(r) for r in got.collect()} == want and got.columns == df.columns


def test_budget_needs_a_template_that_ends_in_whitespace(spark):
    with pytest.raises(ValueError):
        conv.conversation_budget(long_form(spark)[1], template=("[", "]", ""))


def test_last_pair_and_split_match_brute_force(spark):
    rows, df = long_form(spark)
    pairs, truths, prompts = {}, {}, set()
    for c, messages in grouped(rows).items():
        last = {role: content for _, role, content in messages}
        if last.get("user") and last.get("assistant"):
            pairs[c] = (last["user"], last["assistant"])
        turn, role, content = messages[-1]
        truth = content.strip().lower()
        if role == "assistant" and truth:
            truths[c] = (turn, truth)
            prompts |= {(c, t, r, x) for t, r, x in messages[:-1]}
    got = {r.conv_id: (r.user_text, r.assistant_text) for r in conv.last_user_assistant(df).collect()}
    assert got == pairs
    out = conv.prompt_truth_split(df).collect()
    assert {r.conv_id: (r.turn, r.content) for r in out if r.part == "truth"} == truths
    assert {(r.conv_id, r.turn, r.role, r.content) for r in out if r.part == "prompt"} == prompts
    assert truths and pairs


def test_one_bad_message_drops_its_conversation(spark):
    rows = [(1, 0, "user", "a"), (1, 1, None, "b"), (2, 0, "user", "c"), (3, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert [r.conv_id for r in conv.valid_conversations(df).collect()] == [2]
