from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adcorpus.constants import NEGOTIABLE_SALARY, WHITESPACE
from adcorpus.functions import text

SPACES = "".join(sorted(WHITESPACE))


def test_whitespace_is_what_python_strips():
    assert {c for c in map(chr, range(0x110000)) if c.isspace()} == set(WHITESPACE)


def test_strip_and_tokens_match_python_for_every_whitespace_character(values):
    cells = [f"{c}a{c} b{c}" for c in SPACES] + ["", " ", SPACES, "​x​", "﻿x"]
    assert values(cells, text.strip) == [c.strip() for c in cells]
    assert values(cells, text.tokens) == [c.split() for c in cells]
    assert values(cells, text.token_count) == [len(c.split()) for c in cells]


def python_integer(cell: str):
    for word in cell.split():
        if re.fullmatch(r"[+-]?[0-9]+(_[0-9]+)*", word):
            return int(word)
    return None


def test_parse_integer_micro_cases(values):
    cells = ["18 triệu", "khoảng 1_000 vnd", "15.0 12", "none", "", "-5 x", "1__0 _1 1_ +7", None]
    assert values(cells, text.parse_integer) == [18, 1000, 12, None, None, -5, 7, None]


def test_integers_of_any_length_are_kept(values):
    cells = ["9007199254740993", "9223372036854775808", "1" + "0" * 40]
    assert values(cells, text.parse_integer) == [9007199254740993.0, float(2**63), 1e40]


@settings(max_examples=15, deadline=None)
@given(cells=st.lists(st.text(alphabet="0123456789_+-. x\t  \n", max_size=14), max_size=60))
def test_parse_integer_follows_the_token_rule(values, cells):
    got = values(cells, text.parse_integer)
    assert got == [python_integer(c) for c in cells]


def test_clean_null_policies(values):
    cells = ["  a ", " ", "", None, "null", "nan"]
    assert values(cells, text.clean) == ["a", "", "", "", "null", "nan"]
    assert values(cells, lambda c: text.clean(c, "nan_text")) == ["a", "", "nan", "nan", "nan", "nan"]
    with pytest.raises(ValueError):
        values([], lambda c: text.clean(c, "other"))


def test_present_means_clean_is_not_empty(values):
    cells = ["  a ", " ", "", None, "null", "nan", "\u3000\t", "\u200b"]
    for policy in ("drop", "nan_text"):
        cleaned = values(cells, lambda c: text.clean(c, policy))
        assert values(cells, lambda c: text.is_present(c, policy)) == [v != "" for v in cleaned]


def test_salary_label(values):
    assert values([" 10-12_Triệu+ ", None], text.salary_label) == ["10 12 triệu ", ""]


def test_negotiable_is_lowered_but_not_stripped(values):
    cells = ["Thoả Thuận", "thỏa thuận", " thoả thuận", None]
    kept = values(cells, lambda c: text.is_not_negotiable(c, NEGOTIABLE_SALARY))
    assert kept == [False, True, True, None]


def test_fenced_json(values):
    cells = [
        'x\n```json\n{"a":\n1}\n```\ny ```json\n{}\n```', "no fence", "```json\n\n```", "```json {}```",
        None,
    ]
    assert values(cells, text.fenced_json) == ['{"a":\n1}', None, None, None, None]


def test_list_literal(values):
    cells = ["['a', 'b']", "", None, "['it\\'s', \"x'y\"]", "[]", "nope"]
    assert values(cells, text.list_literal) == [
        ["a", "b"], None, None, ["it's", "x'y"], [], None,
    ]


def test_salary_range_of_the_published_sample(values):
    cells = [
        "15.0 - 22.0 triệu", "8.0 - 13.0 triệu", "9.4 - 12.0 triệu", "12.0 - 15.0 triệu",
        "15.0 - 25.0 triệu", "Thoả thuận", None,
    ]
    got = [r and tuple(r) for r in values(cells, text.salary_range)]
    assert got == [
        (15, 22, "18 triệu"), (8, 13, "10 triệu"), (9, 12, "10 triệu"), (12, 15, "13 triệu"),
        (15, 25, "20 triệu"), None, None,
    ]
