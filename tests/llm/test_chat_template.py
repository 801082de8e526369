"""The template language, its sandbox, and round trips through the formatted text."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkloom.llm.chat_template import CHATML, TemplateError, compile_template, digests, escape, format_conversations, many_lines, one_line, parse, pieces, read_turns, unescape

HARD = st.text(alphabet=st.sampled_from(list("<|\\>im_endstar%0A\n é\U0001f600")), max_size=40)


@given(HARD)
def test_escapes_are_reversible_and_remove_control_strings(text):
    assert unescape(escape(text)) == text and "<|" not in escape(text)
    assert many_lines(one_line(text)) == text and "\n" not in one_line(text)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb<|x", ""]), HARD), max_size=6), st.integers(1, 30))
def test_round_trip_in_any_piece_size(turns, size):
    run = compile_template(CHATML)
    parts = [(t, [{"start": a, "end": b} for a, b in s]) for t, s in pieces(run({"role": r, "text": t} for r, t in turns), size)]
    assert list(read_turns(parts)) == [(r, t, t if r == "assistant" else "") for r, t in turns]


def test_constants_are_folded():
    assert parse("a{{ 'b' ~ 1 | upper }}{% if 'x' == 'x' and not false %}c{% else %}{{ y }}{% endif %}") == [("text", "ab1c")]


def test_tags_in_quotes_and_texts():
    assert parse("{{ '}}' ~ '%}' }}") == [("text", "}}%}")] and parse("a }} %} b") == [("text", "a }} %} b")]


def test_language():
    run = compile_template("{% set n = 'N' %}{% for m in messages %}{% if m.role in 'user admin' %}U{% elif m.role == 'x' %}X{{ n }}{% else %}{% generation %}{{ (m.text | trim) ~ '!' }}{% endgeneration %}{% endif %}{% endfor %}")
    assert list(run([{"role": "user", "text": ""}, {"role": "x", "text": ""}, {"role": "bot", "text": " hi "}])) == [("U", False), ("X", False), ("N", False), ("hi!", True)]


@pytest.mark.parametrize("bad", ["{{ a.b() }}", "{{ a | system }}", "{% import os %}", "{% for x in y %}", "{{ a[0] }}", "{{ }}", "{% if a %}", "x{{ 'abcd' }", "x{% if a", "{{ 1 in 'a' }}", "{{ 'a }}"])
def test_sandbox_refuses(bad):
    with pytest.raises(TemplateError):
        compile_template(bad)


def test_attributes_are_lookups_only():
    with pytest.raises((KeyError, TypeError)):
        list(compile_template("{{ messages.__class__ }}")([{"role": "u", "text": ""}]))


def test_table_cases(spark):
    schema = "conv_id long, turn long, role string, text string, piece int, spans string"
    assert digests(format_conversations(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, 1, "assistant", "b", 0, ""), (1, 0, None, None, 0, ""), (1, 1, "assistant", "b", 0, ""), (None, None, "user", "é" * 3_000_000, 0, "")]
    got = {r.conv_id: r for r in digests(format_conversations(spark.createDataFrame(rows, schema))).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].n_turns, got[None].loss_chars) == (3, 2, 1, 0)
    assert got[None].formatted_chars == 3_000_000 + 12 + 4 + 1 + 11


def test_turns_are_read_before_all_pieces_are_there():
    taken = []
    run = compile_template(CHATML)
    parts = [(t, [{"start": a, "end": b} for a, b in s]) for t, s in pieces(run({"role": "user", "text": f"text {i}"} for i in range(100)), 40)]
    turns = read_turns(taken.append(1) or p for p in parts)
    assert next(turns) == ("user", "text 0", "") and len(taken) < 5
    assert len(list(turns)) == 99 and len(taken) == len(parts)


def test_pieces_are_digested_where_they_are(spark):
    """Texts are shuffled once, a long conversation in many pieces gives the same digest, and no setting is left behind."""
    schema = "conv_id long, turn long, role string, text string"
    rows = [(c, t, ["user", "assistant"][t % 2], f"<|im_end|> {c} {t} é " * 9) for c in range(40) for t in range(6)]
    turns = spark.createDataFrame(rows, schema).repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = digests(format_conversations(turns), in_place=True)
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = sorted(map(tuple, whole.collect()))
    assert len(want) == 40 and want == sorted(map(tuple, digests(format_conversations(turns, piece_chars=50), in_place=True).collect()))
    assert want == sorted(map(tuple, digests(format_conversations(turns).repartition(7)).collect()))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
