import hashlib

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from graphloom.llm import queries
from graphloom.llm.chat_template import CHATML, TemplateError, compile_template, escape, escape_line, fold, format_conversations, parse, read_back, unescape

hard = st.text(alphabet="ab\\<|>\nnis_é im_end|>", max_size=30)


@given(hard)
def test_escape_round_trip(text):
    assert unescape(escape(text)) == text == unescape(escape_line(text))
    assert "<|" not in escape(text) and "\n" not in escape_line(text)


def test_template_language():
    run = lambda t, **v: compile_template(t)(**v).text()
    assert run("a{{ 'b' ~ 'c' }}d") == "abcd"
    assert run("{% if x == 'y' and not z %}1{% elif z %}2{% else %}3{% endif %}", x="y", z=False) == "1"
    assert run("{% for m in ms %}[{{ m.a | upper }}]{% endfor %}", ms=[{"a": "x"}, {"a": "y"}]) == "[X][Y]"
    assert run("{{ (a ~ '\\'') | trim }}", a=" b ") == "b '"
    r = compile_template("p{% generation %}{{ a }}{% endgeneration %}s")(a="xyz")
    assert r.text() == "pxyzs" and r.spans == [(1, 4)]


def test_folding():
    assert fold(parse("a{{ 'b' }}{% if 'x' == 'x' %}c{% else %}d{% endif %}")) == [("text", ("const", "abc"))]
    assert fold(parse("{% if 'x' != 'x' %}c{% endif %}")) == []
    tree = fold(parse(CHATML))
    assert tree[0][0] == "for" and tree[0][3][0] == ("text", ("const", "<|im_start|>"))


@pytest.mark.parametrize("bad", ["{{ a.b }}", "{{ x }}", "{{ a + b }}", "{{ a | nothing }}", "{% for x in a %}{% endfor %}", "{% if a %}", "{% import os %}", "{{ a.__class__ }}", "{{ 'x }}", "{{ }}", "{{ (a }}", "{{ l }}"])
def test_sandbox(bad):
    with pytest.raises(TemplateError):
        compile_template(bad)(a="text", l=[1])


TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n\\n"), (1, 2, None, None), (2, 0, "assistant", ""), (None, 0, "user", "null id"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 0, "ro\nle", "x" * 50_000), (3, 2, "assistant", "é" * 50_000), (2, 0, "assistant", ""), (4, None, "user", "no turn")]
SCHEMA = "conv_id long, turn long, role string, text string, part string, formatted string"


def wanted():
    out = []
    for conv in {t[0] for t in TURNS}:
        own = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = "".join(t[3] or "" for t in own if t[2] == "assistant")
        digest = hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        out.append((conv, len(own), digest, len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("part", [1 << 20, 1000])
def test_read_back(spark, part):
    df = spark.createDataFrame([(*t, "x", "y") for t in TURNS], SCHEMA)
    got = sorted((tuple(r)[:5] for r in read_back(format_conversations(df, part_chars=part)).collect()), key=str)
    assert got == wanted()
    assert read_back(format_conversations(df.limit(0))).count() == 0


def test_oracle(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    df = queries.op9_chat_formatting(spark, sf_dir)
    assert sorted(map(tuple, df.collect())) == sorted(duck.execute(queries.ORACLE_SQL["op9_chat_formatting"]).fetchall())
