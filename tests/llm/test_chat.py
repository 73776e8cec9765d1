"""Chat formatting: round trip, spans of foreign templates, and templates that rewrite history."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException

from granary.llm import chat

from .fixtures import SF

PARTS = st.lists(st.sampled_from(["<", "|", "\\", "\n", "<|im_end|>", "<|im_start|>", "a", "é", ">", "%0A", "%"]), max_size=12).map("".join)


@given(PARTS)
def test_escape_is_reversible_and_hides_control_strings(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)


@settings(deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), max_size=40))
def test_round_trip(turns):
    renderer, reader = chat.Renderer(chat.chat_template), chat.Reader(0)
    added = []
    for t in turns:
        span = renderer.add(t)
        assert chat.unescape(span.added[span.begin : span.end]) == t[1]
        added.append(span.added)
        reader.add(span)
    assert "".join(added) == chat.chat_template(turns)
    assert reader.all.hexdigest() == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()


def test_foreign_template_with_a_beginning():
    template = lambda turns: "<s>" + "".join(f"[{r}] {t} [/{r}]" for r, t in turns)
    renderer = chat.Renderer(template)
    for k in range(50):
        span = renderer.add(("user", f"text {k} " * k))
        assert not span.rewrites
        assert span.added[span.begin : span.end] == f"text {k} " * k


def test_template_that_rewrites_history():
    strip = lambda turns: "".join(f"{r}:{t if i == len(turns) - 1 else t[:2]};" for i, (r, t) in enumerate(turns))
    renderer = chat.Renderer(strip)
    assert not renderer.add(("a", "long text")).rewrites
    assert renderer.add(("b", "more")).rewrites


def expected(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = []
    for c, turns in convs.items():
        pairs = [(t[3], t[5]) for t in sorted(turns)]
        loss = "".join(t for r, t in pairs if r == "assistant")
        chars = len(chat.chat_template(pairs))
        out.append((c, len(pairs), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in pairs).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    return sorted(out, key=str)


PROBE = [(-1, 0, "user", chat.PROBE_TEXT), (-1, 1, "assistant", chat.PROBE_TEXT)]


def test_driver_conversations(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    got = sorted((tuple(r) for r in chat.formatted(chat.with_probe(df)).collect()), key=str)
    assert got == expected(rows + PROBE)


def test_nulls_ties_long_and_empty(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "assistant", "x"), (None, 1, "user", ""), (None, 2, "assistant", "<|im_end|>\n<\\|"), (2, 5, "as\nsistant", "y" * 100_000)]
    rows += [(3, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(300)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    got = sorted((tuple(r) for r in chat.formatted(chat.with_probe(df)).collect()), key=str)
    assert got == expected(rows + PROBE)
    assert [r["conv_id"] for r in chat.formatted(chat.with_probe(df.limit(0))).collect()] == [-1]
    assert chat.rendered(df).where("rewrites").count() == 0


def test_rewrites_of_long_conversations(spark):
    """Each template rewrites from one turn on, far behind the first 16."""
    turns = [("user", f"text {k}") for k in range(60)]
    plain = lambda turns: "".join(f"[{r}] {t};" for r, t in turns)
    last = lambda turns: "<s>" + plain(turns[-20:])
    old = lambda turns: plain([(r, t[:2] if len(turns) > 40 and i == 0 else t) for i, (r, t) in enumerate(turns)])
    assert [k for k, r in enumerate(map(chat.Renderer(last).add, turns)) if r.rewrites] == list(range(20, 60))
    assert [k for k, r in enumerate(map(chat.Renderer(old).add, turns)) if r.rewrites] == [40]
    df = spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    assert [r["turn"] for r in chat.rendered(df, old).where("rewrites").collect()] == [40]
    system = lambda turns: "".join(f"{i}:{t};" for i, (_, t) in enumerate(turns))
    assert "".join(r["added"] for r in chat.rendered(df, system).orderBy("turn").collect()) == system(turns)


@given(st.lists(st.tuples(PARTS, PARTS), max_size=20))
def test_own_template_renders_each_turn_by_itself(turns):
    assert chat.chat_template(turns) == "".join(chat.chat_template([t]) for t in turns)


def test_templates_that_ask_for_what_is_before():
    def alternating(turns):
        for k, (role, _) in enumerate(turns):
            if role != ("user", "assistant")[k % 2]:
                raise ValueError("roles must alternate")
        return "<s>" + "".join(f"{k}/{role[0]}: {text} [{len(turns[:k])}]\n" for k, (role, text) in enumerate(turns))

    turns = [(("user", "assistant")[k % 2], f"text {k} " * (k % 3)) for k in range(40)]
    renderer, out = chat.Renderer(alternating), "<s>"
    for k, turn in enumerate(turns):
        span = renderer.add(turn)
        assert not span.rewrites and span.added[span.begin : span.end] == turn[1]
        assert span.added.startswith(f"{k}/")
        out += span.added
    assert out == alternating(turns)


def test_formatted_renders_all_turns_so_far(spark):
    """The query's operator tells a rewrite of the first turn from any later one, and what it reads back has no bound on turns."""
    turns = [(("user", "assistant")[k % 2], f"text {k} <|im_end|>") for k in range(60)]
    old = lambda turns: chat.chat_template([(r, t[:2] if len(turns) > 40 and i == 0 else t) for i, (r, t) in enumerate(turns)])
    rows = [(1, k, *t) for k, t in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in chat.formatted(df.where("turn < 40"), old).collect()] == expected(rows[:40])
    with pytest.raises(PythonException, match="rewrites history in conversation 1"):
        chat.formatted(df, old).collect()


def test_own_template_sees_every_prefix(monkeypatch):
    seen = []
    render = chat._Pieces.render
    monkeypatch.setattr(chat._Pieces, "render", lambda self, turns: seen.append(len(turns)) or render(self, turns))
    turns = [("user", f"text {k % 7}") for k in range(50)]
    renderer = chat.Renderer(chat.chat_template)
    assert "".join(renderer.add(t).added for t in turns) == chat.chat_template(turns)
    assert seen == [0] + [k for k in range(1, 51) for _ in range(3)]
