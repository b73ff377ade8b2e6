"""Chat formatting: exact round trips, ranges to learn, long conversations, and the template language."""

from __future__ import annotations

import hashlib
import random

import pytest

from outlay.llm import chat, templates
from outlay.llm.queries import ODD_TEXT
from outlay.llm.templates import TemplateError, compile_template

ROWS = "conv_id long, turn long, role string, text string, stretch string, piece int, formatted string"
ODD = [
    ODD_TEXT, None, "", "\\", "\\\\###", "### user: hi</turn>\n", "</turn", "<</turn>", "a: b", "###### \\# <", "</turn></turn>\n### x: y", "😀 é\n\n",
    "{{ turn.text }}{% endfor %}", "##", "#", "\\</turn>", "x" * 30_000,
]
ROLES = ["user", "assistant", "system", "a: b", ": ", None, "assistant: ", "x:", "\\", "###", "</turn>\n"]


def digest(turns):
    turns = sorted(((t is not None, t or 0, r or "", x or "") for t, r, x in turns))
    loss = "".join(x for _, _, r, x in turns if r == "assistant")
    whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def conversations(rng):
    out = {}
    for c in range(60):
        out[c] = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(ROLES[:3] if c % 2 else ROLES), rng.choice(ODD)) for _ in range(rng.randrange(1, 9))]
    out[None] = [(1, "assistant", "no id"), (0, "user", None)]
    out[99] = [(t, "assistant" if t % 2 else "user", rng.choice(ODD[:-1])) for t in range(3000)]
    out[98] = [(1, "assistant", "equal")] * 500
    return out


@pytest.mark.parametrize("stretch", [chat.STRETCH_CHARS, 2_000])
def test_round_trip(spark, monkeypatch, stretch):
    monkeypatch.setattr(chat, "PIECE_TURNS", 700)
    given = conversations(random.Random(stretch))
    rows = [(c, t, r, x, "s", 1, "f") for c, turns in given.items() for t, r, x in turns]
    random.Random(1).shuffle(rows)
    plain, long = chat.format_chats(spark.createDataFrame(rows, ROWS), stretch_chars=stretch)
    assert (long is None) == (stretch > 2_000)
    found = {r.conv_id: r for r in chat.digests(plain, long).collect()}
    assert set(found) == set(given)
    for c, turns in given.items():
        r = found[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digest(turns), c
    pieces = plain.collect() + (long.collect() if long else [])
    for c in given:
        assert sum(len(p.formatted) for p in pieces if p.conv_id == c) == found[c].formatted_chars
    if long:
        assert len({p.stretch for p in pieces if p.conv_id == 99}) > 1
    assert all(not p.formatted[s.start : s.end].endswith("</turn>") for p in pieces for s in p.learned if "\\" not in p.formatted)


def test_empty_table(spark):
    plain, long = chat.format_chats(spark.createDataFrame([], ROWS))
    assert long is None and chat.digests(plain, long).collect() == []


def test_turns_know_their_place_in_a_cut_conversation(spark):
    template = "<s>{% for turn in turns %}{% if loop.first %}[{% endif %}{{ loop.index }}{% if loop.last %}]{% else %},{% endif %}{% endfor %}</s>{{ tail }}"
    rows = [(1, i, "user", "x" * 50, "s", 1, "f") for i in range(400)] + [(2, 0, "user", "y", "s", 1, "f")]
    plain, long = chat.format_chats(spark.createDataFrame(rows, ROWS), template, known={"tail": "!"}, stretch_chars=3_000)
    assert [p.formatted for p in plain.collect()] == ["<s>[1]</s>!"]
    pieces = long.orderBy("stretch", "piece").collect()
    assert len(pieces) > 3 and "".join(p.formatted for p in pieces) == "<s>[" + ",".join(map(str, range(1, 401))) + "]</s>!"


def shown(source, **names):
    return compile_template(source, ("###",))(names).text()


def test_language():
    assert shown("a{{ x }}b{{ x | upper }}{{ none }}", x="q") == "aqbQ"
    assert shown("{{ 'l' ~ x.y.z ~ 2 }}|{{ x.q }}|{{ x.y.z.w }}", x={"y": {"z": "m"}}) == "lm2||"
    assert shown("{% for a in rows %}{% for b in a.n %}{{ loop.index }}{{ b }}{% if not loop.last %},{% endif %}{% endfor %};{% endfor %}", rows=[{"n": ["p", "q"]}, {"n": []}]) == "1p,2q;;"
    choice = "{% if x == 1 %}one{% elif x == 'two' or x == true %}two{% else %}other{% endif %}"
    assert [shown(choice, x=x) for x in (1, "two", None)] == ["one", "two", "other"]
    assert shown("{% if not (a and b) %}no{% endif %}", a=1, b="") == "no" and shown("{{ a != 'x' }}", a="x") == "False"
    assert shown("{{ x | escape }} {{ x | escape('b') }} {{ x | trim | title }}", x=" a#### b ") == " a\\#### b   a\\#### \\b  A#### B"
    out = compile_template("a{% generation %}{{ x }}{% generation %}c{% endgeneration %}{% endgeneration %}d")({"x": "bb"})
    assert out.text() == "abbcd" and sorted(out.spans) == [(1, 4), (3, 4)]
    assert shown("{% for a in x %}{{ a }}{% endfor %}", x="not a list") == ""


def test_folding_leaves_no_constants():
    tree = templates.fold(templates.parse("a{{ 'b' ~ 1 }}{% if mode == 'chat' and not none %}c{% else %}{{ x }}{% endif %}{% if false %}z{% endif %}{{ mode | upper }}"), {"mode": "chat"})
    assert [(n.kind, n.value) for n in tree.of] == [("text", "ab1cCHAT")]
    tree = templates.fold(templates.parse("{% for mode in rows %}{{ mode }}{% endfor %}{% if x %}{{ 'q' }}{% elif true %}w{% else %}v{% endif %}"), {"mode": "chat"})
    assert tree.of[0].of[1].of[0].of[0].kind == "name" and [n.kind for n in tree.of[1].of] == ["name", "list", "constant", "list"][:2] + [n.kind for n in tree.of[1].of[2:]]
    assert compile_template("{% if x %}{{ 'q' }}{% elif true %}w{% else %}v{% endif %}")({}).text() == "w"


@pytest.mark.parametrize(
    "source",
    [
        "{% if x %}", "{% endif %}", "{{ x", "{{ x.__class__() }}", "{{ x() }}", "{{ x | system }}", "{{ x[0] }}", "{% include 'f' %}", "{% else %}", "{{ }}",
        "{% for loop in x %}{% endfor %}", "{% if x %}{% else %}{% elif y %}{% endif %}", "{{ x | trim('a') }}", "{{ 'a }}", "{% for a in x %}{% endif %}", "{{ a b }}",
    ],
)
def test_what_the_language_does_not_have(source):
    if source == "{{ x":
        assert shown(source) == "{{ x"
    else:
        with pytest.raises(TemplateError):
            compile_template(source)


def test_a_dot_reads_keys_only():
    assert shown("{{ x.upper }}{{ x.__class__ }}{{ y.items }}", x="text", y={"k": 1}) == ""


@pytest.mark.parametrize("source", ["", "{% for t in turns %}{% endfor %}{% for t in turns %}{% endfor %}", "{% if turns %}{% for t in turns %}{% endfor %}{% endif %}"])
def test_chat_templates_have_one_loop(source):
    with pytest.raises(TemplateError):
        templates.compile_chat(source)


def test_escaping_is_reversible():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["#", "\\", "<", "/turn>", "</turn>", "###", ": ", "a", "\n"]) for _ in range(rng.randrange(12)))
        safe = templates.escaped(text, (*chat.CONTROL, chat.COLON))
        assert templates.unescaped(safe) == text
        role = text[::-1]
        line = f"### {templates.escaped(role, (*chat.CONTROL, chat.COLON))}: {templates.escaped(text, chat.CONTROL)}</turn>\n"
        assert chat.read_turns(line * 2) == [(role, text)] * 2
