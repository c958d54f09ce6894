"""Disguised identifiers, written down here and not drawn from the operator's tables, and prose."""

import pytest

from tutorlake.llm import pii


@pytest.mark.parametrize(
    "text, kind",
    [
        ("reach <192[.]168[.]1[.]10> now", "ip"), ("at <192 dot 168 dot 1 dot 10> ok", "ip"), ("ping <10(dot)0(dot)0(dot)1>", "ip"), ("host <172.16[.]4.2> is down", "ip"), ("von <10 punkt 1 punkt 2 punkt 3> aus", "ip"),
        ("write <john AT example.com> today", "email"), ("mail <name @ example . com>!", "email"), ("mail <name @ example.com>", "email"), ("escribe a <joe arroba ejemplo punto com>", "email"), ("ou <jean arobase exemple point fr>", "email"),
        ("<anna (at) web (punkt) de>", "email"), ("<anna at web punkt de>", "email"), ("<j dot doe at example dot org>", "email"), ("to <john[at]example.com>", "email"), ("<kim{at}mail{dot}co{dot}uk>", "email"), ("<a.b AT mail.example.org>", "email"),
        ("tel <zéro six un deux trois quatre cinq six>", "phone"), ("tel <oh one two three four five six seven>", "phone"), ("call <double five one two three four five six> please", "phone"), ("ring <plus four four seven triple nine one two three>", "phone"),
        ("nummer <null eins zwei drei vier fünf sechs sieben>", "phone"), ("<seis uno dos tres cuatro cinco seis>", "phone"),
    ],
)
def test_found(text, kind):
    """The span between the angle brackets, exactly."""
    start, end = text.index("<"), text.index(">") - 1
    bare = text.replace("<", "").replace(">", "")
    assert [(s["kind"], s["start"], s["end"], s["plain"]) for s in pii.detect(bare)] == [(kind, start, end, False)]


@pytest.mark.parametrize(
    "text",
    [
        "Look at this point we agree. Meet me at example.com at noon.", "LOOK AT THIS.THING", "we met at ten. dot your notes", "un deux trois nous irons au bois", "one at a time . then two", "the dot at the end of the line dot dot", "x @ y", "a point at which 1 point 5 holds",
        "version 1 dot 2 of the file", "300 dot 1 dot 1 dot 1", "double one, triple two", "oh one of the three", "",
    ],
)
def test_prose(text):
    assert pii.detect(text) == []
