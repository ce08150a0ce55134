import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.llm.wikitext import render, words

CASES = [
    ("a <!-- x --> b", "a b"), ("a <!-- never closed", "a"), ("a<ref name=x /> b", "a b"), ("a<ref>{{cite web|url=u|title=t}}</ref> b", "a b"), ("a <ref> b never closed", "a b never closed"),
    ("[[Foo|bar]]s and [[Baz]]", "bars and baz"), ("[[Category:X]] y", "y"), ("[[:Category:X]] y", "category x y"), ("[[de:Foo]] y", "y"), ("[[File:a.jpg|thumb|a caption]] y", "a caption y"),
    ("{{Infobox x\n| a = b\n}} y", "y"), ("{{quote|text=some {{nowrap|wise words}}|Author}}", "some wise words author"), ("{{convert|5|km2|abbr=on}}", "5 km2"), ("{{lang|de|Wort}}", "wort"), ("{{a {{b}} never closed", "a never closed"),
    ("'''b''' ''i''", "b i"), ("wor<b>d</b>s<br/>next", "words next"), ("<blockquote>q</blockquote>", "q"), ("a&nbsp;b&#32;c&amp;d &lt;ref&gt;", "a b c d ref"), ("so­ft ze​ro", "soft zero"),
    ('{| class="x"\n! h1 !! h2\n|-\n| style="a" | c1 || c2\n|}', "h1 h2 c1 c2"), ("== Head ==\n* item", "head item"), ("[https://x.invalid label here] [https://y.invalid]", "label here"), ("__NOTOC__ z", "z"), (None, ""), ("", ""), ("]] }} x", "x"),
    ("{{box " * 60 + "}}" * 60 + " y", "y"), ("[[" * 60 + "x" + "]]" * 60 + " {{hid}} y", "x y"), ("{{infobox [[ [[ [[ [[ [[ hidden }} shown", "shown"),
    ("{{ {{x}} {{x}} {{x}} quote |text}}", "text"), ("{{" + " " * 500 + "quote" + " " * 500 + "|text}} y", "text y"), ("{{quote" + " x" * 40 + "|text}} y", "y"), ("[[ {{x}} {{x}} {{x}} Category:X]] y", "y"),
    ("Straße ÀB", "strasse àb"), ("a_b-c'd", "a b c d"),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert words(render(text)).split() == want.split()
    flat, pos = words(*render(text, track=True))
    assert flat.split() == want.split() and len(flat) == len(pos)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["[[", "]]", "{{", "}}", "|", "a", " b ", "<ref>", "</ref>", "<!--", "-->", "'''", "\n", "{|", "|}", "&amp;", "é", "<b>", "quote"]), max_size=40).map("".join))
def test_tracked_equals_plain(text):
    plain, (tracked, pos) = render(text), render(text, track=True)
    assert plain == tracked and len(pos) == len(tracked)
    assert words(plain).split() == words(tracked, pos)[0].split()


@pytest.mark.parametrize(("before", "after"), [("[[", "]]"), ("{{quote|a ", "}}"), ("[[a|b ", "]]"), ("{{a|[[", "}}"), (" {{x}} [[", "]]")])
def test_linear_time_at_any_depth(before, after):
    start = time.time()
    words(render(before * 50_000 + "x" + after * 50_000))
    assert time.time() - start < 8


@pytest.mark.parametrize("piece", ["<ref>", "<ref", "{{", "[[", "[[a|", "{{quote|", "<!--", "<b", "[https://x ", "&", "''", "| a=b ", "|a=ba=b", "\n| a=b c=d", "{{a}}", "\n|-"])
def test_linear_time(piece):
    start = time.time()
    words(render(piece * 20_000))
    assert time.time() - start < 8
