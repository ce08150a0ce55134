"""Wiki markup as a reader of the rendered page sees it, in time linear in the text.

``render(text)`` drops comments, references, templates (but for quotations and the like, whose text shows),
categories, tags and invisible characters, keeps link labels and the cells of tables, and resolves character
entities. With ``track=True`` it also returns the position in ``text`` of every character it kept.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np

#: templates whose arguments are text on the page
SHOWN = frozenset("quote blockquote cquote quotation bq rquote quotebox zitat cita poemquote talkquote pullquote lang nowrap small big url center centre".split())
#: longest beginning of a template name or link target that decides what becomes of it
HEAD = 64
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_REF = re.compile(r"<(/?)ref(?=[\s/>])[^<>]*>", re.I)
_BRACKET = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")
_HIDDEN_LINK = re.compile(r"\s*(?:category|kategorie|categoría|categoria|[a-z]{2,3})\s*:", re.I)
_FILE_LINK = re.compile(r"\s*(?:file|image|datei|bild|archivo|imagen)\s*:", re.I)
_TABLE_LINE = re.compile(r"^[ \t]*(?:\{\|[^\n]*|\|-[^\n]*|\|\}|\|\+)", re.M)
_ATTRIBUTE = r"\w+[ \t]*=[ \t]*(?:\"[^\"\n]*\"|[^\s|\"]+)"
_CELL_ATTRIBUTES = re.compile(rf"(?:^[ \t]*[|!]|\|\||!!)[ \t]*{_ATTRIBUTE}(?:[ \t]+{_ATTRIBUTE})*[ \t]*\|(?!\|)", re.M)
_CELL = re.compile(r"^[ \t]*[|!]|\|\||!!", re.M)
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)[^<>]*>")
_INLINE = frozenset("b i u s em strong span sup sub small big font a abbr code tt kbd ins del mark q cite nowiki".split())
_URL = re.compile(r"\[(?:(?:https?|ftp):)?//[^\s\[\]]*[ \t]?([^\[\]\n]*)\]")
_QUOTES = re.compile(r"'{2,}")
_SWITCH = re.compile(r"__[A-Z]+__")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});?")
_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]")
_SPACES = re.compile(r"\s+")
_NAMED = re.compile(r"\s*\w{1,20}\s*=")
_NO_WORD = re.compile(r"[\W_]+")


def _sub(pattern: re.Pattern, repl, s: str, off):
    """``pattern.sub`` that carries the positions along; inserted characters get the position of the match."""
    if off is None:
        return pattern.sub(repl, s), None
    out, pos, at = [], [], 0
    for m in pattern.finditer(s):
        new = repl(m) if callable(repl) else repl
        out += [s[at: m.start()], new]
        pos += [off[at: m.start()], np.full(len(new), off[m.start()] if m.start() < len(off) else 0)]
        at = m.end()
    return "".join([*out, s[at:]]), np.concatenate([*pos, off[at:]])


def _slices(s: str, off, parts: list[tuple[int, int]]):
    """The text made of slices of ``s``; (-1, 0) is an inserted space."""
    text = "".join([s[a:b] if a >= 0 else " " for a, b in parts])
    if off is None:
        return text, None
    return text, np.concatenate([off[a:b] if a >= 0 else np.zeros(1, off.dtype) for a, b in parts] or [off[:0]])


def _without_refs(s: str, off):
    parts, at, inside = [], 0, False
    last_close = max((m.start() for m in _REF.finditer(s) if m[1]), default=-1)
    for m in _REF.finditer(s):
        if not inside:
            parts.append((at, m.start()))
        at = m.end()
        if m[1]:
            inside = False
        elif not m[0].endswith("/>"):
            inside = m.start() < last_close  # a reference that is never closed hides nothing
    parts.append((at, len(s)))
    return _slices(s, off, parts)


class _Part:
    """What a closed template or link shows: slices and parts within it, and the beginning of its text."""

    __slots__ = ("items", "head")

    def __init__(self, s: str, items: list):
        self.items, self.head = items, _head(s, items)


def _head(s: str, items: list) -> str:
    """The first ``HEAD`` characters, runs of white space as one space, none in front."""
    out = ""
    if len(items) == 1 and not isinstance(items[0], _Part) and 0 <= items[0][0] and items[0][1] - items[0][0] <= HEAD:
        out = s[items[0][0]: items[0][1]]  # most names are one short slice
        return _SPACES.sub(" ", out).lstrip() if "  " in out or not out.isprintable() else out.lstrip()
    for x in items:
        if isinstance(x, _Part):
            t = x.head
        elif x[0] < 0:
            t = " "
        else:
            t = s[x[0]: min(x[1], x[0] + 4 * HEAD)]
            if x[1] > x[0] + 4 * HEAD and len(_SPACES.sub(" ", t)) < HEAD:
                t = s[x[0]: x[1]]
        out = _SPACES.sub(" ", out + _SPACES.sub(" ", t)[:HEAD + 1]).lstrip()
        if len(out) >= HEAD:
            break
    return out[:HEAD]


def _flat(items: list) -> list[tuple[int, int]]:
    """The slices of a tree of parts, in order."""
    out, todo = [], [iter(items)]
    while todo:
        for x in todo[-1]:
            if isinstance(x, _Part):
                todo.append(iter(x.items))
                break
            out.append(x)
        else:
            todo.pop()
    return out


def _spaced(args: list[list]) -> list:
    return [x for a in args for x in [*a, (-1, 0)]]


def _template(s: str, args: list[list]) -> list:
    name = _head(s, args[0]).strip().lower()
    if name == "convert":
        return _spaced(args[1:3])
    if name.replace(" ", "") not in SHOWN:
        return []
    shown: list = [(-1, 0)]
    for arg in args[2:] if name == "lang" else args[1:]:
        if arg and not isinstance(arg[0], _Part) and arg[0][0] >= 0:
            a, b = arg[0]
            named = _NAMED.match(s, a, b)
            arg = [(named.end(), b), *arg[1:]] if named else arg
        shown += [*arg, (-1, 0)]
    return shown


def _link(s: str, args: list[list]) -> list:
    target = _head(s, args[0])
    if target.startswith(":"):
        return args[-1]
    if _HIDDEN_LINK.match(target):
        return []
    if _FILE_LINK.match(target):
        return args[-1] if len(args) > 1 else []
    return [x for a in args[1:] for x in a] if len(args) > 1 else args[0]


def _without_brackets(s: str, off):
    """Templates and links by one pass with a stack; what is never closed stays as text. Each frame's content is handed on
    as one part, whatever it holds, so the time is linear at any depth."""
    base: list = []
    stack: list[tuple[str, list]] = []
    open_ = {"{{": 0, "[[": 0}
    at = 0

    def put(items: list) -> None:
        if items:
            (stack[-1][1][-1] if stack else base).append(items[0] if len(items) == 1 else _Part(s, items))

    for m in _BRACKET.finditer(s):
        tok, a, b = m[0], m.start(), m.end()
        if tok == "|" and not stack:
            continue
        if at < a:
            put([(at, a)])
        at = b
        if tok == "|":
            stack[-1][1].append([])
        elif tok in open_:
            stack.append((tok, [[]]))
            open_[tok] += 1
        else:
            opener = "{{" if tok == "}}" else "[["
            if not open_[opener]:
                continue
            while True:
                kind, args = stack.pop()
                open_[kind] -= 1
                if kind == opener:
                    break
                put(_spaced(args))
            put(_template(s, args) if tok == "}}" else _link(s, args))
    if at < len(s):
        put([(at, len(s))])
    for _, args in stack:  # what an open frame holds comes before what the frames inside it hold
        base += _spaced(args)
    return _slices(s, off, _flat(base))


def _tag(m: re.Match) -> str:
    return "" if m[1].lower() in _INLINE else " "


def render(text: str | None, track: bool = False):
    """The visible text, or (visible text, positions in ``text``) with ``track``."""
    s = text or ""
    off = np.arange(len(s)) if track else None
    if "<!--" in s:
        s, off = _sub(_COMMENT, "", s, off)
    if "<ref" in s or "<REF" in s or "<Ref" in s:
        s, off = _without_refs(s, off)
    if "{{" in s or "[[" in s:
        s, off = _without_brackets(s, off)
    if "|" in s or "!" in s:
        s, off = _sub(_TABLE_LINE, "", s, off)
        s, off = _sub(_CELL_ATTRIBUTES, "\n", s, off)
        s, off = _sub(_CELL, "\n", s, off)
    if "<" in s:
        s, off = _sub(_TAG, _tag, s, off)
    if "//" in s:
        s, off = _sub(_URL, lambda m: m[1], s, off)
    if "''" in s:
        s, off = _sub(_QUOTES, "", s, off)
    if "__" in s:
        s, off = _sub(_SWITCH, "", s, off)
    if "&" in s:
        s, off = _sub(_ENTITY, lambda m: html.unescape(m[0]), s, off)
    if not s.isascii():
        s, off = _sub(_INVISIBLE, "", s, off)
    return (s, off) if track else s


def words(text: str, off=None):
    """Lower-case words of a visible text, one space before, between and after; with ``off`` also their positions."""
    if off is None:
        s = text if text.isascii() else unicodedata.normalize("NFKC", text)
        return " " + _NO_WORD.sub(" ", s.casefold()).strip() + " "
    out, pos = [" "], [np.zeros(1, off.dtype)]
    for m in re.finditer(r"\S+", text):
        w = unicodedata.normalize("NFKC", m[0]).casefold()
        here = off[m.start(): m.end()] if len(w) == len(m[0]) else np.full(len(w), off[m.start()])
        w, here = _sub(_NO_WORD, " ", w, here)
        if w.startswith(" "):
            w, here = w[1:], here[1:]
        if w and not w.endswith(" "):
            w, here = w + " ", np.append(here, here[-1])
        out.append(w), pos.append(here)
    return "".join(out), np.concatenate(pos)
