"""A small tokenizer for wikitext: templates with their parameters, and plain text.

Unbalanced braces and brackets stay as text; nothing here raises on bad markup.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

_REFERENCE = re.compile(r"<ref(?:\s[^>]*)?/>|<ref(?:\s[^>]*)?>.*?</ref>", re.S | re.I)
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_TAG = re.compile(r"</?(?:small|sup|sub|span|div|nowiki|i|b)(?:\s[^>]*)?/?>", re.I)
_EXTERNAL = re.compile(r"\[(?:https?:)?//\S+?(?:\s+([^\]]*))?\]")
_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
_MARKER = re.compile(r"^[*#:;]+", re.M)
#: Text without any of these is plain already.
_SPECIAL = re.compile(r"[<{\['&]|^[*#:;]", re.M)
_BRACES = re.compile(r"\{\{|\}\}")


@dataclass
class Param:
    key: str
    value: str
    positional: bool


@dataclass
class Template:
    raw: str
    name: str = ""
    params: list[Param] = field(default_factory=list)

    def get(self, key: str) -> str | None:
        """The raw value, the last if a key repeats."""
        return next((p.value for p in reversed(self.params) if p.key == key), None)

    @property
    def positionals(self) -> list[str]:
        return [p.value for p in self.params if p.positional]


def strip_noise(text: str) -> str:
    return _TAG.sub("", _COMMENT.sub("", _REFERENCE.sub("", text)))


def _spans(text: str) -> list[tuple[int, int]]:
    """Top-level balanced {{…}}; an opening without its end is passed over."""
    out: list[tuple[int, int]] = []
    opens: list[int] = []
    for m in _BRACES.finditer(text):
        if m[0] == "{{":
            opens.append(m.start())
        elif opens:
            start = opens.pop()
            while out and out[-1][0] > start:
                out.pop()
            out.append((start, m.end()))
    return out


def _split(text: str, mark: str, most: int = -1) -> list[str]:
    """Split at ``mark`` outside nested templates and links."""
    if "{{" not in text and "[[" not in text:
        return text.split(mark, most)
    out, depth, at, k = [], 0, 0, 0
    while k < len(text):
        two = text[k : k + 2]
        if two in ("{{", "[["):
            depth += 1
            k += 2
        elif two in ("}}", "]]") and depth:
            depth -= 1
            k += 2
        else:
            if text[k] == mark and not depth and most:
                out.append(text[at:k])
                at = k + 1
                most -= 1
            k += 1
    return [*out, text[at:]]


def read_template(raw: str) -> Template:
    name, *rest = _split(raw[2:-2], "|")
    out, number = Template(raw, strip_noise(name).strip()), 0
    for part in rest:
        pieces = _split(_hide_annotations(part), "=", 1)
        if len(pieces) == 2:
            key = part[: len(pieces[0])].strip()
            out.params.append(Param(key, part[len(pieces[0]) + 1 :].strip(), key.isdigit()))
        else:
            number += 1
            out.params.append(Param(str(number), part, True))
    return out


def _hide_annotations(part: str) -> str:
    """The same text with <…> blanked, so that an equals sign in an annotation names no parameter."""
    if "<" not in part:
        return part
    out, depth = [], 0
    for k, c in enumerate(part):
        if c == "<":
            depth += 1
        out.append("\0" if depth else c)
        if c == ">" and depth:
            depth -= 1
    return "".join(out) if not depth else part


@lru_cache(maxsize=256)
def nodes(text: str) -> tuple[str | Template, ...]:
    """Text and top-level templates in order. The same body is asked for several times."""
    out: list[str | Template] = []
    at = 0
    for s, e in _spans(text) if "{{" in text else ():
        if s > at:
            out.append(text[at:s])
        out.append(read_template(text[s:e]))
        at = e
    if at < len(text):
        out.append(text[at:])
    return tuple(out)


def templates(text: str) -> list[Template]:
    """Top-level templates in order."""
    return [x for x in nodes(text) if isinstance(x, Template)]


def all_templates(text: str) -> list[Template]:
    """Templates at any depth, outer before inner, in order."""
    out = []
    for t in templates(text):
        out.append(t)
        out += all_templates(t.raw[2:-2])
    return out


def replace_templates(text: str, by: Callable[[Template], str]) -> str:
    return "".join(by(x) if isinstance(x, Template) else x for x in nodes(text))


def _link_text(m: re.Match) -> str:
    return m[1].split("|")[-1]


def strip_markup(text: str) -> str:
    """Plain text: links give their label, templates go, quotes and list markers go, entities are decoded."""
    if not _SPECIAL.search(text):
        return text
    text = replace_templates(strip_noise(text), lambda t: "")
    while True:
        linked = _LINK.sub(_link_text, text)
        if linked == text:
            break
        text = linked
    text = _EXTERNAL.sub(lambda m: m[1] or "", text)
    text = re.sub(r"'{2,}", "", text)
    return html.unescape(_MARKER.sub("", text))
