"""Tokens and literals that the schema and query languages share."""

from __future__ import annotations

import json
import re

from ..types import QueryError

_TOKEN = re.compile(r'[\s,﻿]+|#[^\n]*|(?P<name>[_A-Za-z]\w*)|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<block>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<spread>\.\.\.)|(?P<sign>[{}()\[\]:=!$@|&])')


class Enum(str):
    """A bare name as a value, such as ASC."""


class Variable(str):
    """$name as a value."""


class Tokens:
    def __init__(self, text: str) -> None:
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at]!r} at {at}")
            if m.lastgroup:
                self.items.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.items[k][1] if k < len(self.items) else ""

    def kind(self) -> str:
        return self.items[self.at][0] if self.at < len(self.items) else "end"

    def take(self, wanted: str | None = None) -> str:
        if self.at >= len(self.items) or wanted is not None and self.peek() != wanted:
            raise QueryError(f"expected {wanted or 'more'}, found {self.peek() or 'the end'}")
        self.at += 1
        return self.items[self.at - 1][1]

    def name(self) -> str:
        if self.kind() != "name":
            raise QueryError(f"expected a name, found {self.peek() or 'the end'}")
        return self.take()

    def has(self, sign: str) -> bool:
        if self.peek() == sign and self.kind() in ("sign", "spread", "name"):
            self.at += 1
            return True
        return False

    def value(self):
        kind = self.kind()
        if kind == "number":
            text = self.take()
            return int(text) if re.fullmatch(r"-?\d+", text) else float(text)
        if kind == "string":
            return json.loads(self.take())
        if kind == "block":
            return self.take()[3:-3].replace('\\"""', '"""').strip()
        if kind == "name":
            text = self.take()
            return {"true": True, "false": False, "null": None}.get(text, Enum(text))
        if self.has("$"):
            return Variable(self.name())
        if self.has("["):
            out = []
            while not self.has("]"):
                out.append(self.value())
            return out
        if self.has("{"):
            out = {}
            while not self.has("}"):
                key = self.name()
                self.take(":")
                out[key] = self.value()
            return out
        raise QueryError(f"expected a value, found {self.peek() or 'the end'}")

    def arguments(self) -> dict:
        out = {}
        if self.has("("):
            while not self.has(")"):
                key = self.name()
                self.take(":")
                out[key] = self.value()
        return out

    def directives(self) -> dict[str, dict]:
        out = {}
        while self.has("@"):
            name = self.name()
            out[name] = self.arguments()
        return out
