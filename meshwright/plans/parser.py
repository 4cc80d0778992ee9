"""Query text to steps: a tokenizer and a recursive parser."""

from __future__ import annotations

import re
from dataclasses import dataclass

from meshwright.functions.predicates import NAMES, P


@dataclass(frozen=True)
class Step:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Name:
    """A bare word, such as desc."""

    word: str


TOKEN = re.compile(r"""\s*(?:(?P<num>-?\d+\.\d+(?:[eE][-+]?\d+)?|-?\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[^\W\d]\w*)|(?P<mark>[().,]))""", re.S)


class QueryError(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"can't read the query at {text[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = tokens(text), 0

    def peek(self, ahead: int = 0) -> str | None:
        i = self.at + ahead
        return self.tokens[i][1] if i < len(self.tokens) else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or (want is not None and self.tokens[self.at][1] != want):
            raise QueryError(f"expected {want or 'more'} at {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def traversal(self) -> tuple[Step, ...]:
        if self.peek() in ("g", "__") and self.peek(1) == ".":
            self.at += 2
        steps = [self.step()]
        while self.peek() == ".":
            self.take(".")
            steps.append(self.step())
        return tuple(steps)

    def step(self) -> Step:
        kind, name = self.take()
        if kind != "name":
            raise QueryError(f"a step's name is expected at {name!r}")
        self.take("(")
        args = []
        while self.peek() != ")":
            args.append(self.argument())
            if self.peek() == ",":
                self.take(",")
            elif self.peek() != ")":
                raise QueryError(f"expected , or ) at {self.peek()!r}")
        self.take(")")
        return Step(name, tuple(args))

    def argument(self):
        kind, word = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind == "num":
            self.at += 1
            return float(word) if re.search(r"[.eE]", word) else int(word)
        if kind == "str":
            self.at += 1
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1], flags=re.S)
        if word in ("true", "false") and self.peek(1) != "(":
            self.at += 1
            return word == "true"
        if kind == "name" and self.peek(1) not in ("(", "."):
            self.at += 1
            return Name(word)
        if word in NAMES and self.peek(1) == "(":
            s = self.step()
            return P(s.name, s.args)
        return self.traversal()


def parse(text: str) -> tuple[Step, ...]:
    p = Parser(text)
    steps = p.traversal()
    if p.at != len(p.tokens):
        raise QueryError(f"text is left over at {p.peek()!r}")
    return steps
