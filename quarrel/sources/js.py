"""Facts out of JavaScript and TypeScript sources: functions, control flow, imports, exports and what classes depend on.

A scanner turns text into tokens (comments, strings, templates and regular expressions are single tokens), and a parser of statements builds the
blocks and edges of each function in the terms of operators/flow.py. Expressions are not parsed: they end at a semicolon, at a closing bracket, or
at a line end after which nothing goes on; functions in them are found and parsed as functions of their own. Brackets that do not match are a
row of kind error, not an exception; what stands before is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\f\v ﻿]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<name>[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*|\#[A-Za-z_$][\w$]*)"""
    r"""|(?P<number>\d[\w.]*|\.\d[\w.]*)|(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)|(?P<template>`)|(?P<op>=>|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|\.\.\.|[-+*/%&|^<>=!]=+|\+\+|--|<<=?|>>>?=?|\*\*=?|.)""",
    re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
# Words of the language.
_BEFORE_OPERAND = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())
_NOT_CALLED = frozenset("if for while switch catch function return typeof super import with await yield".split())
_MODIFIERS = ("async", "static", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "declare")


@dataclass
class Token:
    kind: str  # name, number, string, template, regex or op
    text: str
    line: int
    fresh: bool  # first on its line
    mate: int = -1  # place of the matching bracket


def _template_end(text: str, at: int) -> int:
    """The place behind a template that starts at `at`; placeholders may hold templates."""
    at += 1
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                if text[at] == "`":
                    at = _template_end(text, at)
                    continue
                if text[at] in "'\"" and (quoted := _TOKEN.match(text, at)):
                    at = quoted.end()
                    continue
                depth += (text[at] == "{") - (text[at] == "}")
                at += 1
        else:
            at += 1
    return at


def scan(text: str) -> tuple[list[Token], int]:
    """Tokens with their mates, and the line of the first bracket that has none (0 if all do)."""
    out: list[Token] = []
    at, line, fresh, bad = 0, 1, True, 0
    stack: list[int] = []
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, found = m.lastgroup, m[0]
        if kind == "op" and found[0] == "/" and (not out or (out[-1].kind == "op" and out[-1].text not in (")", "]", "}")) or out[-1].text in _BEFORE_OPERAND) and (r := _REGEX.match(text, at)):
            kind, found = "regex", r[0]
        elif kind == "template":
            found = text[at : _template_end(text, at)]
        at += len(found)
        if kind not in ("space", "line", "comment"):
            out.append(Token(kind, found, line, fresh))
            fresh = False
            if kind == "op" and found in _OPEN:
                stack.append(len(out) - 1)
            elif kind == "op" and found in _CLOSE:
                if stack and _OPEN[out[stack[-1]].text] == found:
                    out[-1].mate = stack.pop()
                    out[out[-1].mate].mate = len(out) - 1
                else:
                    bad = bad or line
        if lines := found.count("\n"):
            line, fresh = line + lines, True
    for i in stack:
        bad = min(x for x in (bad, out[i].line) if x) if bad else out[i].line
        out[i].mate = len(out)
    return out, bad


@dataclass
class Flow:
    """Blocks and edges of one function; block 0 is the entry, 1 the exit."""

    name: str
    line: int
    end: int
    blocks: list[str] = field(default_factory=lambda: ["entry", "exit"])
    edges: list[tuple[int, int, str]] = field(default_factory=list)
    statements: list[tuple[int, str, int, int]] = field(default_factory=list)  # block, kind, line, end
    extras: int = 0
    nesting: int = 0

    def block(self, label: str) -> int:
        self.blocks.append(label)
        return len(self.blocks) - 1

    def edge(self, a: int | None, b: int, kind: str = "normal") -> None:
        if a is not None:
            self.edges.append((a, b, kind))


class Parser:
    def __init__(self, text: str):
        self.t, self.error = scan(text)
        self.flows: list[Flow] = []
        self.names: dict[str, int] = {}
        self.classes: list[tuple[str, int, int]] = []

    # ---- reading tokens ----

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def after(self, i: int) -> int:
        """The place behind the bracket that opens at i; the next one if none does."""
        if i >= len(self.t):
            return len(self.t)
        return max(i, min(self.t[i].mate, len(self.t) - 1)) + 1

    def expression_end(self, i: int, end: int) -> int:
        start = i
        while i < end:
            t = self.t[i]
            if t.text == ";" or (t.kind == "op" and t.text in _CLOSE):
                break
            if i > start and t.fresh and not self._goes_on(i):
                break
            i = self.after(i) if t.kind == "op" and t.text in _OPEN else i + 1
        return min(i, end)

    def _goes_on(self, i: int) -> bool:
        """Does the expression go on over the line end before token i?"""
        before, t = self.t[i - 1], self.t[i]
        if before.kind == "op" and before.text not in (")", "]", "}", "++", "--"):
            return True
        return before.text in _BEFORE_OPERAND or (t.kind == "op" and t.text not in ("{", "++", "--", "!", "~", "@", "#")) or t.text in ("instanceof", "in", "of", "as")

    # ---- functions ----

    def unique(self, name: str) -> str:
        n = self.names[name] = self.names.get(name, 0) + 1
        return name if n == 1 else f"{name}#{n}"

    def function(self, name: str, i: int, upto: int, body: int, line: int) -> None:
        """The function whose body's bracket opens at `body`; its parameters stand from i to upto."""
        end = self.after(body)
        f = Flow(self.unique(name), line, self.t[min(end, len(self.t)) - 1].line)
        self.flows.append(f)
        self.nested(i, upto, f)
        last = self.statements(f, body + 1, end - 1, 0, [], None, 1)
        f.edge(last, 1)

    def arrow(self, name: str, i: int, upto: int, body: int, end: int, line: int) -> None:
        """An arrow function whose body is an expression."""
        f = Flow(self.unique(name), line, self.t[end - 1].line if end > body else line)
        self.flows.append(f)
        self.nested(i, upto, f)
        at = f.block("body")
        f.edge(0, at)
        f.statements.append((at, "return", f.line, f.end))
        self.nested(body, end, f)
        f.edge(at, 1, "return")

    def nested(self, i: int, end: int, f: Flow | None) -> None:
        """Functions and classes in the tokens i to end; other tokens count towards f's logical operators and conditions."""
        while i < end:
            t = self.t[i]
            if t.text == "function" and t.kind == "name":
                j = i + 1 + (self.text(i + 1) == "*")
                name = self.text(j) if j < end and self.t[j].kind == "name" else self._given(i) or "anonymous"
                j = next((k for k in range(j, end) if self.text(k) == "("), end)
                body = self._body(self.after(j), end) if j < end else end
                if body < end:
                    self.function(name, j, body, body, t.line)
                    i = self.after(body)
                    continue
            elif t.text == "class" and t.kind == "name" and self.text(i - 1) != ".":
                i = self.type(i, end)
                continue
            elif t.text == "=>":
                first = self._parameters(i)
                name = self._given(first) or "arrow"
                if self.text(i + 1) == "{":
                    self.function(name, first, i, i + 1, self.t[first].line)
                    i = self.after(i + 1)
                else:
                    stop = self._arrow_end(i + 1, end)
                    self.arrow(name, first, i, i + 1, stop, self.t[first].line)
                    i = stop
                continue
            elif t.text == "(" and self.text(i - 1) not in _NOT_CALLED and self.t[i - 1].kind in ("name", "string") and (self.text(i - 2) in ("{", ",") or self.text(i - 2) in _MODIFIERS):
                body = self._body(self.after(i), end)
                if body < end and self.t[i - 1].kind == "name":  # a method in an object
                    self.function(self.text(i - 1), i, body, body, self.t[i - 1].line)
                    i = self.after(body)
                    continue
            if f is not None and t.kind == "op":
                f.extras += t.text in ("&&", "||", "??") or (t.text == "?" and self.text(i + 1) not in (":", ",", ")", "=", ";"))
            i += 1

    def _body(self, i: int, end: int) -> int:
        """The place of the bracket that opens a body, behind the parameters; a type may stand between. end if there is none."""
        if self.text(i) == ":":
            while i < end and self.text(i) not in ("{", ";", "=>", ","):
                i = self.after(i) if self.text(i) in ("(", "[") else i + 1
        return i if i < end and self.text(i) == "{" else end

    def _parameters(self, arrow: int) -> int:
        i = arrow - 1
        if self.text(i) != ")":  # one name, or a type behind the bracket
            j = i
            while j > 0 and self.t[j].kind == "name" and self.text(j - 1) == ":":
                j -= 2
            i = j if self.text(j) == ")" else i
        i = self.t[i].mate if self.text(i) == ")" else i
        return i - 1 if self.text(i - 1) == "async" else max(i, 0)

    def _given(self, i: int) -> str:
        """The name that an expression at i is given: x = ..., or x: ..."""
        k = i - 1 - (self.text(i - 1) == "async")
        return self.text(k - 1) if self.text(k) in ("=", ":") and k > 0 and self.t[k - 1].kind == "name" else ""

    def _arrow_end(self, i: int, end: int) -> int:
        while i < end and self.text(i) not in (",", ";") and not (self.t[i].kind == "op" and self.text(i) in _CLOSE):
            if self.t[i].fresh and not self._goes_on(i):
                break
            i = self.after(i) if self.t[i].kind == "op" and self.text(i) in _OPEN else i + 1
        return min(i, end)

    def type(self, i: int, end: int) -> int:
        """A class: its methods are functions named after it."""
        line, name = self.t[i].line, self.text(i + 1) if i + 1 < end and self.t[i + 1].kind == "name" and self.text(i + 1) != "extends" else self._given(i) or "anonymous"
        body = next((k for k in range(i + 1, end) if self.text(k) == "{"), end)
        if body >= end:
            return end
        stop = self.after(body)
        self.classes.append((name, line, self.t[stop - 1].line))
        k = body + 1
        while k < stop - 1:
            if self.text(k) == "(" and self.t[k - 1].kind == "name":
                at = self._body(self.after(k), stop)
                if at < stop:
                    self.function(f"{name}.{self.text(k - 1)}", k, at, at, self.t[k - 1].line)
                    k = self.after(at)
                    continue
            if self.text(k) in ("=",):
                last = self.expression_end(k + 1, stop - 1)
                self.nested(k + 1, last, None)
                k = last
                continue
            k = self.after(k) if self.text(k) in _OPEN else k + 1
        return stop

    # ---- statements ----

    def statements(self, f: Flow, i: int, end: int, at: int, loops: list[tuple[str, int, int | None]], handler: int | None, depth: int) -> int | None:
        """The statements i to end, from block `at` on; gives the block where control goes on, or None. Statements behind a terminator start
        a block that nothing leads to. loops: (label, exit, header or None for a switch), innermost last."""
        here: int | None = at
        while i < end:
            if here is None and self.text(i) != ";":
                here = f.block("unreachable")
            i, here = self.statement(f, i, end, here, loops, handler, depth)
        return here

    def one(self, f: Flow, i: int, end: int, at: int, loops: list, handler: int | None, depth: int) -> tuple[int, int | None]:
        """A statement or a block in brackets that hangs on another."""
        f.nesting = max(f.nesting, depth)
        if i >= end:
            return i, at
        if self.text(i) == "{":
            stop = self.after(i)
            return stop, self.statements(f, i + 1, stop - 1, at, loops, handler, depth + 1)
        return self.statement(f, i, end, at, loops, handler, depth + 1)

    def say(self, f: Flow, at: int | None, kind: str, i: int, stop: int) -> None:
        if at is not None:
            f.statements.append((at, kind, self.t[i].line, self.t[max(i, min(stop, len(self.t)) - 1)].line))

    def statement(self, f: Flow, i: int, end: int, at: int | None, loops: list, handler: int | None, depth: int, label: str = "") -> tuple[int, int | None]:
        t = self.t[i]
        word = t.text if t.kind in ("name", "op") else ""
        if word == ";":
            self.say(f, at, "noop", i, i + 1)
            return i + 1, at
        if word == "{":
            stop = self.after(i)
            return stop, self.statements(f, i + 1, stop - 1, at, loops, handler, depth)
        if t.kind == "name" and self.text(i + 1) == ":" and word not in ("default", "case"):
            return self.statement(f, i + 2, end, at, loops, handler, depth, word) if i + 2 < end else (end, at)
        if word in ("if", "while", "for", "switch", "do", "try", "with"):
            return getattr(self, f"_{word}")(f, i, end, at, loops, handler, depth, label)
        if word in ("return", "throw", "break", "continue"):
            stop = i + 1 if i + 1 >= end or self.t[i + 1].fresh else self.expression_end(i + 1, end)
            self.nested(i + 1, stop, f)
            self.say(f, at, word, i, stop)
            target = self.text(i + 1) if stop > i + 1 else ""
            if word == "return":
                f.edge(at, 1, "return")
            elif word == "throw":
                f.edge(at, handler if handler is not None else 1, "exception")
            else:
                for name, out, header in reversed(loops):
                    if (not target or target == name) and (word == "break" or header is not None):
                        f.edge(at, out if word == "break" else header, word)
                        break
            return stop + (self.text(stop) == ";" and stop < end), None
        if word in ("function", "class", "async", "export", "abstract") and (word != "async" or self.text(i + 1) == "function"):
            k = i
            while self.text(k) in ("export", "default", "async", "abstract", "declare") and k < end:
                k += 1
            if self.text(k) == "function":
                j = next((x for x in range(k, end) if self.text(x) == "("), end)
                body = self._body(self.after(j), end) if j < end else end
                if body < end:
                    self.nested(k, self.after(body), None)
                    self.say(f, at, "plain", i, self.after(body))
                    return self.after(body), at
            if self.text(k) == "class":
                stop = self.type(k, end)
                self.say(f, at, "plain", i, stop)
                return stop, at
        stop = max(self.expression_end(i, end), i + 1)
        self.nested(i, stop, f)
        self.say(f, at, "plain", i, stop)
        return stop + (self.text(stop) == ";" and stop < end), at

    def _test(self, f: Flow, i: int, at: int | None) -> int:
        """The bracket behind a keyword at i; gives the place behind it."""
        k = next((x for x in (i + 1, i + 2) if self.text(x) == "("), i + 1)
        stop = self.after(k) if self.text(k) == "(" else k
        self.nested(k + 1, stop - 1, f)
        self.say(f, at, "plain", i, stop)
        return stop

    def _if(self, f, i, end, at, loops, handler, depth, label):
        stop = self._test(f, i, at)
        yes, after = f.block("if_then"), f.block("if_merge")
        f.edge(at, yes, "cond_true")
        stop, last = self.one(f, stop, end, yes, loops, handler, depth) if stop < end else (stop, yes)
        f.edge(last, after)
        met = last is not None
        if self.text(stop) == "else" and stop < end:
            no = f.block("if_else")
            f.edge(at, no, "cond_false")
            deeper = depth - 1 if self.text(stop + 1) == "if" else depth  # else if is no deeper than its if
            stop, last = self.one(f, stop + 1, end, no, loops, handler, deeper)
            f.edge(last, after)
            met = met or last is not None
        else:
            f.edge(at, after, "cond_false")
            met = True
        return stop, after if met else None

    def _loop(self, f, i, end, at, loops, handler, depth, label):
        header = f.block("loop_header")
        f.edge(at, header)
        stop = self._test(f, i, header)
        body, out = f.block("loop_body"), f.block("loop_exit")
        f.edge(header, body, "cond_true")
        f.edge(header, out, "cond_false")
        stop, last = self.one(f, stop, end, body, [*loops, (label, out, header)], handler, depth) if stop < end else (stop, body)
        f.edge(last, header, "loop")
        return stop, out

    _while = _for = _loop

    def _with(self, f, i, end, at, loops, handler, depth, label):
        return self.one(f, self._test(f, i, at), end, at, loops, handler, depth)

    def _do(self, f, i, end, at, loops, handler, depth, label):
        body, test, out = f.block("do_body"), f.block("do_test"), f.block("loop_exit")
        f.edge(at, body)
        stop, last = self.one(f, i + 1, end, body, [*loops, (label, out, test)], handler, depth)
        f.edge(last, test)
        if self.text(stop) == "while":
            stop = self._test(f, stop, test)
        f.edge(test, body, "cond_true")
        f.edge(test, out, "cond_false")
        return stop + (self.text(stop) == ";" and stop < end), out

    def _switch(self, f, i, end, at, loops, handler, depth, label):
        body = self._test(f, i, at)
        if self.text(body) != "{":
            return body, at
        f.nesting = max(f.nesting, depth)
        stop, after = self.after(body), f.block("switch_merge")
        marks, k = [], body + 1
        while k < stop - 1:
            if self.text(k) in ("case", "default") and self.t[k].kind == "name":
                j = k + 1
                while j < stop - 1 and self.text(j) != ":":
                    j = self.after(j) if self.text(j) in _OPEN else j + 1
                marks.append((k, j))
                k = j + 1
            else:
                k = self.after(k) if self.t[k].kind == "op" and self.text(k) in _OPEN else k + 1
        fall, other = None, False
        for n, (k, j) in enumerate(marks):
            case = f.block("case")
            plain = self.text(k) == "default"
            other = other or plain
            f.edge(at, case, "cond_false" if plain else "cond_true")
            f.edge(fall, case)
            self.nested(k + 1, j, f)
            fall = self.statements(f, j + 1, marks[n + 1][0] if n + 1 < len(marks) else stop - 1, case, [*loops, (label, after, None)], handler, depth + 1)
        f.edge(fall, after)
        if not other:
            f.edge(at, after, "cond_false")
        return stop, after

    def _try(self, f, i, end, at, loops, handler, depth, label):
        f.nesting = max(f.nesting, depth)
        body, after = f.block("try"), f.block("try_merge")
        f.edge(at, body)
        stop, k = self.after(i + 1), self.after(i + 1)
        catch = f.block("catch") if self.text(k) == "catch" else None
        if catch is not None:
            f.edge(body, catch, "exception")
        last = self.statements(f, i + 2, stop - 1, body, loops, catch if catch is not None else handler, depth + 1)
        f.edge(last, after)
        if catch is not None:
            k = self.after(k + 1) if self.text(k + 1) == "(" else k + 1
            stop = self.after(k)
            f.edge(self.statements(f, k + 1, stop - 1, catch, loops, handler, depth + 1), after)
            k = stop
        if self.text(k) == "finally":
            stop = self.after(k + 1)
            return stop, self.statements(f, k + 2, stop - 1, after, loops, handler, depth + 1)
        return stop, after if any(b == after for _, b, _ in f.edges) else None

    # ---- a whole file ----

    def file(self) -> list[Flow]:
        main = Flow("<module>", 1, self.t[-1].line if self.t else 1)
        last = self.statements(main, 0, len(self.t), 0, [], None, 1)
        main.edge(last, 1)
        return [main, *self.flows]


def _literal(text: str) -> str | None:
    """The value of a quoted module name; None for a template with a placeholder."""
    return None if not text or text[0] not in "'\"`" or "${" in text else text[1:-1]


def _names(p: Parser, i: int) -> tuple[list[tuple[str, str]], int]:
    """(name, local name) pairs in the brackets at i."""
    out, stop, k = [], p.after(i), i + 1
    while k < stop - 1:
        if p.text(k) == "type" and p.t[k + 1].kind == "name" and p.text(k + 1) != "as":
            k += 1
        name = _literal(p.text(k)) or p.text(k)
        local = p.text(k + 2) if p.text(k + 1) == "as" else name
        out.append((name, _literal(local) or local))
        k += 3 if p.text(k + 1) == "as" else 1
        k += p.text(k) == ","
    return out, stop


def modules(p: Parser) -> list[tuple[str, str, str, str, int]]:
    """(kind, name, detail, source, line): imports (of kind import, type_only, dynamic, require or side_effect; detail is the local name), exports
    (named, default, all, commonjs; detail says what is declared or, with a source, re_export)."""
    out, i, n = [], 0, len(p.t)
    while i < n:
        t, word = p.t[i], p.text(i) if p.t[i].kind == "name" and p.text(i - 1) != "." else ""
        if word in ("import", "require") and p.text(i + 1) == "(":
            source = _literal(p.text(i + 2)) if p.after(i + 1) == i + 4 else None
            if source is not None:
                out.append(("dynamic" if word == "import" else "require", "", "", source, t.line))
        elif word == "import" and p.text(i + 1) != ".":
            kind, k, found = "import", i + 1, []
            if p.text(k) == "type" and p.text(k + 1) not in ("from", ","):
                kind, k = "type_only", k + 1
            if k < n and p.t[k].kind == "string":
                out.append(("side_effect", "", "", _literal(p.text(k)) or "", t.line))
                i = k + 1
                continue
            if k < n and p.t[k].kind == "name":
                found.append(("default", p.text(k)))
                k += 1 + (p.text(k + 1) == ",")
            if p.text(k) == "*":
                found.append(("*", p.text(k + 2)))
                k += 3
            elif p.text(k) == "{":
                more, k = _names(p, k)
                found += more
            if p.text(k) == "from" and (source := _literal(p.text(k + 1))) is not None:
                out += [(kind, name, local, source, t.line) for name, local in found]
                i = k + 2
                continue
        elif word == "export":
            k = i + 1
            if p.text(k) == "type" and p.text(k + 1) == "{":
                k += 1
            if p.text(k) == "*":
                name = p.text(k + 2) if p.text(k + 1) == "as" else "*"
                k += 3 if p.text(k + 1) == "as" else 1
                out.append(("all", name, "re_export", _literal(p.text(k + 1)) or "", t.line))
            elif p.text(k) == "{":
                found, k = _names(p, k)
                source = (_literal(p.text(k + 1)) or "") if p.text(k) == "from" else ""
                out += [("default" if local == "default" else "named", local, "re_export" if source else "list", source, t.line) for _, local in found]
            elif p.text(k) == "default":
                k += 1 + (p.text(k + 1) in ("async", "abstract"))
                out.append(("default", "default", {"function": "Function", "class": "Class"}.get(p.text(k), "Expression"), "", t.line))
            else:
                while p.text(k) in ("async", "abstract", "declare"):
                    k += 1
                what, k = p.text(k), k + 1 + (p.text(k + 1) == "*")
                if what in ("function", "class", "interface", "type", "enum", "namespace"):
                    out.append(("named", p.text(k), what.capitalize(), "", t.line))
                elif what in ("const", "let", "var"):
                    stop = p.expression_end(k, n)
                    while k < stop:
                        if p.t[k].kind == "name" and p.text(k - 1) in ("const", "let", "var", ","):
                            out.append(("named", p.text(k), "Variable", "", t.line))
                        k = p.after(k) if p.text(k) in _OPEN else k + 1
        elif word == "module" and p.text(i + 1) == "." and p.text(i + 2) == "exports" and p.text(i + 3) in ("=", "."):
            out.append(("commonjs", "default" if p.text(i + 3) == "=" else p.text(i + 4), "", "", t.line))
        elif word == "exports" and p.text(i + 1) == "." and p.text(i + 3) == "=":
            out.append(("commonjs", p.text(i + 2), "", "", t.line))
        i += 1
    return out


# Classes and objects of the platform that are no dependencies.
BUILT_IN = frozenset("Array ArrayBuffer Boolean Date Error Function Intl JSON Map Math Number Object Promise Proxy Reflect RegExp Set String Symbol URL WeakMap WeakSet console document exports global globalThis module navigator process window this super".split())


def dependencies(p: Parser) -> list[tuple[str, str]]:
    """Distinct (kind, name): what is constructed (new), whose methods are called (call), and what is named as a type or a parent (type)."""
    out = set()
    for i, t in enumerate(p.t):
        if t.kind != "name" or t.text in BUILT_IN:
            continue
        before, after = p.text(i - 1), p.text(i + 1)
        if before == "new":
            out.add(("new", t.text))
        elif after == "." and before not in (".", "?.") and i + 3 < len(p.t) and p.t[i + 2].kind == "name" and p.text(i + 3) == "(":
            out.add(("call", t.text))
        elif before in ("extends", "implements") or (before == ":" and t.text[0].isupper() and p.text(i - 2) != "?" and (p.t[i - 2].kind == "name" or p.text(i - 2) == ")")):
            out.add(("type", t.text))
    return sorted(out)


def identifiers(p: Parser) -> set[str]:
    """Names that stand anywhere but in an import, and not behind a dot."""
    out, i = set(), 0
    while i < len(p.t):
        if p.text(i) == "import" and p.text(i + 1) not in ("(", "."):
            i = p.expression_end(i, len(p.t))
            continue
        if p.t[i].kind == "name" and p.text(i - 1) not in (".", "?."):
            out.add(p.text(i))
        i += 1
    return out


SCHEMA = "path string, kind string, fn string, name string, detail string, source string, a long, b long, line long, end_line long"


def facts_of(path: str, text: str | None) -> list[tuple]:
    """Rows of SCHEMA: function (a logical operators, b nesting), block (a), edge (a to b, detail its kind), stmt (a block, b place, detail its
    kind), class, import_*, export_*, dep, ident and error."""
    p = Parser(text or "")
    out = [(path, "error", "", "", "bracket", "", 0, 0, p.error, p.error)] if p.error else []
    for f in p.file():
        fn = f"{path}::{f.name}"
        out.append((path, "function", fn, f.name, "", "", f.extras, f.nesting, f.line, f.end))
        out += [(path, "block", fn, str(i), label, "", i, 0, 0, 0) for i, label in enumerate(f.blocks)]
        out += [(path, "edge", fn, "", kind, "", a, b, 0, 0) for a, b, kind in f.edges]
        places: dict[int, int] = {}
        for block, kind, line, end in f.statements:
            places[block] = places.get(block, -1) + 1
            out.append((path, "stmt", fn, "", kind, "", block, places[block], line, end))
    out += [(path, "class", "", name, "", "", 0, 0, line, end) for name, line, end in p.classes]
    for kind, name, detail, source, line in modules(p):
        side = "import" if kind in ("import", "type_only", "dynamic", "require", "side_effect") else "export"
        out.append((path, f"{side}_{kind}", "", name, detail, source, 0, 0, line, line))
    out += [(path, "dep", "", name, kind, "", 0, 0, 0, 0) for kind, name in dependencies(p)]
    out += [(path, "ident", "", name, "", "", 0, 0, 0, 0) for name in sorted(identifiers(p))]
    return out


def facts(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA for files(path, content): every file is read and parsed once, whatever is asked of it; an unreadable one (null) has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for path, text in zip(b["path"], b["content"], strict=True) for r in facts_of(path, text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def flow_tables(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """blocks, edges and stmts of operators/flow.py out of facts(); blocks are numbers, the exit is block 1."""
    blocks = found.where("kind = 'block'").selectExpr("fn", "a AS block", "a = 0 AS entry")
    edges = found.where("kind = 'edge'").selectExpr("fn", "a AS src", "b AS dst", "detail AS kind")
    return blocks, edges, found.where("kind = 'stmt'").selectExpr("fn", "a AS block", "b AS pos", "detail AS kind")
