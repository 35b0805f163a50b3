"""Packrat parsing-expression grammars over tokens.

A grammar is text: one rule per line, `name <- expression`, with / * + ? ! & and parentheses, 'literal' tokens and
classes of tokens in capitals. Every (rule, position) is decided once; the furthest failure is kept.
"""

from __future__ import annotations

import re

_PART = re.compile(r"\s*(?:'([^']*)'|([A-Za-z_]\w*)|([()/*+?!&]))")


class Grammar:
    def __init__(self, text: str):
        self.rules = {}
        for line in re.sub(r"\n[ \t]+", " ", re.sub(r"\n+", "\n", text.strip())).split("\n"):
            name, _, body = line.partition("<-")
            self.parts = [m.groups() for m in _PART.finditer(body)]
            self.at = 0
            self.rules[name.strip()] = self._choice()
        self.start = next(iter(self.rules))

    def _peek(self):
        return self.parts[self.at] if self.at < len(self.parts) else (None, None, None)

    def _choice(self):
        options = [self._sequence()]
        while self._peek()[2] == "/":
            self.at += 1
            options.append(self._sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def _sequence(self):
        items = []
        while self.at < len(self.parts) and self._peek()[2] not in (")", "/"):
            items.append(self._suffixed())
        return ("seq", items) if len(items) != 1 else items[0]

    def _suffixed(self):
        literal, name, mark = self._peek()
        self.at += 1
        if mark in ("!", "&"):
            return (mark, self._suffixed())
        if mark == "(":
            item = self._choice()
            self.at += 1
        elif literal is not None:
            item = ("tok", literal)
        else:
            item = ("tok", name) if name.isupper() else ("rule", name)
        while self._peek()[2] in ("*", "+", "?"):
            item = (self._peek()[2], item)
            self.at += 1
        return item


class _Writer:
    """Python source of the rules: one function per rule, in which i is the position and -1 stands for failure."""

    def __init__(self, grammar: Grammar):
        self.rules = grammar.rules
        self.sets: list[frozenset] = []
        self.lines: list[str] = []
        self.count = 0
        self.first = {name: (frozenset(), False) for name in self.rules}
        while True:  # least fixed point of what each rule may begin with
            new = {name: self._first(node) for name, node in self.rules.items()}
            if new == self.first:
                break
            self.first = new

    def _first(self, node) -> tuple[frozenset | None, bool]:
        """(kinds that a match may begin with, None for all; may it match without a token)."""
        op, arg = node
        if op == "tok":
            return (frozenset(), True) if arg == "NLB" else (None, False) if arg == "ANY" else (frozenset([arg]), False)
        if op == "rule":
            return self.first[arg]
        if op in ("!", "&"):
            return frozenset(), True
        if op in ("*", "?", "+"):
            kinds, empty = self._first(arg)
            return kinds, empty or op != "+"
        kinds, empty = frozenset(), op == "seq"
        for x in arg:
            more, skips = self._first(x)
            kinds = None if kinds is None or more is None else kinds | more
            if op == "or":
                empty = empty or skips
            elif not skips:
                return kinds, False
        return kinds, empty

    def _put(self, depth: int, *lines: str) -> None:
        self.lines += [" " * depth + x for x in lines]

    def _name(self, prefix: str) -> str:
        self.count += 1
        return f"{prefix}{self.count}"

    def _guard(self, node) -> str | None:
        """A test that fails where node cannot begin; None where it always may or is a single token."""
        kinds, empty = self._first(node)
        if empty or kinds is None or node[0] == "tok":
            return None
        if len(kinds) == 1:
            return f"k[i] == {next(iter(kinds))!r}"
        if kinds not in self.sets:
            self.sets.append(kinds)
        return f"k[i] in s{self.sets.index(kinds)}"

    def _tried(self, node, depth: int) -> None:
        test = self._guard(node)
        if test:
            self._put(depth, f"if {test}:")
            self._node(node, depth + 1)
            self._put(depth, "else:", " if i > far: far = i", " i = -1")
        else:
            self._node(node, depth)

    def _node(self, node, depth: int) -> None:
        op, arg = node
        if op == "tok" and arg == "NLB":
            self._put(depth, "if not b[i]: i = -1")
        elif op == "tok" and arg == "ANY":
            self._put(depth, "i = i + 1 if k[i] != 'BAD' and k[i] != 'END' else -1")
        elif op == "tok":
            self._put(depth, f"if k[i] == {arg!r}: i += 1", "else:", " if i > far: far = i", " i = -1")
        elif op == "rule":
            self._put(depth, f"i = r_{arg}(i)")
        elif op == "seq":
            for n, x in enumerate(arg):
                if n:
                    self._put(depth, "if i >= 0:")
                    depth += 1
                self._node(x, depth)
            if not arg:
                self._put(depth, "pass")
        elif op == "or":
            start = self._name("a")
            self._put(depth, f"{start} = i")
            for n, x in enumerate(arg):
                if n:
                    self._put(depth, "if i < 0:", f" i = {start}")
                self._tried(x, depth + bool(n))
        elif op in ("!", "&"):
            start = self._name("a")
            self._put(depth, f"{start} = i")
            self._tried(arg, depth)
            self._put(depth, f"i = {start} if i {'<' if op == '!' else '>='} 0 else -1")
        elif op == "?":
            start = self._name("a")
            self._put(depth, f"{start} = i")
            self._tried(arg, depth)
            self._put(depth, f"if i < 0: i = {start}")
        else:
            start = self._name("a")
            if op == "+":
                self._node(arg, depth)
                self._put(depth, "if i >= 0:")
                depth += 1
            self._put(depth, "while True:", f" {start} = i")
            self._tried(arg, depth + 1)
            self._put(depth, f" if i <= {start}:", f"  i = {start}", "  break")

    def source(self, start: str) -> str:
        for name, node in self.rules.items():
            self._put(1, f"def r_{name}(i):", " nonlocal far")
            test = self._guard(node)
            if test:
                self._put(2, f"if not {test}:" if "==" not in test else f"if {test.replace('==', '!=')}:", " if i > far: far = i", " return -1")
            self._put(2, f"at = i; i = m_{name}.get(at)", "if i is not None: return i", "i = at", f"m_{name}[at] = -1")
            self._node(node, 2)
            self._put(2, f"m_{name}[at] = i", "return i")
        head = ["def make(sets):", " k = []; b = []; far = 0", *(f" s{n} = sets[{n}]" for n in range(len(self.sets))), *(f" m_{name} = {{}}" for name in self.rules)]
        clear = "; ".join(f"m_{name}.clear()" for name in self.rules)
        tail = [" def run(kinds, breaks):", "  nonlocal k, b, far", f"  k = kinds; b = breaks; far = 0; {clear}", f"  return r_{start}(0), far", " return run"]
        return "\n".join([*head, *self.lines, *tail])


def compiled(grammar: Grammar):
    """parse(kinds, breaks) -> (accepted, furthest): kinds are the tokens' names, breaks whether a line break precedes.

    A rule or alternative whose first token cannot match is not entered; what it would have cost is the only difference.
    """
    writer = _Writer(grammar)
    scope: dict = {}
    exec(writer.source(grammar.start), scope)  # noqa: S102 - source made from the grammar above alone
    run = scope["make"](writer.sets)

    def parse(kinds: list[str], breaks: list[bool]) -> tuple[bool, int]:
        end, far = run([*kinds, "END"], [*breaks, True])
        good = end == len(kinds) + 1
        return good, len(kinds) if good else far

    return parse
