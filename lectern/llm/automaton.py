"""Byte regular expressions compiled to minimal deterministic automata.

The syntax is what secret rules need: literals, \\xHH and other escapes, classes, groups, | ? * + and
{m}, {m,}, {m,n}. Patterns read UTF-8 bytes, so classes hold ASCII characters only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Syntax trees: ("set", frozenset of bytes), ("cat", [..]), ("alt", [..]), ("rep", tree, least, most or None).


class _Parser:
    def __init__(self, pattern: str, ignore_case: bool):
        self.p, self.i, self.fold = pattern, 0, ignore_case

    def parse(self):
        tree = self.alt()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} of {self.p!r}")
        return tree

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def alt(self):
        options = [self.cat()]
        while self.peek() == "|":
            self.i += 1
            options.append(self.cat())
        return options[0] if len(options) == 1 else ("alt", options)

    def cat(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeat())
        return ("cat", items)

    def repeat(self):
        tree = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                least, comma, most = self.p[self.i : end].partition(",")
                self.i = end + 1
                tree = ("rep", tree, int(least), (int(most) if most else None) if comma else int(least))
            else:
                tree = ("rep", tree, int(c == "+"), 1 if c == "?" else None)
        return tree

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "r": 13, "t": 9}.get(c, ord(c))

    def atom(self):
        c = self.peek()
        if c == "(":
            self.i += 1
            tree = self.alt()
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.i += 1
            return tree
        if c == "[":
            self.i += 1
            return self.members()
        return self.of({self.char()})

    def members(self):
        negated = self.peek() == "^"
        self.i += negated
        found: set[int] = set()
        while self.peek() != "]":
            low = high = self.char()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                high = self.char()
            found |= set(range(low, high + 1))
        self.i += 1
        return self.of(set(range(256)) - found if negated else found)

    def of(self, found: set[int]):
        if self.fold:
            found = found | {b ^ 32 for b in found if chr(b & ~32).isalpha() and (b & ~32) < 128}
        return ("set", frozenset(found))


def parse(pattern: str, ignore_case: bool = False):
    return _Parser(pattern, ignore_case).parse()


def mirrored(tree):
    """The tree of the reversed language."""
    kind = tree[0]
    if kind == "cat":
        return ("cat", [mirrored(x) for x in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [mirrored(x) for x in tree[1]])
    if kind == "rep":
        return ("rep", mirrored(tree[1]), *tree[2:])
    return tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Adds ``tree`` after ``start``; the state where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for x in tree[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in tree[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(x, first)].append(end)
            return end
        _, inner, least, most = tree
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            hub = self.state()
            self.empty[start].append(hub)
            self.empty[self.add(inner, hub)].append(hub)
            return hub
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.add(inner, start)
            self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


@dataclass(frozen=True)
class Dfa:
    """``table[state * 256 + byte]`` is the next state times 256. Accepting states come last, from
    ``accepting`` on (times 256); ``rules[state]`` is the bit set of the rules that accept there."""

    table: np.ndarray
    rules: np.ndarray
    start: int
    accepting: int
    dead: int


def build(trees: list, anywhere: bool) -> Dfa:
    """One automaton for all trees by subset construction and minimisation. ``anywhere``: a match may
    begin at any byte; else only at the first."""
    nfa = _Nfa()
    root = nfa.state()
    if anywhere:
        nfa.moves[root].append((frozenset(range(256)), root))
    ends = {}
    for k, tree in enumerate(trees):
        first = nfa.state()
        nfa.empty[root].append(first)
        ends[nfa.add(tree, first)] = k
    # Bytes that no pattern tells apart share a column.
    kinds: dict[tuple, list[int]] = {}
    sets = list(dict.fromkeys(s for moves in nfa.moves for s, _ in moves))
    for b in range(256):
        kinds.setdefault(tuple(b in s for s in sets), []).append(b)
    columns = list(kinds.values())
    first = nfa.closure([root])
    number, order, rows = {first: 0}, [first], []
    for subset in order:
        row = []
        for column in columns:
            after = nfa.closure({t for q in subset for s, t in nfa.moves[q] if column[0] in s})
            if after not in number:
                number[after] = len(order)
                order.append(after)
            row.append(number[after])
        rows.append(row)
    steps = np.array(rows, np.int64)
    accepts = np.array([sum(1 << ends[q] for q in subset if q in ends) for subset in order], np.int64)
    # Moore's refinement: states stay together as long as acceptance and all successors' classes agree.
    part = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([part, part[steps]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    n = int(part.max()) + 1
    pick = np.zeros(n, np.int64)
    pick[part[::-1]] = np.arange(len(part))[::-1]
    rank = np.argsort(accepts[pick] != 0, kind="stable")
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    wide = np.zeros((n, 256), np.int64)
    for c, column in enumerate(columns):
        wide[:, column] = place[part[steps[pick[rank], c]]][:, None]
    rules = accepts[pick[rank]]
    stuck = [q for q in range(n) if not rules[q] and (wide[q] == q).all()]
    return Dfa((wide * 256).astype(np.int32).ravel(), rules, int(place[part[0]]) * 256, int((rules == 0).sum()) * 256, (stuck[0] if stuck else -1) * 256)
