"""Regular expressions to one minimal deterministic automaton over single bytes."""

from __future__ import annotations

import numpy as np

OTHER = 128  # stands for every symbol beyond ASCII
ALPHABET = range(OTHER + 1)


class _Nfa:
    """Thompson's construction for literals, escapes, classes, groups, |, ?, *, + and {m,n}."""

    def __init__(self, backwards: bool = False):
        self.free: list[list[int]] = []
        self.on: list[tuple[frozenset[int], int] | None] = []
        self.backwards = backwards

    def node(self) -> int:
        self.free.append([])
        self.on.append(None)
        return len(self.on) - 1

    def build(self, tree) -> tuple[int, int]:
        kind, value = tree
        first, last = self.node(), self.node()
        if kind == "set":
            self.on[first] = (value, last)
        elif kind == "seq":
            at = first
            for part in reversed(value) if self.backwards else value:
                a, b = self.build(part)
                self.free[at].append(a)
                at = b
            self.free[at].append(last)
        elif kind == "alt":
            for part in value:
                a, b = self.build(part)
                self.free[first].append(a)
                self.free[b].append(last)
        else:  # repeat
            part, least, most = value
            at = first
            for _ in range(least):
                a, b = self.build(part)
                self.free[at].append(a)
                at = b
            if most is None:
                a, b = self.build(part)
                self.free[at] += [a, last]
                self.free[b] += [a, last]
            else:
                for _ in range(most - least):
                    a, b = self.build(part)
                    self.free[at] += [a, last]
                    at = b
                self.free[at].append(last)
        return first, last


def parse(pattern: str, ignore_case: bool = False):
    """Syntax tree of a pattern."""
    at = 0

    def escaped() -> int:
        nonlocal at
        at += 2
        if pattern[at - 1] == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord(pattern[at - 1])

    def symbol() -> int:
        nonlocal at
        if pattern[at] == "\\":
            return escaped()
        at += 1
        return ord(pattern[at - 1])

    def cased(symbols) -> tuple:
        both = {ord(f(chr(s))) for s in symbols for f in (str.lower, str.upper)} if ignore_case else symbols
        return "set", frozenset(both)

    def one():
        nonlocal at
        if pattern[at] == "(":
            at += 3 if pattern.startswith("(?:", at) else 1
            inner = choice()
            at += 1
            return inner
        if pattern[at] != "[":
            return cased({symbol()})
        at += 1
        members: set[int] = set()
        while pattern[at] != "]":
            low = symbol()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                members |= set(range(low, symbol() + 1))
            else:
                members.add(low)
        at += 1
        return cased(members)

    def repeated():
        nonlocal at
        part = one()
        while at < len(pattern) and pattern[at] in "?*+{":
            if pattern[at] == "{":
                end = pattern.index("}", at)
                low, _, high = pattern[at + 1 : end].partition(",")
                bounds = int(low), (int(high) if high else None if "," in pattern[at:end] else int(low))
                at = end + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[pattern[at]]
                at += 1
            part = ("repeat", (part, *bounds))
        return part

    def sequence():
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(repeated())
        return "seq", parts

    def choice():
        nonlocal at
        options = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            options.append(sequence())
        return ("alt", options) if len(options) > 1 else options[0]

    return choice()


class Automaton:
    """Transition array of a minimal automaton; states with a match have the highest numbers.

    `step[state + symbol class]` is the next state, states being multiples of `width`; state 0 is the
    start. `accepts[state // width]` names the rules that match up to here.
    """

    def __init__(self, trees: list, anchored: bool, backwards: bool = False):
        nfa = _Nfa(backwards)
        ends = {}
        starts = []
        for rule, tree in enumerate(trees):
            first, last = nfa.build(tree)
            starts.append(first)
            ends[last] = rule
        classes: dict[tuple, int] = {}
        sets = list({on[0] for on in nfa.on if on})
        self.classes = bytes(classes.setdefault(tuple(s in x for x in sets), len(classes)) for s in ALPHABET)
        samples = [self.classes.index(c) for c in range(len(classes))]

        def closed(nodes) -> frozenset[int]:
            seen, todo = set(nodes), list(nodes)
            while todo:
                for n in nfa.free[todo.pop()]:
                    if n not in seen:
                        seen.add(n)
                        todo.append(n)
            return frozenset(n for n in seen if nfa.on[n] or n in ends)

        begin = closed(starts)
        states, moves, todo = {begin: 0}, [], [begin]
        for state in todo:  # grows while it runs: subset construction
            row = []
            for s in samples:
                after = {nfa.on[n][1] for n in state if nfa.on[n] and s in nfa.on[n][0]}
                target = closed(after) | (frozenset() if anchored else begin)
                if target not in states:
                    states[target] = len(states)
                    todo.append(target)
                row.append(states[target])
            moves.append(row)
        marks = [frozenset(ends[n] for n in s if n in ends) for s in todo]
        kind = self._numbered(marks)
        while True:  # Moore's minimisation: split classes until their moves agree
            finer = self._numbered([(kind[s], tuple(kind[t] for t in moves[s])) for s in range(len(moves))])
            if max(finer) == max(kind):
                break
            kind = finer
        sample_of = {k: s for s, k in reversed(list(enumerate(kind)))}
        dead = self._dead(sample_of, kind, moves, marks)
        order = sorted(sample_of, key=lambda k: (k != kind[0], bool(marks[sample_of[k]])))
        place = {k: i for i, k in enumerate(order)}
        self.width = len(samples)
        self.step = [place[kind[t]] * self.width for k in order for t in moves[sample_of[k]]]
        self.accepts = [tuple(sorted(marks[sample_of[k]])) for k in order]
        plain = [i for i, a in enumerate(self.accepts) if i and a]
        self.first_accept = min(plain, default=len(order)) * self.width
        self.dead = {place[k] * self.width for k in dead}

    @staticmethod
    def _numbered(keys) -> list[int]:
        seen: dict = {}
        return [seen.setdefault(k, len(seen)) for k in keys]

    @staticmethod
    def _dead(sample_of, kind, moves, marks) -> set[int]:
        """States from which nothing can match any more."""
        return {k for k, s in sample_of.items() if not marks[s] and all(kind[t] == k for t in moves[s])}

    def symbols(self, text: str) -> bytes:
        """A byte for each code point: the class of its symbol."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return np.frombuffer(self.classes, np.uint8)[np.minimum(points, OTHER)].tobytes()

    def longest(self, data: bytes, at: int, stop: int) -> int | None:
        """Where the longest match that begins at `at` ends, before `stop`; None if there is none.

        With `stop` below `at` the data are read backwards.
        """
        state, best, step, dead = 0, None, self.step, self.dead
        way = 1 if stop >= at else -1
        for i in range(at, stop, way):
            state = step[state + data[i]]
            if state in dead:
                break
            if self.accepts[state // self.width]:
                best = i + way
        return best
