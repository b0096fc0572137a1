"""One deterministic automaton for many byte patterns: Thompson construction, subset
construction over byte classes, minimisation by partition refinement, transition arrays.

Patterns are byte regexes of literals, classes ``[...]``, groups, ``|``, ``?``, ``*`` and
``+``; a backslash quotes the next character.  The automaton is unanchored: after each byte
it knows which patterns end there.  Besides the 256 bytes its alphabet has one *cut* a
pattern, which forgets what of that pattern has been read; a scanner uses it at the end of a
match, so that matches of one pattern do not overlap.
"""

from __future__ import annotations

from dataclasses import dataclass

ANY = range(256)


class Pattern:
    """A regex as nested tuples: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, many)."""

    def __init__(self, text: str, ignore_case: bool = False):
        self.text, self.at, self.fold = text, 0, ignore_case
        self.tree = self.alternatives()
        if self.at != len(text):
            raise ValueError(f"unexpected {text[self.at]!r} at {self.at} in {text!r}")

    def peek(self) -> str:
        return self.text[self.at:self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            part = self.single()
            while self.peek() and self.peek() in "?*+":
                sign = self.take()
                part = ("rep", part, sign == "+", sign != "?")
            parts.append(part)
        return ("cat", parts)

    def single(self):
        c = self.take()
        if c == "(":
            inner = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            self.take()
            return inner
        if c == "[":
            return ("set", self.members())
        if c in "?*+":
            raise ValueError(f"nothing to repeat at {self.at - 1} in {self.text!r}")
        return ("set", self.folded({ord(self.take() if c == "\\" else c)}))

    def members(self) -> frozenset:
        inside, start = set(), self.at
        while self.peek() != "]" or self.at == start:
            c = self.take()
            low = ord(self.take() if c == "\\" else c)
            high = low
            if self.peek() == "-" and self.text[self.at + 1:self.at + 2] != "]":
                self.take()
                high = ord(self.take())
            inside.update(range(low, high + 1))
        self.take()
        return self.folded(inside)

    def folded(self, codes) -> frozenset:
        if self.fold:
            codes = codes | {x ^ 32 for x in codes if 65 <= x & ~32 <= 90}
        return frozenset(codes)


def backwards(tree):
    if tree[0] == "cat":
        return ("cat", [backwards(p) for p in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [backwards(p) for p in tree[1]])
    return tree if tree[0] == "set" else ("rep", backwards(tree[1]), *tree[2:])


class Net:
    """A nondeterministic automaton: silent steps and one byte set a state."""

    def __init__(self):
        self.silent: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []
        self.owner: list[int] = []
        self.ends: dict[int, int] = {}

    def state(self, owner: int) -> int:
        self.silent.append([])
        self.step.append(None)
        self.owner.append(owner)
        return len(self.step) - 1

    def add(self, tree, start: int, owner: int) -> int:
        """Append a tree behind a state; the state where it ends."""
        kind = tree[0]
        if kind == "set":
            end, own = self.state(owner), self.state(owner)
            self.silent[start].append(own)
            self.step[own] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start, owner)
            return start
        end = self.state(owner)
        if kind == "alt":
            for part in tree[1]:
                self.silent[self.add(part, start, owner)].append(end)
            return end
        _, part, least, many = tree
        begin = self.state(owner)
        self.silent[start].append(begin)
        last = self.add(part, begin, owner)
        self.silent[last].append(end)
        if not least:
            self.silent[begin].append(end)
        if many:
            self.silent[last].append(begin)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.silent[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def byte_classes(net: Net) -> list[list[int]]:
    """Bytes that no state tells apart, together."""
    sets = sorted({s[0] for s in net.step if s}, key=sorted)
    groups: dict[tuple, list[int]] = {}
    for b in ANY:
        groups.setdefault(tuple(b in s for s in sets), []).append(b)
    return list(groups.values())


@dataclass
class Automaton:
    """``table[256 * state + byte]`` is 256 times the next state.  States from ``first_end`` on
    are those where patterns end: ``ends[state]`` names them.  ``cuts[pattern][state]`` is 256 times the
    state without that pattern.  An anchored automaton has a dead state, ``dead``."""
    table: list[int]
    start: int
    first_end: int
    ends: dict[int, tuple[int, ...]]
    cuts: list[list[int]]
    dead: int

    @property
    def states(self) -> int:
        return len(self.table) // 256


def compile_patterns(trees, anchored: bool = False) -> Automaton:
    net = Net()
    roots = []
    for i, tree in enumerate(trees):
        root = net.state(i)
        roots.append(root)
        net.ends[net.add(tree, root, i)] = i
    fresh = net.closure(roots)
    classes = byte_classes(net)

    def after(states: frozenset, byte: int) -> frozenset:
        reached = {net.step[s][1] for s in states if net.step[s] and byte in net.step[s][0]}
        return net.closure(reached) | (frozenset() if anchored else fresh)

    def without(states: frozenset, pattern: int) -> frozenset:
        return frozenset(s for s in states if net.owner[s] != pattern) | (frozenset() if anchored else fresh)

    # subset construction; the cuts are further letters of the alphabet
    number, rows, todo = {fresh: 0}, [], [fresh]
    for states in todo:
        row = [after(states, c[0]) for c in classes] + [without(states, p) for p in range(len(roots))]
        for target in row:
            if target not in number:
                number[target] = len(number)
                todo.append(target)
        rows.append([number[t] for t in row])
    ended = [tuple(sorted({net.ends[s] for s in states if s in net.ends})) for states in todo]

    # minimisation: blocks are split until all of a block go on alike
    names: dict = {}
    block = [names.setdefault(e, len(names)) for e in ended]
    while True:
        keys: dict = {}
        finer = [keys.setdefault((block[s], *(block[t] for t in row)), len(keys)) for s, row in enumerate(rows)]
        if len(keys) == len(set(block)):
            break
        block = finer

    # states where a pattern ends come last
    some = {b: s for s, b in reversed(list(enumerate(block)))}
    order = sorted(some, key=lambda b: (bool(ended[some[b]]), some[b]))
    place = {b: i for i, b in enumerate(order)}
    table = [0] * (256 * len(order))
    cuts = [[0] * len(order) for _ in roots]
    for b, i in place.items():
        row = [256 * place[block[t]] for t in rows[some[b]]]
        for letter, codes in enumerate(classes):
            for code in codes:
                table[256 * i + code] = row[letter]
        for p in range(len(roots)):
            cuts[p][i] = row[len(classes) + p]
    ends = {place[b]: ended[some[b]] for b in order if ended[some[b]]}
    dead = place[block[number[frozenset()]]] if frozenset() in number else -1
    return Automaton(table, 256 * place[block[0]], 256 * min(ends, default=len(order)), ends, cuts, 256 * dead)
