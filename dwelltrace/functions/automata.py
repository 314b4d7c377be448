"""Patterns as deterministic automata, written back as patterns that Java runs without recursion.

Java's engine follows a loop over alternatives by recursion and tries every way through it. Rules
only ask whether a pattern is found, and for that an automaton does: the pattern becomes a
nondeterministic automaton, this a deterministic one with as few states as possible, and the states
are eliminated one by one into a pattern again. In a deterministic automaton a text has one way, so
from a state that is gone the way either comes back to it or leaves for good: what leads back is a
loop that is never given up again, which Java runs as a plain loop. Rounds of one character, of
which a long text mostly consists, are a loop of their own, ``(?>[x]*)``: Java runs that one several
times as fast as the possessive ``[x]*+`` or as rounds among others. Such a pattern reads a
text of any length in time proportional to it and with a stack that depends on the pattern only.

Characters are told apart as far as the pattern does. Sets of known code points are cut into cells;
sets that only the engine knows (``\\w``, ``\\p{Greek}``) are variables, both of whose values are
followed, and known for ASCII where they are. All of this happens once, when a rule file is loaded.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import product

LAST = 0x10FFFF
Spans = tuple[tuple[int, int], ...]

_MOST_POSITIONS, _MOST_LETTERS, _MOST_STATES, _MOST_TEXT = 3000, 64, 600, 80_000


class TooLarge(Exception):
    """An automaton beyond reason for a pattern."""


# -- sets of characters ----------------------------------------------------------------------


def joined(spans: Iterable[tuple[int, int]]) -> Spans:
    """Spans in order, overlapping and touching ones made one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return tuple(out)


def complement(spans: Spans) -> Spans:
    out, at = [], 0
    for low, high in spans:
        if at < low:
            out.append((at, low - 1))
        at = high + 1
    return (*out, (at, LAST)) if at <= LAST else tuple(out)


@cache
def _orbits() -> dict[int, frozenset[int]]:
    """Characters that differ in case only, by simple case folding, for all that have such."""
    groups: dict[str, set[int]] = defaultdict(set)
    for code in range(LAST + 1):
        char = chr(code)
        folded = char.casefold()
        if len(folded) > 1:
            folded = char.lower() if len(char.lower()) == 1 else char
        if folded != char:
            groups[folded] |= {code, ord(folded)} if len(folded) == 1 else {code}
    return {code: frozenset(group) for group in groups.values() for code in group}


def any_case(spans: Spans) -> Spans | None:
    """The spans with all cases of their characters; none if they are too many to look at."""
    if sum(high - low + 1 for low, high in spans) > 4096:
        return None
    orbits = _orbits()
    codes = [code for low, high in spans for code in range(low, high + 1)]
    return joined((c, c) for code in codes for c in orbits.get(code, (code,)))


# -- patterns --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Known:
    """One character of a set of code points."""

    spans: Spans


@dataclass(frozen=True)
class Named:
    """One character of a set that the engine knows, by its text inside brackets."""

    text: str
    negated: bool = False


@dataclass(frozen=True)
class Sequence:
    parts: tuple["Pattern", ...]


@dataclass(frozen=True)
class Choice:
    parts: tuple["Pattern", ...]


@dataclass(frozen=True)
class Repeat:
    part: "Pattern"
    least: int
    most: int | None


@dataclass(frozen=True)
class Edge:
    """The begin or the end of the text."""

    end: bool


Pattern = Known | Named | Sequence | Choice | Repeat | Edge

# What these classes hold of ASCII.
_ASCII = {
    r"\d": joined([(48, 57)]),
    r"\s": joined([(9, 13), (32, 32)]),
    r"\w": joined([(48, 57), (65, 90), (95, 95), (97, 122)]),
}


def _sets(pattern: Pattern) -> Iterator[Known | Named]:
    match pattern:
        case Known() | Named():
            yield pattern
        case Sequence(parts) | Choice(parts):
            for part in parts:
                yield from _sets(part)
        case Repeat(part):
            yield from _sets(part)


class _Alphabet:
    """Letters: cells of code points, each with a value for every named set."""

    def __init__(self, pattern: Pattern):
        sets = set(_sets(pattern))
        known = sorted({s.spans for s in sets if isinstance(s, Known)})
        self.names = sorted({s.text for s in sets if isinstance(s, Named)})
        known += [_ASCII[name] for name in self.names if name in _ASCII]
        if self.names:
            known.append(((0, 127),))
        edges = sorted({0, LAST + 1, *(low for s in known for low, _ in s), *(high + 1 for s in known for _, high in s)})
        cells: dict[tuple[bool, ...], list[tuple[int, int]]] = defaultdict(list)
        for low, after in zip(edges, edges[1:]):
            cells[tuple(any(a <= low <= b for a, b in s) for s in known)].append((low, after - 1))
        self.cells = [joined(spans) for spans in cells.values()]
        self.letters: list[tuple[int, tuple[bool, ...]]] = []
        for cell, spans in enumerate(self.cells):
            ascii_cell = spans[-1][1] < 128
            values = [
                [any(a <= spans[0][0] <= b for a, b in _ASCII[name])] if ascii_cell and name in _ASCII else [False, True]
                for name in self.names
            ]
            self.letters += [(cell, value) for value in product(*values)]
            if len(self.letters) > _MOST_LETTERS:
                raise TooLarge

    def members(self, chars: Known | Named) -> frozenset[int]:
        """The letters of a set."""
        if isinstance(chars, Named):
            at = self.names.index(chars.text)
            return frozenset(i for i, (_, value) in enumerate(self.letters) if value[at] != chars.negated)
        inside = [any(a <= spans[0][0] <= b for a, b in chars.spans) for spans in self.cells]
        return frozenset(i for i, (cell, _) in enumerate(self.letters) if inside[cell])

    def java(self, letters: frozenset[int]) -> str:
        """A bracketed class of some letters."""
        by_cell: dict[int, set[tuple[bool, ...]]] = defaultdict(set)
        for letter in letters:
            cell, value = self.letters[letter]
            by_cell[cell].add(value)
        whole: list[tuple[int, int]] = []
        parted: dict[tuple[bool, ...], list[tuple[int, int]]] = defaultdict(list)
        for cell, values in by_cell.items():
            if len(values) == sum(c == cell for c, _ in self.letters):
                whole += self.cells[cell]
                continue
            for value in values:
                parted[value] += self.cells[cell]
        whole = joined(whole)
        outside = complement(whole)
        if not parted and outside and len(_ranges(outside)) < len(_ranges(whole)):
            return f"[^{_ranges(outside)}]"
        parts = [_ranges(whole)]
        for value, spans in parted.items():
            asked = "".join(f"&&[{'' if yes else '^'}{name}]" for name, yes in zip(self.names, value))
            parts.append(f"[[{_ranges(joined(spans))}]{asked}]")
        return "[" + "".join(parts) + "]"


def _ranges(spans: Spans) -> str:
    return "".join(_char(a) if a == b else _listed(a, b) or f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans)


def _listed(low: int, high: int) -> str:
    """ASCII letters or digits one by one, which Java looks up at once where it tries ranges in turn."""
    text = "".join(map(chr, range(low, high + 1))) if high < 128 else ""
    return text if text.isalnum() else ""


def _char(code: int) -> str:
    return f"\\x{{{code:X}}}"


# -- automata --------------------------------------------------------------------------------


class _Ways:
    """A nondeterministic automaton: states with free moves and moves over letters."""

    def __init__(self, pattern: Pattern, alphabet: _Alphabet):
        self.alphabet = alphabet
        self.free: list[list[int]] = []
        self.at_edge: list[dict[bool, int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.accept = self.state()
        self.start = self.before(pattern, self.accept)

    def state(self, *free: int) -> int:
        if len(self.free) > _MOST_POSITIONS:
            raise TooLarge
        self.free.append(list(free))
        self.at_edge.append({})
        self.moves.append(None)
        return len(self.free) - 1

    def before(self, pattern: Pattern, after: int) -> int:
        """The state from which a pattern leads to ``after``."""
        match pattern:
            case Known() | Named():
                state = self.state()
                self.moves[state] = (self.alphabet.members(pattern), after)
            case Edge(end):
                state = self.state()
                self.at_edge[state][end] = after
            case Sequence(parts):
                state = after
                for part in reversed(parts):
                    state = self.before(part, state)
            case Choice(parts):
                state = self.state(*[self.before(part, after) for part in parts])
            case Repeat(part, least, most):
                if most is None:
                    state = self.state(after)
                    self.free[state].append(self.before(part, state))
                else:
                    state = after
                    for _ in range(most - least):
                        state = self.state(self.before(part, state), after)
                for _ in range(least):
                    state = self.before(part, state)
        return state

    def reach(self, states: Iterable[int], begin: bool = False, end: bool = False) -> frozenset[int]:
        found, waiting = set(), list(states)
        while waiting:
            state = waiting.pop()
            if state in found:
                continue
            found.add(state)
            waiting += self.free[state]
            waiting += [after for is_end, after in self.at_edge[state].items() if (end if is_end else begin)]
        return frozenset(found)


def _deterministic(ways: _Ways, search: bool) -> tuple[list[list[int]], list[bool], int]:
    """Moves by state and letter, whether a state accepts at the end of the text, and the start.
    Move -1 leads to acceptance whatever follows, -2 to none. With ``search`` a match may begin
    anywhere and the automaton is read from the begin of the text."""
    letters = range(len(ways.alphabet.letters))
    again = ways.reach([ways.start]) if search else frozenset()
    numbers: dict[frozenset[int], int] = {}
    states: list[frozenset[int]] = []

    def number(reached: frozenset[int]) -> int:
        if ways.accept in reached:
            return -1
        kept = frozenset(s for s in reached if ways.moves[s] or ways.at_edge[s])
        if not kept:
            return -2
        if kept not in numbers:
            if len(states) >= _MOST_STATES:
                raise TooLarge
            numbers[kept] = len(states)
            states.append(kept)
        return numbers[kept]

    start = number(ways.reach([ways.start], begin=search))
    moves: list[list[int]] = []
    at_end: list[bool] = []
    while len(moves) < len(states):
        kept = states[len(moves)]
        at_end.append(ways.accept in ways.reach(kept, end=True))
        row = []
        for letter in letters:
            after = [ways.moves[s][1] for s in kept if ways.moves[s] and letter in ways.moves[s][0]]
            row.append(number(ways.reach(after) | again))
        moves.append(row)
    # The end of an empty text is also its begin, where both edges hold at once.
    if start >= 0 and search:
        at_end.append(ways.accept in ways.reach([ways.start], begin=True, end=True))
        moves.append(list(moves[start]))
        start = len(moves) - 1
    return moves, at_end, start


def _fewest(moves: list[list[int]], at_end: list[bool], start: int) -> tuple[list[list[int]], list[bool], int]:
    """The same automaton with states that cannot be told apart made one, hopeless ones dropped."""
    hopeful = {i for i, row in enumerate(moves) if at_end[i] or -1 in row}
    while True:
        more = {i for i, row in enumerate(moves) if i not in hopeful and any(r in hopeful for r in row)}
        if not more:
            break
        hopeful |= more
    moves = [[r if r < 0 or r in hopeful else -2 for r in row] for row in moves]
    block = [int(end) for end in at_end]
    while True:
        signs = [(block[i], *(r if r < 0 else block[r] for r in row)) for i, row in enumerate(moves)]
        order = {sign: n for n, sign in enumerate(dict.fromkeys(signs))}
        refined = [order[sign] for sign in signs]
        if len(order) == len(set(block)):
            break
        block = refined
    block = refined
    first = {b: i for i, b in reversed(list(enumerate(block)))}
    merged = [[r if r < 0 else block[r] for r in moves[first[b]]] for b in range(len(first))]
    if start >= 0 and start not in hopeful:
        return [], [], -2
    return merged, [at_end[first[b]] for b in range(len(first))], block[start] if start >= 0 else start


def _grouped(text: str) -> str:
    return f"(?:{text})"


def _eliminated(alphabet: _Alphabet, moves: list[list[int]], at_end: list[bool], start: int) -> str:
    """The automaton as a pattern: what leads from the start to acceptance."""
    done = len(moves)
    edges: dict[int, dict[int, list[str]]] = {}
    for state, row in enumerate(moves):
        by_target: dict[int, set[int]] = defaultdict(set)
        for letter, target in enumerate(row):
            if target != -2:
                by_target[done if target == -1 else target].add(letter)
        edges[state] = {t: [alphabet.java(frozenset(s))] for t, s in by_target.items()}
        if at_end[state]:
            edges[state].setdefault(done, []).append(r"(?:\z)")
    reachable, waiting = set(), [start]
    while waiting:
        state = waiting.pop()
        if state not in reachable and state != done:
            reachable.add(state)
            waiting += edges[state]
    edges = {s: edges[s] for s in reachable}

    def one_of(texts: list[str]) -> str:
        return texts[0] if len(texts) == 1 else _grouped("|".join(texts))

    def loop(state: int) -> str:
        texts = edges[state].get(state)
        if not texts:
            return ""
        single = [text for text in texts if text.startswith("[") and _one_class(text)]
        others = [text for text in texts if text not in single]
        plain = f"(?>{one_of(single)}*)" if single else ""
        # No round begins as another does, so those of one character may go first.
        return plain + (_grouped(one_of(others) + plain) + "*+" if others else "")

    def cost(state: int) -> int:
        into = sum(len(x) for s, out in edges.items() if s != state for x in out.get(state, ()))
        out = sum(len(x) for t, texts in edges[state].items() if t != state for x in texts)
        ways_in = sum(1 for s, out in edges.items() if s != state and state in out)
        ways_out = sum(1 for t in edges[state] if t != state)
        return into * (ways_out - 1) + out * (ways_in - 1) + len(loop(state)) * (ways_in * ways_out - 1)

    while len(edges) > 1:
        state = min((s for s in edges if s != start), key=cost)
        inner, exits = loop(state), {t: one_of(x) for t, x in edges[state].items() if t != state}
        del edges[state]
        for out in edges.values():
            into = out.pop(state, None)
            if into:
                way = one_of(into) + inner
                for target, text in exits.items():
                    out.setdefault(target, []).append(way + text)
        if sum(len(x) for out in edges.values() for texts in out.values() for x in texts) > _MOST_TEXT:
            raise TooLarge
    return loop(start) + one_of(edges[start][done])


def _one_class(text: str) -> bool:
    """Whether a text is one bracketed class and not several things in a row."""
    depth = 0
    for i, char in enumerate(text):
        depth += (char == "[") - (char == "]")
        if depth == 0:
            return i == len(text) - 1
    return False


NEVER = r"(?!)"


def without_recursion(pattern: Pattern, search: bool) -> str:
    """A Java pattern that is found where ``pattern`` is. With ``search`` it is anchored at the
    begin of the text and looks for a match itself; otherwise it continues a match that has begun.

    Raises :class:`TooLarge` where the automaton would be.
    """
    alphabet = _Alphabet(pattern)
    moves, at_end, start = _fewest(*_deterministic(_Ways(pattern, alphabet), search))
    if start == -1:
        return ""
    if start == -2:
        return NEVER
    text = _eliminated(alphabet, moves, at_end, start)
    return rf"\A{_grouped(text)}" if search else _grouped(text)
