"""Rule patterns: the linear-time regex dialect users write, expressed for Java's engine.

Rule files are shared between tools, so a pattern must mean the same here as in the
dialect it was written for. Spark matches with ``java.util.regex``, which differs:

* ``$`` there also matches before a final newline, and ``.`` stops at more line ends;
* ``\\w \\d \\s \\b`` and ``(?i)`` are ASCII there and Unicode in rule files;
* ``(?U)`` swaps greediness in rule files and selects Unicode classes there;
* ``a*+`` repeats a repetition in rule files and is possessive there;
* look-around and back-references exist there only, and so are refused here;
* ``--``, ``~~`` and ``[:alpha:]`` inside brackets exist in rule files only;
* a loop over alternatives recurses once per round there, and a long value ends the JVM.
  Alternatives of one character each become a bracketed class, and a loop whose rounds are told
  apart by their first character, which is also not that of what follows, becomes possessive:
  both run as plain loops and find the same. A pattern with any other such loop is made
  deterministic first, from its begin or else from that loop on (``automata``), and runs in linear
  time. Only where that is out of reach (word boundaries and line anchors after such a loop, huge
  automata) it stays recursive and needs a thread stack that fits the longest value
  (``cluster_settings``);
* a search there tries every start anew, so a loop at the start of a pattern takes quadratic time.
  Rules only ask whether there is a match: a loop at either end is cut to its fewest rounds. What
  is then a plain word is a substring test, and a pattern of bounded length that ends at the end of
  the value only gets to see so much of it.

``to_java`` rewrites one pattern, once, on the driver when a rule file is loaded. What it
returns is a literal inside a built-in ``rlike``; no Python runs per row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import lru_cache

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from dwelltrace.functions.automata import (
    Choice,
    Edge,
    Known,
    Named,
    Pattern,
    Repeat,
    Sequence,
    Spans,
    TooLarge,
    any_case,
    complement,
    joined,
    without_recursion,
)


class PatternError(ValueError):
    """A pattern that the rule dialect does not accept."""


# Bracketed ASCII classes, long names of general categories, and the binary
# properties for which Java has a name of its own.
_ASCII_CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x{0}-\x{7F}", "blank": r"\t\x{20}",
    "cntrl": r"\x{0}-\x{1F}\x{7F}", "digit": "0-9", "graph": r"\x{21}-\x{7E}", "lower": "a-z",
    "print": r"\x{20}-\x{7E}", "punct": r"\x{21}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}",
    "space": r"\t\n\x{B}\f\r\x{20}", "upper": "A-Z", "word": "0-9A-Z_a-z", "xdigit": "0-9A-Fa-f",
}
_CATEGORIES = {
    "letter": "L", "casedletter": "LC", "uppercaseletter": "Lu", "lowercaseletter": "Ll",
    "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo", "mark": "M",
    "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me", "number": "N",
    "decimalnumber": "Nd", "letternumber": "Nl", "othernumber": "No", "punctuation": "P",
    "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps",
    "closepunctuation": "Pe", "initialpunctuation": "Pi", "finalpunctuation": "Pf",
    "otherpunctuation": "Po", "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc",
    "modifiersymbol": "Sk", "othersymbol": "So", "separator": "Z", "spaceseparator": "Zs",
    "lineseparator": "Zl", "paragraphseparator": "Zp", "other": "C", "control": "Cc",
    "format": "Cf", "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn",
}
_BINARY_PROPERTIES = {
    "alphabetic": "Alphabetic", "alpha": "Alphabetic", "lowercase": "Lowercase",
    "lower": "Lowercase", "uppercase": "Uppercase", "upper": "Uppercase",
    "whitespace": "White_Space", "space": "White_Space", "ideographic": "Ideographic",
    "ideo": "Ideographic", "joincontrol": "Join_Control", "joinc": "Join_Control",
    "hexdigit": "Hex_Digit", "hex": "Hex_Digit", "titlecase": "Titlecase",
    "noncharactercodepoint": "Noncharacter_Code_Point", "assigned": "Assigned",
}
_CONTROL_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "a": "\a", "v": "\v"}
_WORD_EDGES = {
    "start": r"(?<!\w)(?=\w)", "end": r"(?<=\w)(?!\w)", "start-half": r"(?<!\w)", "end-half": r"(?!\w)",
}
_ASCII_WORD = "[0-9A-Za-z_]"

_NOTHING = r"\x{0}&&[^\x{0}]"
_ANYTHING = r"\x{0}-\x{10FFFF}"


@dataclass(frozen=True)
class _Flags:
    ignore_case: bool = False
    multi_line: bool = False
    dot_all: bool = False
    verbose: bool = False
    swap_greed: bool = False
    unicode: bool = True


_FLAG_NAMES = {
    "i": "ignore_case", "m": "multi_line", "s": "dot_all", "x": "verbose", "U": "swap_greed", "u": "unicode",
}


def _quoted(char: str) -> str:
    """A character that stands for itself, in or outside brackets."""
    if char.isascii() and not char.isalnum():
        return "\\" + char if char.isprintable() and char != " " else f"\\x{{{ord(char):X}}}"
    return char


@dataclass
class _Piece:
    """Java text of one part of a pattern, and what is known of it."""

    text: str
    member: str | None = None  # the same inside brackets, if it is one character
    first: frozenset[str] | None = None  # characters it can start with, if known; empty at the end
    rounds: frozenset[str] | None = None  # first characters that tell its alternatives apart
    repetition: str = ""
    optional: bool = False
    fixed: bool = False  # a known number of single characters
    single: bool = False  # one character, repeated
    silent: bool = False  # a change of flags, which matches nothing
    pattern: Pattern | None = None  # the same for an automaton, if it can follow it
    recursive: bool = False  # whether Java recurses over some loop inside

    def __post_init__(self) -> None:
        self.fixed = self.member is not None

    def repeat(self, repetition: str) -> None:
        self.fixed &= not self.repetition and re.fullmatch(r"\{[1-9][0-9]*\}", repetition) is not None
        if self.repetition:
            # A second repetition applies to the first; bare, Java would read it as a
            # possessive or lazy suffix.
            self.text = f"(?:{self.text}{self.repetition})"
            self.rounds = None
            self.pattern = self.whole()
        self.single = self.member is not None
        self.member = None
        self.repetition = repetition
        self.optional |= repetition[0] in "*?" or repetition.startswith("{0")

    def whole(self) -> Pattern | None:
        """The pattern with its repetition."""
        if self.pattern is None or not self.repetition:
            return self.pattern
        return Repeat(self.pattern, *_bounds(self.repetition))

    def java(self, follows: "frozenset[str] | None") -> str:
        """The text with its repetition; ``follows`` is what the next piece can start with."""
        if not self.repetition or self.rounds is None or follows is None or self.rounds & follows:
            most = _bounds(self.repetition)[1] if self.repetition else 1
            self.recursive |= not self.single and (most is None or most > _FEW_ROUNDS)
            return self.text + self.repetition
        # Only whether a match exists counts, so a lazy loop is the same as a greedy one.
        greedy = self.repetition[:-1] if len(self.repetition) > 1 and self.repetition[-1] == "?" else self.repetition
        return self.text + greedy + "+"


# So many rounds of a loop are no danger to any stack.
_FEW_ROUNDS = 100


def _bounds(repetition: str) -> tuple[int, int | None]:
    """The fewest and the most rounds."""
    if repetition[0] in "*+?":
        return {"*": (0, None), "+": (1, None), "?": (0, 1)}[repetition[0]]
    low, comma, high = re.match(r"\{([0-9]+)(,?)([0-9]*)\}", repetition).groups()
    return int(low), int(high) if high else None if comma else int(low)


def _least(repetition: str) -> str:
    """The repetition cut to its fewest rounds."""
    if repetition[0] in "*?" or repetition.startswith("{0"):
        return "{0}"
    return "" if repetition[0] == "+" else re.match(r"\{[0-9]+", repetition).group() + "}"


def _without_loops_at_ends(pieces: list[_Piece]) -> list[_Piece]:
    """A whole alternative of a search, which may begin and end anywhere."""
    for _ in range(2):
        pieces = pieces[::-1]
        kept: list[_Piece] = []
        for piece in pieces:
            if piece.repetition and all(p.silent for p in kept):
                least = _least(piece.repetition)
                if least == "{0}":
                    continue
                piece.repetition = least
            kept.append(piece)
        pieces = kept
    return pieces


def _java(pieces: list[_Piece], at_end: bool) -> str:
    """A sequence; ``at_end`` if nothing of the pattern comes after it."""
    texts: list[str] = []
    follows: frozenset[str] | None = frozenset() if at_end else None
    for piece in reversed(pieces):
        texts.append(piece.java(follows))
        if not piece.optional:
            follows = piece.first
        elif follows is not None:
            follows = None if piece.first is None else follows | piece.first
    return "".join(reversed(texts))


def _deterministic(pieces: list[_Piece]) -> str:
    """A whole alternative of a search as Java text without recursion where that can be had: all of
    it, else what begins with its first recursive loop."""
    text = _java(pieces, True)
    if not any(piece.recursive for piece in pieces):
        return text
    first = next(i for i, piece in enumerate(pieces) if piece.recursive)
    for begin in (0, first) if first else (0,):
        patterns = [piece.whole() for piece in pieces[begin:]]
        if None in patterns or (begin and any(map(_looks_back, patterns))):
            continue
        try:
            made = without_recursion(Sequence(tuple(patterns)), search=begin == 0)
        except TooLarge:
            continue
        # The text is free of flags; those set on the way hold for later alternatives.
        flags = "".join(piece.text for piece in pieces[begin:] if piece.silent)
        # Java tries one start only where a pattern itself begins with \\A.
        edge = r"\A" if made.startswith(r"\A") else ""
        return f"{_java(pieces[:begin], False)}{edge}(?U-i:{made.removeprefix(edge)}){flags}"
    return text


def _longest(pattern: Pattern | None) -> int | None:
    """The most characters of a match that depends on nothing before it, if they are bounded."""
    match pattern:
        case Known() | Named():
            return 1
        case Edge(end):
            return 0 if end else None
        case Sequence(parts) | Choice(parts):
            lengths = [_longest(part) for part in parts]
            if None in lengths:
                return None
            return sum(lengths) if isinstance(pattern, Sequence) else max(lengths)
        case Repeat(part, _, most):
            length = _longest(part)
            return None if most is None or length is None else most * length
    return None


def _word(pieces: list[_Piece]) -> str | None:
    """The text that a whole alternative stands for, if there is only one."""
    parts = [piece.pattern for piece in pieces if not piece.silent]
    if any(piece.repetition for piece in pieces) or not all(isinstance(part, Known) for part in parts):
        return None
    if not parts or any(len(part.spans) != 1 or part.spans[0][0] != part.spans[0][1] for part in parts):
        return None
    word = "".join(chr(part.spans[0][0]) for part in parts)
    # A regex finds this one in broken UTF-8 too.
    return None if "\ufffd" in word else word


def _tail(pieces: list[_Piece]) -> int | None:
    """The most characters of a whole alternative that ends at the end of the value only."""
    parts = [piece.whole() for piece in pieces if not piece.silent]
    return _longest(Sequence(tuple(parts))) if parts and parts[-1] == Edge(end=True) else None


def _looks_back(pattern: Pattern) -> bool:
    match pattern:
        case Edge(end):
            return not end
        case Sequence(parts) | Choice(parts):
            return any(map(_looks_back, parts))
        case Repeat(part):
            return _looks_back(part)
    return False


def _choice(patterns: list[Pattern | None]) -> Pattern | None:
    return None if None in patterns else patterns[0] if len(patterns) == 1 else Choice(tuple(patterns))


def _known(spans: Spans, flags: _Flags) -> Pattern | None:
    """One of the characters, in any case if the flags say so."""
    spans = any_case(spans) if flags.ignore_case else spans
    return None if spans is None else Known(spans)


class _Rewriter:
    def __init__(self, pattern: str):
        self.pattern = pattern
        self.pos = 0
        self.group_names: set[str] = set()
        self.unicode_classes = False
        self.unicode_case = False
        # The characters of the class read last, if it lists them, and its spans, if it has such.
        self.listed: set[str] | None = None
        self.spans: list[tuple[int, int]] | None = None
        # Of the whole pattern: the word it is, and how many characters at the end decide.
        self.word: str | None = None
        self.tail: int | None = None

    # -- reading ---------------------------------------------------------------------

    def fail(self, reason: str) -> PatternError:
        return PatternError(f"{reason} at offset {self.pos} of pattern {self.pattern!r}")

    def looking_at(self, text: str) -> bool:
        return self.pattern.startswith(text, self.pos)

    def accept(self, text: str) -> bool:
        found = self.looking_at(text)
        if found:
            self.pos += len(text)
        return found

    def match(self, regex: str) -> re.Match | None:
        found = re.compile(regex).match(self.pattern, self.pos)
        if found:
            self.pos = found.end()
        return found

    def take(self) -> str:
        if self.pos >= len(self.pattern):
            raise self.fail("unexpected end")
        self.pos += 1
        return self.pattern[self.pos - 1]

    def skip_layout(self, flags: _Flags) -> None:
        if flags.verbose:
            self.match(r"(?:\s|#[^\n]*)*")

    # -- outside brackets ------------------------------------------------------------

    def rewrite(self) -> str:
        body = self.alternatives(_Flags(), depth=0).text
        if self.unicode_classes:
            return "(?U)" + body
        return "(?u)" + body if self.unicode_case else body

    def alternatives(self, flags: _Flags, depth: int) -> _Piece:
        """Everything up to the end of the pattern or of the group that was just opened."""
        choices: list[list[_Piece]] = [[]]
        repeatable = False
        while True:
            self.skip_layout(flags)
            if self.pos == len(self.pattern) or (depth and self.looking_at(")")):
                return self.body(choices, depth)
            if self.looking_at(")"):
                raise self.fail("unopened group")
            if self.accept("|"):
                choices.append([])
                repeatable = False
                continue
            repetition = self.repetition(flags)
            if repetition:
                if not repeatable:
                    raise self.fail("repetition of nothing")
                choices[-1][-1].repeat(repetition)
                continue
            switched = self.flag_switch(flags)
            if switched:
                flags, text = switched
                choices[-1].append(_Piece(text, silent=True, pattern=Sequence(())))
                repeatable = False
                continue
            choices[-1].append(self.atom(flags, depth))
            repeatable = True

    def body(self, choices: list[list[_Piece]], depth: int) -> _Piece:
        if all(len(choice) == 1 and choice[0].member for choice in choices):
            members = [choice[0].member for choice in choices]
            firsts = [choice[0].first for choice in choices]
            first = None if None in firsts else frozenset().union(*firsts)
            member = members[0] if len(members) == 1 else f"[{''.join(members)}]"
            patterns = [choice[0].pattern for choice in choices]
            known = all(isinstance(pattern, Known) for pattern in patterns)
            if len(members) == 1:
                pattern = patterns[0]
            else:
                pattern = Known(joined(span for p in patterns for span in p.spans)) if known else _choice(patterns)
            return _Piece(choices[0][0].text if len(members) == 1 else member, member, first, pattern=pattern)
        if depth == 0:
            choices = [_without_loops_at_ends(choice) for choice in choices]
            self.word = _word(choices[0]) if len(choices) == 1 else None
            tails = [_tail(choice) for choice in choices]
            self.tail = None if None in tails else max(tails)
            return _Piece("|".join(map(_deterministic, choices)))
        text = "|".join(_java(choice, False) for choice in choices)
        sequences = [[piece.whole() for piece in choice] for choice in choices]
        about = {
            "pattern": _choice([None if None in parts else Sequence(tuple(parts)) for parts in sequences]),
            "recursive": any(piece.recursive for choice in choices for piece in choice),
        }
        firsts = [None if not choice or choice[0].optional else choice[0].first for choice in choices]
        if None in firsts:
            return _Piece(text, **about)
        first = frozenset().union(*firsts)
        plain = all(piece.fixed for choice in choices for piece in choice)
        apart = sum(map(len, firsts)) == len(first)
        return _Piece(text, first=first, rounds=first if plain and apart else None, **about)

    def repetition(self, flags: _Flags) -> str | None:
        found = self.match(r"[*+?]")
        if found:
            count = found.group()
        elif self.looking_at("{"):
            found = self.match(r"\{\s*(\d+)\s*(?:(,)\s*(\d+)?\s*)?\}")
            if not found:
                raise self.fail("invalid repetition count")
            low, comma, high = found.groups()
            if high and int(high) < int(low):
                raise self.fail("descending repetition count")
            count = "{" + low + (comma or "") + (high or "") + "}"
        else:
            return None
        lazy = self.accept("?") != flags.swap_greed
        return count + ("?" if lazy else "")

    def flag_switch(self, flags: _Flags) -> tuple[_Flags, str] | None:
        """``(?flags)``: from here to the end of the enclosing group."""
        found = self.match(r"\(\?([A-Za-z-]+)\)")
        if not found:
            return None
        changed = self.apply_flags(flags, found.group(1))
        text = self.java_flags(flags, changed)
        return changed, f"(?{text})" if text else ""

    def apply_flags(self, flags: _Flags, letters: str) -> _Flags:
        on = True
        if letters.count("-") > 1 or letters.endswith("-"):
            raise self.fail("misplaced flag negation")
        for letter in letters:
            if letter == "-":
                on = False
            elif letter in _FLAG_NAMES:
                flags = replace(flags, **{_FLAG_NAMES[letter]: on})
            else:
                raise self.fail(f"unsupported flag {letter!r}")
        return flags

    def java_flags(self, before: _Flags, after: _Flags) -> str:
        """The part of a flag change that Java's engine has to see; the rest is rewritten."""
        on = off = ""
        if after.ignore_case:
            self.unicode_case = True
        if after.ignore_case != before.ignore_case:
            on, off = ("i", "") if after.ignore_case else ("", "i")
        if after.unicode != before.unicode:
            on, off = (on + "uU", off) if after.unicode else (on, off + "uU")
        return on + (f"-{off}" if off else "")

    @staticmethod
    def literal(char: str, flags: _Flags) -> _Piece:
        code = ord(char)
        first = None if flags.ignore_case else frozenset(char)
        return _Piece(_quoted(char), _quoted(char), first, pattern=_known(((code, code),), flags))

    def atom(self, flags: _Flags, depth: int) -> _Piece:
        char = self.take()
        if char == "(":
            return self.group(flags, depth)
        if char == "[":
            text = "[" + self.brackets(flags) + "]"
            negated = text.startswith("[^")
            known = self.listed is not None and not flags.ignore_case and not negated
            if self.spans is not None:
                pattern = _known(joined(self.spans), flags)
                pattern = Known(complement(pattern.spans)) if pattern and negated else pattern
            else:
                pattern = None if flags.ignore_case or not flags.unicode else Named(text)
            return _Piece(text, text, frozenset(self.listed) if known else None, pattern=pattern)
        if char == ".":
            if flags.dot_all:
                return _Piece("(?s:.)", pattern=Known(complement(())))
            return _Piece(r"[^\n]", r"[^\n]", pattern=Known(complement(((10, 10),))))
        if char == "^":
            return _Piece(r"(?:\A|(?<=\n))") if flags.multi_line else _Piece(r"(?:\A)", pattern=Edge(end=False))
        if char == "$":
            if flags.multi_line:
                return _Piece(r"(?=\n|\z)")
            return _Piece(r"(?:\z)", first=frozenset(), pattern=Edge(end=True))
        if char == "\\":
            return self.escape(flags)
        return self.literal(char, flags)

    def group(self, flags: _Flags, depth: int) -> _Piece:
        opening = "("
        named = self.match(r"\?P?<([A-Za-z_][A-Za-z0-9_.\[\]]*)>")
        if named:
            # Rules only ask whether a pattern matches, so the name itself is not needed.
            if named.group(1) in self.group_names:
                raise self.fail(f"duplicate group name {named.group(1)!r}")
            self.group_names.add(named.group(1))
        elif self.looking_at("?"):
            scoped = self.match(r"\?([A-Za-z-]*):")
            if not scoped:
                raise self.fail("look-around and other group extensions are not supported")
            inner = self.apply_flags(flags, scoped.group(1))
            opening = f"(?{self.java_flags(flags, inner)}:"
            flags = inner
        body = self.alternatives(flags, depth + 1)
        if not self.accept(")"):
            raise self.fail("unclosed group")
        body.text = f"{opening}{body.text})"
        if opening not in ("(", "(?:"):
            body.member = None  # its flags hold inside the group only
        return body

    def escape(self, flags: _Flags) -> _Piece:
        char = self.take()
        if char in "Az":
            return _Piece(rf"(?:\{char})", first=frozenset() if char == "z" else None, pattern=Edge(end=char == "z"))
        if char in "<>":
            self.unicode_classes = True
            return _Piece(f"(?:{_WORD_EDGES['start' if char == '<' else 'end']})")
        if char in "bB":
            edge = self.match(r"\{(start|end|start-half|end-half)\}") if char == "b" else None
            self.unicode_classes = True
            if edge:
                return _Piece(f"(?:{_WORD_EDGES[edge.group(1)]})")
            if flags.unicode:
                return _Piece(rf"(?:\{char})")
            word = _ASCII_WORD
            same = (f"(?<={word})(?={word})", f"(?<!{word})(?!{word})")
            differ = (f"(?<={word})(?!{word})", f"(?<!{word})(?={word})")
            return _Piece("(?:" + "|".join(differ if char == "b" else same) + ")")
        chars = self.character_set(char)
        if chars:
            same = chars if chars[0] == "[" else chars[:1] + chars[1].lower() + chars[2:]
            return _Piece(chars, chars, pattern=Named(same, same != chars) if flags.unicode else None)
        return self.literal(self.escaped_literal(char), flags)

    # -- escapes that are valid in and outside brackets ------------------------------

    def character_set(self, char: str) -> str | None:
        if char in "dDwWsS":
            self.unicode_classes = True
            return "\\" + char
        if char in "pP":
            return self.property(negated=char == "P")
        return None

    def property(self, negated: bool) -> str:
        found = self.match(r"\{(\^?)([^{}]*)\}") or self.match(r"()(\w)")
        if not found:
            raise self.fail("invalid Unicode property")
        negated ^= found.group(1) == "^"
        kind, _, value = found.group(2).replace("!=", "=").replace(":", "=").rpartition("=")
        negated ^= "!=" in found.group(2)
        plain = re.sub(r"[\s_-]", "", value).lower()
        plain = plain.removeprefix("is") if plain not in _CATEGORIES else plain
        kind = re.sub(r"[\s_-]", "", kind).lower()
        if not plain:
            raise self.fail("empty Unicode property")
        if kind in ("", "gc", "generalcategory") and plain == "any":
            name = None
        elif kind in ("", "gc", "generalcategory") and plain == "ascii":
            name = "ASCII"
        elif kind in ("", "gc", "generalcategory") and plain in _CATEGORIES:
            name = _CATEGORIES[plain]
        elif kind in ("", "gc", "generalcategory") and len(plain) <= 2:
            name = "LC" if plain in ("lc", "l&") else plain.capitalize()
        elif kind == "" and plain in _BINARY_PROPERTIES:
            name = "Is" + _BINARY_PROPERTIES[plain]
        elif kind in ("", "sc", "script"):
            name = "Is" + value.strip().replace(" ", "_")
        else:
            raise self.fail(f"unsupported Unicode property {found.group(2)!r}")
        if name is None:
            return f"[{_NOTHING if negated else _ANYTHING}]"
        return rf"\{'P' if negated else 'p'}{{{name}}}"

    def escaped_literal(self, char: str) -> str:
        """The one character that an escape stands for."""
        if char in _CONTROL_ESCAPES:
            return _CONTROL_ESCAPES[char]
        if char in "xuU":
            width = {"x": 2, "u": 4, "U": 8}[char]
            found = self.match(r"\{([0-9A-Fa-f]+)\}") or self.match(rf"([0-9A-Fa-f]{{{width}}})")
            code = int(found.group(1), 16) if found else -1
            if not 0 <= code <= 0x10FFFF or 0xD800 <= code <= 0xDFFF:
                raise self.fail("invalid character code")
            return chr(code)
        if char.isascii() and not char.isalnum():
            return char
        raise self.fail(f"unrecognized escape \\{char}")

    # -- brackets --------------------------------------------------------------------

    def brackets(self, flags: _Flags) -> str:
        """The inside of a bracketed class, for Java, after its opening bracket."""
        self.listed, self.spans = set(), []
        self.skip_layout(flags)
        negated = self.accept("^")
        result: str | None = None
        operator = ""
        members: list[str] = []
        self.skip_layout(flags)
        while self.accept("-"):
            members.append(r"\-")
            self.note("-", "-")
            self.skip_layout(flags)
        if not members and self.accept("]"):
            members.append(r"\]")
            self.note("]", "]")
        while True:
            self.skip_layout(flags)
            if self.pos == len(self.pattern):
                raise self.fail("unclosed character class")
            closing = self.accept("]")
            combining = None if closing else self.match(r"&&|--|~~")
            if closing or combining:
                if combining or operator:
                    self.listed = self.spans = None
                result = self.combine(result, operator, "".join(members) or _NOTHING)
                operator, members = combining.group() if combining else "", []
                if closing:
                    return f"^{result}" if negated else result
                continue
            members.append(self.member(flags))

    @staticmethod
    def combine(left: str | None, operator: str, right: str) -> str:
        if left is None:
            return right
        if operator == "&&":
            return f"[{left}]&&[{right}]"
        if operator == "--":
            return f"[{left}]&&[^{right}]"
        return f"[[{left}]&&[^{right}]][[{right}]&&[^{left}]]"

    def member(self, flags: _Flags) -> str:
        named = self.match(r"\[:(\^?)([a-z]+):\]")
        if named:
            if named.group(2) not in _ASCII_CLASSES:
                raise self.fail(f"unknown class {named.group(2)!r}")
            chars = _ASCII_CLASSES[named.group(2)]
            self.listed = self.spans = None
            return f"[^{chars}]" if named.group(1) else chars
        if self.accept("["):
            nested = "[" + self.brackets(flags) + "]"
            self.listed = self.spans = None
            return nested
        first = self.member_start()
        if len(first) > 1:
            self.listed = self.spans = None
            return first
        here = self.pos
        self.skip_layout(flags)
        if not self.looking_at("-") or self.match(r"-(?=[\]-])") is not None:
            # A hyphen before the closing bracket stands for itself; before another hyphen
            # it begins the difference operator.
            self.pos = here
            self.note(first, first)
            return _quoted(first)
        self.accept("-")
        self.skip_layout(flags)
        last = self.member_start()
        if len(last) > 1 or last < first:
            raise self.fail("invalid character range")
        self.note(first, last)
        return f"\\x{{{ord(first):X}}}-\\x{{{ord(last):X}}}"

    def note(self, first: str, last: str) -> None:
        """Characters that the class being read has."""
        if self.listed is not None and ord(last) - ord(first) < 1024:
            self.listed.update(map(chr, range(ord(first), ord(last) + 1)))
        else:
            self.listed = None
        if self.spans is not None:
            self.spans.append((ord(first), ord(last)))

    def member_start(self) -> str:
        """One character, or Java text of several characters for a whole set."""
        char = self.take()
        if char != "\\":
            return char
        char = self.take()
        return self.character_set(char) or self.escaped_literal(char)


@lru_cache(maxsize=4096)
def _rewritten(pattern: str) -> tuple[str, str | None, int | None]:
    """The Java pattern, the word it is and how many characters at the end decide."""
    rewriter = _Rewriter(pattern)
    return rewriter.rewrite(), rewriter.word, rewriter.tail


def to_java(pattern: str) -> str:
    """The Java pattern that finds what ``pattern`` finds; raises :class:`PatternError`."""
    return _rewritten(pattern)[0]


_PLAIN_WORD = re.compile(r"[^\\^$.|?*+()\[\]{}]+\Z")


def search(value: Column, pattern: str) -> Column:
    """Unanchored search; null for a null value.

    A plain word becomes a substring test, which works on the UTF-8 bytes and skips the
    decoding that a regex needs. From two words on, one regex is faster than several tests.
    """
    if _PLAIN_WORD.match(pattern):
        return value.contains(F.lit(pattern))
    java, word, tail = _rewritten(pattern)
    if word is not None:
        return value.contains(F.lit(word))
    if tail is not None:
        # Cut by bytes, so that no characters are counted. The cut may break one; there is room for
        # it before the characters that count.
        size = 4 * (tail + 1)
        value = F.substring(value.cast("string").cast("binary"), -size, size).cast("string")
    return value.rlike(java)


def check_patterns(spark: SparkSession, patterns: Iterable[str]) -> None:
    """Have the JVM compile every pattern now, so that a bad one fails before any data is read."""
    probes = [F.lit("").rlike(to_java(p)).alias(f"p{i}") for i, p in enumerate(sorted(set(patterns)))]
    try:
        spark.range(1).select(F.lit(True), *probes).collect()
    except PySparkException as error:
        raise PatternError(f"a pattern is not supported: {error}") from error
