"""What a change of a rule list can reach: which columns, and which rows.

Rules are row-local and ordered. Rules that both lists have in the same order do the same to a row
unless a rule that only one of them has fires on it; so a row on which no such rule *could* fire
comes out as before, whatever the others do. Whether a rule could fire is judged on the row as it
came in. What earlier rules may have written is allowed for: where they may have set the attribute
or added the tag a test asks for, it may also hold if one of them could fire; where they may have
replaced what it asks for, it may also fail.

For columns the same graph is followed the other way: what a changed rule writes, and what rules
write that read something reached.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwelltrace.operators.rules import (
    AddTag,
    And,
    AttributeRegex,
    AttributeValue,
    Dialect,
    HasTag,
    Ignore,
    Not,
    Or,
    Rule,
    SetAttribute,
    TABLE_RULES,
    leaves_of,
    predicate_column,
)


def fingerprint(rule: Rule) -> str:
    """A name for what a rule says; equal rules have the same."""
    return hashlib.sha256(repr(rule).encode()).hexdigest()


@dataclass(frozen=True)
class Change:
    """Rules that only one of two lists has, by their places."""

    before: tuple[Rule, ...]
    after: tuple[Rule, ...]
    removed: tuple[int, ...]
    added: tuple[int, ...]

    def __bool__(self) -> bool:
        return bool(self.removed or self.added)


def compare(before: Sequence[Rule], after: Sequence[Rule]) -> Change:
    """The fewest rules to call changed, so that the others are the same in the same order. Rules
    without actions do nothing and do not count."""
    before, after = (tuple(rule for rule in rules if rule.actions) for rules in (before, after))
    same = SequenceMatcher(a=[fingerprint(r) for r in before], b=[fingerprint(r) for r in after], autojunk=False)
    kept = [(b.a + i, b.b + i) for b in same.get_matching_blocks() for i in range(b.size)]
    old, new = {i for i, _ in kept}, {j for _, j in kept}
    return Change(
        before,
        after,
        tuple(i for i in range(len(before)) if i not in old),
        tuple(j for j in range(len(after)) if j not in new),
    )


# -- columns ---------------------------------------------------------------------------------


def _written(rule: Rule) -> set[str]:
    """The columns a rule writes."""
    columns = set()
    for action in rule.actions:
        match action:
            case AddTag():
                columns.add("tags")
            case SetAttribute(attribute):
                columns.add(attribute)
            case Ignore():
                columns.add("ignore")
            case _:
                raise TypeError(f"not an action over the table: {action!r}")
    return columns


def _read(rule: Rule) -> set[str]:
    """The columns a rule asks about."""
    columns = set()
    for leaf in leaves_of(rule.predicate):
        match leaf:
            case AttributeValue(name) | AttributeRegex(name):
                columns.add(name)
            case HasTag():
                columns.add("tags")
    return columns


def reached_columns(change: Change) -> set[str]:
    """Columns that may come out otherwise."""
    reached = set()
    for rules, changed in ((change.before, change.removed), (change.after, change.added)):
        here: set[str] = set()
        for i, rule in enumerate(rules):
            if i in changed or _read(rule) & here:
                here |= _written(rule)
        reached |= here
    return reached


# -- rows ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _IsFalse:
    """True where a test is false, and not where it is null."""

    test: object


# A writer of a writer of what a rule asks about is taken to fire on every row.
_DEPTH = 2


def _may_be(predicate, earlier: Sequence[Rule], value: bool, depth: int = _DEPTH):
    """A predicate over the row as it came in that holds wherever ``predicate``, after the
    ``earlier`` rules, may be true, or, with ``value`` false, may be false."""
    match predicate:
        case And(parts) | Or(parts):
            bounds = tuple(_may_be(part, earlier, value, depth) for part in parts)
            return And(bounds) if isinstance(predicate, And) == value else Or(bounds)
        case Not(part):
            return _may_be(part, earlier, not value, depth)
    came = predicate if value else _IsFalse(predicate)
    writers = [i for i, rule in enumerate(earlier) if _may_make(rule, predicate, value)]
    if not writers:
        return came
    if depth == 0:
        return And(())
    return Or((came, *(_may_be(earlier[i].predicate, earlier[:i], True, depth - 1) for i in writers)))


def _may_make(rule: Rule, leaf, value: bool) -> bool:
    """Whether a rule may make a test true, or false."""
    for action in rule.actions:
        match action, leaf:
            case AddTag(tag), HasTag(asked):
                if value and tag == asked:
                    return True
            case SetAttribute(name, new), AttributeValue(asked, wanted):
                if name == asked and (new == wanted) == value:
                    return True
            case SetAttribute(name), AttributeRegex(asked):
                if name == asked:
                    return True
    return False


def _column(predicate, dialect: Dialect) -> Column:
    """True, never null, where a bound holds."""
    match predicate:
        case And(parts) | Or(parts):
            columns = [_column(part, dialect) for part in parts]
            return _folded(columns, isinstance(predicate, And)) if columns else F.lit(isinstance(predicate, And))
        case _IsFalse(test):
            return F.coalesce(~predicate_column(test, dialect), F.lit(False))
    return F.coalesce(predicate_column(predicate, dialect), F.lit(False))


def _folded(columns: Sequence[Column], both: bool) -> Column:
    """Conditions joined as a balanced tree, which the optimizer's stack can take."""
    if len(columns) == 1:
        return columns[0]
    half = len(columns) // 2
    left, right = _folded(columns[:half], both), _folded(columns[half:], both)
    return left & right if both else left | right


def _size(predicate) -> int:
    match predicate:
        case And(parts) | Or(parts):
            return 1 + sum(map(_size, parts))
    return 1


# Beyond so many tests a bound costs more than the rules it spares.
_MOST_TESTS = 2000


def reached_rows(change: Change, dialect: Dialect = TABLE_RULES) -> Column:
    """A condition, never null, over rows as they came in: whether they may come out otherwise.

    A change whose bound would be larger than most rule lists reaches every row.
    """
    bounds = [
        _may_be(rules[i].predicate, rules[:i], True)
        for rules, changed in ((change.before, change.removed), (change.after, change.added))
        for i in changed
    ]
    if sum(map(_size, bounds)) > _MOST_TESTS:
        return F.lit(True)
    return _folded([_column(bound, dialect) for bound in bounds], False) if bounds else F.lit(False)
