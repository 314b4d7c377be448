"""Ordered rules, compiled to column expressions.

A rule is a predicate and a list of actions. Every rule sees what the rules before it did;
within one rule the predicate is judged once, on the row as the rule finds it.

Written down literally that is one projection per rule, each rewriting the row. Instead,
the only thing computed per rule is whether it *fires*. What a rule would see of earlier
rules follows from their flags: an attribute is the value of the last setter that fired, a
tag is present if the event came with it or some adder fired. Thus

* flags that do not depend on other flags are computed side by side, and the number of
  projections is the depth of the dependencies, usually two or three, not the number of rules;
* settings of one attribute become one ``CASE`` with the last rule first, and a flag nobody
  else needs is evaluated inside it, so a row stops at its first match;
* added tags become one ``concat``, in the order of the rules;
* deletions become filters, placed as early as their flags allow.

Everything is row-local: no shuffle, no Python at run time, and the same code serves streams.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cache, reduce
from itertools import groupby
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwelltrace.functions.durations import longer_than
from dwelltrace.functions.regex import search, to_java
from dwelltrace.functions.tags import has_tag, no_tags

# -- the rule model ----------------------------------------------------------------------


@dataclass(frozen=True)
class AttributeValue:
    """The attribute equals a value; false when it is null."""

    attribute: str
    value: str


@dataclass(frozen=True)
class AttributeRegex:
    """A pattern is found somewhere in the attribute."""

    attribute: str
    pattern: str

    def __post_init__(self):
        to_java(self.pattern)


@dataclass(frozen=True)
class HasTag:
    tag: str


@dataclass(frozen=True)
class IsMobile:
    pass


@dataclass(frozen=True)
class IdleForGreaterThan:
    seconds: int


@dataclass(frozen=True)
class And:
    """All parts hold; true without parts."""

    parts: tuple


@dataclass(frozen=True)
class Or:
    """Some part holds; false without parts."""

    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class AddTag:
    """Append a tag unless the row has it already."""

    tag: str


@dataclass(frozen=True)
class SetAttribute:
    attribute: str
    value: str


@dataclass(frozen=True)
class Ignore:
    """Raise the ``ignore`` flag; the row stays."""


@dataclass(frozen=True)
class RedactProcess:
    """Blank the process path, and with it the name derived from it."""


@dataclass(frozen=True)
class Delete:
    """Remove the row; nothing after this sees it."""


@dataclass(frozen=True)
class Rule:
    predicate: object
    actions: tuple = ()


@dataclass(frozen=True)
class Dialect:
    """What a kind of rule file may say, and how it treats missing values."""

    attributes: frozenset[str]
    predicates: frozenset[str]
    actions: frozenset[str]
    # Whether a search in a null attribute is false, or null as in SQL. It shows below a
    # "not": the former makes the rule fire, the latter does not.
    missing_is_false: bool


_COMMON_PREDICATES = {"attributeValue", "attributeRegex", "hasTag", "and", "or", "not"}

# The vocabulary of the two kinds of rule file.
TABLE_RULES = Dialect(
    attributes=frozenset(
        ["hostname", "username", "name", "category", "processPath", "processName", "applicationLabel", "applicationId"]
    ),
    predicates=frozenset(_COMMON_PREDICATES | {"isMobile", "idleForGreaterThanSec"}),
    actions=frozenset(["addTag", "setAttribute", "ignore"]),
    missing_is_false=False,
)
LIVE_RULES = Dialect(
    attributes=frozenset(["windowTitle", "processPath", "processName", "hostname", "username"]),
    predicates=frozenset(_COMMON_PREDICATES),
    actions=frozenset(["addTag", "redactProcess", "delete"]),
    missing_is_false=True,
)


# -- predicates --------------------------------------------------------------------------


def predicate_column(
    predicate,
    dialect: Dialect = TABLE_RULES,
    attribute: Callable[[str], Column] = F.col,
    tagged: Callable[[str], Column] = lambda tag: has_tag(F.col("tags"), tag),
    searched: Callable[[str, str], Column | None] = lambda name, pattern: None,
) -> Column:
    """The predicate over the columns of a flat event table.

    ``attribute`` and ``tagged`` say how to obtain an attribute and the presence of a tag, and
    ``searched`` the outcome of a search, where that is known already.
    """

    def build(p) -> Column:
        match p:
            case AttributeValue(name, value):
                return attribute(name).eqNullSafe(F.lit(value))
            case AttributeRegex(name, pattern):
                known = searched(name, pattern)
                found = search(attribute(name), pattern) if known is None else known
                return F.coalesce(found, F.lit(False)) if dialect.missing_is_false else found
            case HasTag(tag):
                return tagged(tag)
            case IsMobile():
                return F.col("isMobile") == F.lit(True)
            case IdleForGreaterThan(seconds):
                return longer_than(F.col("idleFor"), seconds)
            case And(parts):
                return _joined(Column.__and__, [build(part) for part in parts]) if parts else F.lit(True)
            case Or(parts):
                return _joined(Column.__or__, [build(part) for part in parts]) if parts else F.lit(False)
            case Not(part):
                return ~build(part)
        raise TypeError(f"not a predicate: {p!r}")

    return build(predicate)


def leaves_of(predicate) -> Iterator:
    match predicate:
        case And(parts) | Or(parts):
            for part in parts:
                yield from leaves_of(part)
        case Not(part):
            yield from leaves_of(part)
        case _:
            yield predicate


def patterns_of(rules: Iterable[Rule]) -> set[str]:
    """All search patterns of a rule list, for checking them in one go."""
    return {leaf.pattern for rule in rules for leaf in leaves_of(rule.predicate) if isinstance(leaf, AttributeRegex)}


def _joined(operator: Callable[[Column, Column], Column], conditions: Sequence[Column]) -> Column:
    """Conditions joined as a balanced tree: a chain of hundreds overflows the optimizer's stack."""
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return operator(_joined(operator, conditions[:half]), _joined(operator, conditions[half:]))


def _first_match(choices: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """``CASE`` over the choices; a null condition counts as not met."""
    if not choices:
        return otherwise
    (condition, value), *rest = choices
    return reduce(lambda case, choice: case.when(*choice), rest, F.when(condition, value)).otherwise(otherwise)


# -- rule lists --------------------------------------------------------------------------


@dataclass(frozen=True)
class _Cell:
    """Something rules read and write: an attribute, or the presence of one tag."""

    kind: str
    name: str


class _Program:
    """A rule list with the dependencies between its rules worked out.

    A *state* is a cell together with the number of its writers that came before: what a
    rule sees. States that some rule reads get a column, built from the state before it, and
    so do the flags that more than one expression uses.
    """

    def __init__(
        self,
        rules: Sequence[Rule],
        dialect: Dialect,
        verdicts: Mapping[tuple[str, str], Column] = MappingProxyType({}),
    ):
        self.verdicts = verdicts
        self.rules = [rule for rule in rules if rule.actions]
        self.dialect = dialect
        self.writers: dict[_Cell, list[tuple[int, str | None]]] = {}
        self.additions: list[tuple[int, str]] = []
        self.flaggers: list[int] = []
        self.deleters: set[int] = set()
        for i, rule in enumerate(self.rules):
            self._note_actions(i, rule)
        # The depth of a state or flag is the number of projections that must come before.
        self.states: dict[tuple[_Cell, int], int] = {}
        self.depth: list[int] = []
        for i in range(len(self.rules)):
            self.depth.append(self._note_reads(i))
        self.kept = self._flags_to_keep()
        # Expressions are immutable, and building one costs a round trip to the JVM.
        self.came_with = cache(lambda tag: has_tag(F.col("tags"), tag))
        self.fires = cache(self._fires)

    def _note_actions(self, i: int, rule: Rule) -> None:
        if any(isinstance(action, Delete) for action in rule.actions):
            # Whatever else the rule does, it does to a row that is gone.
            self.deleters.add(i)
            return
        for action in rule.actions:
            match action:
                case AddTag(tag):
                    if (i, tag) not in self.additions:
                        self.additions.append((i, tag))
                        self._note_write(_Cell("tag", tag), i, None)
                case SetAttribute(attribute, value):
                    self._note_write(_Cell("attribute", attribute), i, value)
                case RedactProcess():
                    self._note_write(_Cell("attribute", "processPath"), i, None)
                    self._note_write(_Cell("attribute", "processName"), i, None)
                case Ignore():
                    self.flaggers.append(i)
                case _:
                    raise TypeError(f"not an action: {action!r}")

    def _note_write(self, cell: _Cell, i: int, value: str | None) -> None:
        self.writers.setdefault(cell, []).append((i, value))

    def _note_reads(self, i: int) -> int:
        """Register the states a rule reads; the result is the depth of its flag."""
        depth = 0
        for leaf in leaves_of(self.rules[i].predicate):
            match leaf:
                case AttributeValue(name, _) | AttributeRegex(name, _):
                    cell = _Cell("attribute", name)
                case HasTag(tag):
                    cell = _Cell("tag", tag)
                case _:
                    continue
            version = self._version(cell, i)
            if version:
                below = (self.depth[j] for j, _ in self.writers[cell][:version])
                self.states[cell, version] = 1 + max(below)
                depth = max(depth, self.states[cell, version])
        return depth

    def _version(self, cell: _Cell, i: int) -> int:
        """How many writes of a cell precede rule ``i``."""
        return sum(j < i for j, _ in self.writers.get(cell, ()))

    def _version_below(self, cell: _Cell, version: int) -> int:
        """The latest earlier state of a cell that has a column, or 0 for what the event came with."""
        return max((v for c, v in self.states if c == cell and v < version), default=0)

    def _flags_to_keep(self) -> set[int]:
        read = {j for cell, version in self.states for j, _ in self.writers[cell][:version]}
        uses = Counter(self.flaggers)
        uses.update(i for i, _ in self.additions)
        for cell, writers in self.writers.items():
            if cell.kind == "attribute":
                uses.update(j for j, _ in writers[self._version_below(cell, len(writers) + 1) :])
        return read | {j for j, count in uses.items() if count > 1}

    # -- expressions -----------------------------------------------------------------

    def _fires(self, i: int) -> Column:
        """Whether a rule fires: its column if it has one, else its predicate (maybe null)."""
        return F.col(f"_fires_{i}") if i in self.kept else self.predicate(i)

    def predicate(self, i: int) -> Column:
        def seen(kind: str, name: str) -> Column:
            cell = _Cell(kind, name)
            return self.state(cell, self._version(cell, i))

        def searched(name: str, pattern: str) -> Column | None:
            # What is known was found in the attribute as the event came with it.
            return None if self._version(_Cell("attribute", name), i) else self.verdicts.get((name, pattern))

        return predicate_column(
            self.rules[i].predicate, self.dialect, lambda name: seen("attribute", name), lambda tag: seen("tag", tag), searched
        )

    def first_searches(self) -> dict[str, list[str]]:
        """By attribute, the patterns that some rule looks for in it before any rule may write it."""
        found: dict[str, dict[str, None]] = {}
        for i, rule in enumerate(self.rules):
            for leaf in leaves_of(rule.predicate):
                if isinstance(leaf, AttributeRegex) and not self._version(_Cell("attribute", leaf.attribute), i):
                    found.setdefault(leaf.attribute, {})[leaf.pattern] = None
        return {name: list(patterns) for name, patterns in found.items()}

    def state(self, cell: _Cell, version: int) -> Column:
        if version:
            return F.col(self.state_column(cell, version))
        return F.col(cell.name) if cell.kind == "attribute" else self.came_with(cell.name)

    def state_column(self, cell: _Cell, version: int) -> str:
        return f"_state_{list(self.states).index((cell, version))}"

    def definition(self, cell: _Cell, version: int) -> Column:
        """A state in terms of the state before it and the flags of the writers in between."""
        below = self._version_below(cell, version)
        writers = self.writers[cell][below:version]
        before = self.state(cell, below)
        if cell.kind == "tag":
            return _joined(Column.__or__, [before, *(self.fires(j) for j, _ in writers)])
        return _first_match([(self.fires(j), F.lit(value).cast("string")) for j, value in reversed(writers)], before)

    def first_adder(self, tag: str) -> Column:
        """Which rule added a tag: the first that fired, or none if the event came with it."""
        choices = [(self.came_with(tag), F.lit(-1))]
        choices += [(self.fires(j), F.lit(j)) for j, _ in self.writers[_Cell("tag", tag)]]
        return _first_match(choices, F.lit(-1))

    def run(self, df: DataFrame) -> DataFrame:
        columns = df.columns
        for depth in range(max(self.depth, default=-1) + 1):
            level = [i for i, d in enumerate(self.depth) if d == depth]
            due = [state for state, d in self.states.items() if d == depth]
            while due:
                # A state may build on another of the same depth, which then comes first.
                ready = [(cell, version) for cell, version in due if (cell, self._version_below(cell, version)) not in due]
                df = df.withColumns({self.state_column(*state): self.definition(*state) for state in ready})
                due = [state for state in due if state not in ready]
            gone = [self.fires(i) for i in level if i in self.deleters]
            df = _keep(df, ~_joined(Column.__or__, gone)) if gone else df
            flags = {f"_fires_{i}": F.coalesce(self.predicate(i), F.lit(False)) for i in level if i in self.kept}
            df = df.withColumns(flags) if flags else df
        shared = [cell.name for cell, writers in self.writers.items() if cell.kind == "tag" and len(writers) > 1]
        adders = {tag: f"_adder_{n}" for n, tag in enumerate(shared)}
        df = df.withColumns({adders[tag]: self.first_adder(tag) for tag in shared}) if shared else df
        results = {
            cell.name: self.definition(cell, len(writers)) if self._ends_open(cell) else self.state(cell, len(writers))
            for cell, writers in self.writers.items()
            if cell.kind == "attribute"
        }
        if self.additions:
            results["tags"] = self._with_additions(adders)
        if self.flaggers:
            results["ignore"] = _first_match([(self.fires(i), F.lit(True)) for i in self.flaggers], F.col("ignore"))
        return df.select(*[results[c].alias(c) if c in results else F.col(c) for c in columns])

    def _ends_open(self, cell: _Cell) -> bool:
        return (cell, len(self.writers[cell])) not in self.states

    def _with_additions(self, adders: dict[str, str]) -> Column:
        """The tags in the order of the rules; a run of additions of one tag is one piece."""
        nothing = no_tags()
        pieces = []
        for tag, run in groupby(self.additions, key=lambda addition: addition[1]):
            rules = [i for i, _ in run]
            if tag in adders:
                here = F.col(adders[tag]).between(rules[0], rules[-1])
            else:
                here = self.fires(rules[0]) & ~self.came_with(tag)
            pieces.append(F.when(here, F.array(F.lit(tag))).otherwise(nothing))
        return F.concat(F.col("tags"), *pieces)


_BARRIER = "_barrier"


def _keep(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on values computed below, without copying their expressions into the filter.

    The optimizer would push the filter through the projections below and repeat in it every
    expression they define. It cannot move a filter across a random number.
    """
    return df.withColumn(_BARRIER, F.rand(0)).filter(condition & (F.col(_BARRIER) >= 0)).drop(_BARRIER)


def apply_rules(df: DataFrame, rules: Sequence[Rule], dialect: Dialect = TABLE_RULES) -> DataFrame:
    """Run a rule list over a flat event table."""
    return _Program(rules, dialect).run(df)


# Searches in one attribute that are worth a pass over its values.
_MANY_SEARCHES = 32
_WORD_BITS = 62


def apply_rules_by_value(
    df: DataFrame, rules: Sequence[Rule], dialect: Dialect = TABLE_RULES, *, most_values: int = 100_000
) -> DataFrame:
    """The same as ``apply_rules``, with patterns tried once per distinct value and not per row.

    For long rule lists over columns that repeat few values, such as paths. Each attribute in which
    many patterns are looked for is read once more for its distinct values; the outcomes, a bit per
    pattern, are joined back. An attribute of more than ``most_values`` values is searched row by
    row as ever, so what goes to every task is bounded. ``df`` should be cheap to read twice: a
    staged copy, not raw logs.
    """
    program = _Program(rules, dialect)
    verdicts: dict[tuple[str, str], Column] = {}
    columns, wide = df.columns, df
    for number, (name, patterns) in enumerate(sorted(program.first_searches().items())):
        if len(patterns) < _MANY_SEARCHES:
            continue
        values = df.select(F.col(name).alias(f"_value_{number}")).filter(F.col(name).isNotNull()).distinct()
        known = [row[0] for row in values.limit(most_values + 1).collect()]
        if len(known) > most_values:
            continue
        value, bits = F.col(f"_value_{number}"), f"_found_{number}"
        words = [patterns[at : at + _WORD_BITS] for at in range(0, len(patterns), _WORD_BITS)]
        outcomes = [_outcomes(value, word) for word in words]
        table = df.sparkSession.createDataFrame([(v,) for v in known], f"_value_{number} string")
        table = table.select(value, F.array(*outcomes).alias(bits))
        wide = wide.join(F.broadcast(table), wide[name] == value, "left").drop(f"_value_{number}")
        for i, pattern in enumerate(patterns):
            word = F.element_at(bits, i // _WORD_BITS + 1)
            verdicts[name, pattern] = F.shiftright(word, i % _WORD_BITS).bitwiseAND(F.lit(1)) == 1
    return _Program(rules, dialect, verdicts).run(wide).select(*columns)


def _outcomes(value: Column, patterns: Sequence[str]) -> Column:
    """A bit for each pattern that is found in a value."""
    bits = [F.when(search(value, pattern), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, pattern in enumerate(patterns)]
    return _joined(Column.__add__, bits)


def drop_ignored(df: DataFrame) -> DataFrame:
    """Leave out the rows that a rule flagged."""
    return _keep(df, ~F.col("ignore"))
