"""Spelling variants: words one edit apart, each traced to the frequent form it comes from.

One edit changes the counts of letters by little: a replaced letter takes one from a letter and
gives one to another (an L1 distance of two, between words of one length), an inserted or deleted
one gives or takes a single letter (a distance of one, between neighbouring lengths). So words are
points, a coordinate per letter, and a k-d tree per length answers for each word, in its own length
and in the next one, which words are that near. A branch is entered only where its box can be
reached with one letter more and, in the same length, one less. What is found is then compared
letter by letter.

The top of each tree is laid out in rounds from bounded samples, ``sample`` words of every leaf that
holds more than ``leaf_words``, until none does; the leaves are groups of one shuffle. Each word is
sent to its own leaf and to those that its range reaches: in its own length only to leaves of higher
number, so that each two words meet once. A task holds one leaf, goes on splitting it, and sends one
row per word, with the number of near words and the best of them, not one per pair. The tree of
splits, a few numbers per leaf, goes to every task. Words made of the very same letters cannot be
parted by any tree and share a leaf.

Forms are then followed to their ends by joins that double the way at each round; counts grow at
least fivefold at each step, so a dozen steps are many.

Odd cases: texts that are null, empty or without letters give no words; rows that repeat count
again; words of documents without an id are never altered; an empty table gives an empty one;
further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwelltrace.llm.blocks import in_slices
from dwelltrace.llm.common import staged

_LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PIECE = 1 << 20
_COORDINATE = np.zeros(256, np.int64)
_COORDINATE[97:123] = np.arange(26)
_COORDINATE[0xC0:] = 26 + np.arange(64)
_DIMENSIONS = 90
_MANY = 1 << 30


# -- words -----------------------------------------------------------------------------------


def _pieces(text: str) -> Iterator[str]:
    """A text in parts that end between words."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text):
            cut = _OTHER.search(text, end)
            end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def word_counts(docs: DataFrame, *, shortest: int = 6, alter: int | None = None) -> DataFrame:
    """Columns ``word, n``: how often each word of ``shortest`` letters occurs. With ``alter``, words
    of documents whose checksum it divides lose a letter first, which plants variants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
            )
            counts.clear()
            return batch

        for batch in in_slices(batches, 256):
            for doc, text in zip(*(column.to_pylist() for column in batch.columns)):
                here: Counter[str] = Counter()
                for piece in _pieces((text or b"").translate(_LOWER).decode("utf-8", "replace")):
                    here.update(_LETTERS.findall(piece))
                begun = None if alter is None or doc is None else zlib.crc32(f"{doc}:".encode())
                for word, n in here.items():
                    if len(word) < shortest:
                        continue
                    if begun is not None:
                        check = zlib.crc32(word.encode(), begun)
                        if check % alter == 0:
                            at = check % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                    counts[word] += n
            if len(counts) > 200_000:
                yield flushed()
        yield flushed()

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# -- points and trees ------------------------------------------------------------------------


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as rows of characters."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def points_of(letters: np.ndarray) -> np.ndarray:
    """How often each letter occurs in each row."""
    rows = np.arange(len(letters))[:, None] * _DIMENSIONS
    flat = (rows + _COORDINATE[letters]).reshape(-1)
    return np.bincount(flat, minlength=len(letters) * _DIMENSIONS).reshape(-1, _DIMENSIONS).astype(np.int32)


@dataclass
class Node:
    """A leaf, by number, or a split: points with ``at`` or more of a letter go to ``high``."""

    leaf: int = 0
    letter: int = 0
    at: int = 0
    low: Node | None = None
    high: Node | None = None


def best_split(points: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that part points most evenly; none if all are equal."""
    middle = np.sort(points, axis=0)[len(points) // 2]
    best, off = None, 0
    for at in (middle, middle + 1):  # of the splits by one letter the most even is one of these
        high = (points >= at).sum(axis=0)
        even = np.minimum(high, len(points) - high)
        letter = int(even.argmax())
        if even[letter] > off:
            best, off = (letter, int(at[letter])), int(even[letter])
    return best


def splits(points: np.ndarray, parts: int) -> list[tuple[int, int]]:
    """A tree of so many leaves, or fewer, as splits in order of descent; letter -1 is a leaf."""
    split = best_split(points) if parts > 1 and len(points) > 1 else None
    if split is None:
        return [(-1, 0)]
    high = points[:, split[0]] >= split[1]
    share = min(max(round(parts * float(high.mean())), 1), parts - 1)
    return [split, *splits(points[~high], parts - share), *splits(points[high], share)]


def grown(order: list[tuple[int, int]], number: Iterator[int]) -> Node:
    """The tree of some splits, its leaves numbered."""
    letter, at = order.pop(0)
    if letter < 0:
        return Node(leaf=next(number))
    low = grown(order, number)
    return Node(letter=letter, at=at, low=low, high=grown(order, number))


def reached(tree: Node, points: np.ndarray, less: int) -> Iterator[tuple[object, np.ndarray]]:
    """The leaves and the points whose range meets them: one letter more, up to ``less`` less. The
    box of a branch is known by what each split on the way asks of a letter."""
    nothing = np.zeros(len(points), np.int32)
    waiting = [(tree, np.arange(len(points)), nothing, nothing, {})]
    while waiting:
        node, rows, up, down, box = waiting.pop()
        if node.low is None:
            yield node, rows
            continue
        count = points[rows, node.letter]
        least, most = box.get(node.letter, (0, _MANY))
        more = up + np.maximum(node.at - count, 0) - np.maximum(least - count, 0)
        fewer = down + np.maximum(count - node.at + 1, 0) - np.maximum(count - most, 0)
        for child, ok, u, d, bounds in (
            (node.high, more <= 1, more, down, (node.at, most)),
            (node.low, fewer <= less, up, fewer, (least, node.at - 1)),
        ):
            if ok.any():
                waiting.append((child, rows[ok], u[ok], d[ok], box | {node.letter: bounds}))


def home(tree: Node, points: np.ndarray) -> np.ndarray:
    """The number of the leaf of each point."""
    leaf = np.zeros(len(points), np.int64)
    waiting = [(tree, np.arange(len(points)))]
    while waiting:
        node, rows = waiting.pop()
        if node.low is None:
            leaf[rows] = node.leaf
            continue
        high = points[rows, node.letter] >= node.at
        waiting += [(node.low, rows[~high]), (node.high, rows[high])]
    return leaf


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        yield length, np.flatnonzero(lengths == length)


def _named(length: int, leaf: np.ndarray | int) -> np.ndarray | int:
    return (length << 32) | leaf


def _at_home(trees: dict[int, Node]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 8192):
            words = batch.column(0).to_pylist()
            leaf = np.zeros(len(words), np.int64)
            for length, rows in _by_length(words):
                if length in trees:
                    leaf[rows] = home(trees[length], points_of(letters_of([words[i] for i in rows])))
                leaf[rows] = _named(length, leaf[rows])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["word", "n", "leaf"])

    return run


def _layout(parts_of: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        words = table.column("word").to_pylist()
        parts = min(-(-table.column("rows")[0].as_py() // parts_of), max(len(words) // 16, 2))
        order = splits(points_of(letters_of(words)), parts)
        numbers = pa.list_(pa.field("element", pa.int32()))
        letter, at = (pa.array([list(part)], numbers) for part in zip(*order))
        return pa.table({"leaf": pa.array([key[0].as_py()]), "letter": letter, "at": at})

    return run


def lay_out(words: DataFrame, *, leaf_words: int, sample: int) -> dict[int, Node]:
    """The trees of the lengths that fill more than a leaf."""
    trees: dict[int, Node] = {}
    leaves: dict[int, Node] = {}
    numbers: dict[int, int] = {}
    done: set[int] = set()
    while True:
        dealt = words.mapInArrow(_at_home(trees), "word string, n long, leaf long")
        full = dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > leaf_words)
        step = F.ceil(F.col("rows") / sample)
        drawn = dealt.join(full, "leaf").filter(F.pmod(F.xxhash64("word"), step) == 0).select("leaf", "rows", "word")
        laid = drawn.groupBy("leaf").applyInArrow(_layout(leaf_words), "leaf long, letter array<int>, at array<int>")
        moved = False
        for leaf, letter, at in laid.filter(F.size("letter") > 1).collect():  # a few numbers per leaf
            if leaf in done:
                continue
            done.add(leaf)
            moved = True
            length = leaf >> 32

            def number() -> Iterator[int]:
                while True:
                    numbers[length] = numbers.get(length, 0) + 1
                    yield numbers[length]

            tree = grown(list(zip(letter, at)), number())
            if leaf in leaves:
                vars(leaves[leaf]).update(vars(tree))
            else:
                trees[length] = tree
            waiting = [trees[length]]
            while waiting:
                node = waiting.pop()
                if node.low is None:
                    leaves[_named(length, node.leaf)] = node
                else:
                    waiting += [node.low, node.high]
        if not moved:
            return trees


# -- meeting in leaves -----------------------------------------------------------------------

_HOME, _SAME, _SHORTER = 0, 1, 2


def _sent(trees: dict[int, Node]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word to its own leaf and to those that its range reaches."""
        single = Node()
        for batch in in_slices(batches, 8192):
            words = batch.column(0).to_pylist()
            leaves, roles, rows = [], [], []

            def send(leaf, role, chosen) -> None:
                leaves.append(np.broadcast_to(np.asarray(leaf, np.int64), len(chosen)))
                roles.append(np.full(len(chosen), role, np.int8))
                rows.append(chosen)

            for length, chosen in _by_length(words):
                points = points_of(letters_of([words[i] for i in chosen]))
                own = np.zeros(len(chosen), np.int64)
                if length in trees:
                    own = home(trees[length], points)
                    for node, some in reached(trees[length], points, 1):
                        some = some[own[some] < node.leaf]
                        send(_named(length, node.leaf), _SAME, chosen[some])
                send(_named(length, own), _HOME, chosen)
                for node, some in reached(trees.get(length + 1, single), points, 0):
                    send(_named(length + 1, node.leaf), _SHORTER, chosen[some])
            at = pa.array(np.concatenate(rows))
            columns = [pa.array(np.concatenate(leaves)), pa.array(np.concatenate(roles)), batch.column(0).take(at), batch.column(1).take(at)]
            for start in range(0, len(at), 65_536):
                part = [column.slice(start, 65_536) for column in columns]
                yield pa.RecordBatch.from_arrays(part, names=["leaf", "role", "word", "n"])

    return run


def common_letters(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many letters each two rows have in common: the dot product of their counts as rows of
    ones, one for each count of a letter, or, where words are very long, letter by letter."""
    most = np.minimum(points.max(axis=0, initial=0), others.max(axis=0, initial=0))
    used = np.flatnonzero(most)
    if most.sum() > 2048 or not len(used):
        total = np.zeros((len(points), len(others)), np.int64)
        for d in used:
            total += np.minimum(points[:, d, None], others[None, :, d])
        return total
    a, b = (
        np.concatenate([x[:, [d]] >= np.arange(1, most[d] + 1) for d in used], axis=1).astype(np.float32)
        for x in (points, others)
    )
    return a @ b.T


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters are one replaced letter apart, or one letter that ``b`` has more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    ahead = (a == b[:, :-1]).cumprod(axis=1, dtype=np.int32).sum(axis=1)
    behind = (a == b[:, 1:])[:, ::-1].cumprod(axis=1, dtype=np.int32).sum(axis=1)
    return ahead + behind >= a.shape[1]


def near_in_leaf(letters: np.ndarray, others: np.ndarray, own: bool, smallest: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of ``others``, row of ``letters``) one edit apart. ``own``: both are the same
    rows, and of two of them the first comes first."""
    points, asking = points_of(letters), points_of(others)
    shorter = letters.shape[1] - others.shape[1]
    wanted = others.shape[1] - (0 if shorter else 1)
    members: list[np.ndarray] = []

    def build(rows: np.ndarray) -> Node:
        split = best_split(points[rows]) if len(rows) > smallest else None
        if split is None:
            members.append(rows)
            return Node(leaf=len(members) - 1)
        high = points[rows, split[0]] >= split[1]
        return Node(letter=split[0], at=split[1], low=build(rows[~high]), high=build(rows[high]))

    tree = build(np.arange(len(points)))
    block = max(1, (4 << 20) // letters.shape[1])
    for node, asked in reached(tree, asking, 0 if shorter else 1):
        rows = members[node.leaf]
        for first in range(0, len(rows), 4096):
            few = rows[first : first + 4096]
            for start in range(0, len(asked), 4096):
                some = asked[start : start + 4096]
                a, b = np.nonzero(common_letters(asking[some], points[few]) == wanted)
                a, b = some[a], few[b]
                if own:
                    a, b = a[a < b], b[a < b]
                for at in range(0, len(a), block):
                    x, y = a[at : at + block], b[at : at + block]
                    ok = one_edit(others[x], letters[y])
                    yield x[ok], y[ok]


def _met(table: pa.Table) -> pa.Table:
    """The near words that meet in a leaf: of each word how many, and the best."""
    words, role, n = table.column("word").to_pylist(), table.column("role").to_numpy(), table.column("n").to_numpy()
    place = np.empty(len(words), np.int64)  # by count, then in code point order
    place[np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])), np.int64)] = np.arange(len(words))
    by_place = np.argsort(place)
    count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    homes = np.flatnonzero(role == _HOME)
    if len(homes):
        letters = letters_of([words[i] for i in homes])
        for kind in (_HOME, _SAME, _SHORTER):
            asking = np.flatnonzero(role == kind)
            if not len(asking):
                continue
            others = letters if kind == _HOME else letters_of([words[i] for i in asking])
            for a, b in near_in_leaf(letters, others, kind == _HOME):
                a, b = asking[a], homes[b]
                for x, y in ((a, b), (b, a)):
                    np.add.at(count, x, 1)
                    np.minimum.at(best, x, place[y])
    some = np.flatnonzero(count)
    near = by_place[best[some]]
    return pa.table({
        "word": pa.array([words[i] for i in some], pa.string()), "n_near": pa.array(count[some]),
        "near": pa.array([words[i] for i in near], pa.string()), "near_n": pa.array(n[near], pa.int64()),
    })


def near_words(words: DataFrame, *, leaf_words: int = 4096, sample: int = 4096) -> DataFrame:
    """Columns ``word, n_near, near, near_n`` of words (columns ``word, n``, each word once) that
    have others one edit away: how many, and the most frequent, of equals the first by code points."""
    trees = lay_out(words, leaf_words=leaf_words, sample=sample)
    sent = words.mapInArrow(_sent(trees), "leaf long, role byte, word string, n long")
    met = sent.groupBy("leaf").applyInArrow(_met, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")
    )


def roots_of(links: DataFrame) -> DataFrame:
    """Columns ``word, root`` of ``links`` (columns ``word, form``), which run in no circles: where a
    word ends up. The way each word has come doubles at each round."""
    ways = staged(links.select("word", F.col("form").alias("root")), "ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = ways.join(further, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        longer = staged(longer, "ways")
        ways = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return ways


def spelling_variants(words: DataFrame, *, factor: int = 5, **options) -> DataFrame:
    """Columns ``word, form, root, n, n_near, form_n`` of all words (columns ``word, n``): the form is
    the most frequent near word if it occurs ``factor`` times as often, the root its last form."""
    words = staged(words.select("word", "n"), "words")
    near = near_words(words, **options)
    plain = F.col("near_n") >= factor * F.col("n")
    formed = staged(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(plain, F.col("near")).alias("form"),
            F.when(plain, F.col("near_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = roots_of(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
