"""Mixing sources to target weights by the cube method of balanced sampling.

A source whose target is r times its size takes every document floor(r) times and some once
more. Which ones is a balanced sample with inclusion probability r - floor(r): the flight phase
moves the probabilities along the null space of two constraints, the expected words and the
expected number of documents, until they are 0 or 1. Each step looks at three open units, for
three are the fewest whose null space is not empty; so at most two units of a block stay open.

Blocks of a few thousand units of one source fly in parallel, a large source in many of them.
Open units meet in the next level's blocks, and after about log(units) / log(700) levels a
single block per source is left. A few units of each block, spread over the sizes, do not fly, and
of the last block a dozen: with those that stay open they are the landing problem, small enough to
try every outcome and take the one nearest to the expected words, then documents. All that moves is an id and three numbers
per document; the driver sees one row per source.

Random numbers come from the source, level and block, and blocks from a hash of the id: reruns
agree.

Odd cases: a null or empty text has size 0 and takes 0 words; a null source is a source, the
last one; rows that repeat an id are units of their own; null ids are allowed; a source of size
0 has target 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwelltrace.llm.common import n_words, staged, whole_text

_NEAR = 1e-9
_LANDING = 12  # units of the last block that are kept for the landing
_OPEN = 6  # units that a block leaves open
_FEW_SOURCES = 10_000
_UNIT = "place long, doc_id long, size long, hash long, tie long, p double"


def weighted_targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Share the total by weight; no target exceeds ``cap`` times its size, and what is cut off
    is shared again among the others."""
    targets = [0.0] * len(sizes)
    left, free = float(sum(sizes)), [i for i, size in enumerate(sizes) if size > 0]
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in free:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = float(cap * sizes[i])
        left -= sum(targets[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return targets


def _move(p: list[float], units: list[int], u: tuple[float, ...], coin: float) -> list[int]:
    """One step along ``u`` to the border of the cube, up or down so that no expectation moves.
    Returns the units still open."""
    ahead = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(units, u) if v)
    back = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(units, u) if v)
    step = ahead if coin * (ahead + back) < back else -back
    still = []
    for k, v in zip(units, u):
        moved = p[k] + step * v
        p[k] = 0.0 if moved < _NEAR else 1.0 if moved > 1 - _NEAR else moved
        if 0 < p[k] < 1:
            still.append(k)
    return still


def fly(p: list[float], sizes: list[int], rng: np.random.Generator, land: bool) -> None:
    """Move ``p`` in place, keeping its sum and its sum weighted by size, until at most
    ``_OPEN`` entries lie strictly between 0 and 1; with ``land`` none do, and the sums are kept
    as nearly as some outcome of the landing allows."""
    waiting = [k for k in range(len(p)) if 0 < p[k] < 1]
    held = _LANDING if land else _OPEN - 2
    by_size = sorted(waiting, key=lambda k: sizes[k])
    landing = by_size[:: max(1, len(by_size) // held)][:held]
    waiting = [k for k in waiting if k not in set(landing)]
    units: list[int] = []
    coins = rng.random(len(waiting) + 1)
    for move, k in enumerate(waiting):
        units.append(k)
        if len(units) == 3:
            a, b, c = (float(sizes[x]) for x in units)
            u = (b - c, c - a, a - b)  # orthogonal to (1, 1, 1) and to the sizes
            if not any(u):
                u = (1.0, -1.0, 0.0)
            scale = max(map(abs, u))
            units = _move(p, units, tuple(v / scale for v in u), coins[move])
    if land:
        landing = landing + units
        outcomes = (np.arange(1 << len(landing))[:, None] >> np.arange(len(landing))) & 1
        chances = np.array([p[k] for k in landing])
        words = np.abs((outcomes - chances) @ np.array([float(sizes[k]) for k in landing]))
        documents = np.abs((outcomes - chances).sum(axis=1))
        best = np.lexsort((rng.random(len(outcomes)), documents, words.round(6)))[0]
        for k, taken in zip(landing, outcomes[best].tolist()):
            p[k] = float(taken)


def _flight(level: int, land: bool):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "size", "hash", "tie", "p"], kind="stable")
        p = pdf["p"].tolist()
        fly(p, pdf["size"].tolist(), np.random.default_rng([5, level, int(key[0]), int(key[1])]), land)
        return pdf.assign(p=p)[["place", "doc_id", "size", "hash", "tie", "p"]]

    return run


def _beside(table: DataFrame, rows: int) -> DataFrame:
    """A table of one row per source goes to every task while it is small, so that the rows of a
    large source need not meet; beyond that it is joined by a shuffle, which splits skewed keys."""
    return F.broadcast(table) if rows <= _FEW_SOURCES else table


def mix_sources(
    docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, block: int = 4096
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``, and
    ``hash`` of the text.

    ``weights`` go round the sources in code-point order, null last; ``cap`` bounds a source's
    target and a document's copies; ``block`` is the number of units that fly together.
    """
    spark = docs.sparkSession
    sized = staged(
        docs.select(
            F.col("doc_id").cast("long"),
            F.col("source").cast("string"),
            n_words(whole_text()).alias("size"),
            F.xxhash64(whole_text()).alias("hash"),
            # Rows without an id and of one text are exchangeable, but must not all meet.
            F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0).alias("tie"),
        ),
        "sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).collect()
    totals.sort(key=lambda row: (row["source"] is None, row["source"] or ""))
    sizes = [row["size"] for row in totals]
    targets = weighted_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], cap)

    rows, blocks = [], {}
    for place, row in enumerate(totals):
        rate = min(cap, targets[place] / sizes[place]) if sizes[place] else 0.0
        whole = math.floor(rate + _NEAR)
        rows.append((place, row["source"], row["size"], targets[place], whole, max(0.0, rate - whole)))
        blocks[place] = row["docs"]
    schema = "place long, source string, source_size long, target double, whole int, rate double"
    sources = spark.createDataFrame(rows, schema)

    sources = _beside(sources, len(rows))
    units = sized.join(sources, sized["source"].eqNullSafe(sources["source"]))
    open_units = units.select("place", "doc_id", "size", "hash", "tie", F.col("rate").alias("p"))
    decided = None
    level = 0
    while True:
        level += 1
        blocks = {place: math.ceil(n / block) for place, n in blocks.items()}
        land = max(blocks.values(), default=1) <= 1
        counts = _beside(spark.createDataFrame(list(blocks.items()), "place long, n long"), len(blocks))
        order = F.xxhash64(F.lit(level), "place", F.coalesce("doc_id", F.xxhash64("hash", "tie")), "size")
        dealt = (
            open_units.join(counts, "place")
            .withColumn("order", order)
            .withColumn("block", F.pmod(F.shiftrightunsigned("order", 17), F.greatest("n", F.lit(1))))
        )
        flown = staged(
            dealt.groupBy("place", "block").applyInPandas(_flight(level, land), _UNIT),
            f"flight-{level}",
        )
        closed = flown.filter((F.col("p") <= 0) | (F.col("p") >= 1))
        decided = closed if decided is None else decided.unionByName(closed)
        if land:
            break
        open_units = flown.filter((F.col("p") > 0) & (F.col("p") < 1))
        blocks = {place: _OPEN * n for place, n in blocks.items()}
    copies = (F.col("whole") + F.col("p")).cast("long")
    return decided.join(sources, "place").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        "hash",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its own columns only."""
    copies = (
        mix_sources(docs, **options)
        .groupBy(F.col("doc_id").alias("__id"), F.col("hash").alias("__of"))
        .agg(F.sort_array(F.collect_list("copies")).alias("__copies"))
    )
    # Only rows that repeat an id and a text meet in one task; they share out their copies.
    nth = Window.partitionBy("doc_id", "__hash").orderBy(F.lit(0))
    taken = (
        docs.withColumn("__hash", F.xxhash64(whole_text()))
        .join(copies, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__of")))
        .withColumn("__nth", F.row_number().over(nth))
        .withColumn("__taken", F.element_at("__copies", F.col("__nth")))
        .filter(F.col("__taken") > 0)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__taken"))))
    )
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
