"""Pairs drawn in turn from an order that has nothing to do with the rows, each with a partner a short way ahead."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.operators.ranking import first_per

AHEAD, ROUNDS = 40, 10
FIRST_ROWS = 512


def _matched(rows: Iterator[tuple], ahead: int, rounds: int, low: float, high: float) -> Iterator[tuple]:
    """Pairs of (name, price, item): the first row that has none yet, with the first of the next `ahead` - 1 that has none,
    another name and a price of `low` to `high` times the other. A row that finds no partner is passed over. Holds `ahead` rows."""
    window: deque = deque()
    source, made = iter(rows), 0
    while made < rounds:
        while len(window) < ahead and (row := next(source, None)) is not None:
            window.append(row)
        if not window:
            return
        first = window.popleft()
        if first is None:
            continue
        for at, other in enumerate(window):
            if other is None or other[0] == first[0]:
                continue
            cheap, dear = sorted((first[1], other[1]))
            if cheap * low <= dear <= cheap * high:
                window[at] = None
                made += 1
                yield made, first[2], other[2]
                break


def drawn_pairs(df: DataFrame, group: str, item: str, name: str, price: str, order: list[Column], low: float, high: float, ahead: int = AHEAD, rounds: int = ROUNDS) -> DataFrame:
    """(group, round, first, second) for groups that fill all their rounds; the others have none.

    Rows of a group stand in `order`, which must be full. Only the first rows of each group are shuffled, as many as the rounds
    nearly always need; groups that they do not fill are drawn again from eight times as many, until all their rows are in. A
    group is then streamed through one task that holds `ahead` rows.
    """
    kind = df.schema[item].dataType.simpleString()
    schema = f"g string, round int, first {kind}, second {kind}"

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flat() -> Iterator[tuple]:
            for part in parts:
                yield from zip(part["g"], part["name"], part["price"], part["item"])

        out, stream = [], flat()
        row = next(stream, None)
        while row is not None:
            g = row[0]

            def own() -> Iterator[tuple]:
                nonlocal row
                while row is not None and row[0] == g:
                    yield row[1:]
                    row = next(stream, None)

            mine = own()
            got = [(g, n, a, b) for n, a, b in _matched(mine, ahead, rounds, low, high)]
            out += got if len(got) == rounds else []
            for _ in mine:  # the rest of the group
                pass
        yield pd.DataFrame(out, columns=["g", "round", "first", "second"])

    rows = df.select(F.col(group).cast("string").alias("g"), F.col(name).alias("name"), F.col(price).alias("price"), F.col(item).alias("item"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("o"))
    sizes = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    found, left, n = None, set(sizes), FIRST_ROWS
    while left:
        some = first_per(rows.where(F.col("g").isin(*left)), ["g"], [F.col("o")], n)
        got = some.repartition("g").sortWithinPartitions("g", "o").mapInPandas(draw, schema)
        found = got if found is None else found.unionByName(got)
        more = {g for g in left if sizes[g] > n}
        if more:  # few groups: their names are on the driver
            more -= {r["g"] for r in got.select("g").distinct().collect()}
        left, n = more, n * 8
    found = rows.sparkSession.createDataFrame([], schema) if found is None else found
    return found.withColumnRenamed("g", group)
