"""Moving entities to the keys that their listings now carry, where keys are unique and a move frees one for the next."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.sources.scratch import discard, settled

PASSES = 10


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: strings) -> (node, root): root is the smallest node reachable. Each round every node takes the smallest label
    around it and then that label's own label, so the rounds grow with the logarithm of the longest way."""
    both = settled(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    while True:
        around = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = now.join(around, now["node"] == around["a"], "left").select("node", "root", F.least("root", "near").alias("low"))
        jump = now.select(F.col("node").alias("low"), F.col("root").alias("further"))
        after = lower.join(jump, "low", "left").select("node", F.least("low", "further").alias("root"), (F.least("low", "further") < F.col("root")).alias("moved"))
        after = settled(after, "labels")
        discard(now)
        now = after.select("node", "root")
        if after.where("moved").isEmpty():
            return now


def wanted_keys(entities: DataFrame, votes: DataFrame) -> DataFrame:
    """entities (entity, key, name_key) and votes (entity, key, read) -> (entity, key, wants): the keys it would move to, best first.

    A vote is one listing the entity had: the key that the listing carries now, null if it is gone, and whether its store was read
    at all. An entity all of whose stores were read and none of whose listings kept its key is an orphan: every key its listings
    carry will do, the one of its name first, then by votes. Any other moves only to a key that more than half of all its listings
    carry. Equal votes go to the smaller key.
    """
    counts = votes.where("key is not null").groupBy("entity", F.col("key").alias("vote")).agg(F.count("*").alias("n"))
    totals = votes.groupBy("entity").agg(F.count("*").alias("listings"), F.bool_and("read").alias("all_read"))
    judged = counts.join(entities, "entity").join(totals, "entity")
    other = F.col("vote") != F.col("key")
    named = F.col("vote").eqNullSafe(F.col("name_key"))
    ranked = F.sort_array(F.collect_list(F.when(other, F.struct((~named).cast("int").alias("late"), (-F.col("n")).alias("n"), "vote"))))
    most = F.sort_array(F.collect_list(F.when(other, F.struct((-F.col("n")).alias("n"), "vote"))))
    found = judged.groupBy("entity", "key", "listings", "all_read").agg(F.bool_or(F.col("vote") == F.col("key")).alias("keeps"), ranked.alias("ranked"), most.alias("most"))
    orphan = F.col("all_read") & ~F.col("keeps")
    first = F.get("most", F.lit(0))
    majority = F.when(-first["n"] * 2 > F.col("listings"), F.array(first["vote"])).otherwise(F.array().cast("array<string>"))
    wants = F.when(orphan, F.transform("ranked", lambda x: x["vote"])).otherwise(majority)
    return found.where(F.size("most") > 0).select("entity", "key", wants.alias("wants")).where(F.size("wants") > 0)


def planned_moves(entities: DataFrame, votes: DataFrame, passes: int = PASSES) -> DataFrame:
    """(entity, old, new, turn): the moves, in an order in which they can be written without two entities ever sharing a key.

    Entities are visited by id, again and again for at most `passes` passes; each moves at most once, to the first key it wants that
    nobody holds then. So a key that one gives up serves the next (a chain), and two that want each other's stay. What one does
    depends on others only through keys that both name, so each connected group of movers and keys is folded by itself; entities
    that want nothing only block their key and join no group.
    """
    movers = settled(wanted_keys(entities, votes), "movers")
    named = movers.select("entity", "key", "wants", F.explode(F.concat(F.array("key"), "wants")).alias("touched"))
    entity, key = F.concat(F.lit("e"), F.col("entity").cast("string")), F.concat(F.lit("k"), F.col("touched"))
    group = components(named.select(entity.alias("a"), key.alias("b")))
    held = named.select(F.col("touched").alias("k")).distinct().join(entities.select(F.col("key").alias("k")), "k").join(movers.select(F.col("key").alias("k")), "k", "left_anti")
    blocked = named.join(held, F.col("touched") == F.col("k")).groupBy("entity").agg(F.collect_set("k").alias("blocked"))
    rows = movers.join(blocked, "entity", "left").join(group, entity == F.col("node"))
    rows = rows.select("root", "entity", "key", F.array_except("wants", F.coalesce("blocked", F.array().cast("array<string>"))).alias("wants"))

    # groups are small and many: a batch of them is folded in plain Python, without a data frame for each
    groups = rows.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("entity", "key", "wants"))).alias("visits")).select("visits")

    def fold(visits: list[dict]) -> list[tuple]:
        holders, done, out = {x["key"] for x in visits}, set(), []
        for _ in range(passes):
            before = len(out)
            for x in visits:
                if x["entity"] in done:
                    continue
                new = next((k for k in x["wants"] if k not in holders), None)
                if new is not None:
                    holders.remove(x["key"])
                    holders.add(new)
                    done.add(x["entity"])
                    out.append((x["entity"], x["key"], new, len(out) + 1))
            if len(out) == before:
                break
        return out

    def fold_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field("visits").type.value_type.field("entity").type, pa.string(), pa.string(), pa.int64()]
            moves = [m for visits in batch.column("visits").to_pylist() for m in fold(visits)]
            columns = zip(*moves) if moves else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["entity", "old", "new", "turn"])

    kind = entities.schema["entity"].dataType.simpleString()
    return groups.mapInArrow(fold_all, f"entity {kind}, old string, new string, turn long")
