"""Merkle manifest of a table: a tree for each group over its sorted rows, a tree over the groups, and a proof for every row.

A node is the hex sha256 of its children's hex digests; two consecutive nodes make one, and a last one without a partner makes
one by itself. A node is named by its group, its level (leaves have 0) and its place in the level.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.store import drop, materialize, read_table
from tradewind.llm.text import crc32_sql
from tradewind.llm.toxicity import fold_of

#: Levels that one upper step climbs: it meets at most 2 ** CLIMB nodes in a task.
CLIMB = 16
#: Offsets (one row for each group of each sorted partition) are broadcast up to this many rows, and joined beyond it.
MOST_OFFSETS = 100_000
SIDE = 7


def width(leaves: int, level: int) -> int:
    """Number of nodes on a level of a tree."""
    return -(-leaves >> level) if level else leaves


def height(leaves: int) -> int:
    return max(0, leaves - 1).bit_length()


def parents(nodes: np.ndarray) -> np.ndarray:
    """(k, 32) bytes of consecutive nodes, the first of them at an even place -> their parents."""
    text = nodes.tobytes().hex().encode()
    made = b"".join(sha256(text[at : at + 128]).digest() for at in range(0, len(text), 128))
    return np.frombuffer(made, dtype=np.uint8).reshape(-1, 32)


def climb(first: int, nodes: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """Complete aligned subtrees over the consecutive leaves first, first + 1, .. of a tree.

    Gives for each leaf the level and place of the largest subtree here that holds it, the siblings on the way there, and that
    subtree's node. Near the ends these are ragged: their siblings are elsewhere.
    """
    k = len(nodes)
    place = np.arange(first, first + k)
    level, top = np.zeros(k, dtype=np.int32), place.copy()
    found = np.zeros((k, 32), dtype=np.uint8)
    siblings, has = [], []
    open_ = np.ones(k, dtype=bool)
    lo, at = first, 0
    while len(nodes):
        wide, hi = width(leaves, at), lo + len(nodes)
        node = place >> at
        ends = [lo] if lo % 2 else []
        if hi % 2 and hi < wide or wide == 1:
            ends.append(hi - 1)
        for e in set(ends):
            mine = open_ & (node == e)
            level[mine], top[mine], found[mine] = at, e, nodes[e - lo]
            open_ &= ~mine
        if wide == 1:
            break
        skip = lo % 2
        kept = nodes[skip : len(nodes) - (1 if hi % 2 and hi < wide else 0)]
        lo += skip
        other = (node ^ 1) - lo
        paired = open_ & (other < len(kept))
        row = np.zeros((k, 32), dtype=np.uint8)
        if paired.any():
            row[paired] = kept[other[paired]]
        siblings.append(row)
        has.append(paired)
        nodes, lo, at = parents(kept) if len(kept) else kept, lo >> 1, at + 1
    if not siblings:
        return level, top, [b""] * k, [x.tobytes() for x in found]
    side, mask = np.stack(siblings, axis=1), np.stack(has, axis=1)
    return level, top, [side[i][mask[i]].tobytes() for i in range(k)], [x.tobytes() for x in found]


def fold(leaf: str, place: int, leaves: int, siblings: bytes) -> str:
    """The root that a hex leaf leads to with its siblings, which run from the bottom up."""
    node, at = leaf, 0
    for level in range(height(leaves)):
        if place ^ 1 < width(leaves, level):
            other, at = siblings[at : at + 32].hex(), at + 32
            node = sha256((other + node if place & 1 else node + other).encode()).hexdigest()
        else:
            node = sha256(node.encode()).hexdigest()
        place >>= 1
    return node


def digest(*fields: Column) -> Column:
    """Hex sha256 of the fields: each `-` if null, else its UTF-8 byte count, `:` and its value (numbers in decimal)."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


LOCAL = "g string, n long, place long, kept struct<{kept}>, leaf string, level int, at long, siblings binary, node binary"
UP = "g string, n long, level int, at long, path binary, up_level int, up_at long, up_node binary"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees within a batch: its rows sorted by group and place fall into runs of consecutive leaves."""
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.Table.from_batches([batch]).sort_by([("g", "ascending"), ("place", "ascending")]).combine_chunks()
        place, n = batch["place"].to_numpy(), batch["n"].to_numpy()
        g = batch["g"].combine_chunks().dictionary_encode().indices.to_numpy()
        leaves = np.frombuffer(bytes.fromhex("".join(batch["leaf"].to_pylist())), dtype=np.uint8).reshape(-1, 32)
        cuts = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(place) != 1)) + 1).tolist(), len(place)]
        level, at, siblings, nodes = [], [], [], []
        for a, b in zip(cuts, cuts[1:]):
            lev, top, side, node = climb(int(place[a]), leaves[a:b], int(n[a]))
            fresh = np.r_[True, (np.diff(lev) != 0) | (np.diff(top) != 0)]
            level.append(lev)
            at.append(top)
            siblings += side
            nodes += [x if f else None for x, f in zip(node, fresh)]
        new = {"level": pa.array(np.concatenate(level), pa.int32()), "at": pa.array(np.concatenate(at), pa.int64()), "siblings": pa.array(siblings, pa.binary()), "node": pa.array(nodes, pa.binary())}
        for name, values in new.items():
            batch = batch.append_column(name, values)
        yield from batch.to_batches()


def _climb_block(top: int):
    """Grows the nodes of one aligned block of 2 ** top leaves to the block's own node, or to the root if that is lower."""

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        until = min(top, height(n))
        known = {(int(v), int(a)): bytes(x) for v, a, x in zip(rows["level"], rows["at"], rows["node"])}
        by_level: dict[int, set[int]] = {}
        for v, a in known:
            by_level.setdefault(v, set()).add(a)
        for v in range(until):
            for up in {a >> 1 for a in by_level.get(v, ())}:
                pair = known[v, 2 * up].hex() + (known[v, 2 * up + 1].hex() if 2 * up + 1 < width(n, v) else "")
                known[v + 1, up] = sha256(pair.encode()).digest()
                by_level.setdefault(v + 1, set()).add(up)
        out = []
        for v, a in zip(rows["level"], rows["at"]):
            level, at, path = int(v), int(a), []
            while level < until:
                if at ^ 1 < width(n, level):
                    path.append(known[level, at ^ 1])
                level, at = level + 1, at >> 1
            out.append((b"".join(path), level, at, known[level, at]))
        found = pd.DataFrame(out, columns=["path", "up_level", "up_at", "up_node"])
        return pd.concat([rows[["g", "n", "level", "at"]].reset_index(drop=True), found], axis=1)

    return grow


def _trees(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (g, leaf, kept) -> (g, n, place, kept, leaf, siblings, root): one tree for each g over its rows in order of `kept`'s columns.

    The rows are range-sorted and written with their place in the sorted partition; what a partition holds of each group gives the
    offsets that turn it into a place in the group. Each batch of rows then builds the subtrees that are complete in it, and only
    the nodes at their tops go on: by blocks of 2 ** CLIMB leaves, then of the square of that, until roots are left. No task
    holds more than a batch of rows or 2 ** CLIMB nodes.
    """
    spark = rows.sparkSession
    by = [F.col(f"kept.{c}").asc_nulls_first() for c in order]
    ordered = rows.repartitionByRange("g", *by, "leaf", "kept.row_").sortWithinPartitions("g", *by, "leaf", "kept.row_")
    ordered = materialize(ordered.withColumn("m", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("m", 33)
    counts = ordered.groupBy("g", part.alias("part")).agg(F.min("m").alias("m0"), F.count("*").alias("c"))
    of_group = Window.partitionBy("g").orderBy("part")
    before = F.sum("c").over(of_group.rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialize(
        counts.select("g", "part", (F.coalesce(before, F.lit(0)) - F.col("m0")).alias("shift"), F.sum("c").over(Window.partitionBy("g")).alias("n")), "offsets"
    )
    size = offsets.agg(F.count("*").alias("rows"), F.max("n").alias("n")).first()
    placed = ordered.withColumn("part", part).join(F.broadcast(offsets) if size["rows"] <= MOST_OFFSETS else offsets, ["g", "part"])
    placed = placed.select("g", "n", (F.col("m") + F.col("shift")).alias("place"), "kept", "leaf")
    schema = LOCAL.format(kept=", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema["kept"].dataType))
    local = materialize(placed.mapInArrow(_local, schema), "subtrees")
    drop(ordered)
    drop(offsets)
    nodes = local.where("node is not null").select("g", "n", "level", "at", "node")
    steps: list[DataFrame] = []
    for step in range(max(1, -(-height(size["n"] or 1) // CLIMB))):
        top = CLIMB * (step + 1)
        block = F.expr(f"shiftright(at, {top} - level)").alias("block")
        steps.append(materialize(nodes.groupBy("g", block).applyInPandas(_climb_block(top), UP), "climbed"))
        nodes = steps[-1].select("g", "n", F.col("up_level").alias("level"), F.col("up_at").alias("at"), F.col("up_node").alias("node")).distinct()
    path = steps[0]
    for more in steps[1:]:
        more = more.select("g", F.col("level").alias("up_level"), F.col("at").alias("up_at"), F.col("path").alias("more"), F.col("up_level").alias("l2"), F.col("up_at").alias("a2"), F.col("up_node").alias("n2"))
        path = path.join(more, ["g", "up_level", "up_at"]).select("g", "n", "level", "at", F.concat("path", "more").alias("path"), F.col("l2").alias("up_level"), F.col("a2").alias("up_at"), F.col("n2").alias("up_node"))
    path = path.select("g", "level", "at", "path", F.lower(F.hex("up_node")).alias("root"))
    return local.join(path, ["g", "level", "at"]).select("g", "n", "place", "kept", "leaf", F.concat("siblings", "path").alias("siblings"), "root")


def proofs(docs: DataFrame, fields: list[str], group: str, order: str, carry: dict[str, Column]) -> DataFrame:
    """One row for each row of docs: the columns of `carry` (computed where the row is read), then its leaf and its proof.

    leaf: digest() of `fields`. place, leaves, siblings: its place among the leaves of its group, their number, and the raw siblings
    from the bottom up, which fold() takes to `subroot`. group_place, groups, group_siblings: the same from there to `root`. Rows of
    a group stand by `order` (nulls first), then by leaf; groups stand by name, null first. Equal rows are leaves of their own. An
    empty table has no rows and no root. Texts are read once and never shuffled; columns of docs named like those here do not meet them.
    """
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    carried = [c.alias(f"c{i}") for i, c in enumerate(carry.values())]
    kept = F.struct(F.col(order).alias("order_"), F.monotonically_increasing_id().alias("row_"), *carried)
    leaves = materialize(docs.select(g.alias("g"), digest(*[F.col(f) for f in fields]).alias("leaf"), kept.alias("kept")), "leaves")
    rows = materialize(_trees(leaves, ["order_"]), "proofs")
    drop(leaves)
    tops = rows.where("place = 0").select(F.lit("").alias("g"), F.col("root").alias("leaf"), F.struct(F.col("g").alias("order_"), F.lit(0).cast("long").alias("row_")).alias("kept"))
    above = materialize(_trees(tops, ["order_"]), "groups").select(F.col("kept.order_").alias("g"), F.col("place").alias("group_place"), F.col("n").alias("groups"), F.col("siblings").alias("group_siblings"), F.col("root").alias("top"))
    return rows.join(above, "g").select(
        *[F.col(f"kept.c{i}").alias(name) for i, name in enumerate(carry)], "leaf", "place", F.col("n").alias("leaves"), "siblings", F.col("root").alias("subroot"), "group_place", "groups", "group_siblings", F.col("top").alias("root")
    )


def _checked(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for leaf, place, leaves, side, group_place, groups, above in parts:
        rows = []
        for x, p, n, s, gp, gn, gs in zip(leaf, place, leaves, side, group_place, groups, above):
            s, gs = bytes(s), bytes(gs)
            rows.append((fold(fold(x, p, n, s), gp, gn, gs), sha256((s + gs).hex().encode()).hexdigest()))
        yield pd.DataFrame(rows, columns=["folded_root", "proof_sha256"])


def folded(leaf: str | Column) -> Column:
    """Struct of the root that a leaf leads to by the proof of its row, and the sha256 of the proof's siblings in hex."""
    columns = ["place", "leaves", "siblings", "group_place", "groups", "group_siblings"]
    return F.pandas_udf(_checked, "folded_root string, proof_sha256 string")(leaf, *columns)


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = digest(*[F.col(f) + 1 if f == "n_chars" else F.col(f) for f in fields])
    carry = {"doc_id": F.col("doc_id"), "altered": F.when(fold_of("doc_id", SIDE) == 0, altered)}
    found = proofs(docs, fields, "lang", "doc_id", carry)
    found = found.withColumn("check", folded(F.coalesce("altered", "leaf")))
    return found.select("doc_id", "leaf", "subroot", "root", "check.proof_sha256", "check.folded_root", (F.col("check.folded_root") == F.col("root")).alias("verified"))


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field_sql, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


def _tree_sql(tree: str, leaves: str) -> str:
    """Nodes of all trees over (g, pos, h, tall), level by level."""
    return f"""{tree} AS (SELECT g, 0 AS level, pos, h, tall FROM {leaves}
  UNION ALL SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value(tall) FROM {tree} WHERE level < tall GROUP BY g, level, pos // 2)"""


_UP = "sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.pos % 2 = 0 THEN f.h || s.h ELSE s.h || f.h END)"
#: The rows of op12_merkle.
SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql('n_chars')} AS leaf, CASE WHEN {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % 7 = 0 THEN {_leaf_sql('n_chars + 1')} END AS altered FROM documents),
leaves AS (SELECT doc_id, g, leaf AS h, coalesce(altered, leaf) AS tried, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, CAST(ceil(log2(count(*) OVER (PARTITION BY g))) AS INT) AS tall FROM d),
{_tree_sql('tree', 'leaves')},
subs AS (SELECT '' AS g, g AS name, h, row_number() OVER (ORDER BY g) - 1 AS pos, CAST(ceil(log2(count(*) OVER ())) AS INT) AS tall FROM tree WHERE level = tall),
{_tree_sql('top', 'subs')},
f AS (SELECT doc_id, h AS leaf, g, 0 AS level, pos, tried AS h, '' AS path, tall FROM leaves
  UNION ALL SELECT f.doc_id, f.leaf, f.g, f.level + 1, f.pos // 2, {_UP}, f.path || coalesce(s.h, ''), f.tall FROM f LEFT JOIN tree s ON s.g = f.g AND s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.level < f.tall),
u AS (SELECT doc_id, leaf, f.g, 0 AS level, subs.pos, f.h, path, subs.tall FROM f JOIN subs ON subs.name = f.g WHERE f.level = f.tall
  UNION ALL SELECT f.doc_id, f.leaf, f.g, f.level + 1, f.pos // 2, {_UP}, f.path || coalesce(s.h, ''), f.tall FROM u f LEFT JOIN top s ON s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.level < f.tall)
SELECT u.doc_id, u.leaf, subs.h AS subroot, top.h AS root, sha256(u.path) AS proof_sha256, u.h AS folded_root, u.h = top.h AS verified
FROM u JOIN subs ON subs.name = u.g JOIN top ON top.level = top.tall WHERE u.level = u.tall"""
