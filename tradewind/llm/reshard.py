"""Resharding by minimum-cost flow: which blocks of the old shards go to which new shard."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.store import fresh, materialize, read_table, scratch_path

SHARDS = 16
OLD_SHARDS = 12
#: Bytes of one block, about: what one task numbers and writes.
BLOCK_BYTES = 32 << 20


def size_of(text: str = "text"):
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def min_cost_flow(sizes: list[int], capacities: list[int], cost=lambda old, new: int(old != new)) -> dict[tuple[int, int], int]:
    """{(old, new): bytes} that empties the old shards into the new ones at the least total cost.

    Successive shortest paths with whole-bottleneck augmentation. The graph has a node for each shard, not for each
    document. By default a byte that stays in its shard is free and any other costs 1. Capacities must
    sum to the sizes at least.
    """
    if sum(sizes) > sum(capacities):
        raise ValueError("the new shards are too small")
    n, m = len(sizes), len(capacities)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, room, cost; the reverse edge is at index ^ 1
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, room: int, price: int) -> None:
        out[a].append(len(edges))
        edges.append([b, room, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])

    for i, s in enumerate(sizes):
        add(source, i, s, 0)
    for j, c in enumerate(capacities):
        add(n + j, sink, c, 0)
    first = len(edges)
    for i in range(n):
        for j in range(m):
            add(i, n + j, sizes[i], cost(i, j))
    while True:
        far, via, queue = {source: 0}, {}, deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                b, room, price = edges[e]
                if room > 0 and far[a] + price < far.get(b, 1 << 60):
                    far[b], via[b] = far[a] + price, e
                    queue.append(b)
        if sink not in via:
            break
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = edges[via[at] ^ 1][0]
        push = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= push
            edges[e ^ 1][1] += push
    return {(i, j): f for i in range(n) for j in range(m) if (f := edges[first + 2 * (i * m + j) + 1][1])}


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


@dataclass
class Plan:
    """Where rows go. A row of an old shard falls into one of its `blocks` by a hash of its place, and the blocks are laid out in
    order; `cuts` has, by old shard, the (block, place) before which each stretch of that line ends, and its new shard."""

    blocks: dict[int, int]
    cuts: dict[int, list[tuple[int, int, int]]]
    #: bytes that go from an old to a new shard; old and new shards of one number are the same
    flow: dict[tuple[int, int], int]

    def table(self, spark) -> DataFrame:
        """One row an old shard: (old, blocks, cuts)."""
        rows = [(i, n, self.cuts[i]) for i, n in self.blocks.items()]
        return spark.createDataFrame(rows, "old int, blocks int, cuts array<struct<block:int,h:long,shard:int>>")


def place_of(stored: str):
    """A hash of the file of a row and of its place in the file: the same whenever the files are read, and told apart for equal rows."""
    return F.xxhash64(f"{stored}.file_path", f"{stored}.row_index")


def block_of():
    return F.pmod(F.xxhash64("h", F.lit(7)), F.col("blocks")).cast("int")


def plan(rows: DataFrame, shards: int, capacities: list[int] | None = None) -> Plan:
    """rows has (h: long, size: long, old: int), h a hash of each row's place.

    Each old shard is a line of its blocks, and within a block of its rows by h. The minimum-cost flow cuts that line: the bytes
    that stay come first, then what goes to each new shard. A row goes where the middle of its bytes lies, so a shard misses its
    capacity by less than one row at each cut. Block sizes are summed where they are; what reaches the driver is a number for
    each old shard and a place for each cut, of which there are at most as many as pairs of an old and a new shard. Only the
    blocks that a cut falls into are sorted, each by itself.
    """
    spark = rows.sparkSession
    sizes = {r["old"]: r["bytes"] for r in rows.groupBy("old").agg(F.sum("size").alias("bytes")).collect()}
    olds = 1 + max(sizes, default=-1)
    line = [sizes.get(i, 0) for i in range(olds)]
    flow = min_cost_flow(line, capacities or even_capacities(sum(line), shards))
    blocks = {i: max(1, -(-n // BLOCK_BYTES)) for i, n in sizes.items()}
    ends, cuts = [], {i: [] for i in sizes}
    for i in sizes:
        at, parts = 0, sorted((j for o, j in flow if o == i), key=lambda j: (j != i, j))
        for j in parts[:-1]:
            at += flow[i, j]
            ends.append((i, j, at))
        cuts[i].append((blocks[i], 0, parts[-1]))
    if ends:
        moduli = spark.createDataFrame(list(blocks.items()), "old int, blocks int")
        dealt = rows.join(F.broadcast(moduli), "old").withColumn("block", block_of())
        before = F.sum("bytes").over(Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
        lines = dealt.groupBy("old", "block").agg(F.sum("size").alias("bytes")).withColumn("low", before)
        wanted = spark.createDataFrame(ends, "old int, shard int, at long")
        # a cut for each pair of an old and a new shard at most, and each falls into one block
        inside = lines.join(F.broadcast(wanted), "old").where("low < at and at <= low + bytes").select("old", "block", "low", "shard", "at")
        inside = [tuple(r) for r in inside.collect()]
        found = spark.createDataFrame(inside, "old int, block int, low long, shard int, at long")
        order = Window.partitionBy("old", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
        cut_blocks = dealt.join(F.broadcast(found.select("old", "block").distinct()), ["old", "block"], "left_semi")
        middles = cut_blocks.withColumn("middle", F.sum("size").over(order) - F.expr("size div 2 + 1"))
        past = middles.join(F.broadcast(found), ["old", "block"]).where("low + middle >= at")
        at = {(r["old"], r["shard"]): r["h"] for r in past.groupBy("old", "shard").agg(F.min("h").alias("h")).collect()}
        for i, block, _, j, _ in inside:
            # without a row past the cut in its block, the stretch ends with the block
            cuts[i].append((block, at[i, j], j) if (i, j) in at else (block + 1, -(1 << 63), j))
    position = {(i, j): n for n, (i, j, _) in enumerate(ends)}
    cuts = {i: sorted(c, key=lambda x, i=i: position.get((i, x[2]), len(ends))) for i, c in cuts.items()}
    return Plan(blocks, cuts, flow)


def placed(rows: DataFrame, to: Plan) -> DataFrame:
    """rows (h, old, ...) plus (block, shard): the first stretch that ends after the row."""
    # one row an old shard
    found = rows.join(F.broadcast(to.table(rows.sparkSession)), "old").withColumn("block", block_of())
    later = F.filter("cuts", lambda c: (c["block"] > F.col("block")) | ((c["block"] == F.col("block")) & (c["h"] > F.col("h"))))
    return found.withColumn("shard", later[0]["shard"]).drop("blocks", "cuts")


def reshard(docs: DataFrame, old_shard=None, shards: int = SHARDS, text: str = "text", stored: bool = False) -> DataFrame:
    """docs plus `shard`, `slot` and `moved` (its shard number changed; old and new files of one number are the same).

    old_shard is a Column of small non-negative integers; by default the layout that hashed the source into
    OLD_SHARDS shards. Sizes end up near equal. stored says that docs is a table read from Parquet files, projections apart;
    anything else is written first, as rows are told apart by their place in the files and never matched by value. So repeated rows
    spread and have slots of their own; null ids and texts are fine (size 1); an empty table gives no rows. Where docs has columns of
    these names the new ones have underscores added; see fresh().
    """
    return _resharded(docs, old_shard, shards, text, stored)[0]


def _resharded(docs: DataFrame, old_shard, shards: int, text: str, stored: bool, capacities: list[int] | None = None) -> tuple[DataFrame, Plan, dict[str, str]]:
    names = {c: fresh(docs, c) for c in ("shard", "slot", "moved")}
    old = (old_shard if old_shard is not None else default_old_shard()).cast("int")
    if not stored:
        docs = materialize(docs, "rows")
    place = place_of("_metadata").alias("h")
    sizes = materialize(docs.select(place, size_of(text).alias("size"), old.alias("old")), "sizes")
    to = plan(sizes, shards, capacities)
    counts = placed(sizes, to).groupBy("shard", "old", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    counts = materialize(counts.withColumn("base", before).drop("n"), "bases")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keys = ["shard", "old", "block"]
    dealt = placed(docs.select(row, place, old.alias("old")), to).repartition(*keys)
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
    numbered = dealt.join(counts, keys).withColumn("slot", F.col("base") + inside - 1).withColumn("moved", F.col("shard") != F.col("old"))
    return numbered.select("row.*", *[F.col(c).alias(n) for c, n in names.items()]), to, names


def default_old_shard(source: str = "source"):
    return F.pmod(F.xxhash64(F.coalesce(source, F.lit("")), F.lit(3)), F.lit(OLD_SHARDS)).cast("int")


def write_shards(rows: DataFrame, path: str, changed: list[int] | None = None, shard: str = "shard", slot: str = "slot") -> None:
    """Rewrite the files of the shards in `changed` (None: all), a folder each; others are left alone.

    shard and slot are the columns that reshard() gave their numbers to; folders are named by the former.

    Rows of reshard() are already dealt out by blocks of BLOCK_BYTES, so a large shard is several files and no row moves again.
    """
    if changed is not None:
        rows = rows.where(F.col(shard).isin(changed))
    dealt = rows.sortWithinPartitions(shard, slot)
    dealt.write.mode("overwrite").partitionBy(shard).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path)


def rewrite(spark, path: str, out: str, shards: int, slack: float = 0.05, text: str = "text") -> tuple[list[int], dict[tuple[int, int], int]]:
    """(changed, moves): the layout in path (folders shard=N, with a column slot) for another number of shards.

    A shard may hold `slack` more than an even share; one that holds between an even share and that stays as it is. Only shards that give
    or get rows are read whole and written, under out; files of the others stay where they are and their rows keep their
    slots. The layout is then out/shard=N for the shards of `changed` and path/shard=N for the rest.
    """
    stored = spark.read.parquet(path).drop("slot")
    was = fresh(stored, "from")
    docs = stored.withColumnRenamed("shard", was)
    sizes = {r[was]: r["n"] for r in docs.groupBy(was).agg(F.sum(size_of(text)).alias("n")).collect()}
    line = [sizes.get(i, 0) for i in range(1 + max(sizes, default=-1))]
    capacities = []
    for j, even in enumerate(even_capacities(sum(line), shards)):
        now, most = line[j] if j < len(line) else 0, int(even * (1 + slack)) + 1
        capacities.append(now if even <= now <= most else most)
    flow = min_cost_flow(line, capacities)
    changed = sorted({i for pair in flow if pair[0] != pair[1] for i in pair})
    room = [c if j in changed else 0 for j, c in enumerate(capacities)]
    if changed:
        rows, _, names = _resharded(docs.where(F.col(was).isin(changed)), F.col(was), shards, text, True, room)
        write_shards(rows.drop(was, names["moved"]), out, shard=names["shard"], slot=names["slot"])
    return changed, {pair: n for pair, n in flow.items() if pair[0] != pair[1]}


def op8_reshard(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    path = scratch_path(spark, "shards")
    write_shards(reshard(docs, stored=True).drop("source"), path)
    back = spark.read.schema("doc_id long, text string, slot long, moved boolean, shard int").parquet(path)
    return back.select(
        "doc_id", size_of().alias("size"), F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
