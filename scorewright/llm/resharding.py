"""Minimum-cost-flow resharding.

From the old shards' sizes and the new capacities, a flow decides how many rows of which block move
where, so that the fewest bytes move; then only affected shards are written anew. The law is
``rows``: new shards have row counts at most one apart.

1. Rows are counted by old shard and size. A shard of more than the least capacity has three blocks:
   rows that leave in any case (its smallest), the next larger row, which stays if the shard is one
   of those with a row more, and the rest. These blocks' rows and bytes are exact.
2. The network: each block may send its rows to each new shard, at no cost if it is the own one, else
   at the block's bytes a row; each new shard takes the least capacity, and as many shards as there
   are rows left over take one more. ``min_cost_flow`` solves it on the driver by successive shortest
   paths with potentials. Its size follows the number of shards, never the rows.
3. A size and, at that size, a number of rows say which of a shard's rows leave; they are numbered, and
   the flow's transfers are intervals of these numbers. A row's slot is its number in its new shard.
4. ``rewrite`` writes anew the shards that gain or lose rows.

Ranks never need a whole shard in one task: rows are numbered inside blocks of about ``BLOCK_ROWS`` by
a hash of the row's place, whose counts are summed on a table with a row for each block. So neither
equal texts nor equal ids make a large block. Null texts count as empty. Repeated rows each have a
slot. Null ids are placed like others. Very long texts are only measured. Extra columns are ignored,
or kept by ``rewrite``, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ranked, scratch_path, table, text_of

SHARDS = 24
#: Rows that a block for ranks has about.
BLOCK_ROWS = 2_000

Arc = tuple[object, object, int, float]


def min_cost_flow(arcs: list[Arc], source: object, sink: object) -> list[int]:
    """The flow on each arc (from, to, capacity, cost >= 0) of a largest flow of the least cost.

    Successive shortest paths: each path is shortest by costs reduced by the nodes' potentials, which
    keep residual arcs at a cost of 0 or more, so Dijkstra's search finds it.
    """
    head, left, cost, out = [], [], [], defaultdict(list)
    for u, v, capacity, c in arcs:
        for a, b, room, price in ((u, v, capacity, c), (v, u, 0, -c)):  # an arc and its residual have numbers 2i and 2i + 1
            out[a].append(len(head))
            head.append(b)
            left.append(room)
            cost.append(price)
    potential = defaultdict(float)
    while True:
        far, came, queue, tick = {source: 0.0}, {}, [(0.0, 0, source)], 0
        while queue:
            d, _, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for e in out[u]:
                if left[e]:
                    step = d + max(0.0, cost[e] + potential[u] - potential[head[e]])
                    if step < far.get(head[e], float("inf")):
                        far[head[e]], came[head[e]], tick = step, e, tick + 1
                        heapq.heappush(queue, (step, tick, head[e]))
        if sink not in far:
            return [arc[2] - left[2 * i] for i, arc in enumerate(arcs)]
        for node in list(potential.keys() | far.keys()):
            potential[node] += min(far.get(node, far[sink]), far[sink])
        path, node = [], sink
        while node != source:
            path.append(came[node])
            node = head[came[node] ^ 1]
        flow = min(left[e] for e in path)
        for e in path:
            left[e] -= flow
            left[e ^ 1] += flow


def transfers(blocks: dict[int, list[tuple[int, float]]], shards: int) -> dict[tuple[int, int], int]:
    """Rows that old shard s sends to new shard t, by (s, t), s != t. blocks: of each old shard (rows, bytes a row)."""
    low, odd = divmod(sum(n for b in blocks.values() for n, _ in b), shards)
    arcs: list[Arc] = []
    for s, own in blocks.items():
        for k, (n, each) in enumerate(own):
            arcs.append(("rows", ("block", s, k), n, 0.0))
            arcs += [(("block", s, k), ("shard", t), n, 0.0 if s == t else each) for t in range(shards)]
    arcs += [(("shard", t), "end", low, 0.0) for t in range(shards)]
    arcs += [(("shard", t), "odd", 1, 0.0) for t in range(shards)] + [("odd", "end", odd, 0.0)]
    sent: dict[tuple[int, int], int] = defaultdict(int)
    for (u, v, *_), n in zip(arcs, min_cost_flow(arcs, "rows", "end"), strict=True):
        if n and u[0] == "block" and v[0] == "shard" and u[1] != v[1]:
            sent[u[1], v[1]] += n
    return dict(sent)


def _number(shard: Column) -> Column:
    return F.coalesce(shard.cast("int"), F.lit(-1))


def row_key(docs: DataFrame, old_shard: Column) -> Column:
    """A hash of a row's id, text, old shard and input split: rows of equal keys are alike, and no more than a split has."""
    return F.xxhash64(docs["doc_id"], text_of(docs), _number(old_shard), F.input_file_name(), F.input_file_block_start())


def measured(docs: DataFrame, old_shard: Column) -> DataFrame:
    """(doc_id, size, text_crc32, old, key, uid): size in UTF-8 bytes plus 8; uid numbers the rows and has to be written before it is used twice."""
    text = text_of(docs)
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _number(old_shard).alias("old"),
        row_key(docs, old_shard).alias("key"),
        F.monotonically_increasing_id().alias("uid"),
    )


def plan(rows: DataFrame, shards: int = SHARDS) -> tuple[dict[int, tuple[int, int]], dict[tuple[int, int], int]]:
    """((size, rows of it) up to which each old shard's rows leave, rows to send by (old, new)). Other old shards than the first ``shards`` are dissolved."""
    sizes = rows.groupBy("old", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialise(sizes, "reshard-sizes")  # as many rows as texts have lengths, for each old shard
    totals = {r["old"]: (r["n"], r["b"]) for r in sizes.groupBy("old").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("b")).collect()}  # old shards
    low = sum(n for n, _ in totals.values()) // shards
    kept = {s: low if 0 <= s < shards else 0 for s in totals}
    spare = {s: n - kept[s] for s, (n, _) in totals.items() if n > kept[s]}
    before = Window.partitionBy("old").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    below = sizes.withColumn("less", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("bytes", F.coalesce(F.sum(F.col("n") * F.col("size")).over(before), F.lit(0)))
    last = F.lit(False)  # the last of the rows that the least capacity has no room for
    for s, n in spare.items():
        last = last | (F.col("old") == s) & (F.col("less") < n) & (F.lit(n) <= F.col("less") + F.col("n"))
    edge = {r["old"]: r for r in below.where(last).collect()}  # one row for each old shard
    blocks: dict[int, list[tuple[int, float]]] = {}
    for s, (n, total) in sorted(totals.items()):
        if s not in spare:
            blocks[s] = [(n, total / n)]
            continue
        size, first = edge[s]["size"], spare[s] - 1
        gone = edge[s]["bytes"] + (first - edge[s]["less"]) * size
        rest = n - spare[s]
        blocks[s] = [(k, b / k) for k, b in ((first, gone), (1, size), (rest, total - gone - size)) if k]
    sent = transfers(blocks, shards)
    leave: dict[int, int] = defaultdict(int)
    for (s, _), n in sent.items():
        leave[s] += n
    return {s: (edge[s]["size"], n - edge[s]["less"]) for s, n in leave.items()}, sent


def _numbered(rows: DataFrame, group: str, counts: dict[int, int], name: str) -> DataFrame:
    """``rows`` with their place in ``group`` by blocks of the hash; counts: rows of each group, which are shards."""
    per = F.lit(1)
    for s, n in counts.items():
        per = F.when(F.col(group) == s, F.lit(1 + n // BLOCK_ROWS)).otherwise(per)
    return ranked(rows, [group], [F.col("uid")], F.pmod(F.xxhash64("uid"), per), name)


def _counts(rows: DataFrame, group: str) -> dict[int, int]:
    return {r[group]: r["n"] for r in rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}  # shards


def reshard(docs: DataFrame, old_shard: Column, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, old, key, shard, slot): the new place of each row."""
    spark = docs.sparkSession
    rows = materialise(measured(docs, old_shard), "reshard-rows")
    upto, sent = plan(rows, shards)
    upto = spark.createDataFrame([(s, *x) for s, x in upto.items()], "u_old int, u_size long, u_rows long")
    rows = rows.join(F.broadcast(upto), rows["old"] == F.col("u_old"), "left")  # one row for each old shard
    own = ["doc_id", "size", "text_crc32", "old", "key", "uid"]
    tied = rows.where("size = u_size")
    tied = materialise(_numbered(tied, "old", _counts(tied, "old"), "tie"), "reshard-tied")
    leaving = materialise(rows.where("size < u_size").select(*own).unionByName(tied.where("tie < u_rows").select(*own)), "reshard-leaving")
    ends: dict[int, list[tuple[int, int]]] = defaultdict(list)  # of each old shard the ends of its leavers' intervals and where they go
    for (s, t), n in sorted(sent.items()):
        ends[s].append(((ends[s][-1][0] if ends[s] else 0) + n, t))
    cuts = spark.createDataFrame(list(ends.items()), "p_old int, cuts array<struct<end:long,to:int>>")
    leaving = _numbered(leaving, "old", _counts(leaving, "old"), "rank").join(F.broadcast(cuts), F.col("old") == F.col("p_old"))  # one row for each old shard
    target = F.get(F.filter("cuts", lambda c: F.col("rank") < c["end"]), F.lit(0))["to"]
    stay = rows.where("u_size is null or size > u_size").select(*own).unionByName(tied.where("tie >= u_rows").select(*own))
    placed = stay.withColumn("shard", F.col("old")).unionByName(leaving.select(*own, target.alias("shard")))
    placed = materialise(placed, "reshard-placed")
    out = _numbered(placed, "shard", _counts(placed, "shard"), "slot")
    return out.select("doc_id", "size", "text_crc32", "old", "key", "shard", "slot")


def rewrite(docs: DataFrame, old_shard: Column, places: DataFrame, target: str) -> list[int]:
    """Write the rows of ``docs`` whose shard gains or loses rows to folders to_shard=k of ``target``; returns those shards' numbers.

    Other shards' files stay as they are. Rows of equal keys are alike, so it doesn't matter which of
    them takes which of their places. The texts are shuffled once, to meet their places.
    """
    moved = places.where("old <> shard")
    numbers = sorted(r["s"] for r in moved.select(F.explode(F.array("old", "shard")).alias("s")).distinct().collect())  # shard numbers
    own = [f"d_{c}" for c in docs.columns]
    rows = docs.select(*[docs[c].alias(d) for c, d in zip(docs.columns, own, strict=True)], _number(old_shard).alias("old"), row_key(docs, old_shard).alias("key")).where(F.col("old").isin(numbers))
    to = places.where(F.col("old").isin(numbers)).groupBy("key").agg(F.array_sort(F.collect_list("shard")).alias("shards"))  # of one input split's rows
    rows = rows.join(to, "key").withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("old")))
    out = rows.select(*[F.col(d).alias(c) for c, d in zip(docs.columns, own, strict=True)], F.get("shards", F.col("k") - 1).alias("to_shard"))
    out.write.partitionBy("to_shard").parquet(target)
    return numbers


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.crc32(F.coalesce(docs["source"].cast("string"), F.lit("")).cast("binary")), F.lit(SHARDS))  # one shard holds whole sources
    out = materialise(reshard(docs, old), "reshard-places")
    rewrite(docs, old, out, scratch_path(spark, "reshard-shards"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
