"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

The rows of each source, in an order that a hash of their ids fixes, are cut into blocks of equal
size, and one block is placed in each slot. With weight share s, the source's block c (from 0) is
released at slot floor(c / s) and due by slot ceil((c + 1) / s); in each slot the released block
with the earliest deadline is placed. So at any time each source is less than one block away from
its share. The schedule of integer weights repeats after as many slots as their sum; the plan holds
that pattern alone, and every block's slot follows from it by arithmetic, with no loop over data.
When a source has run out, the others' shares grow in proportion and a new pattern starts there.

A row's rank within its source is its rank within a small hash range plus the counts of the ranges
before it, so that no task sees a whole source, whatever its size.
"""

from __future__ import annotations

import json
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OTHER = "(other)"
RANGE_ROWS = 256
COARSE = 1024
MAX_WEIGHT = 1_000_000
ADDED = ("pool", "block", "pos", "slot", "release", "deadline", "mix_position")


def pattern(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source within one period, by earliest deadline first; ties go to the first name."""
    total = sum(weights.values())
    done, slots = dict.fromkeys(weights, 0), {s: [] for s in weights}
    for t in range(total):
        ready = [s for s, w in weights.items() if done[s] * total // w <= t]
        s = min(ready, key=lambda s: (-(-(done[s] + 1) * total // weights[s]), s))
        slots[s].append(t)
        done[s] += 1
    return slots


def phases(weights: dict[str, int], blocks: dict[str, int]) -> list[dict]:
    """For each source and phase: its blocks [first, last), the phase's first slot, the period, its slots in it.

    Bounded by the number of weights and their sum, whatever the number of blocks.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    used, start, out = dict.fromkeys(left, 0), 0, []
    while left:
        unit = gcd(*(weights[s] for s in left))
        own = {s: weights[s] // unit for s in left}
        period, slots = sum(own.values()), pattern(own)
        ends = {s: (n - 1) // own[s] * period + slots[s][(n - 1) % own[s]] + 1 for s, n in left.items()}
        length = min(ends.values())
        for s in list(left):
            n = length // period * own[s] + sum(x < length % period for x in slots[s])
            out.append({"pool": s, "first": used[s], "last": used[s] + n, "start": start, "period": period, "share": own[s], "slots": slots[s]})
            used[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        start += length
    return out


def mix(df: DataFrame, weights: dict[str, int], other_weight: int, block_rows: int, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """df with each row's place in the mix; every row of df stays, in one shuffle of df.

    Adds pool (the source, or OTHER for null and unlisted ones, which share other_weight), block and
    pos (of the source, and within the block, from 0), slot, release and deadline (in blocks over
    the whole mix) and mix_position (slot * block_rows + pos). Where df has columns of these names,
    the new ones replace them. Only a source's last block may be short. Weights are positive
    integers, of MAX_WEIGHT together at most: the slots of one period are laid out on the driver.
    Rows of equal ids follow each other in the order of their hash; rows without an id are spread by
    theirs. No rows give no rows.
    """
    if block_rows < 1 or min([other_weight, *weights.values()]) < 1 or OTHER in weights:
        raise ValueError("weights and block_rows must be positive integers, and the name of the rest isn't free")
    if other_weight + sum(weights.values()) > MAX_WEIGHT:
        raise ValueError(f"the weights are more than {MAX_WEIGHT} together")
    columns = [c for c in df.columns if c not in ADDED]
    hashable = [F.col(f"row.`{f.name}`") for f in df.schema if f.name in columns and "map<" not in f.dataType.simpleString()]
    hashed = F.md5(F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.concat(F.lit("row "), F.xxhash64(*hashable).cast("string"))))
    pool = F.when(F.col(f"row.`{source_col}`").isin(list(weights)), F.col(f"row.`{source_col}`")).otherwise(OTHER)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")).withColumn("h", hashed).withColumn("pool", pool)
    n_ranges = max(1, rows.count() // RANGE_ROWS)
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("h", 1, 7), 16, 10).cast("long") * n_ranges / (1 << 28)).cast("long"))

    fine = rows.groupBy("pool", "range").agg(F.count("*").alias("n")).withColumn("coarse", F.floor(F.col("range") / COARSE))
    within = Window.partitionBy("pool", "coarse").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("pool").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    coarse = fine.groupBy("pool", "coarse").agg(F.sum("n").alias("n"))
    starts = coarse.select("pool", "coarse", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("start"))
    before = fine.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["pool", "coarse"]).select("pool", "range", (F.col("start") + F.col("within")).alias("before"))

    sizes = {r["pool"]: r["n"] for r in coarse.groupBy("pool").agg(F.sum("n").alias("n")).collect()}  # a row for each weight at most
    every = weights | {OTHER: other_weight}
    plan = phases(every, {s: -(-sizes.get(s, 0) // block_rows) for s in sorted(every)})
    by_pool = [{"pool": s, "phases": [p for p in plan if p["pool"] == s and p["last"] > p["first"]]} for s in sorted({p["pool"] for p in plan})]
    kind = "array<struct<pool:string,phases:array<struct<first:bigint,last:bigint,start:bigint,period:bigint,share:bigint,slots:array<bigint>>>>>"
    table = df.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(by_pool)), kind)).alias("p")).select("p.*")

    order = Window.partitionBy("pool", "range").orderBy("h", F.xxhash64(*hashable))  # the same order in a repeated task
    ranked = rows.join(before, ["pool", "range"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    placed = ranked.withColumns({"block": F.floor(F.col("rank") / block_rows), "pos": F.col("rank") % block_rows})
    placed = placed.join(F.broadcast(table), "pool")  # a row for each weight at most
    placed = placed.withColumn("p", F.expr("element_at(filter(phases, p -> block < p.last), 1)")).withColumn("c", F.expr("block - p.first"))
    placed = placed.withColumns({
        "slot": F.expr("p.start + c div p.share * p.period + p.slots[cast(c % p.share as int)]"),
        "release": F.expr("p.start + c * p.period div p.share"),
        "deadline": F.expr("p.start + ((c + 1) * p.period + p.share - 1) div p.share"),
    })
    return placed.select("row.*", "pool", "block", "pos", "slot", "release", "deadline", (F.col("slot") * block_rows + F.col("pos")).alias("mix_position"))


def oracle(weights: dict[str, int], other_weight: int, block_rows: int) -> str:
    """DuckDB SQL that places the blocks one by one, for the rows of mix() over documents (doc_id, source)."""
    every = dict(sorted((weights | {OTHER: other_weight}).items()))
    names, values = ", ".join(f"'{s}'" for s in every), ", ".join(map(str, every.values()))
    listed = ", ".join(f"'{s}'" for s in weights)
    return f"""
WITH RECURSIVE conf AS (
  SELECT [{names}] AS names, [{values}]::BIGINT[] AS weights, range(1, {len(every) + 1}) AS all_of
), ranked AS (
  SELECT doc_id, source, pool, row_number() OVER (PARTITION BY pool ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), ''))) - 1 AS r
  FROM (SELECT doc_id, source, CASE WHEN source IN ({listed}) THEN source ELSE '{OTHER}' END AS pool FROM documents)
), sizes AS (
  SELECT list((SELECT (count(*) + {block_rows - 1}) // {block_rows} FROM ranked WHERE pool = n) ORDER BY n) AS n_blocks FROM (SELECT unnest(names) AS n FROM conf)
), sim AS (
  SELECT 0::BIGINT AS t, 0::BIGINT AS t0, list_transform(n_blocks, lambda x: 0::BIGINT) AS done, n_blocks AS remaining,
    0::BIGINT AS pick, 0::BIGINT AS block, 0::BIGINT AS release, 0::BIGINT AS deadline FROM sizes
  UNION ALL
  SELECT t + 1, CASE WHEN remaining[p] = 1 THEN t + 1 ELSE t0 END,
    list_transform(all_of, lambda i: CASE WHEN remaining[p] = 1 THEN 0 WHEN i = p THEN done[i] + 1 ELSE done[i] END),
    list_transform(all_of, lambda i: CASE WHEN i = p THEN remaining[i] - 1 ELSE remaining[i] END),
    p, n_blocks[p] - remaining[p], t0 + done[p] * total // weights[p], t0 + ((done[p] + 1) * total + weights[p] - 1) // weights[p]
  FROM (
    SELECT *, list_min(list_transform(list_filter(all_of, lambda i: remaining[i] > 0 AND done[i] * total // weights[i] <= t - t0),
      lambda i: ((done[i] + 1) * total + weights[i] - 1) // weights[i] * 1000 + i)) % 1000 AS p
    FROM (SELECT sim.*, conf.*, n_blocks, list_sum(list_transform(list_filter(all_of, lambda i: remaining[i] > 0), lambda i: weights[i]))::BIGINT AS total FROM sim, conf, sizes)
    WHERE total > 0
  )
)
SELECT doc_id, source, pool, r // {block_rows} AS block, r % {block_rows} AS pos, t - 1 AS slot, release, deadline, (t - 1) * {block_rows} + r % {block_rows} AS mix_position
FROM ranked JOIN sim ON sim.t > 0 AND sim.block = r // {block_rows} AND (SELECT names FROM conf)[sim.pick] = ranked.pool
"""
