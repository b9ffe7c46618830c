"""Sharding: contiguous shards of near equal bytes from global prefix sums.

Equal texts form a group that stays together. Groups are ordered by (CRC-32, MD5) of the text; that key is
uniform, so its leading bits give even partitions without sampling. Bytes are summed per partition, the few
totals are prefix-summed, the cuts at equal targets are found inside the partitions they fall into, and every
document compares its key with these cuts: no join, and no task that holds a hot text's copies.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, text_or_empty

#: Key partitions; 2**12 totals go to the driver whatever the input.
KEY_BITS = 12
#: Groups over 1/HEAVY of all bytes (fewer than HEAVY) are dealt one by one, largest first.
HEAVY = 4096
#: Parts in which the places inside a shard are numbered, or as many as there are shuffle partitions.
SLOT_PARTS = 256


def _plan(heavy: list[tuple[str, int]], light_total: int, n_shards: int) -> tuple[dict[str, int], list[int]]:
    """Shard of each heavy group, and the light bytes where each shard but the first begins.

    Heavy groups go, largest first, to the shard with the fewest bytes; the light bytes then fill all shards
    up to a common level, which leaves shards above that level without any.
    """
    loads = [(0, s) for s in range(n_shards)]
    placed = {}
    for key, size in sorted(heavy, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(loads)
        placed[key] = s
        heapq.heappush(loads, (load + size, s))
    load = {s: x for x, s in loads}
    level, rest = 0, light_total
    ordered = sorted(load.values())
    for k in range(1, n_shards + 1):  # the common level when the k least loaded shards take light bytes
        level = (rest + sum(ordered[:k])) / k
        if k == n_shards or level <= ordered[k]:
            break
    room = [max(0.0, level - load[s]) for s in range(n_shards)]
    return placed, [round(x) for x in accumulate(room)][:-1]


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every document's shard of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 1 (null: 1). A null text has the checksum of the empty text and shares
    its group. slot: gapless from 0 in each shard, in no order of ids. Equal texts, in any number, share a shard, so one text with
    over 1/n_shards of all bytes makes its shard as large as itself. Repeated rows count each for itself. An
    empty table gives an empty result. Other columns of the input are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    t = text_or_empty(text)
    crc = F.crc32(F.encode(t, "utf-8"))
    keyed = scratch.keep(docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.concat(F.lpad(F.lower(F.hex(crc)), 8, "0"), F.md5(F.encode(t, "utf-8"))).alias("key"),
        F.monotonically_increasing_id().alias("row"),  # written, so that it stays
    ), "keys", shuffled=False)
    groups = keyed.groupBy("key").agg(F.sum("size").alias("bytes"))
    total = keyed.agg(F.sum("size")).first()[0] or 0
    heavy = [(r.key, r.bytes) for r in groups.filter(F.col("bytes") * HEAVY > total).collect()]
    light = keyed.join(F.broadcast(spark.createDataFrame(heavy, "key string, bytes long").select("key")), "key", "left_anti")
    part = lambda key: F.conv(F.substring(key, 1, 3), 16, 10).cast("int")  # noqa: E731  KEY_BITS = 3 hex digits
    totals = dict(light.groupBy(part(F.col("key")).alias("p")).agg(F.sum("size").alias("b")).collect())
    before, run = {}, 0
    for p in range(1 << KEY_BITS):
        before[p] = run
        run += totals.get(p, 0)
    placed, targets = _plan(heavy, run, n_shards)
    cuts = _cut_keys(light, part, totals, before, targets)
    shard = sum(((F.col("key") >= cut).cast("int") for cut in cuts), F.lit(0)).cast("int")
    if placed:
        names = spark.createDataFrame(list(placed.items()), "key string, heavy_shard int")
        out = keyed.join(F.broadcast(names), "key", "left").withColumn("shard", F.coalesce("heavy_shard", shard))
    else:
        out = keyed.withColumn("shard", shard)
    parts = max(SLOT_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = out.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))  # even, whatever ids or texts repeat
    sizes = out.groupBy("shard", "part").agg(F.count("*").alias("n"))  # n_shards x parts rows at most
    first = sizes.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    return out.join(F.broadcast(first), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + place - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _cut_keys(light: DataFrame, part: Column, totals: dict[int, int], before: dict[int, int], targets: list[int]) -> list[str]:
    """The key at which each shard but the first begins: groups that end, by more than half, past the target."""
    at = []
    for target in targets:
        fit = [p for p in totals if before[p] < target <= before[p] + totals[p]]
        at.append(fit[0] if fit else None)
    inside = sorted({p for p in at if p is not None})
    groups: dict[int, DataFrame] = {}
    rows = []
    if inside:
        found = light.filter(part(F.col("key")).isin(inside)).groupBy("key").agg(F.sum("size").alias("b"))
        w = Window.partitionBy("p").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = found.withColumn("p", part(F.col("key"))).withColumn("end", F.sum("b").over(w))
        wanted = light.sparkSession.createDataFrame(
            [(k, p, targets[k] - before[p]) for k, p in enumerate(at) if p is not None], "cut int, p int, target long")
        rows = (found.join(F.broadcast(wanted), "p").filter(F.col("end") - F.col("b") / 2 >= F.col("target"))
                .groupBy("cut").agg(F.min("key").alias("key")).collect())
    keys = {r.cut: r.key for r in rows}
    out = []
    for k, (p, target) in enumerate(zip(at, targets)):
        if p is None:  # before all bytes or after them
            out.append("" if target <= 0 else "g")
        else:
            out.append(keys.get(k, f"{p + 1:03x}" if p + 1 < 1 << KEY_BITS else "g"))
    return out
