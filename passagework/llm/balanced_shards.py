"""Balanced label propagation of linked documents over shards, with DataFrame functions only.

Documents with equal texts are linked. All rows are first dealt out in hash order, so shard counts differ by
one at most. Then each round counts, for every group of linked rows, its rows in each shard; the shard with
most is the label its rows move to. Moves keep the counts exactly: rows that move from one shard to another
are matched by rows that move back, or by unlinked rows that make room. Quotas come from the counts of wanted
moves between shards, a table of at most ``shards`` squared rows that the driver balances. A group larger than
half a shard is split by hash into parts that fit, so no hot group overflows a shard or a task. Rows are
ranked within a shard by hash buckets of bounded size, never by one window over a shard.

The law that holds is ``rows``: shard counts are at most one apart.

Defined cases: null text has 16 bytes, checksum 0 and is linked with other nulls only; rows that repeat
doc_id and text are interchangeable; null doc_ids are rows like others; with fewer rows than shards some shards
are empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm.common import text_digest
from passagework.session import written

SHARDS, ROUNDS = 40, 6
OVERHEAD = 16
BUCKET_ROWS = 4096


def ranked(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with ``rank``, their place from 0 within ``keys`` in the order of ``h`` and doc_id."""
    bits = max(1, (total // BUCKET_ROWS).bit_length())
    placed = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    by = [*keys, "bucket"]
    counts = placed.groupBy(*by).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
    return placed.withColumn("within", within).join(offsets, by).withColumn("rank", F.col("offset") + F.col("within") - 1).drop("bucket", "within", "offset")


def quotas(wanted: dict[tuple[int, int], int], free: dict[int, int], shards: int) -> tuple[dict, list[tuple[int, int, int, int]]]:
    """Moves allowed between shards, and ranges (from, to, first rank, end rank) of the unlinked rows that make room."""
    allowed = dict(wanted)
    net = [0] * shards
    for (i, j), n in allowed.items():
        net[j] += n
        net[i] -= n
    over = [j for j in range(shards) if net[j] > free.get(j, 0)]
    while over:  # fewer rows come in; that leaves more where they came from, which may then be too many there
        j = over.pop()
        for i in range(shards):
            cut = min(allowed.get((i, j), 0), net[j] - free.get(j, 0))
            if cut > 0:
                allowed[i, j] -= cut
                net[j] -= cut
                net[i] += cut
                if net[i] > free.get(i, 0) and i not in over:
                    over.append(i)
    back, given = [], [0] * shards
    takers = [[k, -net[k]] for k in range(shards) if net[k] < 0]
    for j in range(shards):
        while net[j] > 0:
            k, room = takers[-1]
            n = min(net[j], room)
            back.append((j, k, given[j], given[j] + n))
            given[j] += n
            net[j] -= n
            takers[-1][1] -= n
            if not takers[-1][1]:
                takers.pop()
    return allowed, back


def _round(rows: DataFrame, total: int, shards: int) -> tuple[DataFrame, int]:
    spark = rows.sparkSession
    linked, group = F.col("linked"), ["digest", "part"]
    votes = rows.where(linked).groupBy(*group, "shard").agg(F.count("*").alias("n"))
    tie = F.xxhash64(*group, "shard").alias("tie")  # equal votes fall evenly on the shards
    label = votes.groupBy(*group).agg(F.max(F.struct("n", tie, "shard"))["shard"].alias("target"))
    aimed = written(rows.join(label, group, "left").withColumn("target", F.coalesce("target", "shard")), "shard-aims")
    moves = {(r["shard"], r["target"]): r["n"] for r in aimed.where("shard != target").groupBy("shard", "target").agg(F.count("*").alias("n")).collect()}
    free = {r["shard"]: r["n"] for r in aimed.where(~linked).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    allowed, back = quotas(moves, free, shards)
    moved = sum(allowed.values())
    if not moved:
        return rows, 0
    go = spark.createDataFrame([(i, j, n) for (i, j), n in allowed.items()], "shard int, target int, quota long")
    ranges = spark.createDataFrame(back, "shard int, goes int, low long, high long")
    columns = [c for c in rows.columns if c != "shard"]
    movers = ranked(aimed.where("shard != target"), ["shard", "target"], total).join(F.broadcast(go), ["shard", "target"], "left")
    movers = movers.select(*columns, F.when(F.col("rank") < F.col("quota"), F.col("target")).otherwise(F.col("shard")).alias("shard"))
    lone = ranked(aimed.where(~linked), ["shard"], total).alias("l")
    made = lone.join(F.broadcast(ranges).alias("r"), (F.col("l.shard") == F.col("r.shard")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
    made = made.select(*(f"l.{c}" for c in columns), F.coalesce("goes", "l.shard").alias("shard"))
    stay = aimed.where(linked & (F.col("shard") == F.col("target"))).select(*columns, "shard")
    return written(movers.unionByName(made).unionByName(stay), "shard-rows"), moved


def assign(documents: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, digest`` of every row."""
    body: Column = F.coalesce(documents[text], F.lit(""))
    rows = documents.select(
        documents[doc_id].alias("doc_id"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        text_digest(documents[text]).alias("digest"),
    )
    rows = written(rows.withColumn("h", F.xxhash64("doc_id", "digest")), "shard-rows")
    total = rows.count()
    parts = F.ceil(F.col("n") / max(total // (2 * shards), 1)).cast("int")
    groups = rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest", parts.alias("parts"))
    rows = rows.join(groups, "digest", "left").withColumn("linked", F.col("parts").isNotNull())
    rows = rows.withColumn("part", F.pmod(F.xxhash64("h", F.lit(1)), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    rows = ranked(written(rows, "shard-links"), [], total)
    rows = written(rows.withColumn("shard", F.pmod("rank", F.lit(shards)).cast("int")).drop("rank"), "shard-rows")
    for _ in range(rounds):
        rows, moved = _round(rows, total, shards)
        if not moved:
            break
    placed = ranked(rows, ["shard"], total)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "digest")


def cut_edges(assigned: DataFrame) -> DataFrame:
    """One row: ``links`` between rows of equal texts, and how many of them are ``cut``."""
    pairs = lambda n: F.sum(n * (n - 1) / 2).cast("long")
    inside = assigned.groupBy("digest", "shard").agg(F.count("*").alias("n"))
    whole = inside.groupBy("digest").agg(F.sum("n").alias("n"), pairs(F.col("n")).alias("kept"))
    return whole.agg(F.coalesce(pairs(F.col("n")), F.lit(0)).alias("links"), F.coalesce(pairs(F.col("n")) - F.sum("kept"), F.lit(0)).alias("cut"))
