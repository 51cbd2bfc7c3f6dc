"""Sharding by balanced label propagation.

Links join rows with equal texts. Every linked row starts in a shard by its id; in each round Spark joins the rows with
their group's histogram over shards, and rows ask to move to the shard that holds most of their group, be it full or not; then
those that are still elsewhere ask for the shard with room that holds most of it, so that a group goes on to its next shard. The
driver sees only shards x shards x buckets counts and turns them into quotas: opposite wishes are swapped one for one, what is
left may use the room below the cap. Rows without links have no preference; they fill the shards to exact counts at the end.

Law: `rows` - counts of any two shards differ by one at most. Groups larger than a shard (a third of all rows may be copies)
go on from shard to shard (4 of 8 measured for a third of
all rows, where 3 would hold them).

Defined results: a null text has size 1, checksum 0 and no links; equal rows (repeated ids included) are separate rows with
slots of their own; an empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm.common import dropped, rank_within, staged

#: Wishes to move are ranked by group, then row, in so many steps; the step in which a quota ends is cut into as many fine steps.
STEPS = 1024


def _allowed(wishes: dict[tuple[int, int, int], int], load: list[int], cap: int, n: int) -> dict[tuple[int, int], int]:
    """Rows of (source, target) that may move: opposite wishes against each other, then what room below the cap lets in."""
    want = {(s, t): sum(wishes.get((s, t, b), 0) for b in range(STEPS)) for s in range(n) for t in range(n) if s != t}
    allowed = {(s, t): min(w, want[t, s]) for (s, t), w in want.items()}
    room = [cap - x for x in load]
    for (s, t), w in sorted(want.items(), key=lambda x: (-x[1], x[0])):
        extra = max(0, min(w - allowed[s, t], room[t]))
        allowed[s, t] += extra
        room[t] -= extra
    return {k: v for k, v in allowed.items() if v}


def _filled(counts: dict[tuple[int, int, int], int], quotas: dict[tuple[int, int], int]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """By (source, target): how many steps fit into the quota as a whole, and how many rows those hold."""
    ends, moved = {}, {}
    for (s, t), quota in quotas.items():
        total = end = 0
        while end < STEPS and total + counts.get((s, t, end), 0) <= quota:
            total += counts.get((s, t, end), 0)
            end += 1
        ends[s, t], moved[s, t] = end, total
    return ends, moved


def _counted(rows: DataFrame, step: str) -> dict[tuple[int, int, int], int]:
    found = rows.groupBy("shard", "target", step).agg(F.count(F.lit(1)).alias("n"))
    return {(r["shard"], r["target"], r[step]): r["n"] for r in found.collect()}  # shards x shards x steps


def _move(members: DataFrame, load: list[int], cap: int, n: int, to_full: bool) -> DataFrame | None:
    """Moves rows toward the fullest shard of their group, of all shards or of those with room, and corrects `load`; None if no row moves."""
    # a shard with less room than a fine step may hold counts as full
    full = [] if to_full else [t for t in range(n) if load[t] + cap // STEPS >= cap]
    counts = members.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
    likes = F.struct("n", F.pmod(F.xxhash64("group", "shard"), F.lit(1 << 20)).alias("p"), "shard")
    best = counts.groupBy("group").agg(F.max(F.when(~F.col("shard").isin(full), likes) if full else likes).alias("best"))
    own = counts.select("group", "shard", likes.alias("own"))
    # a row moves to the fullest shard unless its own ranks above
    asking = own.join(best, "group").where(F.col("best").isNotNull() & (F.col("best") > F.col("own"))).select("group", "shard", F.col("best.shard").alias("target"))
    step = F.pmod(F.xxhash64("group"), F.lit(STEPS // 16)) * 16 + F.pmod(F.xxhash64("row_id"), F.lit(16))
    fine = F.pmod(F.xxhash64("row_id", F.lit(1)), F.lit(STEPS))
    wished = members.join(asking, ["group", "shard"], "left").withColumn("step", step).withColumn("fine", fine)
    wishes = _counted(wished.where("target is not null"), "step")
    quotas = _allowed(wishes, load, cap, n)
    if not quotas:
        return None
    ends, moved = _filled(wishes, quotas)
    pair = F.col("shard") * n + F.col("target")
    at = lambda d: F.element_at(F.create_map(*[x for (s, t), v in sorted(d.items()) for x in (F.lit(s * n + t), F.lit(v))]), pair)
    cut = {k: quota - moved[k] for k, quota in quotas.items() if quota > moved[k]}
    goes = F.col("step") < at(ends)
    if cut:
        fine_ends, more = _filled(_counted(wished.where(F.col("step") == at({k: ends[k] for k in cut})), "fine"), cut)
        goes = goes | ((F.col("step") == at(ends)) & (F.col("fine") < at(fine_ends)))
        moved = {k: v + more.get(k, 0) for k, v in moved.items()}
    if not any(moved.values()):
        return None
    for (s, t), v in moved.items():
        load[s] -= v
        load[t] += v
    goes = F.coalesce(goes, F.lit(False))
    return staged(wished.select("row_id", "group", F.when(goes, F.col("target")).otherwise(F.col("shard")).alias("shard")), "shards")


def propagate(members: DataFrame, n_shards: int, cap: int, rounds: int) -> DataFrame:
    """members: row_id, group, shard. Returns them with the shards after at most `rounds` rounds."""
    load = [0] * n_shards
    for r in members.groupBy("shard").count().collect():  # n_shards rows
        load[r["shard"]] = r["count"]
    for _ in range(rounds):
        still = True
        for to_full in (True, False):
            moved = _move(members, load, cap, n_shards, to_full)
            if moved is not None:
                dropped(members)
                members, still = moved, False
        if still:
            break
    return members


def assign_shards(docs: DataFrame, n_shards: int = 8, rounds: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.when(F.col(text_col).isNotNull(), F.xxhash64(F.col(text_col), F.crc32(text.cast("binary")))).alias("group"),
            F.xxhash64(F.lit(7), F.col(id_col)).alias("row_id"),
        ),
        "sizes",
    )
    total = base.count()
    if not total:
        return base.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lit(1).cast("long").alias("group_rows"))
    sizes = base.where("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("group_rows")).where("group_rows > 1")
    linked = base.join(sizes, "group")
    members = staged(linked.select("row_id", "group", F.pmod("row_id", F.lit(n_shards)).cast("int").alias("shard")).distinct(), "shards")
    members = propagate(members, n_shards, total // n_shards, rounds)
    placed = base.join(sizes, "group", "left").join(members.select("row_id", "group", "shard"), ["row_id", "group"], "left")
    placed = placed.select("doc_id", "size", "text_crc32", "row_id", F.coalesce("shard", F.lit(-1)).alias("pool"), F.coalesce("group_rows", F.lit(1)).alias("group_rows"))
    ranked = staged(rank_within(placed, ["pool"], ["row_id", "text_crc32"], rows=total), "ranked")
    held = {r["pool"]: r["count"] for r in ranked.groupBy("pool").count().collect()}  # n_shards + 1 rows
    quota = [total // n_shards + (t < total % n_shards) for t in range(n_shards)]
    # rows beyond a quota (linked rows of an overfull shard) join the pool of rows that fill what is left
    over, spill, start, fill = held.get(-1, 0), [], 0, []
    for t in range(n_shards):
        spill.append(over)
        over += max(0, held.get(t, 0) - quota[t])
        fill.append((start, min(held.get(t, 0), quota[t])))
        start += quota[t] - fill[-1][1]
    rank, pool = F.col("rank"), F.col("pool")
    at = rank
    for t in range(n_shards):
        at = F.when(pool == t, rank - quota[t] + spill[t]).otherwise(at)
    stays = F.lit(False)
    for t in range(n_shards):
        stays = stays | ((pool == t) & (rank < quota[t]))
    shard, slot = F.lit(n_shards - 1), F.col("at") - fill[-1][0] + fill[-1][1]
    for t in reversed(range(n_shards - 1)):
        here = F.col("at") < fill[t + 1][0]
        shard, slot = F.when(here, F.lit(t)).otherwise(shard), F.when(here, F.col("at") - fill[t][0] + fill[t][1]).otherwise(slot)
    return ranked.withColumn("at", at).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.when(stays, pool).otherwise(shard).cast("int").alias("shard"),
        F.when(stays, rank).otherwise(slot).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "group_rows",
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
