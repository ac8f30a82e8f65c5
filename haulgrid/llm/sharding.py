"""Balanced label propagation: documents to shards, with DataFrame operations only.

Linked documents (equal texts) start with labels dealt at random. All members of a group are each other's neighbours, so
the tally of a group's labels is what each of them sees of its neighbours. In each round a group proposes to move to the
label that most of its members have, among the shards that still have room for it; proposals are admitted, the larger groups'
first, up to each shard's quota. Groups that were refused look again in the next round. Documents without links, and the
members of groups that never found room, then fill what is left, members of a group side by side. Row counts of shards
differ by one at most.

A group larger than a shard, of which there can't be more than shards, fills whole shards first; what is left of it, less
than a shard, moves as one. So a group is on as many shards as it needs. Ranks come from counts of small buckets and a
rank inside a bucket, so no task sees a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulgrid.llm.scratch import Scratch, few, small

SHARDS = 24
ROUNDS = 4
#: Rows of a bucket that one task ranks, about.
BUCKET_ROWS = 20_000
#: More than the buckets of groups of one magnitude, whose numbers come one after the other.
BUCKETS = 1 << 40
_KEY = ["g", "size", "text_crc32"]


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), (at + 1).cast("int"))


def _bucket(rows: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(7)), F.lit(max(1, rows // BUCKET_ROWS)))


def _ranked(df: DataFrame, lane: str, weight: Column, order: list[str], out: str) -> DataFrame:
    """``df`` (with a column bucket) and the sum of ``weight`` over all rows of its lane up to this one, itself included."""
    sums = df.groupBy(lane, "bucket").agg(F.sum(weight).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(lane).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(lane, "bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum(weight).over(Window.partitionBy(lane, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_within", within).join(sums, [lane, "bucket"]).withColumn(out, F.col("_before") + F.col("_within")).drop("_before", "_within")


def _filled(rows: DataFrame, groups: DataFrame, giants: list, room: list[int]) -> DataFrame:
    """``rows`` with the shard that a row of these groups fills (whole); ``room`` loses the filled shards.

    A row beyond a group's last whole shard has none, and is of the group's second part.
    """
    known, filled = [], F.lit(None).cast("int")
    for k, g in enumerate(giants):
        known.append((*(g[c] for c in _KEY), k))
        upto = 0
        for t in range(len(room)):
            if 0 < room[t] <= g.members - upto:
                filled = F.when((F.col("giant") == k) & F.col("upto").between(upto + 1, upto + room[t]), t).otherwise(filled)
                upto, room[t] = upto + room[t], 0
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.select(*_KEY).schema)
    found = rows.join(F.broadcast(rows.sparkSession.createDataFrame(known, f"{schema}, giant int")), _KEY, "left")
    of = found.where("giant is not null").withColumn("bucket", F.pmod(F.xxhash64("r", F.lit(13)), F.lit(max(1, sum(g.members for g in giants) // BUCKET_ROWS))))
    ranked = _ranked(of, "giant", F.lit(1), ["r", "doc_id"], "upto").withColumn("whole", filled).withColumn("part", F.when(F.col("whole").isNull(), 1))
    return found.where("giant is null").select(*rows.columns).unionByName(ranked.select(*rows.columns))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under the law ``rows``) of every row.

    A null text has no bytes and is linked with other null texts; an empty text is a text of its own. Rows with a null or
    repeated doc_id are placed like any other. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.col("text").cast("string")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text, text.isNull()).alias("g"),
    ).withColumn("r", F.xxhash64("doc_id", "g", F.lit(3)))
    base = scratch.table(base, "rows")
    n = base.count()
    quota = [n // shards + (t < n % shards) for t in range(shards)]

    # Groups of linked documents; those larger than a shard get whole shards.
    groups = base.groupBy(*_KEY).count().where("count > 1").select(*_KEY, F.col("count").alias("members"), F.ceil(F.col("count") / BUCKET_ROWS).alias("fine"))
    groups = scratch.table(groups, "groups", rows=n)  # so that the join below can split a hot group's rows
    rows = base.join(small(groups), _KEY, "left").withColumn("label", F.pmod(F.xxhash64("r", F.lit(11)), F.lit(shards)).cast("int"))
    rows = rows.select("doc_id", *_KEY, "r", "label", F.when(F.col("members") > 1, 0).alias("part"), F.pmod(F.xxhash64("r", F.lit(5)), F.coalesce("fine", F.lit(1))).alias("fine"))
    rows = scratch.table(rows.withColumn("whole", F.lit(None).cast("int")), "linked", rows=n)
    giants = groups.where(F.col("members") > quota[0]).orderBy(F.desc("members"), *_KEY).collect()
    room = list(quota)
    if giants:
        rows = scratch.table(_filled(rows, groups, giants, room), "whole", rows=n)
    key = [*_KEY, "part"]
    tally = rows.where("part is not null and whole is null").groupBy(*key, "label").agg(F.count("*").alias("votes"))
    tally = scratch.table(tally.withColumn("members", F.sum("votes").over(Window.partitionBy(*key))), "tally", rows=n)
    count = tally.select(*key).distinct().count()

    settled = None
    left = tally
    for k in range(rounds if count else 0):
        open_shards = [t for t in range(shards) if room[t] > 0]
        if not open_shards:
            break
        fits = F.filter(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(room[t]).alias("room")) for t in open_shards]), lambda x: x["room"] >= F.col("members"))
        any_open = F.when(F.size(fits) > 0, F.element_at(fits, (F.pmod(F.xxhash64(*key, F.lit(k)), F.size(fits)) + 1).cast("int"))["t"])
        votes = F.when(_pick(room, F.col("label")) >= F.col("members"), F.col("votes")).otherwise(F.lit(0))
        wish = left.groupBy(*key, "members").agg(F.max(F.struct(votes.alias("v"), F.xxhash64("label", *key).alias("x"), "label")).alias("best"))
        wish = wish.select(*key, "members", F.when(F.col("best.v") > 0, F.col("best.label")).otherwise(any_open).alias("target")).where("target is not null").withColumn("bucket", F.floor(F.log2("members")) * -BUCKETS + _bucket(count, *key))
        ranked = _ranked(wish, "target", F.col("members"), key, "upto")
        got = scratch.table(ranked.where(F.col("upto") <= _pick(room, F.col("target"))).select(*key, "target", "members"), f"moved-{k}", rows=count)
        moved = {t: m for t, m in got.groupBy("target").agg(F.sum("members")).collect()}
        room = [room[t] - int(moved.get(t, 0)) for t in range(shards)]
        settled = got if settled is None else settled.unionByName(got)
        left = scratch.table(left.join(got, key, "left_anti"), f"left-{k}", rows=count)
        if left.isEmpty():
            break

    lane = F.coalesce("whole", F.lit(shards))
    placed = rows
    if settled is not None:
        placed = rows.join(settled.select(*key, "target"), key, "left")
        lane = F.coalesce("whole", "target", F.lit(shards))
    placed = placed.select("doc_id", *_KEY, "r", lane.cast("int").alias("lane"), F.pmod(F.xxhash64(*_KEY, "part", "fine", F.lit(7)), F.lit(max(1, n // BUCKET_ROWS))).alias("bucket"))
    placed = scratch.table(placed, "placed", rows=n)
    ranked = _ranked(placed, "lane", F.lit(1), [*_KEY, "r", "doc_id"], "upto").withColumn("at", (F.col("upto") - 1).cast("long"))

    # What is left is one line of rows, cut where a shard is full.
    ends, taken = [], []
    for t in range(shards):
        ends.append((ends[-1] if ends else 0) + room[t])
        taken.append(quota[t] - room[t])
    starts = [e - r for e, r in zip(ends, room, strict=True)]
    filler = sum((F.when(F.col("at") >= F.lit(e).cast("long"), 1).otherwise(0) for e in ends), F.lit(0))
    free = F.col("lane") == shards
    at_shard = F.when(free, F.least(filler, F.lit(shards - 1))).otherwise(F.col("lane")).cast("int")
    ranked = ranked.withColumn("shard", at_shard)
    slot = F.when(free, F.col("at") - _pick(starts, F.col("shard")) + _pick(taken, F.col("shard"))).otherwise(F.col("at"))
    return few(ranked, n).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
