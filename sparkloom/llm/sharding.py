"""Sharding by balanced label propagation, in DataFrame operations only.

Documents of equal text are linked. Each starts at a shard of its own by hash; rounds of joins
move linked documents towards the shard that most of their neighbours are in, as far as quotas
allow: no shard takes more linked documents than its share of rows; they end when fewer than one linked document in SETTLED can move. Documents of one group in
one shard have the same neighbours, so a round moves counts by (group, shard), which stay small
however large a group is; at the end a group's members are numbered and dealt to its counts.
Unlinked documents, which cut no edge anywhere, then fill the shards to their quotas.

The law is `rows`: shards' counts of documents differ by at most one. Within this, members of
a group leave only where the shard that they move to is full.

Defined results: a null text counts as empty (size 1) and equals an empty one; repeated rows
each get a place; an empty table gives no rows; other columns are ignored. A group larger than
a shard fills shards one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, buckets_for, numbered, stage

SHARDS = 16
#: Rounds end with one that moves at most one linked document of so many.
SETTLED = 200


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("grp"),
    )


def by_shard(pairs: list[int], shard: Column) -> Column:
    """The number of a shard from a list of one for each shard."""
    return F.element_at(F.array(*(F.lit(int(x)).cast("long") for x in pairs)), shard + 1)


def before(df: DataFrame, key: str, amount: str, out: str, buckets: int) -> DataFrame:
    """Add out: the amounts of the rows of the key before this row. Groups of fewer members (by powers of two) come first, then hashed buckets, as in numbered()."""
    b = df.withColumn("_b", F.floor(F.log2("members")).cast("int") * buckets + bucket_of(F.col("grp"), buckets))
    prior = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = b.groupBy(key, "_b").agg(F.sum(amount).alias("_n")).select(key, "_b", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_shift"))
    inner = Window.partitionBy(key, "_b").orderBy("grp", "shard").rowsBetween(Window.unboundedPreceding, -1)
    own = b.withColumn("_own", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    return own.join(shift, [key, "_b"]).withColumn(out, F.col("_own") + F.col("_shift")).drop("_b", "_own", "_shift")


def loads(state: DataFrame, shards: int) -> list[int]:
    found = dict(state.groupBy("shard").agg(F.sum("n")).collect())  # one row for each shard
    return [found.get(s, 0) for s in range(shards)]


def propagate(state: DataFrame, quotas: list[int]) -> DataFrame:
    """Rounds over staged (grp, members, shard, n), the linked documents by group and shard, until hardly any move is granted.

    Documents only move to where at least as many of their group are, ties to the lower shard, so the
    sum of squared parts grows with each round. Where quotas are tight, rounds that move a few at a
    time could be many: the last one is that which moves one in SETTLED or fewer, at any size.
    """
    shards, buckets = len(quotas), buckets_for(sum(quotas))
    while True:
        held = loads(state, shards)
        free = [q - x for q, x in zip(quotas, held)]
        room = by_shard(free, F.col("shard"))
        open_to = state.where(room > 0).groupBy("grp").agg(F.max(F.struct("n", (-F.col("shard")).alias("back"))).alias("best"))
        wish = state.join(open_to, "grp").withColumn("to", (-F.col("best.back")).cast("int"))
        better = (F.col("to") != F.col("shard")) & ((F.col("best.n") > F.col("n")) | ((F.col("best.n") == F.col("n")) & (F.col("to") < F.col("shard"))))
        movers = stage(wish.where(better).select("grp", "members", "shard", "n", "to"), "movers")
        granted = before(movers, "to", "n", "ahead", buckets)
        moved = F.greatest(F.lit(0), F.least(F.col("n"), by_shard(free, F.col("to")) - F.col("ahead")))
        granted = stage(granted.select("grp", "members", "shard", "to", moved.alias("moved")).where("moved > 0"), "granted")
        n_moved = granted.agg(F.sum("moved")).first()[0] or 0
        change = granted.select("grp", "members", F.col("to").alias("shard"), F.col("moved").alias("n")).unionByName(granted.select("grp", "members", "shard", (-F.col("moved")).alias("n")))
        state = stage(state.unionByName(change).groupBy("grp", "members", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "state")
        if n_moved * SETTLED <= sum(held):
            return state


def placed(state: DataFrame, quotas: list[int]) -> DataFrame:
    """(grp, ends): for each group the ends of its shards' parts among its members; what is over a quota is left out."""
    kept = before(state, "shard", "n", "ahead", buckets_for(sum(quotas)))
    n = F.greatest(F.lit(0), F.least(F.col("n"), by_shard(quotas, F.col("shard")) - F.col("ahead")))
    kept = kept.select("grp", "shard", n.alias("n")).where("n > 0")
    upto = Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn("end", F.sum("n").over(upto)).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))  # at most one for each shard


def quotas_of(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def first_below(ends: list[int], rank: Column) -> Column:
    """The number of the first interval whose end exceeds rank."""
    out = F.lit(len(ends) - 1)
    for s in reversed(range(len(ends) - 1)):
        out = F.when(rank < ends[s], F.lit(s)).otherwise(out)
    return out.cast("int")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    marked = stage(measured(docs, id_col, text_col), "sizes")
    quotas = quotas_of(marked.count(), shards)
    buckets = buckets_for(sum(quotas))
    start = marked.groupBy("grp", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    members = F.sum("n").over(Window.partitionBy("grp"))
    state = propagate(stage(start.withColumn("members", members).where("members > 1"), "state"), quotas)
    ends = stage(placed(state, quotas), "placed")
    ranked = numbered(marked, ["grp"], "row", "rank", buckets)
    mine = F.filter("ends", lambda e: e["end"] > F.col("rank"))
    linked = stage(ranked.join(ends, "grp", "left").select("row", "doc_id", "size", "text_crc32", F.when(F.size(mine) > 0, F.get(mine, F.lit(0))["shard"]).alias("own")), "linked")
    taken = dict(linked.where("own IS NOT NULL").groupBy("own").count().collect())
    gaps, total = [], 0
    for s, q in enumerate(quotas):
        total += q - taken.get(s, 0)
        gaps.append(total)
    filler = numbered(linked.where("own IS NULL").withColumn("one", F.lit(1)), ["one"], "row", "rank", buckets).withColumn("shard", first_below(gaps, F.col("rank")))
    kept = ["row", "doc_id", "size", "text_crc32"]
    dealt = stage(linked.where("own IS NOT NULL").select(*kept, F.col("own").alias("shard")).unionByName(filler.select(*kept, "shard")), "dealt")
    out = numbered(dealt, ["shard"], "row", "slot", buckets)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
