"""Mixing sources to target weights by Sainte-Laguë apportionment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, drop_tables, key_bucket, packed_row, prefix_sums, quoted, seeded_key, source_key, table_mark, text_of, unpacked, word_count, written

#: Up to so many sources the plan goes to every task: a row a source, and at most a number for each block and source.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """Targets of the sources from (stratum, source_size): adds place, weight and target.

    Sources in code-point order, null last, take the weights in turn and share
    the total of all sizes. A target stops at limit times its source's size and
    the excess goes to the others by weight: with sources in order of limit per
    weight, the common level is the greatest of the levels that result when the
    first i sources are full.
    """
    everything = Window.partitionBy(F.lit(0))
    placed = sizes.withColumn("place", F.row_number().over(everything.orderBy(F.col("stratum") == "n", "stratum")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("weight", weight).withColumn("ceiling", limit * F.col("source_size"))
    ahead = everything.orderBy(F.col("ceiling") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(ahead), F.lit(0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
    return placed.withColumn("level", level).withColumn("target", F.least(F.col("ceiling").cast("double"), F.col("weight") * F.max("level").over(everything))).drop("level", "ceiling")


def block_size(total: int, shards: int = 64, per_shard: int = 1024) -> int:
    """Words in a block: the total over all blocks of all shards, rounded up."""
    return max(1, -(-total // (shards * per_shard)))


def block_count(total: int, size: int) -> int:
    """Blocks that the mix has: total over size, rounded half up, in whole numbers."""
    return max(1, (2 * total + size) // (2 * size))


def block_quotas(targets: DataFrame, total: int, shards: int = 64, per_shard: int = 1024, limit: int = 3) -> DataFrame:
    """Sainte-Laguë: (stratum, shard, quota), whole blocks of each source in each shard.

    The total is cut into at most shards * per_shard equal blocks; the blocks go
    one by one to the highest quotient target / (2j + 1), and the run of
    winners is cut into the shards. Each source offers as many quotients as it
    can win at most (its share, raised by the rounding of all sources), so the
    ranking has a bounded number of rows: the blocks, and two for each source.
    """
    size = block_size(total, shards, per_shard)
    seats = block_count(total, size)
    everything = Window.partitionBy(F.lit(0))
    share = F.col("target") * seats / F.lit(max(total, 1))
    most = F.ceil(share * (1 + F.count("*").over(everything) / (2 * seats)) + 1)
    offers = targets.withColumn("offers", F.least(most, limit * F.ceil(F.col("source_size") / size)))
    quotients = offers.filter("offers > 0").select("stratum", "place", "target", F.explode(F.expr("sequence(0L, offers - 1L)")).alias("j"))
    quotients = quotients.withColumn("quotient", F.col("target") / (2 * F.col("j") + 1))
    seat = F.row_number().over(everything.orderBy(F.desc("quotient"), "place", "j")) - 1
    won = quotients.withColumn("seat", seat).filter(F.col("seat") < seats)
    return won.groupBy("stratum", F.expr(f"seat div {per_shard}").cast("int").alias("shard")).agg(F.count("*").alias("quota"))


def block_plan(targets: DataFrame, quotas: DataFrame, block: int, seed: int) -> DataFrame:
    """How every source fills its quotas: (stratum, source_size, target, blocks, quota, places, upto).

    places: for each block of the source its place in a seeded shuffle of them.
    Shards are filled in turn with the blocks in order of their places, from
    the first again after the last: pick k is the block whose place is k mod
    blocks. upto: for each shard the number of picks up to its end. A row a
    source; all places together are at most the blocks of the mix and one for
    each source.
    """
    own = targets.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)).cast("long"))
    dealt = own.select("stratum", F.explode(F.expr("sequence(0L, blocks - 1L)")).alias("block"))
    shuffled = Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "stratum", F.col("block").cast("string"))), "block")
    places = dealt.withColumn("place", F.row_number().over(shuffled) - 1).groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("block", "place"))).alias("dealt"))
    filled = quotas.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("shard", F.col("quota").cast("long").alias("quota")))).alias("won"), F.sum("quota").cast("long").alias("quota"))
    upto = F.expr("transform(won, (x, k) -> named_struct('shard', x.shard, 'picks', aggregate(slice(won, 1, k + 1), 0L, (s, y) -> s + y.quota)))")
    both = own.join(places, "stratum").join(filled, "stratum", "left")
    return both.select("stratum", "source_size", "target", "blocks", F.coalesce("quota", F.lit(0)).cast("long").alias("quota"), F.col("dealt.place").alias("places"), F.coalesce(upto, F.expr("array()")).alias("upto"))


def mixed(docs: DataFrame, shards: int = 64, per_shard: int = 1024, seed: int = 23, limit: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of every document the mix takes (repeats counted), and into which shards.

    Each source is a stream of words, its documents in a seeded shuffle, cut
    into equal blocks. block_quotas gives whole numbers of blocks for each
    shard; each shard's quota is filled with blocks of the source in a seeded
    order (block_plan), every block at most limit times. Reruns agree, for all
    depends on ids, sizes and the seed alone.

    Returns doc_id, source, size, source_size, target, taken, and takes: an
    array of (shard, words). Null and blank texts have size 0 and give 0; null
    sources are one source, last in order; an empty table gives no rows; rows
    that repeat an id, and those without one, are separate rows, ordered by
    size. No row of a hot source meets all others: offsets come from sums over
    buckets (prefix_sums).
    """
    return _mixed(written(_sized(docs, seed, id_col, text_col, source_col), "mix-rows"), shards, per_shard, seed, limit)


def _sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, *keep) -> DataFrame:
    return docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(source_col)).alias("source"), source_key(source_col).alias("stratum"), word_count(text_of(text_col)).alias("size"), seeded_key(seed, F.col(quoted(id_col))).alias("key"), *keep)


def _mixed(rows: DataFrame, shards: int, per_shard: int, seed: int, limit: int, keep: tuple[str, ...] = ()) -> DataFrame:
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = block_size(total, shards, per_shard)
    mark = table_mark()
    targets = written(source_targets(rows.groupBy("stratum").agg(F.sum("size").alias("source_size")), limit=limit), "mix-targets", files=8)
    plan = written(block_plan(targets, block_quotas(targets, total, shards, per_shard, limit), block, seed), "mix-plan", files=1)
    drop_tables(rows.sparkSession, mark, (plan,))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    placed = prefix_sums(rows.withColumn("bucket", key_bucket("key", buckets_for(n))), ["stratum"], "bucket", ["key", "size", *keep], ["size"])
    covered = f"if(size = 0, array(), sequence(size_before div {block}L, (size_before + size - 1L) div {block}L))"
    # The words of the row, which begins at word size_before of its source, that lie in block b; its picks are those numbers under quota that leave its place over blocks.
    overlap = f"(least(size_before + size, (b + 1L) * {block}L) - greatest(size_before, b * {block}L))"
    place = "element_at(places, cast(b + 1 as int))"
    taken = f"aggregate({covered}, 0L, (sum, b) -> sum + {overlap} * (quota div blocks + if({place} < quota % blocks, 1L, 0L)))"
    picks = f"filter(sequence(0, {limit - 1}), r -> {place} + r * blocks < quota)"
    shard = f"filter(upto, u -> u.picks > {place} + r * blocks)[0].shard"
    takes = f"flatten(transform({covered}, b -> transform({picks}, r -> named_struct('shard', {shard}, 'words', {overlap}))))"
    return placed.join(plan, "stratum").select("doc_id", "source", "size", "source_size", "target", F.expr(taken).alias("taken"), F.expr(takes).alias("takes"), *keep)


def mixed_documents(docs: DataFrame, shards: int = 64, per_shard: int = 1024, seed: int = 23, limit: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix: each as often as the words taken of it, over its size, round to (half up).

    Columns stay as they are, whatever their names. Documents without a word
    stay out; an empty table gives none. Copies go back by a key written with
    the rows, so that rows without an id or with a repeated one each get their
    own; rows alike in all are separate rows.
    """
    keyed = written(docs.select(packed_row(docs), F.monotonically_increasing_id().alias("nth")), "mix-keyed")
    own = keyed.select(*[F.col(f"row.{quoted(c)}").alias(k) for c, k in ((id_col, "id"), (text_col, "text"), (source_col, "source"))], "nth")
    takes = _mixed(written(_sized(own, seed, "id", "text", "source", "nth"), "mix-rows"), shards, per_shard, seed, limit, ("nth",)).filter("size > 0")
    copies = takes.select("nth", F.expr("cast((2 * taken + size) div (2 * size) as int)").alias("copies")).filter("copies > 0")
    return keyed.join(copies, "nth").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*unpacked(docs.columns))
