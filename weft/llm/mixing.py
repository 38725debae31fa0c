"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import SPACE, row_key, written

#: Whole number of words in a block, of words for which a shard is made, and of times that a document may be taken.
BLOCK_WORDS, SHARD_WORDS, MAX_EPOCHS = 64, 1 << 22, 3


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    parts = F.split(text, SPACE)
    edges = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.coalesce(F.size(parts) - edges, F.lit(0)).cast("long")


def apportion(votes: DataFrame, group: list[str], vote: str, seats: str, order: list[Column], out: str) -> DataFrame:
    """Sainte-Lague: adds `out`, the seats of each row; in a group the highest quotients vote / (2k + 1) take its `seats`.

    The divisor lies between V / (S + n/2) and V / (S - n/2); seats that the larger one gives are sure, and only the quotients
    between the two (at most about 2n rows a group) are ranked. Ties: by `order`. Rows with vote 0 get none.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    keys = [c for c in votes.columns]
    bounds = (
        votes.filter(F.col(vote) > 0)
        .withColumn("_w_v", F.sum(vote).over(w))
        .withColumn("_w_n", F.count(F.lit(1)).over(w))
        .withColumn("_w_low", F.when(F.col(seats) > F.col("_w_n") / 2, F.greatest(F.lit(0), F.floor(F.col(vote) * (F.col(seats) - F.col("_w_n") / 2) / F.col("_w_v") + 0.5) - 1)).otherwise(0).cast("long"))
        .withColumn("_w_high", (F.floor(F.col(vote) * (F.col(seats) + F.col("_w_n") / 2) / F.col("_w_v") + 0.5) + 1).cast("long"))
    )
    tried = bounds.withColumn("_w_sure", F.sum("_w_low").over(w)).withColumn("_w_k", F.explode(F.expr("sequence(_w_low, _w_high)")))
    ranked = tried.withColumn("_w_rank", F.row_number().over(w.orderBy(F.desc(F.col(vote) / (2 * F.col("_w_k") + 1)), *order, "_w_k")))
    return ranked.groupBy(*keys).agg((F.first("_w_low") + F.sum(F.when(F.col("_w_rank") <= F.col(seats) - F.col("_w_sure"), 1).otherwise(0))).cast("long").alias(out))


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds `target` to (source, source_size): weights 1, 2, 3, 1, ... by code point, null last, share all words.

    A target stops at max_epochs times its source's size; the rest is shared again by weight until none is above. In order of
    size / weight the sources that stop come first, so running sums find where they end. One row for each source goes
    through one window; documents never do.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("_w_weight", (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    ranked = ranked.withColumn("_w_cap", F.col("source_size") * max_epochs).withColumn("_w_total", F.sum("source_size").over(every))
    before = every.orderBy(F.col("_w_cap") / F.col("_w_weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("_w_weights", F.sum("_w_weight").over(every))
        .withColumn("_w_level", (F.col("_w_total") - F.coalesce(F.sum("_w_cap").over(before), F.lit(0))) / (F.col("_w_weights") - F.coalesce(F.sum("_w_weight").over(before), F.lit(0))))
        .withColumn("_w_open", F.col("_w_level") * F.col("_w_weight") < F.col("_w_cap"))
        .withColumn("_w_final", F.min(F.when(F.col("_w_open"), F.struct(F.col("_w_cap") / F.col("_w_weight"), F.col("_w_level").alias("level")))).over(every))
    )
    target = F.when(F.col("_w_open"), F.col("_w_final.level") * F.col("_w_weight")).otherwise(F.col("_w_cap").cast("double"))
    return ranked.select("source", "source_size", "_w_total", target.cast("double").alias("target"))


def mix(documents: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(id, size, source_size, target, taken) for each row of documents: how many of its words the mix takes, repeats counted.

    All words are dealt as blocks of `block_words`: Sainte-Lague apportionment gives each source its number of blocks (votes:
    its target), and again each shard its part of the source's (votes: the source's words in the shard; shards are seeded
    hashes of the document, about `shard_words` words each, so that no source meets in one task). What a source's whole blocks
    leave over of its target, or exceed it by, is a part block of its largest shard, so a source of any size gets its target. A shard takes its words as
    often as its blocks fill them, and for the rest blocks in a seeded order, the last one in part. No row is taken more than
    max_epochs times its size. Null and empty texts have size 0 and nothing taken; a null source is a source of its own, the
    last; a null id is an id like others; repeated rows count as often as they occur. Reruns give the same.
    """
    return drawn(documents, id_column, text, source, seed, block_words, shard_words, max_epochs).select(id_column, "size", "source_size", "target", "taken")


def drawn(documents: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """What `mix` returns, and `ranges`: the words (first, end) of each row that are taken once more, in order, null for none; k1 and k2, a hash of its id and text (`row_key`); its source."""
    rows = documents.select(F.col(id_column).alias("_w_id"), *row_key(F.col(id_column), F.col(text)), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit("\0")), F.coalesce(F.col(text), F.lit("\0"))).alias("_w_hash"))
    rows = written(rows)
    shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // shard_words))
    rows = rows.withColumn("_w_shard", F.pmod(F.col("_w_hash"), F.lit(shards)))
    parts = rows.groupBy("source", "_w_shard").agg(F.sum("size").alias("_w_words"))
    parts = written(parts)
    goals = targets(parts.groupBy("source").agg(F.sum("_w_words").alias("source_size")), max_epochs)
    goals = goals.withColumn("_w_blocks", F.round(F.col("_w_total") / block_words).cast("long"))
    quotas = apportion(goals, [], "target", "_w_blocks", [F.col("source").asc_nulls_last()], "_w_quota")
    goals = written(goals.select(F.col("source").alias("_w_source"), "source_size", "target").join(quotas.select("source", "_w_quota"), F.expr("_w_source <=> source"), "left").select(F.col("_w_source").alias("source"), "source_size", "target", F.coalesce("_w_quota", F.lit(0)).alias("_w_quota")))
    shares = parts.join(goals.withColumnRenamed("source", "_w_s"), F.expr("source <=> _w_s")).select("source", "_w_shard", "_w_words", "_w_quota", (F.round("target").cast("long") - F.col("_w_quota") * block_words).alias("_w_over"))
    dealt = apportion(shares, ["source"], "_w_words", "_w_quota", [F.col("_w_shard").asc()], "_w_taken")
    most = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("_w_words"), "_w_shard"))
    goal = F.col("_w_taken") * block_words + F.when(most == 1, F.col("_w_over")).otherwise(0)
    dealt = dealt.select("source", "_w_shard", "_w_words", F.least(F.greatest(goal, F.lit(0)), F.col("_w_words") * max_epochs).alias("_w_goal"))
    dealt = written(dealt.withColumn("_w_epochs", F.floor(F.col("_w_goal") / F.col("_w_words"))).withColumn("_w_rest", F.col("_w_goal") - F.col("_w_epochs") * F.col("_w_words")))
    # the rest of a shard: its blocks in seeded order until it is filled
    here = Window.partitionBy("source", "_w_shard")
    blocks = dealt.filter("_w_rest > 0").select("source", "_w_shard", "_w_rest", "_w_words", F.explode(F.expr(f"sequence(0L, (_w_words - 1) div {block_words})")).alias("_w_block"))
    blocks = blocks.withColumn("_w_long", F.least(F.lit(block_words), F.col("_w_words") - F.col("_w_block") * block_words))
    until = here.orderBy(F.xxhash64(F.lit(seed), "_w_shard", "source", "_w_block"), "_w_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_w_part", F.least("_w_long", F.col("_w_rest") - F.coalesce(F.sum("_w_long").over(until), F.lit(0)))).filter("_w_part > 0").select(F.col("source").alias("_w_s"), F.col("_w_shard").alias("_w_h"), "_w_block", "_w_part")
    # each document's words as a range of its shard's; equal rows are told apart by their number
    placed = rows.filter("size > 0").withColumn("_w_start", F.sum("size").over(here.orderBy("_w_hash", "_w_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = written(placed.withColumn("_w_row", F.row_number().over(here.orderBy("_w_hash", "_w_id"))))
    covered = placed.select("source", "_w_shard", "_w_row", "_w_start", "size", F.explode(F.expr(f"sequence(_w_start div {block_words}, (_w_start + size - 1) div {block_words})")).alias("_w_b"))
    # blocks grow with the words, which their estimated size doesn't show: never broadcast
    met = covered.join(blocks.hint("merge"), F.expr("source <=> _w_s and _w_shard = _w_h and _w_b = _w_block"))
    first, end = F.greatest(F.col("_w_start"), F.col("_w_block") * block_words), F.least(F.col("_w_start") + F.col("size"), F.col("_w_block") * block_words + F.col("_w_part"))
    span = F.when(end > first, F.struct((first - F.col("_w_start")).alias("first"), (end - F.col("_w_start")).alias("end")))
    some = met.groupBy("source", "_w_shard", "_w_row").agg(F.sum(F.greatest(F.lit(0), end - first)).alias("_w_some"), F.sort_array(F.collect_list(span)).alias("ranges"))
    some = some.select(F.col("source").alias("_w_s"), F.col("_w_shard").alias("_w_h"), F.col("_w_row").alias("_w_r"), "_w_some", "ranges")
    epochs = dealt.select(F.col("source").alias("_w_s2"), F.col("_w_shard").alias("_w_h2"), "_w_epochs")
    empty = rows.filter("size = 0").select("_w_id", "k1", "k2", "source", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast(some.schema["ranges"].dataType).alias("ranges"))
    full = placed.join(some, F.expr("source <=> _w_s and _w_shard = _w_h and _w_row = _w_r"), "left").join(epochs, F.expr("source <=> _w_s2 and _w_shard = _w_h2"), "left")
    full = full.select("_w_id", "k1", "k2", "source", "size", (F.coalesce("_w_epochs", F.lit(0)) * F.col("size") + F.coalesce("_w_some", F.lit(0))).cast("long").alias("taken"), "ranges")
    sizes = goals.select(F.col("source").alias("_w_s3"), "source_size", "target")
    return full.union(empty).join(sizes, F.expr("source <=> _w_s3"), "left").select(F.col("_w_id").alias(id_column), "size", "source_size", "target", "taken", "ranges", "k1", "k2", "source")
