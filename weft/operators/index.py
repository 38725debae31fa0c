"""A stored inverted index: postings sorted by token, read by token ranges, with merges of changed nodes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.search import tokens

#: The field of whole symbols, whose tokens are upper-cased behind a mark that no word begins with.
SYMBOL, MARK = "=symbol", "="
MANIFEST = "generation long, base boolean, path string"
#: Replaced keys up to this number go to every task.
BROADCAST_ROWS = 1 << 20
#: Fields of nodes, or postings, whose words a task sorts: the more there are, the more tasks, so none grows with the index.
PART = 1 << 17


def postings(nodes: DataFrame, key: str, fields: list[str], symbol: str | None) -> DataFrame:
    """(token, key, field, tf) of the words of all fields, one by one, and each node's whole symbol as one token."""
    words = tokens(nodes, key, fields).select("token", "key", "field", F.lit(1).cast("long").alias("tf"))
    if symbol is None:
        return words
    whole = nodes.filter(F.col(symbol).isNotNull()).select(F.concat(F.lit(MARK), F.upper(symbol)).alias("token"), F.col(key).alias("key"), F.lit(SYMBOL).alias("field"), F.lit(1).cast("long").alias("tf"))
    return words.unionByName(whole)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def segments(spark: SparkSession, path: str) -> list[tuple[int, bool, str]]:
    """The segments that count, oldest first: the last base and what was merged since. A segment counts once its row is written."""
    if not _there(spark, f"{path}/manifest"):
        return []
    rows = sorted((r["generation"], r["base"], r["path"]) for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect())
    last = max(i for i, r in enumerate(rows) if r[1])
    return rows[last:]


def _add(spark: SparkSession, path: str, rows: DataFrame, replaced: DataFrame | None, generation: int, base: bool, size: int) -> None:
    """Writes a segment. Ranges are of tokens and keys, since a word that all nodes have doesn't fit one task; they also are what a posting's rows are
    summed in, so nothing is grouped where nodes are read."""
    own = f"{path}/{generation:06d}-{uuid.uuid4().hex}"
    summed = rows.repartitionByRange(size // PART + 1, "token", "key").groupBy("token", "key", "field").agg(F.sum("tf").alias("tf"))
    summed.sortWithinPartitions("token", "key").write.parquet(f"{own}/postings")
    if replaced is not None:
        replaced.write.parquet(f"{own}/replaced")
    spark.createDataFrame([(generation, base, own)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def build(nodes: DataFrame, path: str, key: str, fields: list[str], symbol: str | None = None) -> None:
    """Writes the index of all nodes: range-partitioned and sorted by token, so that Parquet skips what a search doesn't ask for."""
    spark = nodes.sparkSession
    known = segments(spark, path)
    _add(spark, path, postings(nodes, key, fields, symbol), None, known[-1][0] + 1 if known else 0, True, nodes.count() * len(fields))


def merge(changed: DataFrame, path: str, key: str, fields: list[str], symbol: str | None = None, deleted: DataFrame | None = None) -> None:
    """Adds a segment with the postings of changed and new nodes; older ones of their keys, and of the keys in `deleted`, don't count any more. Nothing else is read or written."""
    spark = changed.sparkSession
    keys = changed.select(F.col(key).alias("key"))
    if deleted is not None:
        keys = keys.unionByName(deleted.select(F.col(key).alias("key")))
    _add(spark, path, postings(changed, key, fields, symbol), keys.distinct(), segments(spark, path)[-1][0] + 1, False, changed.count() * len(fields))


def load(spark: SparkSession, path: str) -> DataFrame:
    """(token, key, field, tf) as of now. Filters on tokens reach the scans of all segments."""
    rows, replaced = None, None
    for generation, base, own in segments(spark, path):
        one = spark.read.parquet(f"{own}/postings").withColumn("_g", F.lit(generation))
        rows = one if rows is None else rows.unionByName(one)
        if not base:
            gone = spark.read.parquet(f"{own}/replaced").select("key", F.lit(generation).alias("_r"))
            replaced = gone if replaced is None else replaced.unionByName(gone)
    if rows is None:
        raise ValueError(f"no index in {path}")
    if replaced is not None:
        last = replaced.groupBy("key").agg(F.max("_r").alias("_r"))
        few = F.broadcast(last) if replaced.count() <= BROADCAST_ROWS else last
        rows = rows.join(few, "key", "left").filter("_r is null or _g >= _r")
    return rows.select("token", "key", "field", "tf")


def compact(spark: SparkSession, path: str) -> None:
    """Writes all that counts as a new base; older segments are no longer read."""
    rows = load(spark, path)
    _add(spark, path, rows, None, segments(spark, path)[-1][0] + 1, True, rows.count())


def exact(index: DataFrame, text: str) -> DataFrame:
    """(key) of the nodes whose symbol is the whole text, case ignored."""
    return index.filter((F.col("token") == MARK + text.strip().upper()) & (F.col("field") == SYMBOL)).select("key")


def words(index: DataFrame) -> DataFrame:
    """The postings of words, without those of whole symbols."""
    return index.filter(F.col("field") != SYMBOL)
