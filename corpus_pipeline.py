"""A corpus from raw documents to training sequences: rejects, near-duplicates, personal data, source weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.normalize import once
from weft.llm import minhash, mixing, packing, pii, quality
from weft.llm.common import having, lacking, row_key, written
from weft.tables import table


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _w_k1 and _w_k2, which tell rows apart by id and text."""
    return docs.select("*", *[k.alias(f"_w_{n}") for k, n in zip(row_key(F.col("doc_id"), F.col("text")), ("k1", "k2"), strict=True)])


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, each row judged by its own text, rows with a null id too."""
    given = _keyed(docs)
    scored = quality.score(given.select("doc_id", "text", "_w_k1", "_w_k2"), table(spark, sf_dir, "labels"), keep=("_w_k1", "_w_k2"))
    good = written(scored.filter("predicted = 1").select("_w_k1", "_w_k2").distinct())
    return having(given, good, "_w_k1", "_w_k2").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; of that id's rows one of each text. Rows with a null id
    link with nothing: one of each text stays. Of rows that differ in other columns only the first by these stays."""
    kept = minhash.near_duplicates(docs.select("doc_id", "text")).filter("kept and doc_id is not null").select("doc_id").distinct()
    given = docs.filter("doc_id is null").unionByName(having(docs, written(kept), "doc_id").select(*docs.columns))
    given = _keyed(given)
    often = written(given.groupBy("_w_k1", "_w_k2").agg(F.count(F.lit(1)).alias("_w_n")).filter("_w_n > 1").drop("_w_n"))
    others = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    first = F.row_number().over(Window.partitionBy("_w_k1", "_w_k2").orderBy(*[c.asc_nulls_last() for c in others], "_w_k1"))
    one = having(given, often, "_w_k1", "_w_k2").withColumn("_w_n", first).filter("_w_n = 1").drop("_w_n")
    return lacking(given, often, "_w_k1", "_w_k2").unionByName(one).select(*[F.col(f"`{c}`") for c in docs.columns])


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked; n_chars follows the text."""
    masked = pii.mask(docs)
    return masked.select(*[F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole repeats, and once more with the words that are taken in part.

    A part is the blocks that the mix has drawn, wherever they lie in the document; documents of which nothing is taken go. Rows are told apart by id and text; rows
    equal in both count one by one, in the order of their other columns.
    """
    taken = mixing.drawn(docs.select("doc_id", "text", "source"))
    taken = taken.withColumn("_w_n", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.col("source").asc_nulls_last(), "taken", "ranges"))).filter("taken > 0")
    taken = taken.select(F.col("k1").alias("_w_k1"), F.col("k2").alias("_w_k2"), "_w_n", F.col("size").alias("_w_size"), F.col("taken").alias("_w_taken"), F.col("ranges").alias("_w_ranges"))
    others = [F.col(f"`{c}`").cast("string").asc_nulls_last() for c in docs.columns if c not in ("doc_id", "text", "source")]
    given = _keyed(docs).withColumn("_w_n", F.row_number().over(Window.partitionBy("_w_k1", "_w_k2").orderBy(F.col("source").cast("string").asc_nulls_last(), *others)))
    met = given.join(taken, ["_w_k1", "_w_k2", "_w_n"])
    full, part = F.expr("_w_taken div _w_size"), F.expr("_w_taken % _w_size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), full.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    cut = met.withColumn("_w_words", F.explode(copies))
    words = F.split(F.regexp_replace("text", r"\A[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    slices = once(words, lambda split: F.flatten(F.transform("_w_ranges", lambda r: F.slice(split, (r["first"] + 1).cast("int"), (r["end"] - r["first"]).cast("int")))))
    cut = cut.withColumn("_w_text", F.when(F.col("_w_words") > 0, F.array_join(slices, "")).otherwise(F.col("text")))
    return cut.select(*[F.col("_w_text").alias("text") if c == "text" else F.length("_w_text").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences that all documents are packed into."""
    return packing.pack(docs)


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
