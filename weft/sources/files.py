"""Readers of the raw file formats: delimited tables, GTF, GCT, GMT, XML, JSON, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.normalize import gtf_attributes, not_blank
from weft.sources import archives
from weft.sources.lines import numbered


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def first_present(df: DataFrame, candidates: list[str]) -> Column:
    """The first of the candidate columns that the table has; null if none."""
    for c in candidates:
        if c in df.columns:
            return F.col(f"`{c}`")
    return F.lit(None).cast("string")


def tsv(spark: SparkSession, path: str, columns: list[str] | None = None, names: list[str] | None = None, sep: str = "\t", comment: str | None = None, idx: bool = False) -> DataFrame:
    """A delimited file, all strings; `names` for one without a header, `columns` are required and the only ones read; `idx`: also each row's place in the file."""
    reader = spark.read.option("sep", sep).option("inferSchema", False).option("quote", "\u0000" if sep == "\t" else '"')
    if comment:
        reader = reader.option("comment", comment)
    df = reader.schema(", ".join(f"`{n}` string" for n in names)).csv(path) if names else reader.option("header", True).csv(path)
    wanted = [f"`{c}`" for c in columns or df.columns]
    df = require_columns(df, columns or [])
    return numbered(df, wanted) if idx else df.select(*wanted)


def gtf(spark: SparkSession, path: str, feature: str = "transcript", idx: bool = False) -> DataFrame:
    """Rows of one feature: (seqname, start, end, strand, attributes as a map), with `idx` also the line's place in the file. Lines without nine
    fields or with unreadable places are left out. A gzip file is one split."""
    read = spark.read.text(path)
    lines = numbered(read) if idx else read
    f = F.split("value", "\t")
    lines = lines.filter(~F.col("value").startswith("#") & (F.size(f) == 9) & (F.get(f, 2) == feature))
    rows = lines.select(F.get(f, 0).alias("seqname"), F.get(f, 3).try_cast("int").alias("start"), F.get(f, 4).try_cast("int").alias("end"), F.get(f, 6).alias("strand"), gtf_attributes(F.get(f, 8)).alias("attributes"), *(["idx"] if idx else []))
    return rows.filter("start is not null and end is not null")


def gct(spark: SparkSession, path: str, columns: list[str], idx: bool = False) -> DataFrame:
    """A GCT matrix: two lines before the header are skipped; the named columns as numbers, the first column as it is; `idx`: also the line's place in the file."""
    read = spark.read.text(path)
    header = read.filter(F.col("value").startswith("Name\t")).first()
    if header is None:
        raise ValueError("no header line")
    names = header[0].split("\t")
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"missing columns {missing}; found {names}")
    f = F.split("value", "\t")
    rows = (numbered(read) if idx else read).filter((F.size(f) == len(names)) & ~F.col("value").startswith("Name\t"))
    return rows.select(f[0].alias("Name"), *[f[names.index(c)].try_cast("double").alias(c) for c in columns], *(["idx"] if idx else []))


def gmt(spark: SparkSession, path: str) -> DataFrame:
    """Gene sets with any number of members as (line order, set_name, gene)."""
    f = F.split("value", "\t")
    rows = numbered(spark.read.text(path), out="line").select("line", f[0].alias("set_name"), F.slice(f, F.lit(3), F.greatest(F.lit(0), F.size(f) - 2)).alias("genes"))
    return rows.select("line", "set_name", F.explode("genes").alias("gene")).filter(not_blank(F.col("gene")).isNotNull())


def long_matrix(df: DataFrame, key: str, out: str = "sample", value: str = "value") -> DataFrame:
    """A wide matrix as (key, sample, value)."""
    return df.unpivot([key], [c for c in df.columns if c != key], out, value).withColumn(value, F.col(value).try_cast("double"))


def xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def json_rows(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def projected(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Several Parquet folders as one table, only the named columns."""
    return require_columns(spark.read.parquet(*paths), columns).select(*columns)


def zipped_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """TSV members of ZIP archives, all strings; each member is a task, its rows stream out in chunks. Archives that are web pages are refused."""
    return archives.table(spark, path, columns)


def publications(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, abstract) of publication records in XML; the parts of an abstract joined, missing ones empty."""
    schema = "MedlineCitation struct<PMID string, Article struct<ArticleTitle string, Abstract struct<AbstractText array<string>>>>"
    a = xml(spark, path, "PubmedArticle", schema).select("MedlineCitation.PMID", "MedlineCitation.Article.*")
    return a.select(F.col("PMID").alias("pmid"), F.coalesce("ArticleTitle", F.lit("")).alias("title"), F.array_join(F.coalesce(F.col("Abstract.AbstractText"), F.array().cast("array<string>")), " ").alias("abstract")).filter("pmid is not null")


def labelled(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities (surface, id, kind, canonical) and gold triples (pmid, text, edge_type, subject_id, object_id, polarity; one row without a triple for a case that has none) of a labelled corpus."""
    schema = "entities array<struct<surface string, id string, kind string, canonical string>>, cases array<struct<pmid string, text string, gold array<struct<edge_type string, subject_id string, object_id string, polarity string>>>>"
    whole = json_rows(spark, path, schema, multi_line=True)
    cases = whole.select(F.explode("cases").alias("c")).select("c.pmid", "c.text", F.explode_outer("c.gold").alias("g"))
    return whole.select(F.explode("entities").alias("e")).select("e.*"), cases.select("pmid", "text", "g.*")


def newest(spark: SparkSession, pattern: str) -> str:
    """The path that a glob finds with the last name, in any store that Spark can read."""
    found = spark.read.format("binaryFile").load(pattern).select("path").agg(F.max_by("path", F.element_at(F.split("path", "/"), -1))).first()[0]
    if found is None:
        raise ValueError(f"no file like {pattern}")
    return found


def delimited(spark: SparkSession, pattern: str, columns: list[str]) -> DataFrame:
    """The newest file that a glob finds, all strings: a tar archive's delimited members (each a task, rows stream out in chunks), a tab- or comma-separated file, compressed or not. Web pages are refused."""
    path = newest(spark, pattern)
    if not path.endswith((".tar", ".tar.gz", ".tgz")):
        first = spark.read.text(path).limit(1).collect()
        if first and first[0][0].lstrip().lower().startswith(("<!doctype", "<html")):
            raise ValueError("a web page instead of a table")
        return tsv(spark, path, columns, sep="," if path.removesuffix(".gz").endswith(".csv") else "\t")

    return archives.table(spark, path, columns)
