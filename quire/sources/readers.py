"""Sources and sinks: delimited files, ragged directories, XML snapshots, prefetched JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import clean_text

CONFERENCE_PAPERS = ["id", "author", "booktitle", "crossref", "key", "pages", "title", "url", "ee", "year"]
ARTICLES = ["id", "author", "journal", "volume", "number", "key", "pages", "title", "url", "ee", "year", "publisher"]
RANKS = ["id", "title", "acronym", "source", "rank", "dblp", "primaryfor"]


def strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def delimited(spark: SparkSession, path: str, sep: str = ";", columns: list[str] | None = None) -> DataFrame:
    """A delimited file with a header, by name: all strings, header blanks trimmed, bad UTF-8 replaced.

    ``columns`` picks and orders; those that the file lacks are null.
    """
    df = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    df = df.toDF(*[c.strip() for c in df.columns])
    if columns:
        have = {c.lower(): c for c in df.columns}
        df = df.select(*[F.col(f"`{have[c.lower()]}`").alias(c) if c.lower() in have else F.lit(None).cast("string").alias(c) for c in columns])
    return df


def conference_papers(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, ";", CONFERENCE_PAPERS)


def articles(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, ";", ARTICLES)


def stripped(df: DataFrame) -> DataFrame:
    return df.select(*[clean_text(F.col(c)).alias(c) for c in df.columns])


def optional(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """A delimited file, or no rows if it is missing or only the pointer to a large file."""
    try:
        first = spark.read.text(path).limit(1).collect()
    except Exception as error:  # Spark says so by path
        if "PATH_NOT_FOUND" not in str(error):
            raise
        first = []
    if not first or first[0][0].startswith("version https://git-lfs"):
        return spark.createDataFrame([], strings(columns))
    return delimited(spark, path, sep, columns)


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated if there is a tab in the first line, else comma-separated."""
    first = spark.read.text(path).limit(1).collect()
    return delimited(spark, path, "\t" if first and "\t" in first[0][0] else ",")


def ragged_ranks(spark: SparkSession, directory: str) -> DataFrame:
    """Raw rank files of a directory: header optional, rows of any length; what follows the seventh cell are more fields of research.

    Adds file and line_no, the place in the file.
    """
    lines = spark.read.text(directory).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_id"), "value").filter("trim(value) != ''")
    cells = F.transform(F.split(F.regexp_replace("value", r',(?=(?:[^"]*"[^"]*")*[^"]*$)', "\u0001"), "\u0001"), lambda c: F.trim(F.btrim(F.trim(c), F.lit('"'))))
    df = lines.withColumn("c", cells).filter(~((F.lower(F.get("c", 0)) == "id") & (F.lower(F.get("c", 1)) == "title")))
    named = [F.nullif(F.get("c", k), F.lit("")).alias(n) for k, n in enumerate(RANKS)]
    more = F.filter(F.slice("c", 7, F.greatest(F.size("c") - 6, F.lit(0))), lambda x: x != "").alias("for_codes")
    from pyspark.sql import Window

    return df.select("file", F.row_number().over(Window.partitionBy("file").orderBy("_id")).alias("line_no"), *named, more)


def xml_snapshot(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Records of one tag (article, inproceedings, proceedings) of a plain or gzipped snapshot."""
    fields = ["journal", "booktitle", "title", "crossref", "url"]
    schema = T.StructType([T.StructField("_key", T.StringType())] + [T.StructField(f, T.StringType()) for f in fields])
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumnRenamed("_key", "key")


_SOURCES = {
    "venue": ("struct<result:struct<hits:struct<hit:array<struct<info:struct<venue:string,acronym:string,url:string>>>>>>", "result.hits.hit", ["info.venue", "info.acronym", "info.url"]),
    "source": ("struct<results:array<struct<id:string,display_name:string,issn:array<string>,issn_l:string>>>", "results", ["display_name", "issn", "issn_l"]),
    "container": ("struct<message:struct<items:array<struct<title:string,ISSN:array<string>>>>>", "message.items", ["title", "ISSN"]),
}


def payload_candidates(payloads: DataFrame, shape: str) -> DataFrame:
    """Candidates in prefetched JSON answers (name, payload) of one of three services; bad JSON has none."""
    schema, at, fields = _SOURCES[shape]
    parsed = payloads.select("name", F.from_json("payload", schema).alias("j"))
    return parsed.select("name", F.explode(f"j.{at}").alias("x")).select("name", *[F.col(f"x.{f}").alias(f.split(".")[-1].lower()) for f in fields])


def pick_source(files: list[str], token: str, exact: str) -> str | None:
    """The best of some file names: the exact one, else with the token, else the shortest."""
    named = [f for f in files if re.search(r"(^|/)input_[^/]*\.csv$", f)]
    key = lambda f: (-(100 * (f.rsplit("/", 1)[-1] == exact) + 10 * (token in f.rsplit("/", 1)[-1])), len(f.rsplit("/", 1)[-1]), f)
    return min(named, key=key, default=None)


def write_delimited(df: DataFrame, path: str, columns: list[str], sep: str = ",") -> None:
    """A file with a fixed header; arrays are joined by bars."""
    cell = lambda c: F.array_join(c, " | ").alias(c) if df.schema[c].dataType.typeName() == "array" else F.col(c)
    df.select(*[cell(c) for c in columns]).write.mode("overwrite").csv(path, header=True, sep=sep)


def write_json(df: DataFrame, path: str) -> None:
    """One object per row, keys in order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def bundle(profile: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Profile and its rows as one JSON answer per key."""
    nested = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != key]))).alias("yearly_stats"))
    body: Column = F.to_json(F.struct(F.struct(*profile.columns).alias("profile"), F.coalesce("yearly_stats", F.array()).alias("yearly_stats")))
    return profile.join(nested, key, "left").select(key, body.alias("answer"))


def markdown(title: str, metrics: DataFrame) -> str:
    """A report of a small frame of metrics."""
    head = f"# {title}\n\n| " + " | ".join(metrics.columns) + " |\n|" + "---|" * len(metrics.columns) + "\n"
    return head + "".join("| " + " | ".join(str(v) for v in row) + " |\n" for row in metrics.collect())
