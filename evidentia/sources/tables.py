"""Scans: the tables by name, and documents as lines, pages and validated byte sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes an uploaded document must and may have, and how it must begin ("%PDF-"). Fixed values.
MIN_BYTES, MAX_BYTES, MAGIC = 64, 50 * 1024 * 1024, "255044462D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; event times without a zone become timestamps in the session's zone, as watermarks need them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def read(spark: SparkSession, kind: str, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """Any format Spark reads (parquet, orc, csv, json, text, avro where its jar is there, jdbc); a schema avoids inference passes."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, content, length of files, with `rejected`: why a file is no acceptable document, or null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content", "length").withColumn("rejected", byte_verdict("content"))


def byte_verdict(content: str) -> Column:
    """null for bytes that can be a document, else too_small, too_large or no_magic; what a server says of the type is never trusted."""
    n = F.octet_length(content)
    return (
        F.when(F.col(content).isNull(), "missing")
        .when(n < MIN_BYTES, "too_small")
        .when(n > MAX_BYTES, "too_large")
        .when(F.hex(F.substring(content, 1, 5)) != MAGIC, "no_magic")
    )


def content_reference(files: DataFrame, name: str, content: str) -> DataFrame:
    """Finalised references: sanitised file name, SHA-256, length."""
    from ..functions.text import file_name

    return files.withColumns({"file_name": file_name(F.col(name)), "sha256": F.sha2(content, 256), "byte_length": F.octet_length(content)})


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no from 0, line, start and end (characters of the text, end exclusive)."""
    rows = docs.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("parts"))
    # the start of line i: lengths of the lines before it and their line ends, within the row: no shuffle, no window
    sizes = F.transform("parts", lambda p: F.length(p))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n + 1)))
    rows = rows.withColumn("starts", F.when(F.size("parts") <= 64, starts))
    few = rows.where("starts is not null").select(key, F.posexplode(F.arrays_zip("parts", F.slice("starts", 1, F.size("parts")).alias("starts"))).alias("line_no", "z"))
    few = few.select(key, "line_no", F.col("z.parts").alias("line"), F.col("z.starts").cast("long").alias("start"))
    # long texts: running sums by window, so that no row holds an array that is built up quadratically
    from pyspark.sql import Window

    many = rows.where("starts is null").withColumn("_row", F.monotonically_increasing_id()).select(key, "_row", F.posexplode("parts").alias("line_no", "line"))
    before = Window.partitionBy("_row").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    many = many.select(key, "line_no", "line", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long").alias("start"))
    return few.unionByName(many).withColumn("end", F.col("start") + F.length("line"))


def pages(docs: DataFrame, lines_a_page: int = 12, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, page from 1, page_text: groups of lines, cut within the row."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    count = F.ceil(F.size("parts") / lines_a_page).cast("int")
    page = F.transform(F.sequence(F.lit(1), count), lambda p: F.array_join(F.slice("parts", (p - 1) * lines_a_page + 1, lines_a_page), "\n"))
    return docs.select(key, parts.alias("parts")).select(key, F.posexplode(page).alias("p", "page_text")).select(key, (F.col("p") + 1).alias("page"), "page_text")
