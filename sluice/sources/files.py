"""Files as rows: duplicates by size and digest, and the dialect of CSV samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def duplicate_files(spark: SparkSession, path: str, partial: int = 65536) -> DataFrame:
    """``path, length, digest, copies``: files of equal size, then equal start, then equal whole content.

    Contents are only read of files that share their size with another.
    """
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sized = meta.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length")
    some = meta.join(F.broadcast(sized), "length", "left_semi").select("path", "length", F.sha2(F.substring("content", 1, partial), 256).alias("start"), F.sha2("content", 256).alias("digest"))
    groups = some.groupBy("length", "start", "digest").agg(F.count("*").alias("copies")).where("copies > 1")
    return some.join(groups, ["length", "start", "digest"]).select("path", "length", "digest", "copies")


def write_codecs(df: DataFrame, home: str, codecs: tuple[str, ...]) -> tuple[str, ...]:
    """The table as Parquet under each codec, in a folder of its name."""
    for codec in codecs:
        df.write.option("compression", codec).parquet(f"{home}/{codec}")
    return codecs


def codec_sizes(spark: SparkSession, home: str, codecs: tuple[str, ...]) -> DataFrame:
    """``codec, files, bytes, ratio`` of what ``write_codecs`` wrote, by the files' listing; the ratio is to the largest."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{home}/{c}" for c in codecs]).select("path", "length")
    codec = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    sizes = listed.groupBy(codec.alias("codec")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return sizes.join(F.broadcast(sizes.agg(F.max("bytes").alias("most")))).select("codec", "files", "bytes", (F.col("bytes") / F.col("most")).alias("ratio"))


def sniff_delimiter(lines: DataFrame, column: str = "value", delimiters: str = ",;\t|") -> DataFrame:
    """``delimiter, consistent, fields, verdict`` of sample lines; ambiguous where two fit as well.

    A delimiter fits as far as lines agree on how often it stands outside quotes.
    """
    bare = F.regexp_replace(F.col(column), r'"(?:[^"]|"")*"', "")
    counts = [F.struct(F.lit(d).alias("delimiter"), F.regexp_count(bare, F.lit(f"[{d}]")).alias("n")) for d in delimiters]
    each = lines.where(F.trim(column) != "").select(F.explode(F.array(*counts)).alias("c")).select("c.*").groupBy("delimiter", "n").agg(F.count("*").alias("lines"))
    total = each.groupBy("delimiter").agg(F.sum("lines").alias("all"), F.max_by(F.struct("n", "lines"), F.struct("lines", "n")).alias("m"))
    fit = total.select("delimiter", F.when(F.col("m.n") > 0, F.col("m.lines") / F.col("all")).otherwise(0.0).alias("consistent"), (F.col("m.n") + 1).alias("fields"))
    best = fit.agg(F.max("consistent").alias("top"))
    out = fit.join(F.broadcast(best)).where("consistent = top and consistent > 0")
    n = out.agg(F.count("*").alias("rivals"))
    return out.join(F.broadcast(n)).select("delimiter", F.round("consistent", 4).alias("consistent"), "fields", F.when(F.col("rivals") > 1, "ambiguous").otherwise("ok").alias("verdict"))
