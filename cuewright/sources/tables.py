"""Symbol tables, job queues and media lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Codec names by container codec.
CODECS = {"MPEG1VIDEO": "MPEG1", "MPEG2VIDEO": "MPEG2", "MPEG4": "MPEG4", "VC1": "VC1", "H264": "H264", "HEVC": "HEVC", "VP8": "VP8", "VP9": "VP9", "MJPEG": "JPEG"}


def codec(name: Column) -> Column:
    out = F
    for k, v in CODECS.items():
        out = out.when(F.upper(name) == k, F.lit(v))
    return out.otherwise(F.lit("none"))


def alphabet(spark: SparkSession, path: str) -> DataFrame:
    """(idx, ch) of a text file's characters, line ends included; 0 is the blank."""
    chars = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "")).alias("i", "ch")).where("ch <> ''")
    return spark.createDataFrame([(0, "\0")], "idx int, ch string").union(chars.select((F.col("i") + 1).cast("int"), "ch"))


def bigrams(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, p) of lines "pair probability"; fails on a pair of other length."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), "\\s+").alias("v"))
    good = rows.select(F.when(F.length(F.get("v", F.lit(0))) == 2, F.col("v")).otherwise(F.raise_error(F.lit("a pair needs two characters"))).alias("v"))
    return good.select(F.substring(F.get("v", F.lit(0)), 1, 1).alias("a"), F.substring(F.get("v", F.lit(0)), 2, 1).alias("b"), F.get("v", F.lit(1)).cast("double").alias("p"))


def latest_status(updates: DataFrame, job: str, at: str) -> DataFrame:
    """The last row of each job."""
    w = Window.partitionBy(job).orderBy(F.desc(at))
    return updates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def poll(jobs: DataFrame, order: str, limit: int = 20) -> DataFrame:
    """The next jobs, ``limit`` at most."""
    return jobs.orderBy(order).limit(limit)


def resolution(streams: DataFrame, video: str) -> DataFrame:
    """(video, pos, quality, url): the last stream of 360 lines, else the first."""
    low = F.split("quality", "p")[0] == "360"
    return streams.groupBy(video).agg(F.coalesce(F.max_by(F.when(low, F.col("url")), F.when(low, F.col("pos"))), F.min_by("url", "pos")).alias("url"))


def container(name: Column) -> Column:
    """How the parts of a download are joined, by the end of their name; other
    ends are an error that isn't tried again."""
    end = F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return F.when(end.isin("flv", "f4v"), "flv").when(end.isin("mp4", "m4v"), "mp4").otherwise("none")


def upserted(jobs: DataFrame, updates: DataFrame, job: str, at: str) -> DataFrame:
    """Jobs with the latest of their rows and updates, by ``at``."""
    return latest_status(jobs.unionByName(updates), job, at)


def requeued(jobs: DataFrame, worker: str, at: Column, status: str = "Queuing") -> DataFrame:
    """Updates that give back what ``worker`` has reserved and not ended."""
    held = jobs.where((F.col("worker_id") == worker) & ~F.col("status").isin("Done", "Error", status))
    return held.withColumns({"status": F.lit(status), "worker_id": F.lit(None).cast("string"), "at": at})
