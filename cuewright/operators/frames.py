"""Frame operators: micro-batches, change against the frame before, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.pixels import abs_difference

BATCH = 256


def batch_of(frame_id: Column, size: int = BATCH) -> Column:
    return F.floor(frame_id / size).cast("long")


def differences(frames: DataFrame) -> DataFrame:
    """(video_id, batch_id, frame_id, px) with sad against the frame before in
    its batch; null for the first of a batch."""
    w = Window.partitionBy("video_id", "batch_id").orderBy("frame_id")
    return frames.select("*", F.lag("px").over(w).alias("__before")).withColumn("sad", F.when(F.col("__before").isNotNull(), abs_difference(F.col("px"), F.col("__before")))).drop("__before")


def changed(frames: DataFrame, threshold: int) -> DataFrame:
    """Frames that differ by ``threshold`` or more, and the first of each batch."""
    return differences(frames).where(F.col("sad").isNull() | (F.col("sad") >= threshold))


def score_mask(text: Column, link: Column, low_text: float = 0.5, link_threshold: float = 0.1) -> Column:
    """255 where text or link passes its threshold, else 0."""
    f = lambda x: F.lit(x).cast("float")
    return F.zip_with(text, link, lambda t, k: F.when((t > f(low_text)) | (k > f(link_threshold)), 255).otherwise(0))


def emitted(frames: DataFrame) -> DataFrame:
    """(video_id, batch_id, frame_id, n_regions, n_dirty): the first of a batch,
    those whose number of regions changed, and those with a dirty region."""
    w = Window.partitionBy("video_id", "batch_id").orderBy("frame_id")
    before = F.lag("n_regions").over(w)
    return frames.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__b") != F.col("n_regions")) | (F.col("n_dirty") > 0)).drop("__b")


def with_empty_batches(events: DataFrame, frames: DataFrame, time_ms: Column, emit: bool = False) -> DataFrame:
    """(video_id, time_ms, texts) of events (video_id, batch_id, time_ms, texts) of
    batches with regions. A batch without any says nothing, so the texts before it
    stay; with ``emit`` it ends them by an event without texts at its first frame's
    time. ``frames``: (video_id, batch_id, frame_id) of all frames, ``time_ms`` of
    frame_id. Null videos are a video."""
    own = events.select("video_id", "time_ms", "texts")
    if not emit:
        return own
    spine = frames.groupBy("video_id", "batch_id").agg(F.min("frame_id").alias("frame_id"))
    told = events.select(F.col("video_id").alias("v"), F.col("batch_id").alias("b")).distinct()
    silent = spine.join(told, spine.video_id.eqNullSafe(told.v) & (spine.batch_id == told.b), "left_anti")
    return own.unionByName(silent.select("video_id", time_ms.cast("long").alias("time_ms"), F.array().cast("array<string>").alias("texts")))


def padded(rows: DataFrame, key: list[str], order: list[str], size: int) -> DataFrame:
    """Slots of batches of ``size``: rows compacted in order, and null rows that
    fill the last batch of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    placed = rows.withColumn("slot", (F.row_number().over(w) - 1).cast("long"))
    need = placed.groupBy(*key).agg(F.count("*").alias("n"))
    fill = need.where(F.col("n") % size != 0).select(*key, F.explode(F.sequence(F.col("n"), F.ceil(F.col("n") / size) * size - 1)).alias("slot"))
    return placed.unionByName(fill, allowMissingColumns=True).withColumn("batch", F.floor(F.col("slot") / size))


def one_geometry(frames: DataFrame, video: list[str], order: str, columns: tuple[str, ...] = ("width", "height")) -> DataFrame:
    """The frames; a change of ``columns`` within a video ends the query."""
    w = Window.partitionBy(*video).orderBy(order)
    same = F.lit(True)
    for c in columns:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    good = F.when(F.row_number().over(w) == 1, True).when(same, True).otherwise(F.raise_error(F.lit("frames of a video change their geometry")).cast("boolean"))
    return frames.withColumn("__good", good).where("__good").drop("__good")
