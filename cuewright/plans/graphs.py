"""Queries of chains, components and batches without events, and their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cuewright.operators import frames, ranges, regions, tiles
from cuewright.plans.registry import BOXES, boxes, query, read

ONE = "f as (select dense_rank() over (order by l_orderkey) as seq, region_idx as r from (with " + BOXES + " select * from b)), l as (select *, case when lag(seq) over w = seq - 1 and (seq + r) % 97 <> 0 then 0 else 1 end as n from f window w as (partition by r order by seq)), t as (select *, sum(n) over (partition by r order by seq rows unbounded preceding) as k from l)"


@query("with " + ONE + " select seq, cast(r as int) as region_idx, first_value(seq) over (partition by r, k order by seq) as first_seq, cast(r as int) as first_region from t")
def long_track_chains(spark, sf):
    """Tracks of one video of all orders' boxes, up to 97 frames long."""
    rows = boxes(spark, sf).select("l_orderkey", F.col("region_idx").cast("int").alias("region_idx"))
    seen = rows.select("l_orderkey").distinct()
    placed = rows.join(numbered(seen), "l_orderkey").select(F.lit(0).alias("video_id"), "seq", "region_idx")
    later = placed.select((F.col("seq") - 1).alias("seq"), "region_idx")
    edges = placed.join(later, ["seq", "region_idx"]).where((F.col("seq") + 1 + F.col("region_idx")) % 97 != 0)
    found = regions.long_tracks(placed, edges.select("video_id", "seq", F.col("region_idx").alias("src"), F.col("region_idx").alias("dst")), ["video_id"])
    return found.drop("video_id")


def numbered(seen):
    """Orders with their number from 1, by ranges of them."""
    cut = ranges.cut(seen, [], ["l_orderkey"])
    return ranges.running(cut, [], ["l_orderkey"], "seq", F.lit(1)).select("l_orderkey", F.col("seq").cast("long").alias("seq"))


@query("""with recursive g as (select vec_id, unnest(embedding) as e, generate_subscripts(embedding, 1) - 1 as i from embeddings), c as (select vec_id, i, e from g where e > 0),
r(vec_id, i, j) as (select vec_id, i, i from c union select r.vec_id, r.i, c.i from r join c on r.vec_id = c.vec_id and ((abs(r.j - c.i) = 1 and r.j // 8 = c.i // 8) or abs(r.j - c.i) = 8)),
m as (select vec_id, i, min(j) as first from r group by 1, 2) select vec_id, first // 8 as y0, first % 8 as x0, count(*) as area, min(i % 8) as x, min(i // 8) as y, max(i % 8) - min(i % 8) + 1 as width, max(i // 8) - min(i // 8) + 1 as height, round(cast(max(e) as double), 6) as peak from m join c using (vec_id, i) group by 1, 2, 3, first""")
def tiled_components(spark, sf):
    """Components of 8 x 8 images in four tiles each."""

    def cut(batches):
        for batch in batches:
            out = []
            for vec_id, v in zip(batch["vec_id"], batch["embedding"], strict=True):
                image = np.asarray(v, "<f4").reshape(8, 8)
                for row in range(2):
                    for column in range(2):
                        own = np.ascontiguousarray(image[row * 4 : row * 4 + 4, column * 4 : column * 4 + 4])
                        out.append((vec_id, row, column, row * 4, column * 4, 4, 4, (own > 0).astype(np.uint8).tobytes(), own.tobytes()))
            yield pd.DataFrame(out, columns=["vec_id", "row", "column", "top", "left", "height", "width", "mask", "score"])

    images = read(spark, sf, "embeddings").select("vec_id", "embedding")
    found = tiles.components(images.mapInPandas(cut, "vec_id long, row int, column int, top int, left int, height int, width int, mask binary, score binary"), ["vec_id"])
    place = lambda c: F.col(c).cast("long").alias(c)
    return found.select("vec_id", F.shiftright("first", 32).alias("y0"), F.col("first").bitwiseAND(F.lit((1 << 32) - 1)).alias("x0"), "area", place("x"), place("y"), place("width"), place("height"), F.round("peak", 6).alias("peak"))


@query("with e as (select user_id as v, event_id // 256 as b, event_id, event_id % 977 = 0 as told from events), t as (select v, event_id * 40 as time_ms, 'told' as text, 'both' as setting from e where told), s as (select v, min(event_id) * 40 as time_ms from e group by v, b having not bool_or(told)) select v as video_id, time_ms, text, 'default' as setting from t union all select v, time_ms, text, 'emit' from t union all select v, time_ms, '', 'emit' from s")
def empty_batches(spark, sf):
    """Events of batches of which few have any, by either setting."""
    rows = read(spark, sf, "events").select(F.col("user_id").alias("video_id"), frames.batch_of(F.col("event_id")).alias("batch_id"), F.col("event_id").alias("frame_id"))
    events = rows.where("frame_id % 977 = 0").select("video_id", "batch_id", (F.col("frame_id") * 40).alias("time_ms"), F.array(F.lit("told")).alias("texts"))
    made = [frames.with_empty_batches(events, rows, F.col("frame_id") * 40, emit).withColumn("setting", F.lit(name)) for emit, name in ((False, "default"), (True, "emit"))]
    return made[0].unionByName(made[1]).select("video_id", "time_ms", F.array_join("texts", "\n").alias("text"), "setting")
