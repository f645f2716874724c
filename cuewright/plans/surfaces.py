"""Queries of decoded surfaces, a detector's input and models with weights, and their SQL."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from cuewright.functions import pixels as P
from cuewright.functions import text as T
from cuewright.operators import models, surfaces
from cuewright.plans.registry import BYTES, query, read
from cuewright.streaming import shared_path

NAMES = ("NV12", "P016", "YUV444", "YUV444P16")


def binary(values, deep):
    """Bytes of an array of samples: one each, or two, the lower first."""
    one = lambda x: F.lpad(F.hex(x), 2, "0")
    two = lambda x: F.concat(one(255 - x), one(x))
    return F.unhex(F.array_join(F.transform(values, lambda x: F.when(deep, two(x)).otherwise(one(x))), ""))


def bytes_of(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", P.from_unit).alias("b"))


@query("with " + BYTES + f""", s as (select vec_id, vec_id % 4 as l, i, b[i + 1] as y, case when vec_id % 4 < 2 then b[i // 16 * 8 + i % 8 // 2 * 2 + 1] else b[64 - i] end as u, case when vec_id % 4 < 2 then b[i // 16 * 8 + i % 8 // 2 * 2 + 2] else b[i * 7 % 64 + 1] end as v from y, range(64) t(i)),
w as (select vec_id, l, i, case when l % 2 = 1 then 4096 else 16 end as low, y * k.m + (255 - y) * k.o as y, u * k.m + (255 - u) * k.o as u, v * k.m + (255 - v) * k.o as v from s join (values (0, 1, 0), (1, 256, 1)) k(d, m, o) on k.d = l % 2),
f as (select vec_id, l, i, (y - low)::double as y, (u - low * 8)::double as u, (v - low * 8)::double as v, (low * 16 - 1)::double as most, case when l % 2 = 1 then 256 else 1 end as cut from w),
c as (select vec_id, l, i, unnest([0, 1, 2]) as k, most, cut, unnest([y * (255::double / 219) + v * (1.5748::double * (255::double / 219)), y * (255::double / 219) - u * (1.8556::double * 0.0722::double / 0.7152::double * (255::double / 219)) - v * (1.5748::double * 0.2126::double / 0.7152::double * (255::double / 219)), y * (255::double / 219) + u * (1.8556::double * (255::double / 219))]) as x from f)
select vec_id, {list(NAMES)!r}[l + 1] as layout, md5(unhex(string_agg(format('{{:02x}}', cast(trunc(greatest(0::double, least(most, x))) as bigint) // cut), '' order by k, i))) as rgb from c group by 1, 2""")
def surface_rgb(spark, sf):
    """RGB of small frames of all four layouts, as digests."""
    layout = F.get(F.array(*map(F.lit, NAMES)), (F.col("vec_id") % 4).cast("int"))
    full = F.concat("b", F.reverse("b"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("b", i * 7 % 64)))
    samples = F.when(F.col("vec_id") % 4 < 2, F.concat("b", F.slice("b", 1, 32))).otherwise(full)
    frames = bytes_of(spark, sf).select("vec_id", layout.alias("layout"), F.lit(8).alias("width"), F.lit(8).alias("height"), binary(samples, F.col("vec_id") % 2 == 1).alias("surface"))
    return surfaces.to_rgb(frames, ["vec_id", "layout"]).select("vec_id", "layout", F.md5("px").alias("rgb"))


@query("with " + BYTES + """, p as (select i, cast(trunc(i::float / 11::float * 7::float + 0.5::float) as int) as p from range(12) t(i)),
s as (select vec_id, r.i as i, c.i as j, b[r.p * 8 + c.p + 1]::float as y, (b[r.p // 2 * 8 + c.p // 2 * 2 + 1] - 128)::float as u, (b[r.p // 2 * 8 + c.p // 2 * 2 + 2] - 128)::float as v from y, p r, p c),
q as (select vec_id, i, j, trunc(greatest(0::float, least(255::float, y + 1.402::float * v)))::double as r, trunc(greatest(0::float, least(255::float, y - 0.34414::float * u - 0.71414::float * v)))::double as g, trunc(greatest(0::float, least(255::float, y + 1.772::float * u)))::double as b from s),
d as (select dy, dx from range(-2, 3) a(dy), range(-2, 3) b(dx) where dy * dy + dx * dx <= 4),
k as (select o.vec_id, o.i, o.j, d.dy, d.dx, n.r, n.g, n.b, exp(-(dy * dy + dx * dx) / (2 * 80.0::double * 80.0::double) - (abs(n.r - o.r) + abs(n.g - o.g) + abs(n.b - o.b)) ** 2 / (2 * 80.0::double * 80.0::double)) as w
  from q o, d join q n on n.vec_id = o.vec_id and n.i = 11 - abs(11 - abs(o.i + dy)) and n.j = 11 - abs(11 - abs(o.j + dx))),
m as (select vec_id, i, j, sum(w order by dy, dx) as w, sum(r * w order by dy, dx) as r, sum(g * w order by dy, dx) as g, sum(b * w order by dy, dx) as b from k group by 1, 2, 3),
o as (select vec_id, i * 32 + j as pos, unnest([0, 1, 2]) as plane, cast(trunc(unnest([r, g, b]) / w) as bigint) as x from m)
select vec_id, cast(32 as int) as height, cast(32 as int) as width, md5(unhex(string_agg(format('{:02x}', coalesce(x, 0)), '' order by plane, pos))) as digest from (select vec_id, pos, plane from y, range(1024) a(pos), range(3) b(plane)) left join o using (vec_id, plane, pos) group by 1""")
def preprocessed_frames(spark, sf):
    """Small NV12 frames as a detector takes them, in double precision, as digests."""
    frames = bytes_of(spark, sf).select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), binary(F.concat("b", F.slice("b", 1, 32)), F.lit(False)).alias("surface"))
    made = surfaces.preprocessed(frames, ["vec_id"], 12, np.float64)
    return made.select("vec_id", "height", "width", F.md5("px").alias("digest"))


@query("""with w as (select i, count(*) filter (embedding[i + 1] > 0)::double as w from embeddings, range(48) t(i) group by 1),
s as (select vec_id, vec_id % 3 as shape, [4, 2, 8][vec_id % 3 + 1] as h, [4, 8, 2][vec_id % 3 + 1] as wd, embedding as e from embeddings),
p as (select vec_id, e, h, wd, k, k // (wd // 2) * 2 * wd + k % (wd // 2) * 2 as pt from s, range(4) t(k))
select vec_id, p.h as height, wd as width, cast(k as bigint) as pos, (e[pt + 1]::double * a.w + e[pt + 17]::double * b.w + e[pt + 33]::double * c.w)::float::double as score from p join w a on a.i = pt join w b on b.i = pt + 16 join w c on c.i = pt + 32""")
def shaped_models(spark, sf):
    """A model of weights that Spark has counted, fetched by executors as a file, on
    images of three shapes."""
    vectors = read(spark, sf, "embeddings").select("vec_id", "embedding")
    path = shared_path(spark, "weights")
    counts = vectors.select(F.posexplode(F.slice("embedding", 1, 48)).alias("i", "e")).groupBy("i").agg(F.count_if(F.col("e") > 0).alias("n"))
    counts.orderBy("i").select(F.concat_ws(" ", "i", "n").alias("value")).coalesce(1).write.text(path)
    file = spark.read.text(path).select("_metadata.file_path").first()[0]
    side = lambda *s: F.get(F.array(*map(F.lit, s)), (F.col("vec_id") % 3).cast("int"))
    images = vectors.select("vec_id", side(4, 2, 8).alias("height"), side(4, 8, 2).alias("width"), F.slice("embedding", 1, 48).alias("px"))
    found = models.detect(images, ["vec_id", "height", "width"], models.shipped(spark, file, weighed))
    each = found.select("vec_id", "height", "width", F.posexplode("text").alias("pos", "score"))
    return each.select("vec_id", "height", "width", F.col("pos").cast("long").alias("pos"), F.col("score").cast("double").alias("score"))


def weighed(path: str) -> models.Model:
    """A detector that weighs the three planes of every other pixel."""
    weights = np.zeros(48)
    for i, n in map(str.split, Path(path).read_text().splitlines()):
        weights[int(i)] = int(n)

    def of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = weights.reshape(3, *x.shape[2:])
        each = x.astype(float) * own
        score = (each[:, 0] + each[:, 1] + each[:, 2])[:, ::2, ::2].astype(np.float32)
        return score, score

    return of


@query("select doc_id, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) as units, text as back from documents")
def utf16_roundtrip(spark, sf):
    """Code units of each text in UTF-16, and the text read back from them."""
    held = read(spark, sf, "documents").select("doc_id", T.utf16(F.col("text")).alias("u"))
    return held.select("doc_id", (F.octet_length("u") / 2).cast("long").alias("units"), T.of_utf16(F.col("u")).alias("back"))
