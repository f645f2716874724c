"""Region operators: boxes of components, merged boxes, tracks, carried texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions import geometry as G
from cuewright.functions import pixels as P
from cuewright.operators import graphs
from cuewright.operators.assign import assign_all
from cuewright.store import stored

MIN_AREA, MIN_PEAK = 10, 0.99
#: Frames of a video that a task follows at a time.
BLOCK = 8192
#: Pairs of boxes that are compared at a time, about.
PAIRS = 1 << 20
#: Numbers below it are compared as 32 bits.
NARROW = 1 << 26
#: Rows of frames that a call gets, about; a larger frame comes whole.
CALL = 1 << 17
#: The cost of a pair of which none is known.
UNKNOWN = 1 << 40


def component_boxes(pixels: DataFrame, key: list[str], width: int, height: int, min_area: int = MIN_AREA, min_peak: float = MIN_PEAK, whole: bool = False) -> DataFrame:
    """(key, label, x, y, score) pixels to inflated and cropped boxes of the
    components that are large and certain enough; those as large as the map only
    if ``whole`` says so."""
    found = pixels.groupBy(*key, "label").agg(F.count("*").alias("area"), F.max("score").alias("peak"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    fills = (F.col("w") == width) & (F.col("h") == height)
    found = found.where((F.col("area") >= min_area) & (F.col("peak") >= F.lit(min_peak).cast("float")) & (F.lit(whole) | ~fills))
    own = G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return found.select(*key, "label", "area", G.crop(G.inflate(own, F.col("area")), F.lit(2 * width), F.lit(2 * height)).alias("box"))


def _mergeable(a, b):
    """The rule of geometry.can_merge for numbers or arrays of them: ``a`` comes before
    ``b``, which matters where both start at the same x."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    holds = (ax <= bx) & (ay <= by) & (ax + aw >= bx + bw) & (ay + ah >= by + bh)
    lies = (bx <= ax) & (by <= ay) & (bx + bw >= ax + aw) & (by + bh >= ay + ah)
    size = np.minimum(ah, bh)
    uneven = (abs(ay + ah // 2 - by - bh // 2) * 3 > size * 2) & ((abs(ah - bh) > size) | (abs(ay - by) * 2 > size))
    return holds | lies | ~uneven & (np.where(ax < bx, abs(ax + aw - bx), abs(bx + bw - ax)) <= size)


def united(n: int, pairs: Iterable[tuple[int, int]]) -> list[int]:
    """The least member of the set that each of 0 to n - 1 is in."""
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def _level(a, b):
    """Whether boxes (y, height) may be mergeable, wherever they lie from left to right."""
    (ay, ah), (by, bh) = a, b
    size = np.minimum(ah, bh)
    uneven = (abs(ay + ah // 2 - by - bh // 2) * 3 > size * 2) & ((abs(ah - bh) > size) | (abs(ay - by) * 2 > size))
    return ~uneven | (ay <= by) & (ay + ah >= by + bh) | (by <= ay) & (by + bh >= ay + ah)


def pairs_of(boxes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mergeable pairs of boxes (x, y, width, height: a row each) of frames of
    ``sizes`` boxes. About PAIRS are looked at at a time."""
    if boxes.dtype.kind == "i" and boxes.size and -NARROW < boxes.min() and boxes.max() < NARROW:
        boxes = boxes.astype(np.int32)
    later = np.repeat(np.cumsum(sizes), sizes) - np.arange(boxes.shape[1]) - 1
    sums = np.cumsum(later)
    first, out = 0, [np.zeros((2, 0), np.int64)]
    while first < len(later):
        last = max(first + 1, int(np.searchsorted(sums, PAIRS + (sums[first - 1] if first else 0), "right")))
        n = later[first:last]
        a = np.repeat(np.arange(first, last), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        near = np.flatnonzero(_level(boxes[1::2][:, a], boxes[1::2][:, b]))
        a, b = a[near], b[near]
        same = _mergeable(boxes[:, a], boxes[:, b])
        out.append(np.stack([a[same], b[same]]))
        first = last
    return tuple(np.concatenate(out, 1))


def _ordered(boxes: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boxes and their frames by (frame, y, x, width, height); where all of a row are
    few bits, they are sorted as one number."""
    columns = [frame, boxes[1], boxes[0], boxes[2], boxes[3]]
    if boxes.dtype.kind == "i" and len(frame):
        low = [int(c.min()) for c in columns]
        bits = [(int(c.max()) - least).bit_length() for c, least in zip(columns, low, strict=True)]
        if sum(bits) < 63:
            packed = np.zeros(len(frame), np.int64)
            for c, least, n in zip(columns, low, bits, strict=True):
                packed = packed << n | c - least
            packed.sort()
            for i in range(4, -1, -1):
                columns[i] = (packed & (1 << bits[i]) - 1) + low[i]
                packed >>= bits[i]
            return np.stack([columns[2], columns[1], *columns[3:]]), columns[0]
    at = np.lexsort(columns[::-1])
    return boxes[:, at], frame[at]


def _sizes(frame: np.ndarray) -> np.ndarray:
    """The rows of each of some rising frames."""
    return np.diff(np.append(np.flatnonzero(np.diff(frame, prepend=-1)), len(frame)))


def merged_frames(boxes: np.ndarray, frame: np.ndarray, times: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hulls (x, y, width, height: a row each) of the connected mergeable boxes of each
    frame, ``times`` over, and their frames (from 0), by (frame, y, x, width, height);
    boxes are compared in this order too. A frame of which none merge is done."""
    boxes, frame = _ordered(boxes, frame)
    a, b = pairs_of(boxes, _sizes(frame)) if times else ((), ())
    if times and boxes.dtype.kind == "f" and not len(a):  # a box of unknown start has no known reach
        return _ordered(np.concatenate([boxes[:2], boxes[:2] + boxes[2:] - boxes[:2]]), frame)
    if not len(a):
        return boxes, frame
    told = np.zeros(int(frame[-1]) + 1, bool)
    told[frame[a]] = True
    changed = told[frame]
    own, of, place = boxes[:, changed], frame[changed], np.cumsum(changed) - 1
    group = np.array(united(len(of), zip(place[a].tolist(), place[b].tolist(), strict=True)), np.int64)
    at = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[at], prepend=-1))
    low, high = own[:2, at], (own[:2] + own[2:])[:, at]
    low, high = np.minimum.reduceat(low, starts, 1), np.maximum.reduceat(high, starts, 1)
    own, of = merged_frames(np.concatenate([low, high - low]), of[at][starts], times - 1)
    rest, kept = boxes[:, ~changed], frame[~changed]
    if boxes.dtype.kind == "f":
        rest, kept = merged_frames(rest, kept)
    boxes, frame = np.concatenate([rest, own], 1), np.concatenate([kept, of])
    at = np.argsort(frame, kind="stable")
    return boxes[:, at], frame[at]


def merged(boxes: list[tuple]) -> list[tuple]:
    """Hulls of the connected mergeable boxes of one frame, by (y, x, width, height)."""
    found, _ = merged_frames(np.array(boxes, np.int64).reshape(-1, 4).T, np.zeros(len(boxes), np.int64))
    return list(map(tuple, found.T.tolist()))


def _frames(rows: DataFrame, key: list[str], names: list[str], made: list[str], of: Callable, ordered: bool = True) -> DataFrame:
    """(key, made: int each) of the whole numbers ``names`` of each frame. ``of`` gets the
    rows of many whole frames, ``ordered`` by ``names`` or not, and the frame of each,
    rising, and gives rows and their frames; nulls are NaN. Partitions are sorted, so that
    no frame is a list or a group of its own: both cost more than its rows. Sorted by
    whole numbers of a key alone, frames start where these change."""
    kinds = dict(rows.dtypes)
    whole = rows.select(*key, *[F.col(c).cast("int").alias(c) for c in names])
    if ordered or any(kinds[k] not in ("bigint", "int", "smallint", "tinyint") for k in key):
        first = F.row_number().over(Window.partitionBy(*key).orderBy(*names)) == 1
        marked, marks = whole.select("*", first.alias("__first")), []
    else:
        marked, marks = whole.repartition(parts(rows), *key).sortWithinPartitions(*key), key

    def call(held: list[pa.RecordBatch], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        if len(table):
            columns = [table[c].to_numpy() for c in names]
            numbers = np.stack([c.astype(np.float64 if any(x.dtype.kind == "f" for x in columns) else np.int64) for c in columns], 1)
            found, frame = of(numbers, np.cumsum(starts) - 1)
            keys = table.select(key).take(pa.array(np.flatnonzero(starts)[frame]))
            columns = [pa.array(c, from_pandas=True).cast(pa.int32()) for c in found.T]
            yield from pa.Table.from_arrays([*keys.columns, *columns], names=[*key, *made]).to_batches(max_chunksize=1 << 16)

    def firsts(batch: pa.RecordBatch, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Which rows are the first of a frame, and the last row's key."""
        if not marks:
            return batch.column("__first").to_numpy(zero_copy_only=False), None
        found = [x.to_numpy(zero_copy_only=False).astype(np.int64) for c in map(batch.column, marks) for x in (c.fill_null(0), c.is_valid())]
        own = np.stack(found)
        starts = np.append(last is None or (own[:, 0] != last).any(), (own[:, 1:] != own[:, :-1]).any(0))
        return starts, own[:, -1]

    def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        told: list[np.ndarray] = []
        n, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own, last = firsts(batch, last)
            starts = np.flatnonzero(own)
            if n + batch.num_rows > CALL and len(starts):
                yield from call([*held, batch.slice(0, starts[-1])], np.concatenate([*told, own[: starts[-1]]]))
                batch, own, held, told, n = batch.slice(starts[-1]), own[starts[-1] :], [], [], 0
            held.append(batch)
            told.append(own)
            n += batch.num_rows
        if held:
            yield from call(held, np.concatenate(told))

    return marked.mapInArrow(calls, ", ".join([*[f"`{k}` {kinds[k]}" for k in key], *[f"{c} int" for c in made]]))


def merge_boxes(boxes: DataFrame, key: list[str], times: int = 2) -> DataFrame:
    """(key, x, y, width, height): boxes of a line merged, ``times`` over. A
    frame's boxes are one group, as many as a frame shows; a call merges many frames."""

    def found(rows: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, frame = merged_frames(rows.T, frame, times)
        sizes = _sizes(frame)
        number = np.arange(len(frame)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.concatenate([number[None], own]).T, frame

    names = ["x", "y", "width", "height"]
    return _frames(boxes, key, names, ["region_idx", *names], found, ordered=False)


def iou_pairs(boxes: DataFrame, key: list[str]) -> DataFrame:
    """(key, seq, region_idx, box): costs of all pairs of regions of a frame and
    the frame before it."""
    later = boxes.select(*key, (F.col("seq") - 1).alias("seq"), F.col("region_idx").alias("dst"), F.col("box").alias("b"))
    both = boxes.select(*key, "seq", F.col("region_idx").alias("src"), F.col("box").alias("a")).join(later, [*key, "seq"])
    return both.select(*key, "seq", "src", "dst", G.iou(F.col("a"), F.col("b")).alias("iou"))


def edges_of(costs: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (src, dst, cost) of each frame at the least total cost, and their
    frames, of the costs of all its pairs. Unknown costs are the highest."""
    at = np.lexsort((costs[:, 1], costs[:, 0], frame))
    costs, frame = costs[at], frame[at]
    last = np.append(np.any(np.diff(costs[:, :2], axis=0), 1) | (np.diff(frame) > 0), True)[: len(frame)]
    costs, frame = costs[last], frame[last]  # of pairs that are told twice one counts
    if not len(frame):
        return costs, frame
    starts = np.flatnonzero(np.diff(frame, prepend=-1))
    pairs = np.diff(np.append(starts, len(frame)))
    sources = np.add.reduceat((np.diff(costs[:, 0], prepend=np.nan) != 0) | (np.diff(frame, prepend=-1) > 0), starts, dtype=np.int64)
    if (pairs % sources).any():
        raise ValueError("a pair of regions has no cost")
    out, of = [], []
    for rows, columns in sorted({*zip(sources.tolist(), (pairs // sources).tolist(), strict=True)}):
        own = starts[(sources == rows) & (pairs == rows * columns)]
        table = costs[own[:, None] + np.arange(rows * columns)].reshape(-1, rows, columns, 3)
        if (table[..., 1] != table[:, :1, :, 1]).any():
            raise ValueError("a pair of regions has no cost")
        known = np.nan_to_num(table[..., 2], nan=UNKNOWN).astype(np.int64)
        column = assign_all(known)
        k, row = np.nonzero(column >= 0)
        out.append(table[k, row, column[k, row]])
        of.append(frame[own][k])
    rows, frame = np.concatenate(out), np.concatenate(of)
    at = np.argsort(frame, kind="stable")
    return rows[at], frame[at]


def assignments(costs: DataFrame, key: list[str]) -> DataFrame:
    """(key, src, dst, cost): one-to-one edges at the least total cost for each key."""

    names = ["src", "dst", "cost"]
    return _frames(costs, key, names, names, edges_of)


def unmatched(regions: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Regions that no edge ends in."""
    return regions.join(edges.select(*key, F.col("dst").alias("region_idx")), [*key, "region_idx"], "left_anti")


def clean_edges(edges: DataFrame, differences: DataFrame, key: list[str], width: Column, threshold: float = 0.7, height: int = 32) -> DataFrame:
    """Edges whose regions' mean difference stays below the threshold."""
    dirty = differences.where(F.col("absdiff") / (width * height * 3) >= threshold).select(*key, "src", "dst")
    return edges.join(dirty, [*key, "src", "dst"], "left_anti")


def region_width(width: Column, key: list[str], cap: int = 640) -> Column:
    """The widest of a batch, rounded up to 32."""
    return F.least(F.lit(cap), F.ceil(F.max(width).over(Window.partitionBy(*key)) / 32) * 32).cast("int")


def parts(rows: DataFrame) -> int:
    """Shuffle partitions. Named in a repartition they stay as many: else a few tasks get
    all rows where these are packed well, and sort them in more memory than those take."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tracks(regions: DataFrame, edges: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """(key, seq, region_idx) with the track: (seq, region) of the chain's first.
    ``edges``: seq, src, dst from a frame to the next; those from regions that aren't
    there are none. ``block`` frames of a video are a group: chains are followed within
    it, and only the ends of chains that reach a block's first frame are tied to the
    block before, by pointers that double their reach in each round."""
    kinds = dict(regions.dtypes)
    names = [f"`{k}` {kinds[k]}" for k in key]
    schema = ", ".join(names) + ", seq long, region_idx int, first_seq long, first_region int"

    def of(values: tuple, rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        before = {(s + 1, d): (s, x) for s, x, d in zip(links["seq"].tolist(), links["src"].tolist(), links["dst"].tolist(), strict=True)}
        first: dict = {}
        for at in sorted(zip(rows["seq"].tolist(), rows["region_idx"].tolist(), strict=True)):
            first[at] = first.get(before.get(at), at)
        made = {k: pd.Series([v] * len(first), dtype=object) for k, v in zip(key, values, strict=False)}
        numbers = np.array([(*at, *start) for at, start in first.items()], np.int64).reshape(-1, 4)
        return pd.DataFrame(made | dict(zip(("seq", "region_idx", "first_seq", "first_region"), numbers.T, strict=True)))

    at = lambda seq: F.floor(seq / block).cast("long").alias("__block")
    placed = regions.select(*key, F.col("seq").cast("long").alias("seq"), F.col("region_idx").cast("int").alias("region_idx"), at(F.col("seq")))
    links = edges.select(*[F.col(c).alias(c) for c in (*key, "seq", "src", "dst")], at(F.col("seq") + 1))  # new columns, should both come from one table
    inner = links.where(F.floor(F.col("seq") / block) == F.col("__block"))
    grouped = [*key, "__block"]
    dealt = lambda df: df.repartition(parts(df), *grouped)
    found = stored(dealt(placed).groupBy(*grouped).cogroup(dealt(inner).groupBy(*grouped)).applyInPandas(of, schema), "tracks")

    node = lambda seq, region: F.struct(*key, F.col(seq).cast("long").alias("seq"), F.col(region).cast("int").alias("region_idx"))
    across = links.where(F.floor(F.col("seq") / block) < F.col("__block")).select(F.struct(*key, (F.col("seq") + 1).alias("seq"), F.col("dst").cast("int").alias("region_idx")).alias("node"), node("seq", "src").alias("from"))
    last = found.where(F.pmod("seq", F.lit(block)) == block - 1).select(node("seq", "region_idx").alias("from"), node("first_seq", "first_region").alias("up"))
    ties = across.join(last, "from").groupBy("node").agg(F.min("up").alias("up"))
    starts = ties.select("node").union(ties.select("up")).distinct()
    pointers = starts.join(ties, "node", "left").select("node", F.coalesce("up", "node").alias("up"))
    roots = graphs.roots(pointers).where("node <> root")
    whole = found.withColumn("node", node("first_seq", "first_region")).join(roots, "node", "left")
    own = lambda name, field: F.coalesce(F.col("root").getField(field), F.col(name)).alias(name)
    return whole.select(*key, "seq", "region_idx", own("first_seq", "seq"), own("first_region", "region_idx"))


def long_tracks(regions: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """tracks() under the name that long videos' callers know; no video is a task's work."""
    return tracks(regions, edges, key)


def carried(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """``value`` where it is known, else the last known before it, as ``carried``."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("carried", F.last(value, ignorenulls=True).over(w))




def region_ids(regions: DataFrame, batch: list[str], order: list[str]) -> DataFrame:
    """Regions with a number from 0 in their batch, as ``region_id``. Either
    direction of the lookup is a join with this table."""
    w = Window.partitionBy(*batch).orderBy(*order)
    return regions.withColumn("region_id", (F.row_number().over(w) - 1).cast("long"))


def along_tracks(found: DataFrame, texts: DataFrame, key: list[str], default: str = "") -> DataFrame:
    """tracks() with the text of each track's first region. ``texts``: (key, seq,
    region_idx, text) of the regions that were read; ``default`` where it wasn't."""
    first = texts.select(*key, F.col("seq").alias("first_seq"), F.col("region_idx").alias("first_region"), "text")
    return found.join(first, [*key, "first_seq", "first_region"], "left").withColumn("text", F.coalesce("text", F.lit(default)))


def region_strips(frames: DataFrame, regions: DataFrame, key: list[str], out_w: int, out_h: int = 32) -> DataFrame:
    """(key, frame_id, region_idx, strip): each region cut from its frame (``px``:
    bytes of ``planes`` planes of height x width) and scaled to out_h x out_w."""

    @F.pandas_udf("binary")
    def cut(px: pd.Series, planes: pd.Series, height: pd.Series, width: pd.Series, box: pd.DataFrame) -> pd.Series:
        rows = zip(px, planes, height, width, box.itertuples(index=False), strict=True)
        return pd.Series([P.region(np.frombuffer(x, np.uint8).reshape(n, h, w), b.x, b.y, b.width, b.height, out_w, out_h).tobytes() for x, n, h, w, b in rows], index=px.index)

    joined = regions.select(*key, "frame_id", "region_idx", "box").join(frames.select(*key, "frame_id", "px", "planes", "height", "width"), [*key, "frame_id"])
    return joined.select(*key, "frame_id", "region_idx", cut("px", "planes", "height", "width", "box").alias("strip"))


def region_differences(strips: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, frame_id, src, dst, absdiff) of edges from region ``src`` of a frame to
    ``dst`` of ``next_id``: the sum of their strips' absolute differences."""

    @F.pandas_udf("long")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        of = lambda x: np.frombuffer(x, np.uint8).astype(np.int32)
        return pd.Series([int(np.abs(of(x) - of(y)).sum()) for x, y in zip(a, b, strict=True)], index=a.index)

    a = strips.select(*key, "frame_id", F.col("region_idx").alias("src"), F.col("strip").alias("a"))
    b = strips.select(*key, F.col("frame_id").alias("next_id"), F.col("region_idx").alias("dst"), F.col("strip").alias("b"))
    return edges.join(a, [*key, "frame_id", "src"]).join(b, [*key, "next_id", "dst"]).select(*key, "frame_id", "src", "dst", apart("a", "b").alias("absdiff"))
