"""Pixel functions, as columns and as numpy kernels for pandas functions."""

from __future__ import annotations

import math
from collections import deque
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def from_unit(x: Column) -> Column:
    """[-1, 1] to a byte."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5))).cast("int")


def normalised(px: Column) -> Column:
    """Bytes to [-1, 1]."""
    return F.transform(px, lambda x: (x / 127.5 - 1).cast("float"))


def abs_difference(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two pixel arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def rgb(y: Column, u: Column, v: Column) -> Column:
    """Full-range YUV to RGB, cut off to bytes."""
    byte = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), x.cast("int")))
    return F.struct(byte(y + 1.402 * (v - 128)).alias("r"), byte(y - 0.34414 * (u - 128) - 0.71414 * (v - 128)).alias("g"), byte(y + 1.772 * (u - 128)).alias("b"))


def chroma(code: Column) -> Column:
    """Struct of bit depth, bytes a pixel and planes of a chroma format."""
    deep = code.endswith("10LE") | code.endswith("12LE")
    return F.struct(F.when(code.endswith("10LE"), 10).when(code.endswith("12LE"), 12).otherwise(8).alias("bits"), F.when(deep, 2).otherwise(1).alias("bytes"), F.when(code.contains("444"), 2).otherwise(1).alias("planes"))


#: Shares of red and blue in the luma of each standard.
LUMA = {"BT601": (0.299, 0.114), "BT709": (0.2126, 0.0722), "BT2020": (0.2627, 0.0593), "FCC": (0.3, 0.11), "SMPTE240M": (0.212, 0.087)}


def studio_rgb(y: Column, u: Column, v: Column, standard: str = "BT709", bits: int = 8) -> Column:
    """YUV of limited range (luma 16 to 235 of 8 bits) to RGB bytes."""
    kr, kb = LUMA[standard]
    unit = float(1 << bits - 8)
    luma, cb, cr = (y / unit - 16) * (255 / 219), (u / unit - 128) * (255 / 224), (v / unit - 128) * (255 / 224)
    byte = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x + 0.5))).cast("int")
    red, blue = luma + 2 * (1 - kr) * cr, luma + 2 * (1 - kb) * cb
    green = luma - 2 * (1 - kr) * kr / (1 - kr - kb) * cr - 2 * (1 - kb) * kb / (1 - kr - kb) * cb
    return F.struct(byte(red).alias("r"), byte(green).alias("g"), byte(blue).alias("b"))


def interleaved(px: Column, planes: int = 3) -> Column:
    """Planes one after the other to pixels, the last plane first (BGR of RGB)."""
    n = (F.size(px) / planes).cast("int")
    return F.transform(F.sequence(F.lit(0), F.size(px) - 1), lambda i: F.get(px, (planes - 1 - i % planes) * n + F.floor(i / planes).cast("int")))


def chroma_layout(code: Column) -> Column:
    """Struct of a chroma format's share of rows in the chroma planes, and whether
    it is NV12, the only one that frames may have."""
    return F.struct(F.when(code.contains("444"), 1.0).when(code.contains("420"), 0.5).alias("rows"), (code == "YUV420").alias("nv12"))


def only_nv12(code: Column) -> Column:
    """The code, or an error that ends the query."""
    return F.when(code == "YUV420", code).otherwise(F.raise_error(F.concat(F.lit("frames must be NV12, not "), code)))


def preprocess(nv12: np.ndarray, width: int, height: int, side: int = 640, kind: type = np.float32) -> np.ndarray:
    """(3, h, w) bytes of an NV12 frame: scaled so that its longer side is ``side``,
    in RGB, blurred (in numbers of ``kind``), filled with black to multiples of 32."""
    r = np.float32(side) / np.float32(max(width, height))
    w, h = (int(np.float32(r * np.float32(x)) + 0.5) for x in (width, height))
    out = np.zeros((3, -(-h // 32) * 32, -(-w // 32) * 32), np.uint8)
    out[:, :h, :w] = bilateral(nv12_to_rgb(nv12, width, height, w, h, w, h), kind=kind)
    return out


def nv12_to_rgb(nv12: np.ndarray, width: int, height: int, target_w: int, target_h: int, out_w: int, out_h: int) -> np.ndarray:
    """(3, out_h, out_w) bytes by nearest samples; black beyond the target."""
    luma, inter = nv12[: width * height].reshape(height, width), nv12[width * height :].reshape(height // 2, width // 2, 2)
    at = lambda n, size: (np.arange(n, dtype=np.float32) / np.float32(max(n - 1, 1)) * np.float32(size - 1) + np.float32(0.5)).astype(int)
    ys, xs = at(target_h, height), at(target_w, width)
    y = luma[ys][:, xs].astype(np.float32)
    u, v = (inter[np.minimum(ys // 2, height // 2 - 1)][:, np.minimum(xs // 2, width // 2 - 1), k].astype(np.float32) - 128 for k in (0, 1))
    full = np.stack([y + 1.402 * v, y - 0.34414 * u - 0.71414 * v, y + 1.772 * u])
    out = np.zeros((3, out_h, out_w), np.uint8)
    out[:, :target_h, :target_w] = np.clip(full, 0, 255)
    return out


@lru_cache(32)
def _weights(square: int, most: int, sigma_space: float, sigma_colour: float) -> np.ndarray:
    """exp() of a distance for each sum of colour differences up to ``most``, by the C
    library: numpy's own differs from it in the last bit on some processors."""
    return np.array([math.exp(-square / (2 * sigma_space**2) - float(c) ** 2 / (2 * sigma_colour**2)) for c in range(most + 1)])


def bilateral(img: np.ndarray, radius: int = 2, sigma_space: float = 80.0, sigma_colour: float = 80.0, kind: type = np.float32) -> np.ndarray:
    """Edge-keeping blur of (3, h, w) bytes over a disc, borders mirrored."""
    _, h, w = img.shape
    padded = np.pad(img.astype(kind), ((0, 0), (radius, radius), (radius, radius)), mode="reflect")
    top, weight = np.zeros(img.shape, kind), np.zeros((h, w), kind)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dx * dx + dy * dy <= radius * radius:
                near = padded[:, radius + dy : radius + dy + h, radius + dx : radius + dx + w]
                colour = np.abs(near - img).sum(0)
                if kind is np.float64:
                    k = _weights(dx * dx + dy * dy, 255 * img.shape[0], sigma_space, sigma_colour)[colour.astype(int)]
                else:
                    k = np.exp(-(dx * dx + dy * dy) / (2 * sigma_space**2) - colour**2 / (2 * sigma_colour**2)).astype(kind)
                top += near * k
                weight += k
    return (top / weight).astype(np.uint8)


def region(img: np.ndarray, x: int, y: int, w: int, h: int, out_w: int, out_h: int = 32) -> np.ndarray:
    """Crop scaled to the output's height and filled with zeros on the right, or,
    if too wide for that, scaled to its width and filled above and below."""
    out = np.zeros((img.shape[0], out_h, out_w), np.uint8)
    new_w = int(out_h * w / h)
    new_h, top = out_h, 0
    if new_w > out_w:
        new_h = min(out_h, -(-int(out_w * h / w) // 2) * 2)
        new_w, top = out_w, (out_h - new_h) // 2
    ys, xs = (np.arange(n) * size // max(n, 1) for n, size in ((new_h, h), (new_w, w)))
    out[:, top : top + new_h, :new_w] = img[:, y + ys][:, :, x + xs]
    return out


def label_components(mask: np.ndarray) -> np.ndarray:
    """4-connected components in order of their first pixel; 0 is background."""
    out = np.zeros(mask.shape, np.int32)
    n = 0
    for start in zip(*np.nonzero(mask), strict=True):
        if not out[start]:
            n += 1
            out[start] = n
            todo = deque([start])
            while todo:
                y, x = todo.popleft()
                for at in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if 0 <= at[0] < mask.shape[0] and 0 <= at[1] < mask.shape[1] and mask[at] and not out[at]:
                        out[at] = n
                        todo.append(at)
    return out
