"""Decoded surfaces of each layout: their planes, their RGB, and the way back."""

from __future__ import annotations

import numpy as np

#: Shares of red and blue, and the luma's black, white and greatest
#: value, of each standard; BT2020 is of 10 bits, held in the upper bits of 16.
STANDARDS = {"BT709": (0.2126, 0.0722, 16, 235, 255), "BT601": (0.2990, 0.1140, 16, 235, 255), "BT2020": (0.2627, 0.0593, 4096, 60160, 65535)}
#: Bytes a sample of each layout, and whether its chroma is a quarter and interleaved.
LAYOUTS = {"NV12": (1, True), "P016": (2, True), "YUV444": (1, False), "YUV444P16": (2, False)}


def length(layout: str, width: int, height: int) -> int:
    """Bytes of a surface."""
    size, quarter = LAYOUTS[layout]
    return width * height * size * 3 // (2 if quarter else 1)


def planes(data: bytes, layout: str, width: int, height: int) -> np.ndarray:
    """(3, height, width) samples, chroma repeated to the luma's size. Sides are even
    where chroma is a quarter; data of another length is an error."""
    size, quarter = LAYOUTS[layout]
    if len(data) != length(layout, width, height) or quarter and (width % 2 or height % 2):
        raise ValueError(f"not a {layout} surface of {width} x {height}: {len(data)} bytes")
    x = np.frombuffer(data, "<u2" if size == 2 else "u1")
    if not quarter:
        return x.reshape(3, height, width)
    chroma = x[width * height :].reshape(height // 2, width // 2, 2)
    return np.stack([x[: width * height].reshape(height, width), *(chroma[:, :, k].repeat(2, 0).repeat(2, 1) for k in (0, 1))])


def _matrix(standard: str) -> np.ndarray:
    """Luma and colour differences (from -0.5 to 0.5) of RGB."""
    red, blue, *_ = STANDARDS[standard]
    luma = np.array([red, 1 - red - blue, blue])
    return np.stack([luma, (np.eye(3)[2] - luma) / (2 - 2 * blue), (np.eye(3)[0] - luma) / (2 - 2 * red)])


def _inverse(standard: str) -> np.ndarray:
    red, blue, *_ = STANDARDS[standard]
    from_blue, from_red = 2 - 2 * blue, 2 - 2 * red
    green = 1 - red - blue
    return np.array([[1, 0, from_red], [1, -from_blue * blue / green, -from_red * red / green], [1, from_blue, 0]])


def _mixed(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The matrix times each pixel, added from the left in double precision."""
    return sum(matrix[:, k, None, None] * x[k].astype(float) for k in range(3))


def _scale(standard: str) -> float:
    *_, black, white, most = STANDARDS[standard]
    return most / (white - black)


def to_rgb(yuv: np.ndarray, standard: str = "BT709", size: int = 1) -> np.ndarray:
    """(3, height, width) of ``size`` bytes a sample, cut off; of a studio's range."""
    bits = yuv.dtype.itemsize * 8
    zero = np.array([1 << bits - 4, 1 << bits - 1, 1 << bits - 1]).reshape(3, 1, 1)
    exact = _mixed(_inverse(standard) * _scale(standard), yuv.astype(np.int64) - zero)
    return _deep(np.clip(exact, 0, (1 << bits) - 1).astype(yuv.dtype), size)


def from_rgb(rgb: np.ndarray, standard: str = "BT709", size: int = 2) -> np.ndarray:
    """Planes of luma and chroma of RGB samples, the way back of to_rgb()."""
    bits = rgb.dtype.itemsize * 8
    zero = np.array([1 << bits - 4, 1 << bits - 1, 1 << bits - 1]).reshape(3, 1, 1)
    exact = _mixed(_matrix(standard) / _scale(standard), rgb) + zero
    return _deep(np.clip(exact, 0, (1 << bits) - 1).astype(rgb.dtype), size)


def _deep(x: np.ndarray, size: int) -> np.ndarray:
    """Samples of ``size`` bytes: the upper bits stay the upper bits."""
    if x.dtype.itemsize > size:
        return (x >> 8).astype(np.uint8)
    return x.astype("<u2") << 8 if x.dtype.itemsize < size else x


def surface(yuv: np.ndarray, layout: str) -> bytes:
    """The surface of planes; chroma of a quarter is the mean of its four samples."""
    size, quarter = LAYOUTS[layout]
    yuv = _deep(yuv, size)
    if not quarter:
        return yuv.tobytes()
    _, h, w = yuv.shape
    mean = yuv[1:].reshape(2, h // 2, 2, w // 2, 2).mean((2, 4)).astype(yuv.dtype)
    return yuv[0].tobytes() + mean.transpose(1, 2, 0).tobytes()


def pixels(rgb: np.ndarray, order: str = "planar") -> bytes:
    """Planes one after the other, or pixels ``bgra`` or ``rgba`` with alpha 0."""
    if order == "planar":
        return rgb.tobytes()
    full = np.concatenate([rgb, np.zeros_like(rgb[:1])])
    return full[["rgba".index(c) for c in order]].transpose(1, 2, 0).tobytes()
