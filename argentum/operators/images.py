"""Measures of pictures from raw pixels: hashes, exposure, sharpness, flatness. Kernels are numpy over one picture.

pixels: 8-bit RGB rows (height x width x 3 bytes). A picture that doesn't fit its size gives nulls and an error text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MOST_PIXELS, MOST_SIDE, MOST_BYTES = 64_000_000, 64_000, 512 << 20


def luma(rgb: np.ndarray) -> np.ndarray:
    """8-bit brightness, Rec. 709 weights in whole numbers."""
    w = np.array([2126, 7152, 722], np.int64)
    return (rgb.astype(np.int64) @ w // 10_000).astype(np.uint8)


def nearest(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resized by nearest sample (pixel centers)."""
    y = np.minimum(((np.arange(height) + 0.5) * a.shape[0] / height).astype(int), a.shape[0] - 1)
    x = np.minimum(((np.arange(width) + 0.5) * a.shape[1] / width).astype(int), a.shape[1] - 1)
    return a[y[:, None], x[None, :]]


def _triangle(n: int, m: int) -> np.ndarray:
    """Weights of a triangle filter from n samples to m."""
    scale = n / m
    support = max(1.0, scale)
    center = (np.arange(m) + 0.5) * scale
    w = np.maximum(0, 1 - np.abs(np.arange(n)[None, :] + 0.5 - center[:, None]) / support)
    return w / w.sum(1, keepdims=True)


def triangle(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resized by a triangle filter, 8 bits again."""
    out = np.einsum("yh,hwc,xw->yxc", _triangle(rgb.shape[0], height), rgb.astype(np.float64), _triangle(rgb.shape[1], width), optimize=True)
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def bounded(rgb: np.ndarray, edge: int) -> np.ndarray:
    """No side longer than `edge`; smaller pictures stay as they are."""
    h, w = rgb.shape[:2]
    if max(h, w) <= edge:
        return rgb
    k = edge / max(h, w)
    return triangle(rgb, max(1, round(w * k)), max(1, round(h * k)))


def oriented(rgb: np.ndarray, orientation: int | None) -> np.ndarray:
    """Turned upright by the EXIF orientation (1 to 8)."""
    turned = {2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1], 5: lambda a: a.swapaxes(0, 1), 6: lambda a: np.rot90(a, -1), 7: lambda a: a[::-1, ::-1].swapaxes(0, 1), 8: lambda a: np.rot90(a)}
    return turned.get(orientation or 1, lambda a: a)(rgb)


def difference_hash(gray: np.ndarray) -> str:
    """A byte for each of 8 rows; a bit is set where a sample is brighter than the next, least bit first."""
    small = nearest(gray, 9, 8)
    return np.packbits(small[:, :-1] > small[:, 1:], axis=1, bitorder="little").tobytes().hex()


def frequency_hash(rgb: np.ndarray) -> tuple[int, float, np.ndarray]:
    """(64 bits as a signed number, contrast, mean color) of the 32x32 picture: low DCT terms above their median."""
    small = triangle(rgb, 32, 32).astype(np.float32)
    gray = small @ np.array([0.299, 0.587, 0.114], np.float32)
    basis = np.cos((2 * np.arange(32) + 1)[None, :] * np.arange(8)[:, None] * np.pi / 64).astype(np.float32)
    c = (basis @ gray @ basis.T).ravel()
    bits = c > np.sort(c[1:])[31]
    bits[0] = False
    return int(np.packbits(bits, bitorder="little").view("<i8")[0]), float(gray.std()), small.reshape(-1, 3).mean(0)


def laplacian(gray: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian, over a thousand, at most 1; 0 for pictures without an inside."""
    if min(gray.shape) <= 2:
        return 0.0
    g = gray.astype(np.float64)
    v = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(np.clip(v.var() / 1000, 0, 1))


def region_sharpness(gray: np.ndarray, x: int, y: int, w: int, h: int) -> float | None:
    """Sharpness of a part, null where it is under 8 pixels."""
    part = gray[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]
    return None if min(part.shape, default=0) < 8 else laplacian(part)


def exposure(gray: np.ndarray) -> dict[str, float]:
    g = gray.astype(np.float64)
    clip = lambda v: float(np.clip(v, 0, 1))
    return {"exposure": clip(g.mean() / 255), "shadow_clipping": clip((g < 10).mean()), "highlight_clipping": clip((g > 245).mean()), "contrast": clip(g.std() / 127.5)}


def flatness(rgb: np.ndarray, gray: np.ndarray, block: int = 16, limit: float = 14.0) -> tuple[float, float]:
    """(mean saturation, share of flat blocks)."""
    top, low = rgb.max(2).astype(np.float64), rgb.min(2)
    saturation = np.where(top > 0, (top - low) / np.maximum(top, 1), 0).mean()
    by, bx = max(1, gray.shape[0] // block), max(1, gray.shape[1] // block)
    cells = nearest(gray, bx * block, by * block).reshape(by, block, bx, block).astype(np.float64)
    return float(saturation), float((cells.std((1, 3)) < limit).mean())


def openness(gray: np.ndarray, cx: float, cy: float, radius: float) -> float | None:
    """How open an eye is: mean difference between the samples above and below, over 64."""
    r = max(1, round(radius))
    x0, x1 = max(0, round(cx) - r), min(gray.shape[1], round(cx) + r)
    y0, y1 = max(1, round(cy) - r), min(gray.shape[0] - 1, round(cy) + r)
    if x1 <= x0 or y1 <= y0:
        return None
    g = gray.astype(np.float64)
    return float(np.clip(np.abs(g[y0 - 1 : y1 - 1, x0:x1] - g[y0 + 1 : y1 + 1, x0:x1]).mean() / 64, 0, 1))


MEASURES = "width int, height int, sharpness double, exposure double, contrast double, highlight_clipping double, shadow_clipping double, mean_saturation double, flat_fraction double, perceptual_hash string, phash long, phash_contrast double, red double, green double, blue double, error string"


def measure(pictures: DataFrame, edge: int = 512) -> DataFrame:
    """One row of measures for each picture: id, width, height, orientation, pixels (bytes). A map: no shuffle."""
    names = ["id", *(c.split()[0] for c in MEASURES.split(", "))]

    def one(key, width, height, orientation, pixels) -> dict:
        row: dict = dict.fromkeys(names)
        row |= {"id": key, "width": width, "height": height}
        try:
            if width is None or height is None or pixels is None:
                raise ValueError("no pixels")
            if width < 1 or height < 1 or width * height > MOST_PIXELS or max(width, height) > MOST_SIDE or len(pixels) > MOST_BYTES:
                raise ValueError("size out of bounds")
            rgb = np.frombuffer(pixels, np.uint8).reshape(int(height), int(width), 3)
            rgb = bounded(oriented(rgb, None if orientation is None or orientation != orientation else int(orientation)), edge)
            gray = luma(rgb)
            bits, contrast, color = frequency_hash(rgb)
            saturation, flat = flatness(rgb, gray)
            row |= exposure(gray) | {"sharpness": laplacian(gray), "mean_saturation": saturation, "flat_fraction": flat, "perceptual_hash": difference_hash(gray), "phash": bits, "phash_contrast": contrast, "red": float(color[0]), "green": float(color[1]), "blue": float(color[2])}
        except (ValueError, TypeError) as e:
            row["error"] = str(e)[:500]
        return row

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [one(*r) for r in f.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=names).astype({"phash": "Int64", "width": "Int32", "height": "Int32"})

    return pictures.select("id", "width", "height", "orientation", "pixels").mapInPandas(run, f"id {pictures.schema['id'].dataType.simpleString()}, {MEASURES}")
