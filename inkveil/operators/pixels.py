"""Masking of picture regions, in numpy inside tasks, over Spark's image rows (height, width, nChannels, data)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.rules import RulePack
from inkveil.operators.boxes import padded

METHODS = ("mosaic", "blur", "black", "whole")


def mosaic(region: np.ndarray, block: int = 16) -> np.ndarray:
    """Nearest pixel of a grid of at least 2 x 2 cells."""
    h, w = region.shape[:2]
    rows, columns = max(2, h // block), max(2, w // block)
    y, x = np.arange(h) * rows // h, np.arange(w) * columns // w
    return region[(y * h // rows)][:, (x * w // columns)]


def blur(region: np.ndarray, radius: int = 15) -> np.ndarray:
    """Separable Gaussian of 2 * radius + 1 pixels, edges reflected."""
    size = 2 * radius + 1
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    out = region.astype(float)
    for axis in (0, 1):
        pad = [(radius, radius) if a == axis else (0, 0) for a in range(out.ndim)]
        wide = np.pad(out, pad, mode="reflect" if region.shape[axis] > radius else "symmetric")
        out = sum(k * np.take(wide, np.arange(i, i + region.shape[axis]), axis) for i, k in enumerate(kernel))
    return np.rint(out).clip(0, 255).astype(np.uint8)


def masked(picture: np.ndarray, boxes: list[tuple[int, int, int, int]], method: str) -> np.ndarray:
    out = picture.copy()
    for x1, y1, x2, y2 in boxes:
        region = out[y1:y2, x1:x2]
        if region.size:
            out[y1:y2, x1:x2] = {"mosaic": mosaic, "blur": blur, "black": np.zeros_like, "whole": shrunk}[method](region)
    return out


def shrunk(picture: np.ndarray, factor: int = 8) -> np.ndarray:
    """Mosaic of a whole picture: cells of `factor` pixels, one cell at least."""
    h, w = picture.shape[:2]
    rows, columns = max(1, h // factor), max(1, w // factor)
    y, x = np.arange(h) * rows // h, np.arange(w) * columns // w
    return picture[y * h // rows][:, x * w // columns]


def statistics(picture: np.ndarray) -> tuple[float, float, float, int]:
    """Standard deviation of grey levels, share of edge pixels, share of pixels above Otsu's threshold, number of grey levels."""
    grey = picture.mean(2) if picture.ndim == 3 else picture.astype(float)
    gy, gx = (np.gradient(grey, axis=a) if grey.shape[a] > 1 else np.zeros_like(grey) for a in (0, 1))
    levels = np.bincount(grey.astype(np.uint8).ravel(), minlength=256) / grey.size
    w, m = levels.cumsum(), (levels * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((m[-1] * w - m) ** 2 / (w * (1 - w)), posinf=0)
    fill = (grey.astype(np.uint8) > between.argmax()).mean()
    return float(grey.std()), float((np.hypot(gx, gy) > 50).mean()), float(fill), int((levels > 0).sum())


def joined(boxes: list[tuple[int, int, int, int]], gap: int = 50) -> list[tuple[int, int, int, int]]:
    """Boxes in the order of their left sides; one that begins within `gap` of the last one's right side and meets it in height becomes part of it."""
    out: list[tuple[int, int, int, int]] = []
    for x1, y1, x2, y2 in sorted(boxes, key=lambda b: b[0]):
        a = out[-1] if out else None
        if a is not None and x1 - a[2] < gap and y2 >= a[1] and y1 <= a[3]:
            out[-1] = a[0], min(a[1], y1), max(a[2], x2), max(a[3], y2)
        else:
            out.append((x1, y1, x2, y2))
    return out


def is_logo(region: np.ndarray, least_std: int = 60) -> bool:
    """Whether a region looks like a logo, as `logo_region` says of statistics."""
    if not region.size:
        return False
    std, edges, fill, _ = statistics(region)
    return std < least_std or (edges > 0.05 and fill > 0.3) or fill > 0.6


def _redacted(frames: Iterator[pd.DataFrame], method: str) -> Iterator[pd.DataFrame]:
    plain = lambda boxes: [(b["x1"], b["y1"], b["x2"], b["y2"]) for b in (boxes if boxes is not None else ())]
    for frame in frames:
        out = []
        for r in frame.itertuples():
            data, texts, logos = r.data, plain(r.boxes), []
            if r.height > 0:
                picture = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                logos = joined([b for b in plain(r.marks) if is_logo(picture[b[1] : b[3], b[0] : b[2]])])
                data = masked(masked(picture, texts, method), logos, "mosaic").tobytes()
            out.append((r.path, r.height, r.width, r.nChannels, data, len(texts), len(logos)))
        yield pd.DataFrame(out, columns=["path", "height", "width", "nChannels", "data", "n_texts", "n_logos"])


def redacted(pictures: DataFrame, ocr: DataFrame, pack: RulePack, method: str = "mosaic", pad: int = 3) -> DataFrame:
    """path, height, width, nChannels, data, n_texts, n_logos: pictures (of sources.pictures.read) with the text boxes that `pack` changes masked, and a mosaic over the logos beside texts that name a bank.

    ocr: path, text, left, top, width, height of the text boxes that a reader outside Spark has found. Logos are looked for in the pixels as they were; those that are near each other become one region.
    """
    if method not in METHODS[:3]:
        raise ValueError(f"method is none of {METHODS[:3]}")
    sizes = pictures.select("path", F.col("width").alias("page_width"), F.col("height").alias("page_height"))
    page = F.col("page_width"), F.col("page_height")
    place = [F.col(c) for c in ("left", "top", "width", "height")]
    rows = ocr.join(sizes, "path").withColumn("masked", pack.apply(F.trim("text")))
    box = F.when((F.trim("text") != "") & (F.col("masked") != F.trim("text")), padded(*place, pad, *page))
    mark = F.when(F.col("text").contains("银行"), logo_box(*place, *page))
    found = rows.select("path", F.struct("top", "left", "text").alias("at"), box.alias("box"), mark.alias("mark")).filter("box is not null or mark is not null")
    listed = lambda c: F.filter(F.transform(F.sort_array(F.collect_list(F.struct("at", c))), lambda x: x[c]), lambda x: x.isNotNull()).alias(f"{c}s")
    regions = found.groupBy("path").agg(listed("box"), listed("mark"))
    regions = regions.select("path", F.col("boxs").alias("boxes"), "marks")
    columns = "path string, height int, width int, nChannels int, data binary, n_texts int, n_logos int"
    return pictures.join(regions, "path", "left").mapInPandas(partial(_redacted, method=method), columns)


def _masked(frames: Iterator[pd.DataFrame], method: str) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for r in frame.itertuples():
            picture = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
            boxes = [(b["x1"], b["y1"], b["x2"], b["y2"]) for b in (r.boxes if r.boxes is not None else ())]
            boxes = boxes if method != "whole" else [(0, 0, r.width, r.height)]
            out.append((r.origin, r.height, r.width, r.nChannels, masked(picture, boxes, method).tobytes(), *statistics(picture)))
        yield pd.DataFrame(out, columns=["origin", "height", "width", "nChannels", "data", "std", "edges", "fill", "levels"])


def mask(images: DataFrame, method: str = "mosaic") -> DataFrame:
    """Pictures (origin, height, width, nChannels, data) with their `boxes` masked (method `whole`: all of the picture), and statistics of the unmasked picture."""
    if method not in METHODS:
        raise ValueError(f"method is none of {METHODS}")
    rows = images.select("origin", "height", "width", "nChannels", "data", "boxes")
    return rows.mapInPandas(partial(_masked, method=method), "origin string, height int, width int, nChannels int, data binary, std double, edges double, fill double, levels int")


def logo_region(std: Column, edges: Column, fill: Column, least_std: int = 60) -> Column:
    """Whether a region's statistics are those of a logo (50 for pages, 60 for pictures)."""
    return (std < least_std) | ((edges > 0.05) & (fill > 0.3)) | (fill > 0.6)


def logo_box(left: Column, top: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Where a bank's logo is looked for: 320 pixels before a text that names the bank and 60 around it, 20 behind it, inside the page."""
    zero = F.lit(0)
    return F.struct(
        F.greatest(left - 320, zero).cast("int").alias("x1"), F.greatest(top - 60, zero).cast("int").alias("y1"),
        F.least(left + width + 20, page_width).cast("int").alias("x2"), F.least(top + height + 60, page_height).cast("int").alias("y2"),
    )
