"""Pixel operators on raw bitmaps (height x width x channels, one byte each)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, WHITE = 2, 255
SCHEMA = "doc_id string, qid string, height int, width int, channels int, pixels binary"


def crop(page: np.ndarray, y0: float, y1: float, scale: int = SCALE) -> np.ndarray:
    """Full width, rows y0 to y1, each pixel ``scale`` times in both directions, no alpha channel."""
    part = page[max(0, int(y0)) : int(np.ceil(y1)), :, :3]
    return part.repeat(scale, axis=0).repeat(scale, axis=1)


def layout(content: bytes, page: int) -> np.ndarray:
    """A page of a PDF file as black boxes where its text stands, one pixel a unit: enough to check crops where no rasteriser is installed."""
    from folioflow.sources import pdf

    width, height, spans = pdf.read(content)[page]
    image = np.full((int(np.ceil(height)), int(np.ceil(width)), 3), WHITE, np.uint8)
    for *_, x0, y0, x1, y1 in spans:
        image[max(0, int(y0)) : max(0, int(np.ceil(y1))), max(0, int(x0)) : max(0, int(np.ceil(x1)))] = 0
    return image


def png(image: np.ndarray) -> bytes:
    """A bitmap of one, three or four channels as a PNG file."""
    height, width, channels = image.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(height, width * channels)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def merge_down(parts: list[np.ndarray]) -> np.ndarray | None:
    """One below the other, filled up with white at the right; nothing gives nothing, one gives itself."""
    if not parts:
        return None
    if len(parts) == 1:
        return parts[0]
    width = max(p.shape[1] for p in parts)
    return np.vstack([np.pad(p, ((0, 0), (0, width - p.shape[1]), (0, 0)), constant_values=WHITE) for p in parts])


def item_images(crops: DataFrame) -> DataFrame:
    """One image per item from the crops of its pages (doc_id, qid, page, height, width, channels, pixels)."""

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, r.channels) for r in rows.sort_values("page").itertuples()]
        image = merge_down(parts)
        return pd.DataFrame([{"doc_id": rows.doc_id.iloc[0], "qid": rows.qid.iloc[0], "height": image.shape[0], "width": image.shape[1], "channels": image.shape[2], "pixels": image.tobytes()}])

    return crops.groupBy("doc_id", "qid").applyInPandas(merged, SCHEMA)


def item_crops(segments: DataFrame, files: DataFrame, raster: Callable[[bytes, int], np.ndarray] = layout, scale: int = SCALE) -> DataFrame:
    """(doc_id, qid, page, height, width, channels, pixels): each segment (doc_id, qid, page, y0, y1) cut out of its page; ``raster`` draws a page of a file (doc_id, content). A segment without height gives nothing."""

    def cut(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        pages, found = {}, []
        for r in rows.itertuples() if len(held) else ():
            if r.page not in pages:
                pages = {r.page: raster(held.content.iloc[0], int(r.page))}
            image = crop(pages[r.page], r.y0, r.y1, scale)
            if image.size:
                found.append((r.doc_id, r.qid, int(r.page), *image.shape, image.tobytes()))
        return pd.DataFrame(found, columns=["doc_id", "qid", "page", "height", "width", "channels", "pixels"])

    ordered = segments.sortWithinPartitions("doc_id", "page")
    return ordered.groupBy("doc_id").cogroup(files.select("doc_id", "content").groupBy("doc_id")).applyInPandas(cut, "doc_id string, qid string, page int, height int, width int, channels int, pixels binary")


def as_png(images: DataFrame) -> DataFrame:
    """(doc_id, qid, path, content): images as PNG files named ``problems/{doc_id}_{qid}.png``."""

    @F.pandas_udf("binary")
    def encoded(pixels: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([png(np.frombuffer(p, np.uint8).reshape(h, w, c)) for p, h, w, c in zip(pixels, height, width, channels, strict=True)])

    path = F.concat(F.lit("problems/"), F.col("doc_id"), F.lit("_"), F.col("qid"), F.lit(".png"))
    return images.select("doc_id", "qid", path.alias("path"), encoded("pixels", "height", "width", "channels").alias("content"))


def image_map(questions: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, kind, qid, path) for each question, with an empty path where there is no image; an id shared by kinds shares its image."""
    left = questions.filter("qid <> ''").select("doc_id", "kind", "qid")
    return left.join(images.select("doc_id", "qid", "path"), ["doc_id", "qid"], "left").select("doc_id", "kind", "qid", F.coalesce("path", F.lit("")).alias("path"))


def with_images(questions: DataFrame, images: DataFrame) -> DataFrame:
    """``questions`` with ``images``, an array of (label, content) of those there are; a question without an image has an empty one."""
    side = images.filter("content is not null").groupBy("doc_id", "qid").agg(F.collect_list(F.struct(F.concat(F.lit("question "), F.col("qid")).alias("label"), "content")).alias("images"))
    none = F.array().cast("array<struct<label:string,content:binary>>")
    return questions.join(side, ["doc_id", "qid"], "left").withColumn("images", F.coalesce("images", none))
