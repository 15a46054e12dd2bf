"""Rasters and size budgets.

Pixels come from Spark's image source (rows of bytes, channels in the order blue, green, red, alpha); work on them is
numpy over Arrow batches. Choices among encoded variants are plain aggregations.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

# Tries of the quality ladder, the scan shape and the limits of images that may be coded again.
LADDER = ((0.85, 1.0), (0.75, 1.0), (0.65, 1.0), (0.55, 1.0), (0.45, 1.0), (0.35, 1.0), (0.25, 1.0), (0.7, 0.85), (0.6, 0.85), (0.5, 0.85))
INK_SHARE, INK_BELOW = 0.004, 245
MAX_AREA, SCAN_SIDE, SCAN_CAP = 30_000_000, 900, 2800


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images of a folder with their sides; unreadable ones are dropped."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")


@F.pandas_udf(BinaryType())
def _inverted(data: pd.Series, channels: pd.Series) -> pd.Series:
    def one(raw: bytes, n: int) -> bytes:
        px = np.frombuffer(raw, dtype=np.uint8).reshape(-1, n).copy()
        px[:, : min(n, 3)] = 255 - px[:, : min(n, 3)]
        return px.tobytes()

    return pd.Series([one(d, n) for d, n in zip(data, channels, strict=True)], dtype=object)


def invert(images: DataFrame) -> DataFrame:
    """Colours inverted, alpha as it was."""
    return images.withColumn("data", _inverted("data", "nChannels"))


@F.pandas_udf(DoubleType())
def _ink(data: pd.Series, channels: pd.Series) -> pd.Series:
    def one(raw: bytes | None, n: int) -> float | None:
        if not raw or not n:
            return None
        px = np.frombuffer(raw, dtype=np.uint8).reshape(-1, n)[:, : min(n, 3)]
        return float((px < INK_BELOW).any(axis=1).mean())

    return pd.Series([one(d, n) for d, n in zip(data, channels, strict=True)], dtype=float)


def ink_ratio(images: DataFrame) -> DataFrame:
    """Share of pixels with any colour below 245, and whether that leaves a page blank; unreadable ones are not blank."""
    return images.withColumn("ink", _ink("data", "nChannels")).withColumn("is_blank", F.coalesce(F.col("ink") < INK_SHARE, F.lit(False)))


def crop(images: DataFrame) -> DataFrame:
    """Pixels inside ``crop_x, crop_y, crop_w, crop_h``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cut = []
            for r in batch.itertuples(index=False):
                px = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels)
                cut.append(px[r.crop_y : r.crop_y + r.crop_h, r.crop_x : r.crop_x + r.crop_w])
            yield batch.assign(data=[c.tobytes() for c in cut], height=[c.shape[0] for c in cut], width=[c.shape[1] for c in cut])

    return images.mapInPandas(run, images.schema)


def target_dims(images: DataFrame, cap: int, protect_scans: bool = True) -> DataFrame:
    """Sides scaled so that none is over the cap; scan-shaped images have a cap of at least 2800 in protected presets."""
    long_, short = F.greatest("width_px", "height_px"), F.least("width_px", "height_px")
    ratio = long_ / short
    is_scan = (short >= SCAN_SIDE) & (ratio > 1.2) & (ratio < 1.75)
    most = F.when(is_scan, F.greatest(F.lit(cap), F.lit(SCAN_CAP))).otherwise(cap) if protect_scans else F.lit(cap)
    scale = F.least(F.lit(1.0), most / long_)
    side = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * scale + 0.5))
    return images.select("*", is_scan.alias("is_scan"), side("width_px").alias("new_w"), side("height_px").alias("new_h"))


def recompressible(images: DataFrame) -> DataFrame:
    """``may_recode`` of image objects: subtype, one known filter, no mask, plain colour, eight bits, area and predictor."""
    plain = F.col("color_space").isin("DeviceRGB", "DeviceGray") | ((F.col("color_space") == "ICCBased") & F.col("components").isin(1, 3))
    predictor = F.col("predictor").isNull() | (F.col("predictor") == 1) | F.col("predictor").between(10, 15)
    ok = (F.col("subtype") == "Image") & F.col("filter").isin("DCTDecode", "FlateDecode") & ~F.col("soft_mask") & plain & (F.col("bits") == 8) & (F.col("width_px") * F.col("height_px") <= MAX_AREA) & predictor
    return images.withColumn("may_recode", F.coalesce(ok, F.lit(False)))


def variant_grid(steps: int = 65) -> list[tuple[float, float, int]]:
    """(t, quality, max side) from best to smallest: quality .92 to .3 and side 3000 to 700 along t."""
    return [(i / (steps - 1), 0.92 - 0.62 * i / (steps - 1), int(3000 - 2300 * i / (steps - 1) + 0.5)) for i in range(steps)]


def variant_at(t: float) -> tuple[float, int]:
    """Quality and longest side along t, from .92 and 3000 to .3 and 700."""
    return 0.92 - 0.62 * t, int(3000 - 2300 * t + 0.5)


def encoded(pixels: np.ndarray, quality: float, most: int) -> bytes:
    """A raster coded smaller: every so manieth point where a side is over ``most``, colours rounded to steps that grow as quality falls, then deflated."""
    high, wide = pixels.shape[:2]
    scale = min(1.0, most / max(high, wide, 1))
    rows, columns = ((np.arange(max(1, int(n * scale + 0.5))) / scale).astype(int).clip(0, n - 1) for n in (high, wide))
    step = max(1, int(round((1 - quality) * 64)))
    return zlib.compress((pixels[rows][:, columns] // step * step).astype(np.uint8).tobytes(), 6)


def search_variant(images: DataFrame, budget: int, steps: int = 6) -> DataFrame:
    """(key, t, out_bytes, achieved) of images (key, width, height, nChannels, data, bytes): the best quality whose coded raster fits the budget.

    An image that fits as it is keeps its bytes and has no t. Others are coded and measured at ``steps`` points that halve t
    from 0 to 1: upwards in quality after a fit, downwards after a miss. Where none fits the smallest that was measured is taken. A row without
    pixels keeps its bytes too.
    """

    def search(raw: bytes, high: int, wide: int, n: int) -> tuple[float, int, bool]:
        pixels = np.frombuffer(raw, dtype=np.uint8).reshape(high, wide, n)
        low, top, least, fit = 0.0, 1.0, None, None
        for _ in range(steps):
            t = (low + top) / 2
            size = len(encoded(pixels, *variant_at(t)))
            if least is None or size < least[1]:
                least = (t, size)
            if size <= budget:
                fit, top = (t, size), t
            else:
                low = t
        return (*(fit or least), fit is not None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                kept = r.bytes <= budget or not r.data or not r.width or not r.height
                rows.append((r.key, None, r.bytes, bool(r.bytes <= budget)) if kept else (r.key, *search(r.data, r.height, r.width, r.nChannels)))
            yield pd.DataFrame(rows, columns=["key", "t", "out_bytes", "achieved"])

    return images.select("key", "width", "height", "nChannels", "data", "bytes").mapInPandas(run, "key long, t double, out_bytes long, achieved boolean")


def _with_budget(variants: DataFrame, assets: DataFrame, budget: Column) -> DataFrame:
    """Variants with their asset's budget, both dealt by asset: no table of assets is broadcast, and rows come sorted to what sums them."""
    return variants.join(assets.select("asset_id", budget.alias("_budget")).hint("merge"), "asset_id")


def choose_variant(assets: DataFrame, variants: DataFrame, budget: Column) -> DataFrame:
    """Per asset: itself if it fits the budget, else the variant of lowest t that does, else the smallest, with ``achieved``."""
    v = _with_budget(variants, assets, budget)
    fitting = F.min_by(F.struct("t", F.col("bytes").alias("size")), F.when(F.col("bytes") <= F.col("_budget"), F.col("t")))
    best = v.groupBy("asset_id").agg(fitting.alias("_fit"), F.min_by(F.struct("t", F.col("bytes").alias("size")), F.struct("bytes", "t")).alias("_least"))
    found = assets.withColumn("_budget", budget).hint("merge").join(best, "asset_id", "left")
    kept = F.col("bytes") <= F.col("_budget")
    pick = F.coalesce("_fit", "_least")
    return found.select("asset_id", F.when(~kept, pick["t"]).alias("t"), F.when(kept, F.col("bytes")).otherwise(F.coalesce(pick["size"], F.col("bytes"))).alias("out_bytes"), (kept | F.col("_fit").isNotNull()).alias("achieved"))


def ladder_choice(assets: DataFrame, tries: DataFrame, budget: Column) -> DataFrame:
    """Per asset, of its tries (asset_id, step, bytes): the first that fits, else the smallest; the original if that is not smaller."""
    t = _with_budget(tries, assets, budget)
    pair = F.struct("step", F.col("bytes").alias("size"))
    best = t.groupBy("asset_id").agg(F.min_by(pair, F.when(F.col("bytes") <= F.col("_budget"), F.col("step"))).alias("_fit"), F.min_by(pair, F.struct("bytes", "step")).alias("_least"))
    found = assets.hint("merge").join(best, "asset_id", "left")
    pick = F.coalesce("_fit", "_least")
    smaller = F.coalesce(pick["size"] < F.col("bytes"), F.lit(False))
    return found.select("asset_id", F.when(smaller, pick["step"]).alias("step"), F.when(smaller, pick["size"]).otherwise(F.col("bytes")).alias("out_bytes"))


def apply_savings_rule(df: DataFrame, target_mode: bool = False) -> DataFrame:
    """``kept``: the original where the output is not smaller, or, without a target, where it saves under 4 percent."""
    saved = (F.col("bytes") - F.col("out_bytes")) / F.col("bytes")
    original = F.col("out_bytes") >= F.col("bytes") if target_mode else (F.col("out_bytes") >= F.col("bytes")) | (saved < 0.04)
    return df.withColumn("kept", F.when(original, "original").otherwise("output")).withColumn("out_bytes", F.when(original, F.col("bytes")).otherwise(F.col("out_bytes")))


def savings_report(df: DataFrame, key: str) -> DataFrame:
    """Bytes before and after and the percent saved, per key and, with a null key, in all."""
    sums = df.rollup(key).agg(F.sum("bytes").alias("before"), F.sum("out_bytes").alias("after"))
    return sums.withColumn("percent", F.when(F.coalesce("before", F.lit(0)) == 0, F.lit(0)).otherwise(F.floor((F.col("before") - F.col("after")) / F.col("before") * 100 + 0.5)).cast("long"))


def images_to_pages(images: DataFrame) -> DataFrame:
    """A page of its own size for each readable image, in order of name."""
    ok = images.where((F.col("width_px") > 0) & (F.col("height_px") > 0))
    return ok.select("doc_id", "image_no", F.col("width_px").cast("double").alias("width_pt"), F.col("height_px").cast("double").alias("height_pt"), F.lit(0).alias("rotation"))
