"""Paired images as rows of pixels: image, y, x, channel, a, b (0 to 1) and keep; every pixel of a row of an image is there."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The window and its spread in pixels, the constants of the index for a range of 1, and the bounds of PSNR: fixed values.
WINDOW, SIGMA, C1, C2, MOST_DB, LEAST_MSE = 11, 1.5, 0.01**2, 0.03**2, 100.0, 1e-10


def weights() -> list[float]:
    """The Gaussian weights of a window's places along one axis; they sum to one."""
    raw = [math.exp(-((i - WINDOW // 2) ** 2) / (2 * SIGMA**2)) for i in range(WINDOW)]
    return [v / sum(raw) for v in raw]


def scores(pixels: DataFrame) -> DataFrame:
    """(image, mse, psnr, ssim) over kept pixels and all channels; ssim over windows that lie in kept pixels, null without one.

    A window's weighted means are a weighted sum along rows, then one along columns: only a row, and then a column, of one
    image's channel meets in a task. A pixel whose keep is null, or that has a null value, isn't kept; an image without
    kept pixels has null scores.
    """
    sound = F.coalesce(F.col("keep"), F.lit(False)) & F.col("a").isNotNull() & F.col("b").isNotNull()
    rows = pixels.select("image", "y", "x", "channel", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), sound.alias("keep"))
    mse = rows.groupBy("image").agg(F.avg(F.when(F.col("keep"), (F.col("a") - F.col("b")) ** 2)).alias("mse"))
    means = {"a": F.col("a"), "b": F.col("b"), "aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b"), "ab": F.col("a") * F.col("b"), "n": F.col("keep").cast("double")}
    half, weight = WINDOW // 2, weights()
    for across, along in (("y", "x"), ("x", "y")):
        w = Window.partitionBy("image", "channel", across).orderBy(along)
        at = lambda c, k, w=w: F.lead(c, k).over(w)
        rows = rows.withColumns({f"_{c}": v for c, v in means.items()})
        # Null at the border, where no window fits.
        summed = {c: sum((at(f"_{c}", k) * (1.0 if c == "n" else weight[k + half]) for k in range(-half, half + 1)), F.lit(0.0)) for c in means}
        rows = rows.select("image", "channel", "y", "x", *[v.alias(c) for c, v in summed.items()])
        means = {c: F.col(c) for c in means}
    ma, mb = F.col("a"), F.col("b")
    index = (2 * ma * mb + C1) / (ma * ma + mb * mb + C1) * (2 * (F.col("ab") - ma * mb) + C2) / (F.col("aa") - ma * ma + F.col("bb") - mb * mb + C2)
    ssim = rows.filter(F.col("n") == WINDOW * WINDOW).groupBy("image").agg(F.avg(index).alias("ssim"))
    psnr = F.least(F.lit(MOST_DB), 10 * F.log10(1 / F.greatest(F.col("mse"), F.lit(LEAST_MSE))))
    return mse.join(ssim, "image", "left").select("image", "mse", F.when(F.col("mse").isNotNull(), psnr).alias("psnr"), "ssim")


def uncovered(pixels: DataFrame, threshold: float) -> DataFrame:
    """(image, uncovered): the share of an image's supported pixels (image, alpha, supported) whose alpha is below the threshold."""
    return pixels.filter("supported").groupBy("image").agg(F.avg((F.col("alpha") < threshold).cast("double")).alias("uncovered"))
