"""Queries of paired images, which are made from vectors: sixteen of them are the rows of an image."""

from pyspark.sql import functions as F

from plumbline.operators import images
from plumbline.registry import query
from plumbline.tables import table


@query("image_scores", """WITH p AS (SELECT vec_id // 16 AS image, vec_id % 16 AS y, x, (embedding[x + 1]::DOUBLE + 1) / 2 AS a FROM embeddings, range(64) t(x)),
    q AS (SELECT *, a * 0.9 + (x % 3) * 0.03::DOUBLE AS b, (x * 7 + y * 13) % 811 <> 0 AS keep FROM p),
    k AS (SELECT d - 5 AS d, exp(-((d - 5) ** 2) / 4.5) / sum(exp(-((d - 5) ** 2) / 4.5)) OVER () AS w FROM range(11) t(d)),
    s AS (SELECT c.image, c.y, c.x, count(*) FILTER (WHERE n.keep) AS n, sum(i.w * j.w * n.a) AS ma, sum(i.w * j.w * n.b) AS mb, sum(i.w * j.w * n.a * n.a) AS aa, sum(i.w * j.w * n.b * n.b) AS bb, sum(i.w * j.w * n.a * n.b) AS ab
      FROM q c CROSS JOIN k i CROSS JOIN k j JOIN q n ON n.image = c.image AND n.y = c.y + i.d AND n.x = c.x + j.d GROUP BY ALL),
    t AS (SELECT image, avg((2 * ma * mb + 0.0001) / (ma * ma + mb * mb + 0.0001) * (2 * (ab - ma * mb) + 0.0009) / (aa - ma * ma + bb - mb * mb + 0.0009)) AS ssim FROM s WHERE n = 121 GROUP BY image),
    m AS (SELECT image, avg((a - b) ** 2) FILTER (WHERE keep) AS mse FROM q GROUP BY image)
    SELECT image, round(mse, 9) AS mse, round(least(100, 10 * log10(1 / greatest(mse, 1e-10))), 6) AS psnr, round(ssim, 6) AS ssim FROM m LEFT JOIN t USING (image)""")
def image_scores(spark, sf_dir):
    """Mean squared error, PSNR and SSIM of image pairs."""
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("image"), (F.col("vec_id") % 16).alias("y"), F.posexplode("embedding").alias("x", "e"))
    a = (F.col("e").cast("double") + 1) / 2
    pixels = v.select("image", "y", "x", F.lit(0).alias("channel"), a.alias("a"), (a * 0.9 + (F.col("x") % 3) * 0.03).alias("b"), ((F.col("x") * 7 + F.col("y") * 13) % 811 != 0).alias("keep"))
    s = images.scores(pixels)
    return s.select("image", F.round("mse", 9).alias("mse"), F.round("psnr", 6).alias("psnr"), F.round("ssim", 6).alias("ssim"))


@query("uncovered_pixels", """SELECT vec_id // 16 AS image, round(avg(CASE WHEN e < 0.05::DOUBLE THEN 1 ELSE 0 END), 6) AS uncovered FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e FROM embeddings WHERE vec_id % 3 <> 0) GROUP BY 1""")
def uncovered_pixels(spark, sf_dir):
    """The share of supported pixels that are hardly covered."""
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("image"), (F.col("vec_id") % 3 != 0).alias("supported"), F.explode(F.col("embedding").cast("array<double>")).alias("alpha"))
    return images.uncovered(v, 0.05).select("image", F.round("uncovered", 6).alias("uncovered"))
