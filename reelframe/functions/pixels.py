"""Picture geometry and colour, as expressions over integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe import catalog


def _up(x: Column, d: Column) -> Column:
    return F.floor((x + d - 1) / d).cast("long")


def planes(pictures: DataFrame, width: str, height: str, pixel_format: str) -> DataFrame:
    """pictures with a row for each plane: plane, plane_width, plane_height, stride, plane_bytes.

    A stride is rounded up to 16 bytes.
    """
    dim = F.broadcast(catalog.dimension(pictures.sparkSession, "pixel_formats")).withColumnRenamed("name", "__format")
    out = pictures.join(dim, F.col(pixel_format) == F.col("__format")).withColumn("plane", F.explode(F.sequence(F.lit(0), F.col("planes") - 1)))
    w, h, first, palette = F.col(width).cast("long"), F.col(height).cast("long"), F.col("plane") == 0, F.col("__format") == "pal8"
    out = out.withColumn("plane_width", F.when(first, w).when(palette, F.lit(256)).otherwise(_up(w, F.col("sub_x"))))
    out = out.withColumn("plane_height", F.when(first, h).when(palette, F.lit(1)).otherwise(_up(h, F.col("sub_y"))))
    out = out.withColumn("stride", aligned(F.col("plane_width") * F.when(first, F.col("bpp0")).otherwise(F.col("bpp1"))))
    return out.withColumn("plane_bytes", F.col("stride") * F.col("plane_height")).drop("__format", "bpp0", "bpp1", "sub_x", "sub_y", "planes", "bits")


def aligned(n: Column) -> Column:
    return F.shiftleft(F.shiftright(n + 15, 4), 4)


def _clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(255))


def yuv_to_rgb(y: Column, u: Column, v: Column, bits: Column) -> tuple[Column, Column, Column]:
    """BT.709 r, g, b of full-range samples of this many bits; float32, each term truncated."""
    scale = (F.lit(255.0).cast("float") / (F.call_function("shiftleft", F.lit(1), bits.cast("int")) - 1).cast("float")).cast("float")
    level = lambda x: (x.cast("float") * scale).cast("float").cast("int")
    term = lambda k, x: (F.lit(k).cast("float") * x.cast("float")).cast("float").cast("int")
    yi, ui, vi = level(y), level(u) - 128, level(v) - 128
    # The BT.709 coefficients.
    return _clamp(yi + term(1.5748, vi)), _clamp(yi - term(0.1873, ui) - term(0.4681, vi)), _clamp(yi + term(1.8556, ui))


def chroma_index(sub_x: Column, sub_y: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Where the chroma sample of a pixel is."""
    return F.floor(x / sub_x).cast("long"), F.floor(y / sub_y).cast("long")


def pack_rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    """a, b, g, r from the most significant byte of an unsigned 32-bit number down."""
    return a.cast("long") * 16777216 + b.cast("long") * 65536 + g.cast("long") * 256 + r.cast("long")


def rgb555(v: Column) -> tuple[Column, Column, Column]:
    """r, g, b of a 16-bit 5-5-5 pixel, each shifted left by 3."""
    part = lambda k: F.shiftleft(F.shiftright(v, k).bitwiseAND(31), 3)
    return part(10), part(5), part(0)


def palette_colour(palette: Column, index: Column) -> Column:
    """The colour at an index, null outside the palette."""
    return F.get(palette, index)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, Column, Column]:
    """(1 - c)(1 - k) * 255 in float32, truncated."""
    one, top = F.lit(1.0).cast("float"), F.lit(255.0).cast("float")
    left = lambda x: (one - (x.cast("float") / top).cast("float")).cast("float")
    return tuple(((left(x) * left(k)).cast("float") * top).cast("float").cast("int") for x in (c, m, y))


def with_alpha(r: Column, g: Column, b: Column, a: Column | None = None) -> Column:
    return pack_rgba(r, g, b, F.lit(255) if a is None else a)
