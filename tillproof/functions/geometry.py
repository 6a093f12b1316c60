"""Boxes, crops and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import round_half_up


def centre_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def centre_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def sigma_for(width: Column) -> Column:
    """The blur radius that suits an image of this width."""
    return F.least(F.lit(6.0), F.greatest(F.lit(1.5), width.cast("double") / 900 * 1.5))


def fitted(width: Column, height: Column, longest: int = 3000) -> Column:
    """Width and height scaled down, never up, to a longest edge; null where there are no pixels."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.nullif(F.greatest(width, height), F.lit(0)).cast("double"))
    size = lambda v: F.greatest(F.lit(1), round_half_up(v * scale))
    return F.when((width > 0) & (height > 0), F.struct(size(width).alias("width"), size(height).alias("height")))


def guide_source_rect(fw: Column, fh: Column, ew: Column, eh: Column, gx: Column, gy: Column, gw: Column, gh: Column) -> Column:
    """The pixels of a frame under a guide drawn on an element that the frame covers, cropped about its centre."""
    known = (ew > 0) & (eh > 0) & (fw > 0) & (fh > 0)
    element, frame = ew.cast("double") / F.nullif(eh, F.lit(0)), fw.cast("double") / F.nullif(fh, F.lit(0))
    narrow = F.greatest(F.lit(1), round_half_up(fh * element))
    low = F.greatest(F.lit(1), round_half_up(fw / F.nullif(element, F.lit(0.0))))
    wide, tall = F.coalesce(known & (frame > element), F.lit(False)), F.coalesce(known & (frame < element), F.lit(False))
    sw, sh = F.when(wide, narrow).otherwise(fw), F.when(tall, low).otherwise(fh)
    sx = F.when(wide, F.floor((fw - narrow) / 2)).otherwise(0)
    sy = F.when(tall, F.floor((fh - low) / 2)).otherwise(0)
    part = lambda v, g: round_half_up(v * g)
    return F.struct(
        (sx + part(sw, gx)).cast("bigint").alias("sx"),
        (sy + part(sh, gy)).cast("bigint").alias("sy"),
        F.greatest(F.lit(1), part(sw, gw)).cast("bigint").alias("sw"),
        F.greatest(F.lit(1), part(sh, gh)).cast("bigint").alias("sh"),
    )
