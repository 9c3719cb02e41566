"""Pixel arithmetic as Column expressions; every function also works inside ``transform`` over a block."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class colours in the order of typed keywords.
PALETTE = (
    "#00c864", "#ff8c1a", "#3aa0ff", "#e152d0", "#ffd11a", "#22d3d3", "#ff5c5c", "#9b7bff", "#dfbf90", "#1414cc",
    "#df90b5", "#aaea2a", "#bc246b", "#ae6432", "#bee887", "#328dae", "#b72aea", "#aea232", "#2aea36", "#324fae",
)
DTYPE_MAX = {"uint8": 255, "uint16": 65535}
REFLECTANCE_SCALE = 10000.0
# Upper limits of the red, green and blue display stretch.
GAMMA_LIMITS = (1700, 1300, 900)


def clip(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def truncate(v: Column, kind: str = "int") -> Column:
    """Toward zero, as a cast to an integer pixel type."""
    return v.cast(kind)


def to_uint8(v: Column) -> Column:
    """16-bit value without its low byte."""
    return F.shiftright(v, 8)


def rescale(v: Column, low: float = 0.0, high: float = 3000.0, dtype: str | None = "uint16") -> Column:
    """Linear display stretch to 0..255; 8-bit input stays as it is."""
    if dtype == "uint8":
        return v
    return truncate(clip((v - low) / (high - low), 0.0, 1.0) * 255.0)


def stretch_gamma(v: Column, limit: float, gamma: float = 0.75) -> Column:
    """Power stretch of one band to 0..255, rounded as the byte output rounds."""
    return F.floor(F.pow(clip(v / limit, 0.0, 1.0), gamma) * 255.0 + 0.5).cast("int")


def ndvi(red: Column, nir: Column) -> Column:
    """Vegetation index; zero where both bands sum to nothing, null without a NIR band."""
    total = nir + red
    return F.when(nir.isNull(), F.lit(None)).when(total > 0, (nir - red) / total).otherwise(0.0)


def ndvi_mask(red: Column, nir: Column, threshold: float = 0.2) -> Column:
    return ndvi(red, nir) >= threshold


def gate(mask: Column, vegetation: Column) -> Column:
    """Model mask and vegetation mask; the gate is open where no index is known."""
    return mask & F.coalesce(vegetation, F.lit(True))


def standardize(v: Column, mean: float, std: float, scale: float = REFLECTANCE_SCALE) -> Column:
    """Reflectance, then zero mean and unit deviation of its band."""
    return (v / scale - mean) / std


def sigmoid(v: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-v))


def score_to_mask(logit: Column, threshold: float = 0.5, quantized: bool = False) -> Column:
    """Probability above the threshold; the resized path stores the probability in one byte first."""
    p = sigmoid(logit)
    if quantized:
        p = F.floor(p * 255.0) / 255.0
    return p > threshold


def argmax_is(scores: Column, target: int) -> Column:
    """The best class of a score array is the target; the first of equal scores counts."""
    return F.array_position(scores, F.array_max(scores)) == target + 1


def hex_channel(color: Column, channel: int, dtype: str = "uint8") -> Column:
    """Red, green or blue of a #rrggbb colour in the range of a pixel type."""
    value = F.conv(F.substring(color, 2 + 2 * channel, 2), 16, 10).cast("double")
    return truncate(value / 255.0 * DTYPE_MAX[dtype])


def blend(v: Column, color: Column, channel: int, opacity: float, dtype: str = "uint8") -> Column:
    """Pixel under a translucent colour, clipped and truncated."""
    mixed = v * (1.0 - opacity) + hex_channel(color, channel, dtype) * opacity
    return truncate(clip(mixed, 0.0, float(DTYPE_MAX[dtype])))


def label_color(label: Column, colors: Mapping[str, str], default: str = "#ff0000") -> Column:
    """Colour of a label, looked up as it is written, else the default."""
    if not colors:
        return F.lit(default)
    table = F.create_map(*[F.lit(v) for kv in colors.items() for v in kv])
    return F.coalesce(F.try_element_at(table, label), F.lit(default))


def palette(index: Column) -> Column:
    """Colour of a class by its place, repeating."""
    return F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (F.pmod(index, F.lit(len(PALETTE))) + 1).cast("int"))


def select_bands(bands: Column, indexes: Sequence[int]) -> Column:
    """Bands in the asked order (from 1); a missing band ends the job with an error."""
    need = max(indexes)
    picked = F.array(*[F.element_at(bands, i) for i in indexes])
    fail = F.raise_error(F.concat(F.lit(f"needs {need} bands, got "), F.size(bands).cast("string")))
    return F.when(F.size(bands) >= need, picked).otherwise(fail.cast("array<int>"))


def display_bands(bands: Column) -> Column:
    """Three display bands: one band is repeated, two become first, second, first."""
    first, second = F.get(bands, F.lit(0)), F.get(bands, F.lit(1))
    return (
        F.when(F.size(bands) == 1, F.array(first, first, first))
        .when(F.size(bands) == 2, F.array(first, second, first))
        .otherwise(F.slice(bands, 1, 3))
    )


def valid(v: Column) -> Column:
    """Zero means no data."""
    return F.nullif(v, F.lit(0))


def tile_origins(length: Column, patch: int, overlap: int) -> Column:
    """Origins every patch minus overlap; edge tiles are cut short."""
    return F.sequence(F.lit(0), length - 1, F.lit(patch - overlap))


def tile_origins_flush(length: Column, tile: int, overlap: int) -> Column:
    """Origins with the last tile flush with the edge; one tile when the image is short."""
    pulled = F.array_sort(
        F.array_distinct(
            F.transform(F.sequence(F.lit(0), F.greatest(length, F.lit(1)) - 1, F.lit(tile - overlap)),
                        lambda p: F.least(p, length - tile))
        )
    )
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(pulled)


def reflect_index(i: Column, n: Column) -> Column:
    """Source index of a reflect-padded position (the edge is not repeated)."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    k = F.pmod(i, period)
    return F.when(k < n, k).otherwise(period - k)


def padded(n: Column, patch: int) -> Column:
    """Length up to the next multiple of the patch."""
    return (F.ceil(n / patch) * patch).cast("int")


def decimation(width: Column, height: Column, probe: int = 1024) -> Column:
    """Read every f-th pixel so that the long side is about ``probe`` pixels (half to even)."""
    return F.greatest(F.lit(1), F.bround(F.greatest(width, height) / probe, 0).cast("int"))


def resized(size: Column, gsd: Column, target: float) -> Column:
    """Pixels of a side at the target resolution, at least one (half to even)."""
    return F.greatest(F.lit(1), F.bround(size * gsd / target, 0).cast("int"))


def downsample_scale(resolution: Column, target: float, projected: Column) -> Column:
    """Scale of a read at a coarser grid; never upsampled, and only for projected rasters."""
    return F.when(projected, F.least(F.lit(1.0), resolution / target)).otherwise(1.0)
