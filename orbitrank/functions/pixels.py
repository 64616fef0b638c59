"""Pixel arithmetic on band arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scene classes that are not clear ground, and the order bands
# are stored in the multispectral archive.
MASKED_SCENE_CLASSES = (0, 1, 3, 7, 8, 9, 10, 11)
ARCHIVE_BAND_ORDER = (
    "B01", "B02", "B03", "B04", "B05", "B06", "B07",
    "B08", "B09", "B10", "B11", "B12", "B8A",
)
REFLECTANCE_SCALE = 0.0001


def masked_pixels(
    bands: Sequence[Column], nodata: Column | None = None, scene_class: Column | None = None
) -> Column:
    """Array of booleans, true where any band is empty or the scene class is masked."""
    mask = F.transform(bands[0], lambda dn: dn.isNull() | (dn == 0))
    for band in bands[1:]:
        mask = F.zip_with(mask, band, lambda m, dn: m | dn.isNull() | (dn == 0))
    if nodata is not None:
        mask = F.zip_with(mask, nodata, lambda m, n: m | n)
    if scene_class is not None:
        mask = F.zip_with(
            mask, scene_class, lambda m, c: m | c.isNull() | c.isin(*MASKED_SCENE_CLASSES)
        )
    return mask


def reflectance_offset(baseline: Column) -> Column:
    """Additive offset introduced with processing baseline 4.00; NULL when invalid."""
    value = F.trim(baseline).try_cast("decimal(6,2)")
    return F.when(value >= 4, F.lit(-0.1)).when(value > 0, F.lit(0.0))


def reflectance(dn: Column, offset: Column) -> Column:
    offsets = F.array_repeat(offset, F.size(dn))
    return F.zip_with(dn.cast("array<double>"), offsets, lambda x, o: x * REFLECTANCE_SCALE + o)


def rgb_stretch(values: Column, mask: Column, low: float, high: float) -> Column:
    """Clip to [low, high], scale to 0..255 rounding half to even; masked pixels are 0."""
    def scale(x: Column) -> Column:
        unit = (x - low) / (high - low)
        return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), unit)) * 255.0).cast("int")

    return F.zip_with(
        values.cast("array<double>"), mask, lambda x, m: F.when(m, F.lit(0)).otherwise(scale(x))
    )


_STORED_AT = {name: place for place, name in enumerate(ARCHIVE_BAND_ORDER)}


def reorder_bands(bands: Column, wanted: Sequence[str]) -> Column:
    """The ``wanted`` bands of an archive row, each looked up by its stored place."""
    places = dict.fromkeys(wanted)
    if len(places) < len(wanted) or not places.keys() <= _STORED_AT.keys():
        raise ValueError(f"wanted bands must be distinct names of the archive: {', '.join(wanted)}")
    return F.array(*[bands[_STORED_AT[name]] for name in places])


def scale_reflectance(bands: Column) -> Column:
    """Clip every digital number to 0..10000 and divide by 10000."""
    def clip(x: Column) -> Column:
        return F.least(F.lit(10_000.0), F.greatest(F.lit(0.0), x.cast("double"))) / 10_000.0

    return F.transform(bands, lambda band: F.transform(band, clip))


def standardise(bands: Column, means: Sequence[float], stds: Sequence[float]) -> Column:
    """Subtract one mean and divide by one deviation per band."""
    if len(means) != len(stds) or any(s <= 0 for s in stds):
        raise ValueError("need one mean and one positive deviation per band")
    stats = F.array(*[
        F.struct(F.lit(float(m)).alias("mean"), F.lit(float(s)).alias("std"))
        for m, s in zip(means, stds, strict=True)
    ])
    return F.zip_with(
        bands,
        stats,
        lambda band, st: F.transform(band, lambda x: (x.cast("double") - st["mean"]) / st["std"]),
    )
