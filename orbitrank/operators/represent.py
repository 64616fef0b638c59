"""Representations as distributed jobs: pixels, PCA, pluggable encoders, new items."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitrank.operators.checks import enforce, projection_violations
from orbitrank.operators.topk import exact_topk

# Above this many features the covariance matrix no longer fits one executor
# comfortably, and the basis comes from a distributed SVD of centred rows.
COVARIANCE_FEATURES = 2_048
ARCHIVE_ONLY_BACKENDS = ("ssl4eo-s12", "terramind")


# ---- pixels -----------------------------------------------------------------

def _cubic(x: np.ndarray) -> np.ndarray:
    """Published cubic convolution kernel with a = -0.5."""
    a, x = -0.5, np.abs(x)
    near = ((a + 2) * x - (a + 3)) * x * x + 1
    far = (((x - 5) * x + 8) * x - 4) * a
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def resample_weights(size_in: int, size_out: int) -> np.ndarray:
    """Rows of antialiased cubic weights taking ``size_in`` samples to ``size_out``."""
    scale = size_in / size_out
    stretch = max(scale, 1.0)
    centres = (np.arange(size_out) + 0.5) * scale
    offsets = (np.arange(size_in)[None, :] + 0.5 - centres[:, None]) / stretch
    weights = np.where(np.abs(offsets) < 2, _cubic(offsets), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def _resize(pixels: np.ndarray, size: int) -> np.ndarray:
    """Two 8-bit passes, across then down, as image libraries resample."""
    across = np.einsum("hwc,ow->hoc", pixels, resample_weights(pixels.shape[1], size))
    across = np.clip(np.floor(across + 0.5), 0, 255)
    down = np.einsum("hoc,ph->poc", across, resample_weights(pixels.shape[0], size))
    return np.clip(np.floor(down + 0.5), 0, 255)


def flatten_images(images: DataFrame, size: int) -> DataFrame:
    """Square-resized RGB pixels as one 0..1 vector per image.

    ``images`` has (item_id, height, width, nChannels, data) as the image source
    reads them: rows of blue, green, red bytes, or one grey byte.
    """
    if size < 8:
        raise ValueError("size must be at least 8")

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("height", "width", "nChannels", "data")]
            for height, width, channels, data in zip(*columns, strict=True):
                raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                rgb = raw[:, :, 2::-1] if channels >= 3 else np.repeat(raw[:, :, :1], 3, axis=2)
                out.append((_resize(rgb.astype(np.float64), size) / 255.0).astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array([v.tolist() for v in out], pa.list_(pa.float32()))],
                names=["item_id", "pixels"],
            )

    return images.select("item_id", "height", "width", "nChannels", "data").mapInArrow(
        flatten, "item_id string, pixels array<float>"
    )


# ---- principal components ---------------------------------------------------

@dataclass(frozen=True)
class Projection:
    """Mean and components of a basis fitted on index rows."""

    mean: np.ndarray
    components: np.ndarray
    explained: np.ndarray


def fit_pca(rows: DataFrame, components: int, vector: str = "vector") -> Projection:
    """Fit on the index split only, never looking at labels.

    Components come with an arbitrary sign; compare subspaces, not coordinates.
    """
    index = rows.filter(F.col("split") == "index")
    features = index.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    seen = features.agg(Summarizer.mean(F.col("features")).alias("mean"), F.count(F.lit(1)).alias("n")).first()
    if not seen["n"]:
        raise ValueError("there are no index rows to fit on")
    mean = seen["mean"].toArray()
    if not 1 <= components <= min(seen["n"], len(mean)):
        raise ValueError(f"{min(seen['n'], len(mean))} components can be fitted at most, and one at least")
    if len(mean) <= COVARIANCE_FEATURES:
        model = PCA(k=components, inputCol="features", outputCol="projected").fit(features)
        return Projection(mean, model.pc.toArray().T, model.explainedVariance.toArray())
    shipped = features.sparkSession.sparkContext.broadcast(mean)
    centred = features.rdd.map(lambda row: Vectors.dense(row[0].toArray() - shipped.value))
    found = RowMatrix(centred).computeSVD(components, computeU=False)
    spread = features.agg(Summarizer.variance(F.col("features")).alias("v")).first()["v"].toArray().sum()
    explained = found.s.toArray() ** 2 / (seen["n"] - 1) / spread
    return Projection(mean, found.V.toArray().T, explained)


def project(rows: DataFrame, basis: Projection, vector: str = "vector") -> DataFrame:
    """(x - mean) times the components, then unit length, added as ``embedding``."""
    shipped = rows.sparkSession.sparkContext.broadcast((basis.mean, basis.components))
    kept = [f for f in rows.schema.fields if f.name != vector]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, components = shipped.value
        for batch in batches:
            column = batch.column(vector)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(column) and len(flat) != len(column) * len(mean):
                raise ValueError(f"vectors must have {len(mean)} features")
            projected = (flat.reshape(len(column), len(mean)) - mean) @ components.T
            unit = projected / np.sqrt((projected * projected).sum(axis=1, keepdims=True))
            values = pa.array(unit.ravel(), pa.float64())
            offsets = pa.array(np.arange(len(column) + 1) * components.shape[0], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], pa.ListArray.from_arrays(offsets, values)],
                names=[*[f.name for f in kept], "embedding"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.select(*[f.name for f in kept], vector).mapInArrow(apply, f"{schema}, embedding array<double>")


# ---- pluggable encoders -----------------------------------------------------

Encoder = Callable[[list], np.ndarray]


def encode(rows: DataFrame, payload: str, factory: Callable[[], Encoder], dimension: int, batch_rows: int = 64) -> DataFrame:
    """Apply a frozen encoder in batches: one encoder per task, checked unit vectors out.

    ``factory`` builds the encoder inside the worker; it maps a list of payloads to
    a matrix with ``dimension`` columns.
    """
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = factory()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                features = np.asarray(encoder(part.column(payload).to_pylist()), dtype=np.float64)
                if features.shape != (part.num_rows, dimension):
                    raise ValueError(f"encoder produced {features.shape}, expected {(part.num_rows, dimension)}")
                norms = np.sqrt((features * features).sum(axis=1, keepdims=True))
                if not np.isfinite(features).all() or (norms == 0).any():
                    raise ValueError("encoder produced non-finite or zero-length features")
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id"), pa.array((features / norms).tolist(), pa.list_(pa.float64()))],
                    names=["item_id", "embedding"],
                )

    return rows.select("item_id", payload).mapInArrow(apply, "item_id string, embedding array<double>")


# ---- queries for new and known items ---------------------------------------

def query_new_items(
    items: DataFrame, store: DataFrame, store_meta: DataFrame, k: int,
    basis: Projection | None = None, projection_meta: DataFrame | None = None,
    factory: Callable[[], Encoder] | None = None,
) -> DataFrame:
    """Rank items that are not in the store, embedded the way the store was.

    ``items`` has (query_id, vector) of raw features for a PCA store, or
    (query_id, payload) when an encoder factory is given.
    """
    facts = store_meta.first()
    backend = facts["backend"] or "unknown"
    if backend in ARCHIVE_ONLY_BACKENDS:
        raise ValueError(f"the {backend} backend embeds archive members, not new images")
    if backend == "pca":
        if basis is None:
            raise ValueError("the pca backend needs the fitted projection")
        if projection_meta is not None:
            enforce(projection_violations(projection_meta, store_meta))
        embedded = project(items.select("query_id", "vector"), basis)
    elif factory is not None:
        found = encode(items.withColumnRenamed("query_id", "item_id"), "payload", factory, facts["dimension"])
        embedded = found.withColumnRenamed("item_id", "query_id")
    else:
        raise ValueError(f"embedding a new item is not supported for backend {backend!r}")
    index = store.filter(F.col("split") == "index").select(
        "item_id", "position", F.col("label").alias("item_label"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return exact_topk(embedded.select("query_id", F.col("embedding").alias("vector")), index, k, exclude_self=False)


def query_by_id(store: DataFrame, item_id: str, k: int) -> DataFrame:
    """Rank the index for one stored item, which never answers itself."""
    chosen = store.filter(F.col("item_id") == item_id).select(
        F.col("item_id").alias("query_id"), F.col("embedding").alias("vector")
    )
    if not chosen.limit(1).count():
        raise ValueError(f"unknown item: {item_id}")
    index = store.filter(F.col("split") == "index").select(
        "item_id", "position", F.col("label").alias("item_label"), F.col("embedding").alias("vector")
    )
    return exact_topk(chosen, index, k, exclude_self=True)
