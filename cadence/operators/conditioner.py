"""Embedding conditioning: centred PCA from raw embeddings to k dimensions.

Fit: Spark ML's PCA (distributed Gramian/covariance over the rows; only the
d x d covariance and the d x k components reach the driver, bounded by the
embedding width). Components get a deterministic sign (largest absolute
loading positive). Transform: (x - mean) @ components in Arrow batches via
``mapInPandas``; the model is a fingerprinted value so stored conditioned
embeddings can be matched to the model that produced them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

N_DIMS = 50


@dataclass(frozen=True)
class Conditioner:
    mean: np.ndarray  # (d,)
    components: np.ndarray  # (k, d)

    @property
    def k(self) -> int:
        return self.components.shape[0]

    @property
    def name(self) -> str:
        return f"pca_d{self.k}"

    @property
    def hash(self) -> str:
        """6-hex fingerprint of the components (rounded, so refits that agree
        to 1e-9 share a fingerprint)."""
        return hashlib.md5(np.round(self.components, 9).astype(np.float64).tobytes()).hexdigest()[:6]

    @property
    def model_id(self) -> str:
        return f"{self.name}_{self.hash}"


def fit(df: DataFrame, col: str = "embedding", k: int = N_DIMS) -> Conditioner:
    """Centred PCA of the array column ``col`` (rows with NULL skipped)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    v = df.where(F.col(col).isNotNull()).select(array_to_vector(F.col(col).cast("array<double>")).alias("v"))
    from pyspark.ml.stat import Summarizer

    mean = np.asarray(v.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray(), dtype=np.float64)
    model = PCA(k=k, inputCol="v", outputCol="p").fit(v)
    comps = np.asarray(model.pc.toArray(), dtype=np.float64).T  # (k, d)
    # deterministic signs: the largest |loading| of each component is positive
    idx = np.argmax(np.abs(comps), axis=1)
    signs = np.sign(comps[np.arange(comps.shape[0]), idx])
    signs[signs == 0] = 1.0
    return Conditioner(mean=mean, components=comps * signs[:, None])


def transform(df: DataFrame, model: Conditioner, col: str = "embedding", out: str = "conditioned_embedding",
              only_missing: bool = False) -> DataFrame:
    """Add ``out`` = (x - mean) @ components.T; NULL input -> NULL output.
    With ``only_missing``, rows that already have ``out`` keep it
    (incremental scoring)."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast((model.mean, model.components))
    schema = T.StructType(list(df.schema.fields) + (
        [] if out in df.columns else [T.StructField(out, T.ArrayType(T.DoubleType()))]))

    def fn(batches):
        mean, comps = bc.value
        for pdf in batches:
            emb = pdf[col].tolist()
            rows = [i for i, x in enumerate(emb) if x is not None]
            res: list = [None] * len(emb)
            if rows:
                X = np.stack([np.asarray(emb[i], dtype=np.float64) for i in rows])
                Y = (X - mean) @ comps.T
                for i, y in zip(rows, Y):
                    res[i] = y
            if only_missing and out in pdf.columns:
                for i, prev in enumerate(pdf[out].tolist()):
                    if prev is not None:
                        res[i] = prev
            pdf = pdf.copy()
            pdf[out] = pd.Series(res, index=pdf.index, dtype=object)
            yield pdf

    return df.mapInPandas(fn, schema)


def save(spark, model: Conditioner, path: str) -> str:
    """Add the fitted model to the registry folder ``path`` (a parquet table
    of one row per model); returns its id."""
    row = (model.model_id, model.name, model.hash, [float(x) for x in model.mean], [[float(x) for x in c] for c in model.components])
    spark.createDataFrame(
        [row], "model_id string, name string, hash string, mean array<double>, components array<array<double>>"
    ).write.mode("append").parquet(path)
    return model.model_id


def load(spark, path: str, model_id: str) -> Conditioner:
    """The registered model of that id. Refused: an id that is not there, and
    a model whose name or fingerprint is not the registered one."""
    rows = spark.read.parquet(path).where(F.col("model_id") == model_id).limit(1).collect()
    if not rows:
        raise ValueError(f"no model {model_id} in the registry")
    r = rows[0]
    model = Conditioner(mean=np.asarray(r["mean"]), components=np.asarray(r["components"]))
    if (model.name, model.hash, model.model_id) != (r["name"], r["hash"], model_id):
        raise ValueError(f"model {model_id} does not match its fingerprint ({model.model_id})")
    return model
