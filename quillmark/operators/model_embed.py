"""Embeddings by a model (E8): one registration serves ``embed`` and the complete layouts.

``make_predict`` follows ``predict_batch_udf``: called once in a Python worker, it loads the
model and returns a function from an array of texts to a matrix with a row per text.  The
batch size bounds how many texts are in the model at a time.

Defined results: a null text is embedded as the empty text by ``embed`` and is no text for
the layouts; equal texts of a batch are put through the model once by the layouts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import embed, layouts

BATCH = 256
_loaded: dict[str, Callable] = {}  # of a worker: a function per registration


class Model:
    """Vectoriser of the layouts; the model itself is loaded where it is used."""

    def __init__(self, make_predict: Callable, batch: int):
        self.make_predict, self.batch, self.name = make_predict, batch, uuid.uuid4().hex

    def __getstate__(self):
        return {"make_predict": cloudpickle.dumps(self.make_predict), "batch": self.batch, "name": self.name}

    def __setstate__(self, state):
        self.__dict__.update(state, make_predict=cloudpickle.loads(state["make_predict"]))

    def vectors_of(self, texts: list[str]) -> dict[str, np.ndarray]:
        if self.name not in _loaded:
            _loaded[self.name] = self.make_predict()
        own = list(dict.fromkeys(texts))
        out: dict[str, np.ndarray] = {}
        for a in range(0, len(own), self.batch):
            part = own[a:a + self.batch]
            out.update(zip(part, np.asarray(_loaded[self.name](np.array(part, dtype=object)), dtype=np.float64)))
        return out

    def vector(self, text, lookup=None):
        return lookup[text] if lookup and text in lookup else self.vectors_of([text])[text]


def register_model(name: str, make_predict: Callable, batch: int = BATCH) -> None:
    """Registers ``name`` for ``embed.embed`` and for ``layouts``."""
    model = Model(make_predict, batch)

    def run(df: DataFrame, key: str = "doc_id", text: str = "text", **_) -> DataFrame:
        predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch)
        return df.select(key, predict(F.coalesce(text, F.lit(""))).alias("vec"))

    embed.register_embedder(name, run)
    layouts.register_vectorizer(name, lambda df, **_: (df, model))


def letter_model(dim: int = 8, seed: int = 42) -> Callable:
    """A small model of fixed weights: counts of a-z through one layer of +-1 weights
    (``embed._sign_matrix``) and a ramp; integers, so exact anywhere."""
    def make_predict():
        weights = embed._sign_matrix(seed, 26, dim)

        def predict(texts: np.ndarray) -> np.ndarray:
            counts = np.zeros((len(texts), 26))
            for i, t in enumerate(texts):
                raw = np.frombuffer(t.lower().encode("utf-8"), np.uint8)
                counts[i] = np.bincount(raw, minlength=256)[97:123]
            return np.maximum(counts @ weights, 0.0)

        return predict

    return make_predict


register_model("letters", letter_model())
