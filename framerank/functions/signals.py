"""Slots for models and pixel functions: scalar Arrow UDFs whose output is a plain column.

A scalar UDF lets native filters pass below it and is pruned if nobody reads it; mapInArrow would stop both."""

from __future__ import annotations

import logging
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from framerank.functions import pixels


#: Loaded models that one worker process holds; the one unused the longest goes first.
MODELS = 4

_loaded: OrderedDict[str, Callable[..., pa.Array]] = OrderedDict()


def _model(key: str, load: Callable[[], Callable[..., pa.Array]]) -> Callable[..., pa.Array]:
    """The model of a key, loaded at its first use in this process."""
    if key not in _loaded:
        while len(_loaded) >= MODELS:
            _loaded.popitem(last=False)
        _loaded[key] = load()
    _loaded.move_to_end(key)
    return _loaded[key]


@dataclass(frozen=True)
class SignalProvider:
    """load() gives a function from Arrow arrays to one Arrow array; a worker process calls it once for all tasks of a
    column, and for all columns whose providers have the same name and version. If the function fails on a batch its rows
    are tried one by one, and the rows that fail are `fallback`; without one the error is raised."""

    name: str
    inputs: tuple[str, ...]
    kind: T.DataType
    load: Callable[[], Callable[..., pa.Array]]
    version: str | None = None
    fallback: object = None

    def column(self) -> Column:
        key, load, run = f"{self.name}:{self.version or uuid.uuid4().hex}", self.load, self._run
        if len(self.inputs) == 1:

            @F.arrow_udf(self.kind)
            def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                model = _model(key, load)
                for batch in batches:
                    yield run(model, (batch,))

            return one(*map(F.col, self.inputs))

        @F.arrow_udf(self.kind)
        def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            model = _model(key, load)
            for batch in batches:
                yield run(model, batch)

        return many(*map(F.col, self.inputs))

    def _run(self, model: Callable[..., pa.Array], batch: tuple[pa.Array, ...]) -> pa.Array:
        if self.fallback is None:
            return model(*batch)
        try:
            return model(*batch)
        except Exception:
            logging.getLogger(__name__).warning("%s fails on a batch; its rows are tried one by one", self.name, exc_info=True)
        out, kind = [], to_arrow_type(self.kind)
        for i in range(len(batch[0])):
            try:
                out += model(*(x.slice(i, 1) for x in batch)).to_pylist()
            except Exception:
                out.append(self.fallback)
        return pa.array(out, kind)


#: Fixed value: the quality of a picture that its model can't judge.
NEUTRAL_QUALITY = 0.5


def quality(score: Column | str, lower_is_better: bool = False) -> Column:
    """A quality model's score as a signal: negated where less is better, kept within 0 to 1; neutral if there is none."""
    score = F.col(score) if isinstance(score, str) else score
    signed = -score if lower_is_better else score
    return F.when(score.isNull() | F.isnan(score), NEUTRAL_QUALITY).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), signed)))


def with_signals(frames: DataFrame, *providers: SignalProvider) -> DataFrame:
    return frames.withColumns({p.name: p.column() for p in providers})


METRICS = ("luminance", "sharpness", "uniformity", "texture")
_METRICS = T.StructType([T.StructField(c, T.DoubleType()) for c in METRICS])


def _load_metrics():
    def run(picture: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
        out = []
        for raw, h, w in zip(picture.to_pylist(), height.to_pylist(), width.to_pylist()):
            whole = raw is not None and h and w and len(raw) == 3 * h * w
            out.append(pixels.frame_metrics(np.frombuffer(raw, np.uint8).reshape(h, w, 3)) if whole else None)
        return pa.array(out, pa.struct([(c, pa.float64()) for c in METRICS]))

    return run


#: Metrics of raw RGB bytes (columns rgb, height, width); null for an unreadable picture.
PIXEL_METRICS = SignalProvider("metrics", ("rgb", "height", "width"), _METRICS, _load_metrics)


def _load_hash():
    def run(picture: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
        out = []
        for raw, h, w in zip(picture.to_pylist(), height.to_pylist(), width.to_pylist()):
            whole = raw is not None and h and w and len(raw) == 3 * h * w
            out.append(pixels.difference_hash(pixels.grey(np.frombuffer(raw, np.uint8).reshape(h, w, 3))) if whole else [0])
        return pa.array(out, pa.list_(pa.int64()))

    return run


#: Perceptual hash as an array of 64-bit words; zero for an unreadable picture.
PERCEPTUAL_HASH = SignalProvider("phash", ("rgb", "height", "width"), T.ArrayType(T.LongType()), _load_hash)
