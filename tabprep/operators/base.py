"""Fit-once / apply-as-expressions stages that plug into ``pyspark.ml.Pipeline``.

``fit`` runs at most a few aggregate jobs and keeps the small result (one value
per column, or a bounded vocabulary) as JSON in a Param; ``transform`` is one
``select`` built from literals, so it is a pure projection that Catalyst fuses
with its neighbours and that also runs on a streaming DataFrame. Both sides are
saved and loaded with the default ``pyspark.ml`` params writer.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable

from tabprep.functions.exprs import nan_as_null


class _JsonParams(Params):
    options = Param(Params._dummy(), "options", "stage options (JSON)", typeConverter=TypeConverters.toString)

    def _init_options(self, options: dict | None) -> None:
        self._setDefault(options="{}")
        if options:
            self._set(options=json.dumps(options, sort_keys=True))

    @property
    def opts(self) -> dict:
        return json.loads(self.getOrDefault(self.options))


class TabEstimator(Estimator, _JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    """Base estimator: subclasses implement ``_fit`` returning a :class:`TabModel`."""

    defaults: dict = {}

    def __init__(self, **options):
        super().__init__()
        merged = dict(self.defaults)
        merged.update(options)
        self._init_options(merged)

    def fit(self, dataset, params=None):
        return super().fit(nan_as_null(dataset), params)


class TabModel(Model, _JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    """Base model: the fitted state lives in the ``state`` Param as JSON."""

    state = Param(Params._dummy(), "state", "fitted state (JSON)", typeConverter=TypeConverters.toString)

    def __init__(self, state: dict | None = None, options: dict | None = None):
        super().__init__()
        self._setDefault(state="{}")
        if state is not None:
            self._set(state=json.dumps(state, sort_keys=True, default=float))
        self._init_options(options)

    def transform(self, dataset, params=None):
        return super().transform(nan_as_null(dataset), params)

    @property
    def st(self) -> dict:
        return json.loads(self.getOrDefault(self.state))
