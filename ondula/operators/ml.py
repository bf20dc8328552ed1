"""Scattering features as a Spark ML transformer that can be saved and loaded."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.operators.scattering import Scattering1D


def _as_is(value):
    return value


class ScatteringFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds a vector of the four summaries of every path, in the row: rows are neither moved nor joined, so repeated ones stay.

    Everything that the transform depends on is a Param, so a pipeline that holds one is saved and loaded as it is.
    """

    n = Param(Params._dummy(), "n", "samples of a signal", TypeConverters.toInt)
    J = Param(Params._dummy(), "J", "log2 of the widest wavelet's support", TypeConverters.toInt)
    Q = Param(Params._dummy(), "Q", "wavelets an octave, of first and second order", TypeConverters.toListInt)
    T = Param(Params._dummy(), "T", 'samples averaged over, "global", 0, or None', _as_is)
    T_sec = Param(Params._dummy(), "T_sec", "seconds averaged over, or None", _as_is)
    max_order = Param(Params._dummy(), "max_order", "1 or 2", TypeConverters.toInt)
    stride = Param(Params._dummy(), "stride", "samples of an output step, or None", _as_is)
    sr = Param(Params._dummy(), "sr", "samples in a second, or None", _as_is)
    on_error = Param(Params._dummy(), "on_error", '"raise" or "skip"', TypeConverters.toString)
    indices = Param(Params._dummy(), "indices", "the paths to summarise, or None for all", _as_is)
    renorm_eps = Param(Params._dummy(), "renorm_eps", "added to the parents of second-order paths", TypeConverters.toFloat)
    quantile = Param(Params._dummy(), "quantile", "share of a signal's positive values below its floor", TypeConverters.toFloat)

    #: Params that are arguments of the operator.
    ARGUMENTS = ("n", "J", "Q", "T", "T_sec", "max_order", "stride", "sr", "on_error")

    @keyword_only
    def __init__(self, *, inputCol="x", outputCol="features", operator: Scattering1D | None = None, key_col=None, n=None, J=None, Q=None, T=None, T_sec=None, max_order=None, stride=None, sr=None, on_error=None, indices=None, renorm_eps=None, quantile=None):
        """``operator`` sets the Params of its arguments. ``key_col`` is ignored: rows need no key."""
        super().__init__()
        self._setDefault(inputCol="x", outputCol="features", Q=[8], T=None, T_sec=None, max_order=2, stride=None, sr=None, on_error="raise", indices=None, renorm_eps=1e-12, quantile=0.01)
        given = {k: v for k, v in self._input_kwargs.items() if v is not None and k not in ("operator", "key_col")}
        if operator is not None:
            plan = operator.time
            given |= {k: v for k in self.ARGUMENTS[:-1] if (v := getattr(plan, k)) is not None} | {"on_error": operator.on_error}
            if operator.wanted is not None:
                given["indices"] = sorted(operator.wanted)
        if "Q" in given:
            given["Q"] = list(given["Q"]) if isinstance(given["Q"], (list, tuple)) else [given["Q"]]
        self._set(**given)

    def operator(self) -> Scattering1D:
        """The operator that the Params describe; arguments that don't fit raise here."""
        found = Scattering1D(**{k: self.getOrDefault(getattr(self, k)) for k in self.ARGUMENTS})
        indices = self.getOrDefault(self.indices)
        return found if indices is None else found.select_paths(indices=indices)

    def _transform(self, df: DataFrame) -> DataFrame:
        found = self.operator().feature_arrays(df, self.getInputCol(), self.getOutputCol(), self.getOrDefault(self.renorm_eps), self.getOrDefault(self.quantile))
        return found.withColumn(self.getOutputCol(), array_to_vector(F.col(f"`{self.getOutputCol()}`")))
