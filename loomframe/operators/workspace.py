"""Named frames and functions: a session's state, for programs that refer to both by name.

Functions take columns or frames and give columns or frames, so that what is called by name is planned like everything
else; there is no language of its own to parse.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arithmetic as A
from ..functions import binning, dates, factors, sequences, text
from . import frame, groups, metrics, reduce, sampling

#: What is there from the start: column functions, then frame functions.
BUILT_IN: dict[str, Callable] = {
    **A.UNARY,
    "ifelse": A.if_else, "is.na": A.is_na, "round": A.round_exact, "signif": A.signif, "%%": A.remainder, "%/%": A.int_divide, "^": A.power, "/": A.divide, "&": A.and_, "|": A.or_,
    "tolower": text.lower, "toupper": text.upper, "trim": text.trim, "sub": text.sub, "gsub": text.gsub, "revalue": text.revalue, "strsplit": text.strsplit,
    "as.numeric": A.number, "factor": factors.factor, "levels": factors.levels, "setLevel": factors.set_level, "as.Date": dates.as_date, "date.part": dates.part, "millis": lambda c: dates.part(c, "millis"),
    "cut": binning.cut_breaks, "findInterval": binning.find_interval, "seq": sequences.seq, "runif": sampling.runif, "sample": sampling.sample,
    "cbind": frame.cbind, "rbind": frame.rbind, "t": frame.transpose, "%*%": frame.matmul, "crossprod": frame.gram, "diff": frame.diff, "which": frame.which, "head": frame.head, "tail": frame.tail,
    "unique": groups.unique, "scale": groups.scale, "order": groups.order, "ddply": groups.ddply, "apply": groups.apply_cols, "sapply": groups.apply_cols, "each.row": groups.each_row,
    "table": reduce.table, "var": reduce.covariance, "quantile": reduce.quantiles, "hist": reduce.histogram, "summary": reduce.summary, "xorsum": reduce.xorsum, "sum": reduce.fold, "confusion": metrics.confusion_matrix,
}


def can_be_coerced_to_logical(df: DataFrame, column: str) -> bool:
    """Whether a column is logical, a number that is only 0, 1 or missing, or a text that is only true, false or missing."""
    kind = dict(df.dtypes)[column]
    c = F.col(f"`{column}`")
    ok = F.lit(True) if kind == "boolean" else F.lower(c).isin("true", "false") if kind == "string" else c.cast("double").isin(0.0, 1.0)
    return bool(df.agg(F.bool_and(F.coalesce(ok, F.lit(True)))).first()[0] in (True, None))


class Workspace:
    """Frames, functions, models and the metrics of models on frames, by name."""

    def __init__(self):
        self.frames: dict[str, DataFrame] = {}
        self.functions: dict[str, Callable] = {}
        self.models: dict[str, object] = {}
        self.scores: dict[tuple[str, str], dict[str, float]] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.frames[name] = df
        return df

    def put_value(self, spark, name: str, value: str) -> DataFrame:
        """A raw text under a name: one row, one column."""
        return self.put(name, spark.createDataFrame([(value,)], "value string"))

    def ls(self) -> list[str]:
        return sorted([*self.frames, *self.models])

    def rm(self, *names: str) -> None:
        """Names that are not there are ignored."""
        for n in names:
            self.frames.pop(n, None)
            self.models.pop(n, None)

    def add_function(self, name: str, fun: Callable) -> None:
        if name in BUILT_IN:
            raise ValueError(f"{name} is built in")
        self.functions[name] = fun

    def call(self, name: str, *args, **options):
        """A function by name; names of frames among the arguments stand for the frames."""
        fun = self.functions.get(name) or BUILT_IN.get(name)
        if fun is None:
            raise KeyError(f"unknown function {name}")
        return fun(*(self.frames.get(a, a) if isinstance(a, str) else a for a in args), **options)

    def compatible(self, columns: Sequence[str]) -> list[str]:
        """The frames that have all of a model's columns."""
        return sorted(n for n, df in self.frames.items() if set(columns) <= set(df.columns))

    def put_metrics(self, model: str, data: str, **values: float) -> None:
        self.scores[model, data] = values

    def metrics(self, model: str | None = None, data: str | None = None) -> list[dict]:
        return [{"model": m, "frame": f, **v} for (m, f), v in sorted(self.scores.items()) if model in (None, m) and data in (None, f)]
