"""A user-supplied implementation of a step, applied per row batch.

Each step's work sits behind a small function so that a user can plug in
their own scanner, converter or extractor. ``make_fn`` is called once per
task (one client per partition); the returned function is called per row
with the values of ``input_cols`` and returns a dict of output fields. A
failing row gets its message in ``error_col`` and NULL outputs; the task and
the other rows go on.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def apply_backend(df: DataFrame, make_fn: Callable[[], Callable[..., dict]], input_cols: list[str],
                  output: T.StructType, error_col: str = "backend_error") -> DataFrame:
    # Ship this module and the user's factory by value, so Python workers need
    # not have this package on their path.
    import sys

    from pyspark import cloudpickle
    for mod in {__name__, getattr(make_fn, "__module__", None)} - {None, "__main__"}:
        if mod in sys.modules:
            cloudpickle.register_pickle_by_value(sys.modules[mod])
    schema = T.StructType(list(df.schema.fields) + list(output.fields)
                          + [T.StructField(error_col, T.StringType())])
    names = [f.name for f in output.fields]

    def run(batches):
        fn = make_fn()
        for pdf in batches:
            cols = {n: [] for n in names}
            errs = []
            for vals in zip(*[pdf[c] for c in input_cols]):
                try:
                    out = fn(*vals) or {}
                    err = None
                except Exception as e:  # noqa: BLE001 - a row's failure is data
                    out, err = {}, f"{type(e).__name__}: {e}"
                for n in names:
                    cols[n].append(out.get(n))
                errs.append(err)
            res = pdf.copy()
            for f in output.fields:
                s = pd.Series(cols[f.name], index=pdf.index, dtype="object")
                if isinstance(f.dataType, (T.LongType, T.IntegerType)):
                    s = s.astype("Int64")
                res[f.name] = s
            res[error_col] = pd.Series(errs, index=pdf.index, dtype="object")
            yield res

    return df.mapInPandas(run, schema)
