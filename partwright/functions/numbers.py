"""Column expressions for values with units and for fractions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VALUE_UNIT = r"^\s*([0-9]+(?:\.[0-9]+)?(?:-[0-9]+/[0-9]+)?|[0-9]+/[0-9]+)\s*([A-Za-z\"'°%][A-Za-z0-9\"'°%/]*)\.?\s*$"


def value_and_unit(raw: Column) -> Column:
    """Struct (value, unit) of a text that is one number or fraction with a unit; else the text and null."""
    v, u = F.regexp_extract(raw, _VALUE_UNIT, 1), F.regexp_extract(raw, _VALUE_UNIT, 2)
    return F.struct(F.when(v != "", v).otherwise(F.trim(raw)).alias("value"), F.nullif(u, F.lit("")).alias("unit"))


def fraction_to_double(c: Column) -> Column:
    """The value of '1-1/2', '3/4' or '2.5'; null for anything else."""
    whole, num, den = (F.regexp_extract(c, r"^\s*(?:([0-9]+)[- ])?([0-9]+)/([0-9]+)\s*$", i) for i in (1, 2, 3))
    plain = F.regexp_extract(c, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*$", 1)
    part = F.try_divide(F.nullif(num, F.lit("")).cast("double"), F.nullif(F.nullif(den, F.lit("")).cast("double"), F.lit(0.0)))
    return F.when(den != "", F.coalesce(F.nullif(whole, F.lit("")).cast("double"), F.lit(0.0)) + part).when(plain != "", plain.cast("double"))


def double_to_fraction(c: Column, max_den: int = 64) -> Column:
    """The nearest fraction with a denominator up to ``max_den``, smallest denominator first, as 'n/d', 'w-n/d' or 'w'; null below 0 and for what is no finite number.

    All denominators are tried on a whole Arrow batch at once: functions over arrays are not compiled, and
    written out the expression takes longer to compile than to run.
    """

    @F.pandas_udf("string")
    def nearest(values: pd.Series) -> pd.Series:
        x = values.to_numpy(dtype=np.float64, na_value=np.nan)
        valid = np.isfinite(x) & (x >= 0)
        x = np.where(valid, x, 0.0)
        whole = np.floor(x)
        dens = np.arange(1, max_den + 1)
        scaled = (x - whole)[:, None] * dens
        nums = np.floor(scaled) + np.floor(2 * (scaled - np.floor(scaled)))  # halves up
        at = np.abs((x - whole)[:, None] - nums / dens).argmin(axis=1)
        den, num = dens[at], nums[np.arange(len(x)), at].astype(np.int64)
        whole = whole.astype(np.int64) + (num == den)
        out = [str(w) if n in (0, d) else f"{w}-{n}/{d}" if w else f"{n}/{d}" for w, n, d in zip(whole.tolist(), num.tolist(), den.tolist())]
        return pd.Series(out, dtype=object).where(valid, None)

    return nearest(c)
