"""Aggregates that operands name themselves, folded in order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def _apply(name: str, values: list[int]) -> int | None:
    if name == "sum":
        return sum(values)
    if name == "multiply":
        out = 1
        for v in values:
            out *= v
        return out
    if name == "max":
        return max(values)
    if name == "last":
        return values[-1]
    return None


def agg_merge(operands: DataFrame) -> DataFrame:
    """(key, func, value, error) of operands (key, seq, func, value).

    A change of function closes the running aggregate, whose result is the next one's first
    input; a leading unnamed operand takes the next name; an unknown name, or none after a
    named one, is an error. A key's operands are folded together, in ``seq`` order.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        name, held, failed = "", [], False
        for func, value in rows.sort_values("seq")[["func", "value"]].itertuples(index=False):
            func = func or ""
            if func != name:
                if name and held:
                    r = _apply(name, held)
                    failed |= r is None
                    held = [] if r is None else [r]
                name = func
            held.append(int(value))
        r = _apply(name, held)
        failed |= r is None
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "func": [name], "value": [None if failed else r], "error": [bool(failed)]}).astype({"value": "Int64"})

    return operands.groupBy("key").applyInPandas(fold, "key long, func string, value long, error boolean")
