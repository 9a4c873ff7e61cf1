"""Settings as trees in JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def over(base: object, extension: object) -> object:
    """The extension laid over the base: objects are merged key by key, however deep; anything else, null and lists too, takes the base's place."""
    if not isinstance(base, dict) or not isinstance(extension, dict):
        return extension
    out = dict(base)
    todo = [(out, extension)]  # without recursion: trees may be deep
    while todo:
        at, more = todo.pop()
        for key, value in more.items():
            if isinstance(at.get(key), dict) and isinstance(value, dict):
                at[key] = dict(at[key])
                todo.append((at[key], value))
            else:
                at[key] = value
    return out


def merged(base: Column, extension: Column) -> Column:
    """Both JSON texts as one, keys sorted. Where there is no extension the base stays, where there is no base the extension; broken JSON is an error."""

    @F.pandas_udf("string")
    def kernel(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> str | None:
            if x is None or y is None:
                return y if x is None else x
            return json.dumps(over(json.loads(x), json.loads(y)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return kernel(base, extension)
