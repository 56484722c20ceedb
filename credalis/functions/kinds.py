"""What kind of variable a column holds, from the schema alone."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def kinds(data: DataFrame, ordered: Iterable[str] = ()) -> dict[str, str]:
    """``N`` (numerical), ``C`` (categories) or ``O`` (ordered categories, which the caller names) for each column."""
    some, out = set(ordered), {}
    for f in data.schema.fields:
        if f.name in some:
            out[f.name] = "O"
        elif isinstance(f.dataType, T.NumericType):
            out[f.name] = "N"
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            out[f.name] = "C"
        else:
            raise ValueError(f"the kind of {f.name} ({f.dataType.simpleString()}) must be given: cast it")
    return out


def prepared(data: DataFrame, ordered: Iterable[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """(``data`` with whole numbers as doubles, the kinds of its columns)."""
    found = kinds(data, ordered)
    whole = [f.name for f in data.schema.fields if found[f.name] == "N" and isinstance(f.dataType, T.IntegralType)]
    return data.withColumns({c: data[c].cast("double") for c in whole}) if whole else data, found
