"""JSON texts compared as values."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks the canonical form of a text that isn't JSON, which no JSON text begins with.
NOT_JSON = "\x00"
_HALF = re.compile("[\ud800-\udfff]")


def _number(text: str):
    value = float(text)
    return int(value) if value.is_integer() else value


def _no_constant(text: str):
    raise ValueError(text)


def canonical(text: str | None, null: str | None = None) -> str | None:
    """One spelling for each JSON value: sorted keys, no spaces, 1.0 as 1, the last of
    repeated keys, half a surrogate pair as its escape. Invalid JSON stays plain text behind a
    mark; null gives `null`."""
    if text is None:
        return null
    try:
        spelled = json.dumps(json.loads(text, parse_float=_number, parse_constant=_no_constant), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        return _HALF.sub(lambda half: f"\\u{ord(half[0]):04x}", spelled)
    except (ValueError, RecursionError):
        return NOT_JSON + text


def canonical_all(texts: Iterable[str | None], null: str | None = None) -> list[str | None]:
    """`canonical` of each text; a text that repeats is parsed once."""
    seen: dict = {}
    out = []
    for text in texts:
        if text not in seen:
            seen[text] = canonical(text, null)
        out.append(seen[text])
    return out


def canonical_json(col: Column, null: str | None = None) -> Column:
    """`canonical` as a column, in Arrow batches. Parsing into variants and spelling these on the
    JVM takes as long, and knows neither repeated keys nor what follows a value."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(canonical_all(texts, null), dtype=object)

    return run(col)
