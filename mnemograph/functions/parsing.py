"""Strict JSON decoding of model output.

The native JSON functions are lenient (text after a value is ignored, numbers
become strings), where one odd element must void the whole array. These are the
only scalar Python functions of the library; they run on Arrow batches.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemograph.schema import EXTRACTED_FACT

_TEXT = {"subjectName": False, "objectName": True, "predicate": False, "factText": False}


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _bracketed(output: str | None) -> object:
    """What stands from the first ``[`` to the last ``]``; None if that is no JSON."""
    start, end = (output or "").find("["), (output or "").rfind("]")
    if start < 0 or end < start:
        return None
    try:
        return json.loads(output[start : end + 1], parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None


def decode_facts(output: str | None) -> list[dict]:
    """All facts of an extraction, or none if any is not exactly as it must be. Unknown keys are ignored."""
    found = _bracketed(output)
    if not isinstance(found, list):
        return []
    facts = []
    for f in found:
        if not isinstance(f, dict) or not isinstance(f.get("isCorrection"), bool):
            return []
        for name, optional in _TEXT.items():
            v = f.get(name)
            if not isinstance(v, str) and not (optional and v is None):
                return []
        facts.append({n: f.get(n) for n in (*_TEXT, "isCorrection")})
    return facts


def decode_order(output: str | None, n: int) -> list[int] | None:
    """The order that a model gives to n candidates; None unless it is a permutation of 1 to n."""
    found = _bracketed(output)
    if not isinstance(found, list) or n < 1 or any(isinstance(x, bool) or not isinstance(x, int) for x in found):
        return None
    return found if sorted(found) == list(range(1, n + 1)) else None


@F.pandas_udf(T.ArrayType(EXTRACTED_FACT))
def _facts_udf(output: pd.Series) -> pd.Series:
    return output.map(decode_facts)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _order_udf(output: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([decode_order(o, int(k)) for o, k in zip(output, n, strict=True)], dtype=object)


def parse_extraction(output: Column) -> Column:
    """Array of extracted facts of a model's answer; empty if it is not exactly one JSON array of facts."""
    return _facts_udf(output)


def parse_order(output: Column, n: Column) -> Column:
    """The permutation in a model's answer, or null."""
    return _order_udf(output, n)


def json_field(body: Column, path: str) -> Column:
    """One field of a JSON response; null if there is none."""
    return F.get_json_object(body, path)
