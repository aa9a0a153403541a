"""Rows as JSON and requests from it."""

from __future__ import annotations

import json
from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: bytes of a request at most.
MAX_BODY = 1 << 20


def encoded(rows: DataFrame, *key: str) -> DataFrame:
    """(key, json): each row as one object; what is null is left out, as a missing measurement is."""
    return rows.select(*key, F.to_json(F.struct(*rows.columns)).alias("json"))


def decoded(body: bytes, known: Collection[str]) -> dict:
    """The fields of a request: one object, of MAX_BODY bytes at most, without fields that aren't known."""
    if len(body) > MAX_BODY:
        raise ValueError("the request is too large")
    try:
        value = json.loads(body)
    except ValueError as error:
        raise ValueError("the request must hold a single JSON object") from error
    if not isinstance(value, dict):
        raise ValueError("the request must hold a single JSON object")
    if set(value) - set(known):
        raise ValueError(f"unknown fields: {', '.join(sorted(set(value) - set(known)))}")
    return value
