"""Content hashes, identity hashes and canonical JSON."""

from __future__ import annotations

import json
import math

import hashlib
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha256(text: str | Column) -> Column:
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def identity(prefix: str, width: int, *parts: str | Column, sep: str = "|") -> Column:
    """``prefix`` + first ``width`` hex digits of the hash of the joined parts."""
    cols = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(sep, *cols), 256), 1, width))


def artifact_hash(*columns: str) -> Column:
    """``sha256:`` + hash of the compact JSON object of the columns, keys in order; nulls kept."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def _canonical(raw: str | None) -> str | None:
    if raw is None:
        return None
    try:
        value = json.loads(raw, parse_constant=lambda name: math.nan)
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """Open payloads: sorted keys, no blanks; null for malformed JSON or NaN."""
    return raw.map(_canonical, na_action="ignore")


@F.pandas_udf(T.StringType())
def canonical_json_hash(raw: pd.Series) -> pd.Series:
    def digest(text: str) -> str | None:
        body = _canonical(text)
        return None if body is None else "sha256:" + hashlib.sha256(body.encode()).hexdigest()

    return raw.map(digest, na_action="ignore")
