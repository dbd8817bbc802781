"""Rules as columns: each rule yields an issue struct or null, one scan for all rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKING, WARNING = "blocking", "warning"


def rule(broken: Column, path: str | Column, message: str | Column, severity: str = BLOCKING) -> Column:
    """An issue struct where ``broken`` holds; null conditions count as broken-not-proven (no issue)."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(
        broken,
        F.struct(as_col(path).alias("path"), as_col(message).alias("message"), F.lit(severity).alias("severity")),
    )


def blank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c) == "", F.lit(True))


def not_matching(c: str | Column, pattern: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return ~F.coalesce(c.rlike(pattern), F.lit(False))


def not_in(c: str | Column, allowed: Sequence[str]) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return ~F.coalesce(c.isin(*allowed), F.lit(False))


def issue_rows(df: DataFrame, record_id: str, rules: Sequence[Column], groups: Sequence[Column] = ()) -> DataFrame:
    """(record_id, path, message, severity) rows.  ``groups`` are array<issue> columns."""
    found = F.filter(F.array(*rules), lambda x: x.isNotNull()) if rules else None
    for g in groups:
        g = F.filter(F.coalesce(g, F.array()), lambda x: x.isNotNull())
        found = g if found is None else F.concat(found, g)
    return (
        df.select(F.coalesce(F.col(record_id), F.lit("<unknown>")).alias("record_id"), F.explode(found).alias("i"))
        .select("record_id", "i.path", "i.message", "i.severity")
    )


def raise_if_any(issues: DataFrame, label: str) -> None:
    """Fail closed: one aggregate count, then an error naming one example."""
    row = issues.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(*[F.col(c).cast("string") for c in issues.columns])).alias("first"),
    ).first()
    if row["n"]:
        raise ValueError(f"{label}: {row['n']} issue(s), first {tuple(row['first'])}")
