"""Registered queries on inputs that the given small tables do not hold."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import TABLES, compare, database

SMALL = "/root/testdata/sf0.001"


@pytest.fixture()
def folder(spark, tmp_path):
    """folder(documents=..) -> a copy of the small tables with some of them replaced."""

    def make(**tables):
        for t in TABLES:
            if t in tables:
                tables[t].coalesce(1).write.parquet(str(tmp_path / "made" / t))
                part = next(p for p in os.listdir(tmp_path / "made" / t) if p.endswith(".parquet"))
                os.symlink(tmp_path / "made" / t / part, tmp_path / f"{t}.parquet")
            else:
                os.symlink(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
        return str(tmp_path)

    return make


def same_as_sql(spark, name, folder):
    ok, note = compare(spark, database(folder), name, entry.queries()[name], entry.oracle_sql()[name], folder)
    assert ok, note


def test_fetch_evidence_of_long_files(spark, folder):
    """A range of 700 lines is fetched whole."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    long = docs.limit(3).selectExpr("doc_id + 100000 AS doc_id", "array_join(transform(sequence(1, 700), i -> 'line ' || i), '\n') AS text", "lang", "source", "n_chars")
    same_as_sql(spark, "e6_fetch_evidence", folder(documents=docs.unionByName(long)))


def rows(spark, name, folder):
    return sorted((tuple(r) for r in entry.queries()[name](spark, folder).collect()), key=str)


@pytest.mark.parametrize("name", ["e6_fetch_evidence", "m2_corrections_refresh"])
def test_repeated_rows_repeat_no_line(spark, folder, name):
    """Documents and labels that are listed twice give the same ranges, once."""
    twice = {t: spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels")}
    assert rows(spark, name, folder(**{t: df.unionByName(df.limit(20)) for t, df in twice.items()})) == rows(spark, name, SMALL)


def test_fetch_evidence_of_two_files_at_a_path(spark, folder):
    """Two revisions of a path: each reference gets the text of its own."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    both = docs.unionByName(docs.where("doc_id IN (0, 1, 2)").withColumn("text", docs.text.substr(1, 5)))
    found = [r for r in entry.queries()["e6_fetch_evidence"](spark, folder(documents=both)).collect() if r.event_id in ("evt_0", "evt_1", "evt_2")]
    assert len(found) == 6 and all(r.verified and r.n_lines == r.last_line - r.first_line + 1 for r in found)


def test_corrections_refresh_keeps_texts_without_vector(spark, folder):
    """The signed features of ``1: hgi`` cancel out; its passage stays."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    short = spark.createDataFrame([(100000, "hgi", "en", "src1", 3), (100001, "ijf", "en", "src1", 3)], docs.schema)
    same_as_sql(spark, "m2_corrections_refresh", folder(documents=docs.unionByName(short)))


def test_ledger_scan_of_days_in_several_files(spark):
    """Days too large for one task are written as several files; lines are counted per day all the same."""
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        same_as_sql(spark, "a1_ledger_scan", SMALL)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
