"""Streaming flows: repeated batches, late rows, untouched buckets, corrections, waiting events, quiet files."""

import time

import pytest
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.streaming import flows as S
from ledgerlens.streaming import refresh as R
from ledgerlens.streaming.store import Store
from tests.conftest import rows_of

DDL = "event_id string, position long, text_sha256 string, text string"


def test_upsert_is_idempotent_and_ignores_late_rows(spark, frame, tmp_path):
    base = str(tmp_path / "view")
    calls = []

    def embed(df):
        calls.append(df.count())
        return df

    apply = S.upsert_view(base, "event_id", "text_sha256", embed, buckets=4)
    apply(frame([(f"e{i}", i, "h1", "t1") for i in range(20)], DDL), 0)
    second = frame([("e1", 50, "h2", "new"), ("e2", 60, "h1", "same"), ("e3", 1, "h9", "late"), ("e99", 70, "h1", "added")], DDL)
    apply(second, 1)
    apply(second, 1)
    view = S.read_upserted(spark, base, 4)
    got = {r.event_id: (r.position, r.text) for r in view.collect()}
    assert len(got) == view.count() == 21
    assert got["e1"] == (50, "new") and got["e2"] == (60, "same") and got["e3"] == (3, "t1") and got["e99"] == (70, "added")
    assert calls == [20, 2]  # rows of an unchanged text, late rows and repeated batches are not embedded again
    before = Store(spark, base, 4).state()
    apply(frame([("e1", 90, "h3", "newest")], DDL), 2)
    after = Store(spark, base, 4).state()
    assert sum(after.live[key] != slot for key, slot in before.live.items()) == 1  # one bucket was rewritten
    assert {r.event_id: r.text for r in S.read_upserted(spark, base, 4).collect()}["e1"] == "newest"
    assert S.read_upserted(spark, base, 4).count() == 21
    apply(frame([("e1", 5, "h4", "old")], DDL), 3)
    assert Store(spark, base, 4).state() == after  # nothing newer, nothing written
    for n in range(4, 12):
        apply(frame([("e1", 100 + n, f"h{n}", f"text {n}")], DDL), n)
    assert len(list((tmp_path / "view").glob("rows/slot=*/bucket=*"))) <= 8  # two folders per bucket, whatever the number of batches
    assert S.read_upserted(spark, base, 4).where("event_id = 'e1'").first().text == "text 11"


def test_newer_row_with_unchanged_text_wins(spark, frame, tmp_path):
    """Batches (1, h1, active), (3, h1, withdrawn), (2, h2, active): position 3 stays, and keeps its embedding."""
    base, calls = str(tmp_path / "view"), []

    def embed(df):
        calls.append(df.count())
        return df.withColumn("vector", F.concat(F.lit("v"), "text_sha256"))

    apply = S.upsert_view(base, "event_id", "text_sha256", embed, buckets=2)
    ddl = "event_id string, position long, text_sha256 string, status string"
    for n, row in enumerate([("e", 1, "h1", "active"), ("e", 3, "h1", "withdrawn"), ("e", 2, "h2", "active")]):
        apply(frame([row], ddl), n)
    assert rows_of(S.read_upserted(spark, base, 2), "event_id", "position", "text_sha256", "status", "vector") == [("e", 3, "h1", "withdrawn", "vh1")]
    assert calls == [1, 0]  # the late row writes nothing


def test_file_stream_reads_only_new_files(spark, frame, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = frame([("a", 1, "h", "t")], DDL)
    rows.write.parquet(src)
    run = lambda: S.run_available(S.file_stream(spark, src, rows.schema, "*.parquet"), out, cp)
    run()
    run()
    assert spark.read.parquet(out).count() == 1
    frame([("b", 2, "h", "t")], DDL).write.mode("append").parquet(src)
    run()
    assert rows_of(spark.read.parquet(out), "event_id") == [("a",), ("b",)]


def ledger(frame, rows):
    """(event_id, position, line_start, line_end) or (event_id, position, target, field, recorded, corrected[, status])"""
    out = []
    for r in rows:
        if len(r) == 4:
            out.append((r[0], r[1], "observation", "completed", "p.txt", "h", r[2], r[3], "s", None, None, None, None))
        else:
            out.append((r[0], r[1], "amendment", r[6] if len(r) > 6 else "completed", None, None, None, None, "", *r[2:6]))
    return frame(out, R.LEDGER_DDL)


@pytest.fixture()
def views(spark, tmp_path):
    embedded = []

    def passages_of(e):
        return e.where("line_end >= line_start").select("event_id", "line_start", "line_end", F.explode(F.sequence("line_start", "line_end")).alias("line")).withColumn(
            "text_sha256", F.sha2(F.concat_ws(":", "event_id", "line"), 256))

    def embed(p):
        embedded.extend((r.event_id, r.line) for r in p.collect())
        return p.withColumn("vector", F.concat(F.lit("v"), "line"))

    v = R.RefreshedViews(spark, str(tmp_path / "views"), passages_of, embed, buckets=4)
    v.embedded = embedded
    return v


def test_correction_replaces_the_passages_of_its_target(spark, frame, views):
    events = [(f"e{i}", i, 1, 5) for i in range(6)]
    first = views.apply(ledger(frame, events), 0)
    assert (first["status"], first["new_events"], first["new_passages"]) == ("updated", 6, 30)
    views.embedded.clear()
    fix = ("fix1", 100, "e2", "line_end", 5, 2)
    second = views.apply(ledger(frame, [*events, fix]), 1)
    assert (second["status"], second["new_events"], second["refreshed_events"], second["new_passages"], second["kept_passages"]) == ("updated", 1, 1, 0, 2)
    assert views.embedded == []  # the lines that stay keep their vectors
    assert rows_of(views.passages().where("event_id = 'e2'"), "line", "line_end", "vector") == [(1, 2, "v1"), (2, 2, "v2")]
    assert views.passages().count() == 27
    state = views.store.state()
    assert views.apply(ledger(frame, [*events, fix]), 2)["status"] == "no_change" and views.store.state() == state
    assert views.apply(ledger(frame, [fix]), 1)["status"] == "repeated"


def test_corrections_build_on_each_other(spark, frame, views):
    views.apply(ledger(frame, [("e", 1, 1, 9), ("f", 2, 1, 3)]), 0)
    views.apply(ledger(frame, [("a", 10, "e", "line_end", 9, 5)]), 1)
    views.apply(ledger(frame, [("b", 11, "e", "line_start", 1, 4), ("p", 12, "f", "line_end", 3, 1, "proposed")]), 2)
    assert [r[0] for r in rows_of(views.passages().where("event_id = 'e'"), "line")] == [4, 5]
    assert views.passages().where("event_id = 'f'").count() == 3  # only completed amendments correct
    views.apply(ledger(frame, [("c", 13, "e", "line_end", 9, 6)]), 3)  # its recorded value is not the current one
    assert [r[0] for r in rows_of(views.passages().where("event_id = 'e'"), "line")] == [*range(1, 10)]
    views.apply(ledger(frame, [("e", 20, 1, 0)]), 4)  # a newer event without lines empties its passages
    assert views.passages().where("event_id = 'e'").isEmpty() and views.events().where("event_id = 'e'").first().position == 20


def test_missing_target_fails_and_leaves_the_views(spark, frame, views):
    views.apply(ledger(frame, [("e", 1, 1, 2)]), 0)
    before = views.store.state()
    with pytest.raises(ValueError, match="correction targets are missing"):
        views.apply(ledger(frame, [("e2", 2, 1, 2), ("a", 10, "nobody", "line_end", 2, 1)]), 1)
    assert views.store.state() == before and views.passages().count() == 2
    assert views.apply(ledger(frame, [("e2", 2, 1, 2)]), 1)["new_passages"] == 2  # the batch can be repeated


def test_broken_commit_leaves_the_last_one(spark, frame, views):
    views.apply(ledger(frame, [("e", 1, 1, 2)]), 0)
    before = rows_of(views.passages(), "event_id", "line")
    fail = views.store.commit
    broken = R.Store(spark, views.store.base, 4)
    rows = frame([("e", 9)], "event_id string, line long").withColumn("x", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        broken.commit(broken.state(), 1, {"events": (views.events().limit(0), "event_id"), "passages": (rows, "event_id")}, [0, 1, 2, 3])
    assert fail and rows_of(views.passages(), "event_id", "line") == before and views.events().count() == 1


def test_unique_ids_are_exact_against_all_history(spark, frame, tmp_path):
    sink = S.UniqueIds(spark, str(tmp_path / "ids"), "id", "n", buckets=16, pages=1, compact=3)
    ddl = "id string, n long"
    sink(frame([(f"a{i}", i) for i in range(50)] + [("a7", 99)], ddl), 0)
    assert sink.read_buckets == [0]
    for day in range(1, 9):  # new ids only
        sink(frame([(f"d{day}-{i}", 1000 * day + i) for i in range(20)], ddl), day)
    assert max(sink.read_buckets) <= 3  # new ids do not read the published ones, but for a few that the filter lets through
    sink(frame([("a7", 5000), ("d1-3", 5001), ("new", 5002)], ddl), 9)
    assert sink.read_buckets[-1] in (1, 2, 3)
    sink(frame([("a7", 5000), ("d1-3", 5001), ("new", 5002)], ddl), 9)  # repeated batch
    rows = rows_of(sink.accepted(ddl), "id", "n")
    assert len(rows) == len({i for i, _ in rows}) == 50 + 160 + 1 and ("a7", 7) in rows and ("new", 5002) in rows
    assert len(list((tmp_path / "ids" / "ids").glob("slot=*/batch=*"))) <= 8


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


STATES = [None, "created", "materialized", "preflight_passed", "governor_running"]


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 1, 0, 2]])
def test_chain_problems_do_not_depend_on_the_order_of_arrival(spark, frame, tmp_path, rocks, order):
    rows = [("r", i + 1, STATES[i], STATES[i + 1]) for i in range(4)] + [("q", 1, None, "created"), ("q", 2, "materialized", "materialized"), ("q", 3, "materialized", "created")]
    ddl = "run_id string, sequence long, from_state string, to_state string"
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k in order:
        part = [r for r in rows if r[1] == k + 1]
        frame(part, ddl).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    stream = S.file_stream(spark, src, frame(rows, ddl).schema, "*.parquet", per_trigger=1)
    S.run_available(S.check_transitions_stream(stream, K.RUN_TRANSITIONS), out, cp)
    got = spark.read.schema("run_id string, sequence long, problem string").parquet(out)
    assert rows_of(got, "run_id", "sequence", "problem") == [("q", 2, "from_state"), ("q", 3, "transition")]


def run_for(query, done, seconds=90):
    """Let a stream run until ``done`` holds."""
    end = time.time() + seconds
    try:
        while time.time() < end and not done():
            if query.exception():
                raise query.exception()
            time.sleep(0.5)
    finally:
        query.stop()
    return done()


def memory(df, name):
    return df.writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="1 second")


def test_missing_event_is_reported_after_the_patience(spark, frame, tmp_path, rocks):
    ddl = "run_id string, sequence long, from_state string, to_state string"
    rows = frame([("r", 1, None, "created"), ("r", 3, "materialized", "preflight_passed"), ("r", 4, "preflight_passed", "governor_running")], ddl)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.file_stream(spark, str(tmp_path / "in"), rows.schema, "*.parquet")
    query = memory(S.check_transitions_stream(stream, K.RUN_TRANSITIONS, patience_ms=2000), "gaps").option("checkpointLocation", str(tmp_path / "cp")).start()
    assert run_for(query, lambda: spark.table("gaps").count() > 0)
    assert rows_of(spark.table("gaps"), "run_id", "sequence", "problem") == [("r", 3, "sequence")]


def test_file_touched_three_times_is_announced_once(spark, frame, tmp_path, rocks):
    ddl = "path string, size long, modified long, sha256 string"
    src = str(tmp_path / "in")
    put = lambda rows: frame(rows, ddl).coalesce(1).write.mode("append").parquet(src)
    put([("a", 1, 10, "h1"), ("b", 1, 10, "g")])
    stream = S.file_stream(spark, src, frame([], ddl).schema, "*.parquet", per_trigger=1)
    query = memory(S.quiet_changes(stream, 4000), "quiet").option("checkpointLocation", str(tmp_path / "cp")).start()
    put([("a", 2, 11, "h2")])
    put([("a", 3, 12, "h3"), ("b", 1, 12, "g")])
    assert run_for(query, lambda: spark.table("quiet").count() >= 2)
    assert rows_of(spark.table("quiet"), "path", "size", "sha256") == [("a", 3, "h3"), ("b", 1, "g")]


def test_arrivals_are_written_by_many_tasks_and_arrive_in_order(spark, tmp_path):
    """One file a part, as before, has the whole input of the part made by one task."""
    from ledgerlens.plans.stream_queries import write_arrivals

    parts = [spark.range(i * 1000, i * 1000 + 1000) for i in range(3)]
    files = write_arrivals(spark, parts, str(tmp_path / "in"))
    assert files > 1 and len(list((tmp_path / "in").glob("*.parquet"))) == 3 * files
    seen = []
    stream = S.file_stream(spark, str(tmp_path / "in"), parts[0].schema, "*.parquet", per_trigger=files)
    S.run_available(stream, lambda batch, n: seen.append(batch.agg(F.min("id"), F.max("id"), F.count("*")).first()), str(tmp_path / "cp"))
    assert [tuple(r) for r in seen] == [(i * 1000, i * 1000 + 999, 1000) for i in range(3)]


def test_events_in_order_do_not_go_through_the_waiting_state():
    import pandas as pd

    class Held:
        def __init__(self):
            self.value, self.map, self.calls = None, {}, 0

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def exists(self):
            return self.value is not None or bool(self.map)

        def containsKey(self, key):
            self.calls += 1
            return key in self.map

        def getValue(self, key):
            self.calls += 1
            return self.map.get(key)

        def updateValue(self, key, value):
            self.calls += 1
            self.map[key] = value

        def removeKey(self, key):
            self.calls += 1
            del self.map[key]

    chain = S.ChainState(K.RUN_TRANSITIONS, None)
    chain.last, chain.waiting = Held(), Held()
    rows = lambda *r: iter([pd.DataFrame(r, columns=["run_id", "sequence", "from_state", "to_state"])])
    assert not list(chain.handleInputRows(("r",), rows(("r", 2, "created", "materialized"), ("r", 1, None, "created")), None))
    assert chain.waiting.calls == 0 and chain.last.value == (2, "materialized")
    late = list(chain.handleInputRows(("r",), rows(("r", 4, "x", "governor_running"), ("r", 4, "x", "x"), ("r", 2, None, "x")), None))
    assert [tuple(t) for t in late[0].itertuples(index=False)] == [("r", 4, "late"), ("r", 2, "late")] and chain.waiting.calls == 1
    last = list(chain.handleInputRows(("r",), rows(("r", 3, "materialized", "preflight_passed")), None))
    assert [tuple(t) for t in last[0].itertuples(index=False)] == [("r", 4, "from_state")] and not chain.waiting.map
