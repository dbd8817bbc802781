"""Evidence gates, amendments, chains: a passing and a fail-closed case each."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.functions import text as X
from ledgerlens.operators import evidence as E
from ledgerlens.operators import integrity as I
from ledgerlens.operators import lineage as L
from ledgerlens.operators import validation as V
from ledgerlens.sources import readers as R
from ledgerlens.sources import sinks
from tests.conftest import rows_of

TEXT = "one\ntwo\nthree"
SHA = hashlib.sha256(TEXT.encode()).hexdigest()
OTHER = hashlib.sha256(b"other").hexdigest()


@pytest.fixture()
def store(frame):
    files = frame([("a.txt", SHA, TEXT), ("b.txt", OTHER, "changed")], "path string, sha256 string, text string")
    sources = frame([("e1", "a.txt", SHA), ("e2", "a.txt", SHA), ("e3", "b.txt", SHA)], "event_id string, source_path string, source_sha256 string")
    return sources, E.line_blocks(files)


REF = "ref_id string, claim_id string, event_id string, path string, start_line long, end_line long, expected_sha256 string"


def test_fetch_statuses(frame, store):
    refs = frame([
        ("ok", "c", "e1", "a.txt", 2, 2, SHA), ("mismatch", "c", "e3", "b.txt", 1, 1, SHA), ("unregistered", "c", "e9", "a.txt", 1, 1, SHA),
        ("wrong_hash", "c", "e1", "a.txt", 1, 1, OTHER), ("bad_range", "c", "e1", "a.txt", 3, 2, SHA), ("no_hash", "c", "e1", "a.txt", 1, 2, None),
        ("too_long", "c", "e1", "a.txt", 1, 900, SHA)], REF)
    out = {r.ref_id: r for r in E.fetch_evidence(refs, *store, context=1, max_lines=500).collect()}
    assert out["ok"].verified and out["ok"].content == "1: one\n2: two\n3: three"
    assert out["mismatch"].integrity_status == "mismatched" and out["mismatch"].content is None
    assert out["unregistered"].reason == "source path is not registered for the event"
    assert out["wrong_hash"].reason == "expected_sha256 is not registered for this source"
    assert "end_line" in out["bad_range"].reason and "SHA-256" in out["no_hash"].reason and "excessive" in out["too_long"].reason
    assert not any(r.verified for k, r in out.items() if k != "ok")


def test_release_claim_needs_two_records(frame, store):
    claims = frame([("two", "x", "release", "auto"), ("one", "x", "release", "auto"), ("changed", "x", "release", "auto"), ("routine", "x", "factual", "auto"),
                    ("marked", "x", "factual", "material")], "claim_id string, claim string, claim_type string, materiality string")
    refs = frame([("1", "two", "e1", "a.txt", 1, 1, SHA), ("2", "two", "e2", "a.txt", 2, 2, SHA), ("3", "one", "e1", "a.txt", 1, 1, SHA),
                  ("4", "one", "e1", "a.txt", 2, 2, SHA), ("5", "changed", "e1", "a.txt", 1, 1, SHA), ("6", "changed", "e3", "b.txt", 1, 1, SHA)], REF)
    out = {r.claim_id: r for r in E.eligibility(claims, E.fetch_evidence(refs, *store, context=0, max_lines=500)).collect()}
    assert {k: r.status for k, r in out.items()} == {
        "two": "eligible", "one": "blocked", "changed": "blocked", "routine": "not_required", "marked": "blocked"}
    assert out["one"].blockers == "EVIDENCE-ELIGIBILITY-INSUFFICIENT" and out["changed"].blockers == "EVIDENCE-INTEGRITY-INVALID"


def test_identity_gate_is_null_safe_and_fails_closed(frame):
    ddl = "event_id string, path string, source_sha256 string, start_line long, end_line long"
    view = frame([("e1", "a", SHA, 1, 2), ("e2", None, None, None, None)], ddl)
    hits = frame([("e1", "a", SHA, 1, 2), ("e2", None, None, None, None), ("e1", "a", SHA, 1, 3)], ddl)
    out = rows_of(E.identity_gate(hits, [view]).fillna(-1).fillna("-"), "event_id", "end_line", "identity_verified", "evidence_eligible")
    assert out == [("e1", 2, True, True), ("e1", 3, False, True), ("e2", -1, True, False)]
    with pytest.raises(ValueError, match="identity gate"):
        E.identity_gate(hits, [view], mode="raise")


AMD = "position long, amendment_id string, target_id string, pointer string, status string, recorded_value string, corrected_value string"


def test_amendment_chain(frame):
    payloads = frame([("r1", "a", "0"), ("r1", "b/c", "x"), ("r2", "a", "0")], "record_id string, k string, value string")
    a = frame([
        (1, "m1", "r1", "/payload/a", "completed", "0", "1"), (2, "m2", "r1", "/payload/a", "completed", "1", "2"),
        (3, "m3", "r1", "/payload/b~1c", "completed", "x", "y"), (4, "m4", "r2", "/payload/a", "completed", "7", "8"),
        (5, "m5", "r2", "/payload/zz", "completed", "0", "1"), (6, "m6", "r2", "/status", "completed", "0", "1"), (7, "m7", "r1", "/payload/a", "proposed", "2", "3")], AMD)
    checked = L.check_amendments(a, payloads)
    problems = {r.amendment_id: r.problem for r in checked.collect() if r.problem}
    assert set(problems) == {"m4", "m5", "m6", "m7"} and "does not match" in problems["m4"]
    resolved = {(r.record_id, r.k): (r.current_value, r.blocked) for r in L.resolve_amendments(checked.where("status = 'completed'"), payloads).collect()}
    assert resolved == {("r1", "a"): ("2", False), ("r1", "b/c"): ("y", False), ("r2", "a"): (None, True)}


def test_amendments_fail_closed(frame):
    """A correction to null is null; a bad pointer or an absent field blocks the whole record; absent targets are named."""
    payloads = frame([("n", "a", "0"), ("p", "a", "0"), ("f", "a", "0"), ("ok", "a", "0")], "record_id string, k string, value string")
    a = frame([
        (1, "m1", "n", "/payload/a", "completed", "0", None), (2, "m2", "p", "payload.a", "completed", "0", "1"),
        (3, "m3", "f", "/payload/zz", "completed", "0", "1"), (4, "m4", "gone", "/payload/a", "completed", "0", "1"),
        (5, "m5", "ok", "/payload/a", "completed", "0", None), (6, "m6", "ok", "/payload/a", "completed", None, "2")], AMD)
    checked = L.check_amendments(a, payloads)
    assert {r.amendment_id for r in checked.collect() if r.problem} == {"m2", "m3", "m4"}
    got = {r.record_id: (r.current_value, r.n_applied, r.blocked) for r in L.resolve_amendments(checked, payloads).collect()}
    assert got == {"n": (None, 1, False), "p": (None, 0, True), "f": (None, 0, True), "ok": ("2", 2, False)}
    assert rows_of(L.absent_targets(checked, payloads), "record_id") == [("gone",)]


def test_leaves_at_any_depth(frame):
    deep = '{"macro_f1": 0.50}'
    for level in range(60):
        deep = f'{{"l{level}": [{deep}, null]}}'
    odd = '{"macro_f1": Infinity, "ece": -Infinity, "f1": NaN}'
    bodies = [(1, deep), (2, "not json"), (3, None), (4, "{}"), (5, odd), (6, "[" * 200_000 + "]" * 200_000)]
    rows = L.json_leaves(frame(bodies, "id long, body string"), "id", "body")
    assert sorted((r.id, r.error) for r in rows.where("error IS NOT NULL").collect()) == [(2, "not_json"), (6, "too_deep")]
    assert [r.value for r in rows.where("id = 5").collect()] == ["Infinity", "-Infinity", "NaN"]
    rows = rows.where("id < 5")
    found = L.metric_leaves(rows).where("key = 'macro_f1'").collect()
    assert [(r.id, r.value, r.path.count("/")) for r in found] == [(1, "0.50", 121)]


def test_line_ends_start_no_line(frame):
    from pyspark.sql import functions as F

    from ledgerlens.functions import text as X

    texts = ["a\nb\n", "a\r\nb", "", "\n", "a\n\n", "a\r", None]
    got = [r.n for r in frame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.size(X.lines_of("t")).alias("n")).collect()]
    assert got[:6] == [len(t.splitlines()) for t in texts[:6]]


def test_supersession(frame):
    r = frame([(x, "completed") for x in ("old", "waiting", "free", "edited")], "record_id string, status string")
    rel = frame([("completed", "supersedes", "old"), ("draft", "supersedes", "waiting"), ("rejected", "supersedes", "free"), ("approved", "corrects", "edited")],
                "status string, relation_type string, target_id string")
    assert rows_of(L.current_records(r, rel), "record_id", "authority") == [
        ("edited", "pending_amendment"), ("free", "current"), ("old", "superseded"), ("waiting", "pending_supersession")]


def _chain(n, tamper=None):
    rows, prev = [], None
    for i in range(1, n + 1):
        h = hashlib.sha256(f"{i}|{prev or ''}".encode()).hexdigest()
        rows.append(["run", i, prev, h])
        prev = h
    if tamper:
        tamper(rows)
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("tamper, expected", [
    (None, None), (lambda r: r[3].__setitem__(2, "x"), (4, "previous_hash")), (lambda r: r[2].__setitem__(3, "x"), (3, "event_hash")),
    (lambda r: r.pop(2), (4, "sequence")), (lambda r: r.append(list(r[1])), (2, "sequence"))])
def test_hash_chain(frame, tamper, expected):
    e = frame(_chain(6, tamper), "run_id string, sequence long, previous_event_hash string, event_hash string")
    own = F.sha2(F.concat(F.col("sequence").cast("string"), F.lit("|"), F.coalesce("previous_event_hash", F.lit(""))), 256)
    first = I.first_violation(I.verify_chain(e, own)).first()
    assert (None if first is None else (first.sequence, first.problem)) == expected


def test_transitions(frame):
    e = frame([("a", 1, None, "created"), ("a", 2, "created", "materialized"), ("b", 1, None, "created"), ("b", 2, "created", "completed"), ("c", 1, "x", "created")],
              "run_id string, sequence long, from_state string, to_state string")
    assert rows_of(I.verify_transitions(e, K.RUN_TRANSITIONS)) == [("b", 2, "transition"), ("c", 1, "from_state")]


def test_fingerprint_ignores_order_and_sees_changes(frame):
    rows = [(f"p{i}", f"h{i}") for i in range(50)]
    one = lambda r: I.fingerprint(frame(r, "path string, sha256 string")).first()["fingerprint"]
    assert one(rows) == one(rows[::-1]) != one(rows[:-1] + [("p49", "other")])
    assert one(rows + rows[:1]) != one(rows)


def test_core_rules_on_raw_json(frame):
    good = ('{"schema_version":"core/1.0","record_id":"claim_1","record_kind":"claim","occurred_at":"2024-01-01T00:00:00Z","recorded_at":"2024-01-01T00:00:00+09:00",'
            '"status":"completed","created_by":{"actor_id":"actor_1","actor_type":"human"},"payload":{}}')
    bad = '{"schema_version":"core/1.0","record_id":"1","relations":{"a":1},"payload":[],"created_by":"me"}'
    df = frame([(good,), (bad,)], "raw string").withColumn("r", F.from_json("raw", R.RECORD_SCHEMA)).select("raw", "r.*")
    got = rows_of(V.validate_core(df), "record_id", "path")
    assert {r for r, _ in got} == {"1"}
    assert {"/record_id", "/relations", "/payload", "/created_by", "/status", "/occurred_at", "/record_kind"} <= {p for _, p in got}


def test_core_rules_see_unknown_nested_fields(frame):
    raw = ('{"schema_version":"core/1.0","record_id":"claim_1","record_kind":"claim","occurred_at":"2024-01-01T00:00:00Z","recorded_at":"2024-01-01",'
           '"status":"completed","created_by":{"actor_id":"actor_1","actor_type":"human","x":1},"payload":{},"relations":["loose",{"type":"corrects","target_id":"a","y":2}]}')
    df = frame([(raw,)], "raw string").withColumn("r", F.from_json("raw", R.RECORD_SCHEMA)).select("raw", "r.*")
    got = set(rows_of(V.validate_core(df), "path", "message"))
    assert {("/created_by/x", "unexpected property"), ("/relations/0", "must be an object"), ("/relations/1/y", "unexpected property")} <= got


def test_ledger_lines_keep_their_numbers_over_split_files(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02"):
        folder = tmp_path / "daily" / day
        folder.mkdir(parents=True)
        lines = ['{"event_id": "e%d", "summary": "%s"}' % (i, "x" * 50) for i in range(1, 2001)]
        lines[6], lines[8] = "[1]", ""
        (folder / "events.jsonl").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        led = R.read_ledger(spark, str(tmp_path))
        assert led.rdd.getNumPartitions() > 4
        assert led.where("NOT malformed AND event_id <> concat('e', line_no)").count() == 0
        assert rows_of(led.where("malformed"), "ledger_day", "line_no") == [("2024-01-01", 7), ("2024-01-02", 7)]
        assert led.count() == 2 * 1999
        with pytest.raises(ValueError, match="not an object"):
            R.read_ledger(spark, str(tmp_path), strict=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_failed_publication_keeps_the_previous_view(spark, frame, tmp_path):
    base = str(tmp_path / "v")
    dup = lambda v: V.duplicate_ids(v["t"], "id", "p")
    assert sinks.publish(spark, {"t": frame([("a", 1)], "id string, p long")}, base, "1", dup)
    assert not sinks.publish(spark, {"t": frame([("a", 1), ("a", 2)], "id string, p long")}, base, "2", dup)
    assert sinks.current_version(spark, base) == "1" and sinks.read_view(spark, base, "t").count() == 1
    assert rows_of(spark.read.json(f"{base}/health"), "version", "status") == [("1", "succeeded"), ("2", "failed")]


def test_append_is_refused_with_issues(frame, tmp_path):
    rec = frame([("r1", "2024-01-05T23:00:00Z")], "record_id string, recorded_at string")
    issue = frame([("r1", "/x", "bad", "blocking")], "record_id string, path string, message string, severity string")
    with pytest.raises(ValueError, match="append refused"):
        sinks.append_records(rec, str(tmp_path / "l"), issue)
    sinks.append_records(rec, str(tmp_path / "l"), issue.limit(0))
    assert (tmp_path / "l" / "ledger_day=2024-01-05").is_dir()


def test_technical_references_and_redaction(frame):
    df = frame([("see `run_it()` in src/a.py, token=abc123 and Authorization: Bearer zzz",)], "t string")
    r = df.select(X.technical_references("t").alias("refs"), X.redact("t").alias("clean")).first()
    assert set(r.refs) == {"run_it", "src/a.py"}
    assert "abc123" not in r.clean and "zzz" not in r.clean
