"""Conversation repair against a plain dynamic program over whole conversations."""

import hashlib
import random
import re
import zlib

import pytest

from ledgerlens.llm import conversation_repair as C

OUT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
DDL = "conv_id bigint, turn bigint, role string, text string, part int, conv string, key string"


def brute(rows):
    """Rows (turn, role, text) of one conversation in order -> the columns of the result."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not last else "d" if (role, text) in seen else "t" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    best = {"": (0, "", [])}  # last role so far ("" nothing, s, u, a) -> cost, letters, lines

    def better(table, key, value):
        if key not in table or value[:2] < table[key][:2]:
            table[key] = value

    def inserted(table):
        for _ in range(3):
            for key, (cost, letters, lines) in list(table.items()):
                name = "assistant" if key == "u" else "user"
                better(table, name[0], (cost + 5, letters + "I", [*lines, name + ":"]))
        return table

    best = inserted(best)
    for (_, role, text), fault in zip(rows, faults):
        table = {}
        for key, (cost, letters, lines) in best.items():
            better(table, key, (cost + 2, letters + "D", lines))
            if fault in ("b", "d"):
                continue
            more, name = 5 if fault == "t" else 0, "assistant" if key == "u" else "user"
            if (role[:1] == "s" and key == "") or (role[:1] == name[0]):
                better(table, role[:1], (cost + more, letters + "K", [*lines, f"{role}:{text}"]))
            better(table, name[0], (cost + more + 1, letters + "R", [*lines, f"{name}:{text}"]))
        best = inserted(table)
    cost, letters, lines = min(best[k] for k in ("", "a") if k in best)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def sort_key(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role.encode(), text[:64].encode(), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest())


def want(rows):
    """(conv, turn, role, text) -> conv -> result."""
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {conv: brute(sorted(some, key=sort_key)) for conv, some in found.items()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", "k") for r in rows], DDL)


def got(df):
    rows = df.collect()
    found = {r.conv_id: tuple(r[c] for c in OUT) for r in rows}
    assert len(found) == len(rows)
    return found


TEXTS = ["Yes.", "No!", "What?", "and then", "", " \t\n", "Yes. ", "café.", "long " * 40 + ".", "x", " "]
ROLES = ["user", "assistant", "system", "tool", "", None, "User", "u"]


def rows_of(rng, convs, most, turns=40):
    return [(conv, rng.choice([None, *range(turns)]), rng.choice(ROLES[: rng.choice([2, 3, 8])]), rng.choice([*TEXTS, None, f"t{rng.randint(0, 9)}."]))
            for conv in [None, *range(convs)] for _ in range(rng.randint(1, most))]


def test_symbols_against_brute_force():
    rng = random.Random(4)
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for _ in range(1500):
        symbols = "".join(rng.choice("xxsuaoSUAOuauaua") for _ in range(rng.randint(0, 30)))
        rows = [(i, names.get(s.lower(), "x"), f"{i}" + ("" if s.isupper() else ".") if s != "x" else "") for i, s in enumerate(symbols)]
        cost, letters = C.cheapest(symbols)
        assert (cost, letters) == brute(rows)[5:7]
        cuts = sorted(rng.randint(0, len(symbols)) for _ in range(rng.randint(0, 4)))
        runs, end, ends, kind, joined = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)])], list(C.LAST), [], C.START, ""
        for run in reversed(runs):
            ends.append(end)
            end = C.before(C.transfer(run), end)
        for run, e in zip(runs, reversed(ends)):
            part, kind = C.Lattice(run, tuple(e)).trace(kind)
            joined += part
        assert (end[C.START], joined) == (cost, letters)


def test_work_grows_with_the_rows():
    """Long runs of every kind of row settle in a moment (a price war would take hours)."""
    rng = random.Random(5)
    for symbols in ("x" * 20_000, "ua" * 10_000, "S" * 20_000, "".join(rng.choice("xsuaoSUAO") for _ in range(20_000))):
        cost, letters = C.cheapest(symbols)
        assert len(letters.replace("I", "")) == 20_000 and cost >= 0


@pytest.mark.parametrize("cut", [3, 4096])
@pytest.mark.parametrize("parts", [1, 8])
def test_conversations(spark, cut, parts, monkeypatch):
    rng = random.Random(cut + parts)
    rows = rows_of(rng, 30, 12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false" if parts > 1 else "true")
    try:
        assert got(C.repair(frame(spark, rows), cut_rows=cut)) == want(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_conversation_holds_most_rows(spark):
    """It spans all tasks and many runs; equal texts lie in different runs."""
    rng = random.Random(9)
    rows = [(7, rng.randint(0, 400), rng.choice(ROLES[:4]), rng.choice([*TEXTS, f"t{rng.randint(0, 300)}."])) for _ in range(1500)] + rows_of(rng, 5, 6)
    assert got(C.repair(frame(spark, rows), cut_rows=50)) == want(rows)


def test_bytes_cut_runs(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i} " + "w" * 5000 + ".") for i in range(40)]
    assert got(C.repair(frame(spark, rows), cut_bytes=60_000)) == want(rows)


def test_empty_table_and_other_ids(spark):
    assert C.repair(frame(spark, [])).isEmpty() and C.op13_conversation_repair(frame(spark, [])).isEmpty()
    named = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho."), (None, 1, "user", "?")], "conv_id string, turn int, role string, text string")
    found = got(C.repair(named))
    assert found["a"][5:7] == (0, "KK") and found[None][6] == "D"


def test_damage_and_lost_conversations(spark):
    rng = random.Random(11)
    rows = [(c, t, rng.choice(ROLES[:3]), rng.choice(["Yes.", "No.", f"t{t}", None])) for c in [None, *range(200)] for t in [*range(rng.randint(1, 3)), None]]
    damaged = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        part = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
        damaged += [(conv, turn, "user" if part == 4 else role, text)] * (0 if part == 0 else 2 if part == 3 else 1)
    lost = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    expected = want(damaged)
    assert got(C.op13_conversation_repair(frame(spark, rows))) == {c: expected.get(c, lost) for c in {r[0] for r in rows}}
    alone = [(c, 0, "user", "Hi.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert alone and set(got(C.op13_conversation_repair(frame(spark, alone))).values()) == {lost}
