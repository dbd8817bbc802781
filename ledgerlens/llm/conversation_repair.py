"""Cheapest repair of the turns of conversations, by the auction algorithm for shortest paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import written

BLANK_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5  # costs
START, SYSTEM, USER, ASSISTANT = range(4)  # what the last turn of the repaired part is
NEXT = (USER, USER, ASSISTANT, USER)  # the turn that can be made or put after it
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FAR = 1 << 60
BLOCK = 8  # rows between two origins
CUT_ROWS, CUT_BYTES = 4096, 8 << 20  # rows and bytes held of one conversation at a time; results do not depend on them

# A row's symbol: "x" must go; lower case is sound, upper case truncated; s, u, a: the role's initial, o: any other.
LEGAL = ("su", "ua", "au")


class Lattice:
    """Edits of one run of rows as a graph: node 4 * i + q stands before row i, after a turn of kind q.

    Arcs delete, insert, keep or rerole; ``end[q]`` is the cost from the last layer on.  ``price`` holds a lower bound of
    each node's distance to the end, never above cost + price of the other side of an arc.  The auction algorithm moves a
    path: where its last node's price equals cost + price of the best arc, the path is extended along it, else the price is
    raised to that and the path drawn back by a node.  A path that reaches a node of known distance makes the prices of
    all its nodes exact; they keep their prices for the next origin.  Origins are taken from the end on, block by block of
    a few rows, and a block's prices start at the least price of the layer after it (below which no distance can be), so
    that no path is drawn back far and the work grows with the rows.
    """

    def __init__(self, symbols: str, end: tuple[int, ...]) -> None:
        self.symbols, self.end, n = symbols, end, len(symbols)
        self.n, self.price, self.exact = n, [min(end)] * (4 * n + 4), bytearray(4 * n + 4)
        last = 4 * n + 4
        for i in range(n - n % BLOCK, -1, -BLOCK):
            if last <= 4 * n:
                self.price[4 * i : last] = [min(self.price[last : last + 4])] * (last - 4 * i)
            for q in range(4):
                self.settle(4 * i + q)
            last = 4 * i

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """(letter, cost, node) in the order of the letters; node -1 is the end."""
        i, q = node >> 2, node & 3
        if i == self.n:
            return [("", self.end[q], -1), ("I", INSERT, 4 * i + NEXT[q])]
        found = [("D", DELETE, node + 4), ("I", INSERT, 4 * i + NEXT[q])]
        symbol = self.symbols[i]
        if symbol != "x":
            more = TRUNCATED if symbol < "a" else 0
            to = KEPT.get(symbol.lower(), {}).get(q)
            if to is not None:
                found.append(("K", KEEP + more, 4 * i + 4 + to))
            found.append(("R", REROLE + more, 4 * i + 4 + NEXT[q]))
        return found

    def settle(self, origin: int) -> int:
        """Move a path from the origin until it meets a known distance; returns the origin's distance."""
        price, exact, path = self.price, self.exact, [origin]
        while True:
            node = path[-1]
            if node < 0 or exact[node]:
                break
            best, to = FAR * 2, -1
            for _, cost, other in self.arcs(node):
                bid = cost + (price[other] if other >= 0 else 0)
                if bid < best:
                    best, to = bid, other
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for node in path:
            if node >= 0:
                exact[node] = 1
        return price[origin]

    def trace(self, start: int) -> tuple[str, int]:
        """The least string of letters among the cheapest ways from the first layer's node, and the kind it ends with.

        Exact prices leave no slack on the arcs of cheapest ways, and only there; a node that an arc without slack leads
        to is settled before the arc is taken.
        """
        node, letters = start, []
        self.settle(node)
        while True:
            for letter, cost, other in self.arcs(node):
                if other < 0:
                    if self.price[node] == cost:
                        return "".join(letters), node & 3
                elif self.price[node] == cost + self.price[other] and self.price[node] == cost + self.settle(other):
                    letters.append(letter)
                    node = other
                    break


LAST = (0, FAR, FAR, 0)  # a whole conversation ends with nothing or with an assistant's turn


@lru_cache(20_000)
def _short(symbols: str) -> tuple[int, str]:
    found = Lattice(symbols, LAST)
    return found.settle(START), found.trace(START)[0]


def cheapest(symbols: str) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of a whole conversation; equal runs of short ones are solved once."""
    return _short(symbols) if len(symbols) <= 64 else _short.__wrapped__(symbols)


def transfer(symbols: str) -> list[int]:
    """Cost of the cheapest edits from each kind before to each kind after a run of rows (16 numbers; FAR: impossible)."""
    cost = [[FAR] * 4 for _ in range(4)]
    cost[START][START] = cost[SYSTEM][SYSTEM] = DELETE * len(symbols)
    if "s" in symbols or "S" in symbols:  # nothing but deletions before and after the system turn
        cost[START][SYSTEM] = DELETE * (len(symbols) - 1) + (0 if "s" in symbols else TRUNCATED)
    for to in (USER, ASSISTANT):
        found = Lattice(symbols, tuple(0 if q == to else FAR for q in range(4)))
        for q in range(4):
            cost[q][to] = found.settle(q)
    return sum(cost, [])


def before(costs: list[int], end: list[int]) -> list[int]:
    """Distances at the start of a run from those at its end."""
    return [min(FAR, *(costs[4 * q + to] + end[to] for to in range(4))) for q in range(4)]


def edited(letters: str, roles: list[str], texts: list[str], kind: int) -> tuple[list[str], int]:
    """Repaired ``role:text`` lines of a run, and the kind after it."""
    lines, i, names = [], 0, ("", "", "user", "assistant")
    for letter in letters:
        if letter == "I":
            kind = NEXT[kind]
            lines.append(names[kind] + ":")
            continue
        if letter == "K":
            kind = KEPT[roles[i][0]][kind]
            lines.append(f"{roles[i]}:{texts[i]}")
        elif letter == "R":
            kind = NEXT[kind]
            lines.append(f"{names[kind]}:{texts[i]}")
        i += 1
    return lines, kind


class Summary:
    """Counts and text of one conversation, run by run; holds no rows."""

    def __init__(self) -> None:
        self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.first = self.last = self.initial = None
        self.turns, self.letters, self.hash, self.started = 0, [], hashlib.sha256(), False

    def add(self, initials: list[str], faults: list[str], turns: list, letters: str, lines: list[str]) -> None:
        self.blank += faults.count("b")
        self.duplicate += faults.count("d")
        self.truncated += faults.count("t")
        near = [*([self.initial] if self.initial is not None else []), *initials]
        self.illegal += sum(a + b not in LEGAL for a, b in zip(near, near[1:]))
        self.initial = near[-1] if near else None
        for turn in turns:
            if turn is not None and turn != self.last:
                self.turns += 1
                self.first = turn if self.first is None else self.first
                self.last = turn
        self.letters.append(letters)
        if lines:
            self.hash.update((("\n" if self.started else "") + "\n".join(lines)).encode())
            self.started = True

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.letters), self.hash.hexdigest()


def symbol(role: str, fault: str) -> str:
    initial = role[:1] if role[:1] in KEPT else "o"
    return "x" if fault in ("b", "d") else initial.upper() if fault == "t" else initial


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
KINDS = (pa.int64(),) * 6 + (pa.string(),) * 2
NAMES = [part.split()[0] for part in RESULT.split(", ")]
OPEN = "part bigint, roles array<string>, texts array<string>, turns array<bigint>, faults array<string>, keys array<binary>"
OPEN_KINDS = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.binary()))
OPEN_NAMES = [part.split()[0] for part in OPEN.split(", ")]
COLUMNS = ("conv", "role", "text", "turn", "fault", "key")


def _table(conv_kind: pa.DataType, rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * (len(names) + 1)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (conv_kind, *kinds))], ["conv", *names])


class Run:
    """Rows of one conversation that are held."""

    def __init__(self, conv) -> None:
        self.conv, self.cut, self.part = conv, False, 0
        self.clear()

    def clear(self) -> None:
        self.roles, self.texts, self.turns, self.faults, self.keys, self.bytes = [], [], [], [], [], 0
        self.seen: set[bytes] = set()

    def add(self, role: str, text: str, turn, fault: str, key: bytes) -> None:
        """A later row of the same role and text is a duplicate; its fault counts unless it is blank."""
        if fault != "b":
            if key in self.seen:
                fault = "d"
            self.seen.add(key)
        for column, value in zip((self.roles, self.texts, self.turns, self.faults, self.keys), (role, text, turn, fault, key)):
            column.append(value)
        self.bytes += len(text) * 4 + 200

    def full(self, rows: int, size: int) -> bool:
        return len(self.roles) >= rows or self.bytes >= size

    def opened(self, part: int) -> tuple:
        return self.conv, part, self.roles, self.texts, self.turns, self.faults, self.keys

    def done(self) -> tuple:
        found = Summary()
        found.cost, letters = cheapest("".join(map(symbol, self.roles, self.faults)))
        found.add([r[:1] for r in self.roles], self.faults, self.turns, letters, edited(letters, self.roles, self.texts, START)[0])
        return self.conv, *found.row()


def ordered_rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text, fault (b, t or "") and key of every row; null role and text are one space."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(" "))
    role = F.coalesce(F.col(f"`{role_col}`"), F.lit(" "))
    cut = F.rtrim(text, F.lit(BLANK_CHARS))
    return turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text")).select(
        "*", F.when(cut == "", "b").when(~F.right(cut, F.lit(1)).isin(".", "!", "?"), "t").otherwise("").alias("fault"),
        F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)).alias("key"))


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    cut_rows: int = CUT_ROWS, cut_bytes: int = CUT_BYTES,
) -> DataFrame:
    """Faults and cheapest repair of every conversation: one row each (see ``RESULT`` for the columns after the id).

    A conversation's rows are taken by turn (nulls first), then role, the text's first 64 characters and its digest.  Edits
    keep (0), rerole to user or assistant (1), delete (2; the only edit of blank and duplicate rows) or insert an empty
    turn (5); a truncated row that stays costs 5 more.  The cheapest edits that leave ``(s?(ua)+)?`` by initials of roles are
    found, of equal costs the least by letters.  A role that is empty has no initial and cannot be kept.

    The table is range-partitioned by conversation and order, so that a long conversation spans many tasks.  A task solves
    the conversations that lie inside its range.  The first and last of a range, and runs of more than ``cut_rows`` rows or
    ``cut_bytes`` bytes, stay open and are cut into runs: duplicates are settled by first run per text, each run's costs
    between the four kinds of border are found in parallel, the border prices are carried back over the runs (four numbers
    each), the runs are traced in parallel, and one pass over the runs in order joins letters and hashes the text.  That
    last pass reads a conversation's text in one task, run after run, since SHA-256 is sequential; nothing holds it whole.

    Null ids form a conversation of their own.  Null roles and texts count as one space.  Repeated rows are duplicates.
    Empty tables give no rows; other columns are ignored.  Very long texts are held one run at a time.
    """
    rows = ordered_rows(turns, conv_col, turn_col, role_col, text_col)
    conv_kind = rows.schema["conv"].dataType.simpleString()
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.left("text", F.lit(64)), F.col("key")]
    ranged = rows.withColumn("rid", F.monotonically_increasing_id()).repartitionByRange(*order, "rid").sortWithinPartitions(*order, "rid").select(*COLUMNS)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        run, first, kind = None, True, None

        def flush(done: list[tuple], opened: list[tuple]) -> pa.RecordBatch:
            return _table(kind, [(*d, *[None] * len(OPEN_NAMES)) for d in done] + [(o[0], *[None] * len(NAMES), *o[1:]) for o in opened], NAMES + OPEN_NAMES, KINDS + OPEN_KINDS)

        for batch in batches:
            kind = batch.schema.field("conv").type
            columns = [batch.column(c) for c in COLUMNS]
            for at in range(0, batch.num_rows, 1024):
                done, opened = [], []
                for conv, *row in zip(*[c.slice(at, 1024).to_pylist() for c in columns]):
                    if run is not None and run.conv != conv:
                        if first or run.cut:
                            opened.append(run.opened(part))
                            part += 1
                        else:
                            done.append(run.done())
                        run, first = None, False
                    if run is None:
                        run = Run(conv)
                    elif run.full(cut_rows, cut_bytes):
                        opened.append(run.opened(part))
                        part, run.cut = part + 1, True
                        run.clear()
                        yield flush(done, opened)
                        done, opened = [], []
                    run.add(*row)
                if done or opened:
                    yield flush(done, opened)
        if run is not None:
            yield flush([], [run.opened(part)])

    found = written(ranged.mapInArrow(solve, f"conv {conv_kind}, {RESULT}, {OPEN}"), "repair-runs")
    done = found.where("part IS NULL").select("conv", *NAMES)
    return done.unionByName(_joined(found.where("part IS NOT NULL").select("conv", *OPEN_NAMES), conv_kind)).withColumnRenamed("conv", conv_col)


def _joined(runs: DataFrame, conv_kind: str) -> DataFrame:
    """Results of the conversations whose rows lie in the runs."""
    # texts that occur in several runs of a conversation: later runs hold duplicates (each run is clear of its own)
    keys = runs.select("conv", "part", F.posexplode(F.arrays_zip("keys", "faults")).alias("at", "k")).where("k.faults NOT IN ('b', 'd')").select(
        "conv", "part", "at", F.col("k.keys").alias("key"))
    firsts = keys.groupBy("conv", "key").agg(F.min("part").alias("first"), F.count("*").alias("m")).where("m > 1")
    k, f = keys.alias("k"), firsts.alias("f")
    repeated = k.join(f, F.col("k.conv").eqNullSafe(F.col("f.conv")) & (F.col("k.key") == F.col("f.key")) & (F.col("part") > F.col("first"))).groupBy("part").agg(
        F.collect_list("at").alias("again"))  # at most the rows of one run; run numbers are unique over all conversations
    marked = runs.join(repeated, "part", "left").withColumn(
        "faults", F.when(F.col("again").isNull(), F.col("faults")).otherwise(
            F.transform("faults", lambda x, i: F.when(F.array_contains("again", i.cast("int")), "d").otherwise(x)))).drop("again", "keys")

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = ["".join(map(symbol, r.as_py(), x.as_py())) for r, x in zip(batch.column("roles"), batch.column("faults"))]
            yield pa.RecordBatch.from_pydict({"conv": batch.column("conv"), "part": batch.column("part"), "symbols": symbols, "costs": pa.array(map(transfer, symbols), pa.list_(pa.int64()))})

    marked = written(marked, "repair-marked")
    steps = written(marked.select("conv", "part", "roles", "faults").mapInArrow(costs, f"conv {conv_kind}, part bigint, symbols string, costs array<bigint>"), "repair-costs")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, end, begun = None, list(LAST), False
        for batch in batches:
            ends = []
            for c, steps_ in zip(batch.column("conv").to_pylist(), batch.column("costs").to_pylist()):
                if not begun or c != conv:
                    conv, end, begun = c, list(LAST), True
                ends.append(end)
                end = before(steps_, end)
            yield pa.RecordBatch.from_pydict({"part": batch.column("part"), "end": pa.array(ends, pa.list_(pa.int64()))})

    # one small row per run; a task walks a conversation's runs from the last on
    ends = steps.select("conv", "part", "costs").repartition("conv").sortWithinPartitions(F.col("conv"), F.col("part").desc()).mapInArrow(
        back, "part bigint, end array<bigint>")

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways = []
            for symbols, end in zip(batch.column("symbols").to_pylist(), batch.column("end").to_pylist()):
                lattice = Lattice(symbols, tuple(end))
                ways.append([(lattice.settle(q), *lattice.trace(q)) for q in range(4)])
            kind = pa.list_(pa.struct([("cost", pa.int64()), ("letters", pa.string()), ("kind", pa.int32())]))
            yield pa.RecordBatch.from_pydict({"part": batch.column("part"), "ways": pa.array([[dict(zip(("cost", "letters", "kind"), w)) for w in four] for four in ways], kind)})

    ways = steps.select("part", "symbols").join(ends, "part").mapInArrow(traces, "part bigint, ways array<struct<cost:bigint,letters:string,kind:int>>")

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, kind, conv_type = None, None, START, None
        for batch in batches:
            conv_type, rows = batch.schema.field("conv").type, []
            for i in range(batch.num_rows):
                c, roles, texts, turns, faults, four = (batch.column(x)[i].as_py() for x in ("conv", "roles", "texts", "turns", "faults", "ways"))
                if state is None or c != conv:
                    if state is not None:
                        rows.append((conv, *state.row()))
                    conv, state, kind = c, Summary(), START
                    state.cost = four[START]["cost"]
                way = four[kind]
                lines, kind = edited(way["letters"], roles, texts, kind)
                state.add([r[:1] for r in roles], faults, turns, way["letters"], lines)
            yield _table(conv_type, rows, NAMES, KINDS)
        if state is not None:
            yield _table(conv_type, [(conv, *state.row())], NAMES, KINDS)

    return marked.join(ways, "part").select("conv", "part", "roles", "texts", "turns", "faults", "ways").repartition("conv").sortWithinPartitions(
        "conv", "part").mapInArrow(forward, f"conv {conv_kind}, {RESULT}")


def damage(turns: DataFrame) -> DataFrame:
    """Rows with known faults, chosen by the CRC-32 of ``conv_id:turn`` modulo 20 (nulls: one space).

    0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats it, 4 makes its role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    part = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    return turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), part.alias("part")).where("part <> 0").select(
        "conv_id", "turn", F.when(F.col("part") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("part") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op13_conversation_repair(conversations: DataFrame) -> DataFrame:
    """Repairs of the damaged conversations; conversations that lost all rows have zeros, no letters and the hash of nothing."""
    done = repair(damage(conversations)).alias("r")
    every = conversations.select("conv_id").distinct().alias("e")
    zero = F.lit(0).cast("long")
    return every.join(done, F.col("e.conv_id").eqNullSafe(F.col("r.conv_id")), "left").select(
        "e.conv_id", *[F.coalesce(f"r.{c}", zero).alias(c) for c in NAMES[:6]], F.coalesce("r.audit", F.lit("")).alias("audit"),
        F.coalesce("r.repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


# Rows are walked one by one: cost and least letters so far for each of the four kinds of last turn.
OP13_SQL = """
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
parted AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(hex(k), 2 * i + 1, 2))::BIGINT FOR i IN range(octet_length(k))]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
    4294967295::BIGINT) % 20 AS part FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN part = 4 THEN 'user' ELSE role END AS role,
    CASE part WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, part
  FROM parted WHERE part <> 0),
copied AS (SELECT conv_id, turn, role, text FROM damaged UNION ALL SELECT conv_id, turn, role, text FROM damaged WHERE part = 3),
placed AS (
  SELECT *, coalesce(conv_id::VARCHAR, '') AS conv, row_number() OVER w AS n,
    left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS cut
  FROM copied WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(length(role) || ':' || role || text))),
faulty AS (
  SELECT *, CASE WHEN cut = '' THEN 'b' WHEN n > min(n) OVER (PARTITION BY conv, role, text) THEN 'd' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed),
counts AS (
  SELECT conv, max(n) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv),
walk AS (
  SELECT conv, 0::BIGINT AS n, [{'c': 0::BIGINT, 'a': '', 't': ''}, {'c': 1000000000, 'a': '', 't': ''},
    {'c': 5, 'a': 'I', 't': chr(10) || 'user:'}, {'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}] AS s
  FROM (SELECT DISTINCT conv FROM faulty)
  UNION ALL
  SELECT conv, n, [r[1], r[2], list_sort([r[3], {'c': r[1].c + 5, 'a': r[1].a || 'I', 't': r[1].t || chr(10) || 'user:'},
      {'c': r[2].c + 5, 'a': r[2].a || 'I', 't': r[2].t || chr(10) || 'user:'}, {'c': r[4].c + 5, 'a': r[4].a || 'I', 't': r[4].t || chr(10) || 'user:'}])[1],
    list_sort([r[4], {'c': r[3].c + 5, 'a': r[3].a || 'I', 't': r[3].t || chr(10) || 'assistant:'},
      {'c': r[1].c + 10, 'a': r[1].a || 'II', 't': r[1].t || chr(10) || 'user:' || chr(10) || 'assistant:'},
      {'c': r[2].c + 10, 'a': r[2].a || 'II', 't': r[2].t || chr(10) || 'user:' || chr(10) || 'assistant:'}])[1]] AS s
  FROM (
    SELECT w.conv, f.n, [
      {'c': s[1].c + 2, 'a': s[1].a || 'D', 't': s[1].t},
      list_sort([{'c': s[2].c + 2, 'a': s[2].a || 'D', 't': s[2].t}, {'c': s[1].c + keep_s, 'a': s[1].a || 'K', 't': s[1].t || own}])[1],
      list_sort([{'c': s[3].c + 2, 'a': s[3].a || 'D', 't': s[3].t}, {'c': s[1].c + keep_u, 'a': s[1].a || 'K', 't': s[1].t || own},
        {'c': s[2].c + keep_u, 'a': s[2].a || 'K', 't': s[2].t || own}, {'c': s[4].c + keep_u, 'a': s[4].a || 'K', 't': s[4].t || own},
        {'c': s[1].c + make, 'a': s[1].a || 'R', 't': s[1].t || chr(10) || 'user:' || text},
        {'c': s[2].c + make, 'a': s[2].a || 'R', 't': s[2].t || chr(10) || 'user:' || text},
        {'c': s[4].c + make, 'a': s[4].a || 'R', 't': s[4].t || chr(10) || 'user:' || text}])[1],
      list_sort([{'c': s[4].c + 2, 'a': s[4].a || 'D', 't': s[4].t}, {'c': s[3].c + keep_a, 'a': s[3].a || 'K', 't': s[3].t || own},
        {'c': s[3].c + make, 'a': s[3].a || 'R', 't': s[3].t || chr(10) || 'assistant:' || text}])[1]] AS r
    FROM walk w JOIN (
      SELECT conv, n, text, chr(10) || role || ':' || text AS own, stay + 1 AS make, CASE WHEN initial = 's' THEN stay ELSE 1000000000 END AS keep_s,
        CASE WHEN initial = 'u' THEN stay ELSE 1000000000 END AS keep_u, CASE WHEN initial = 'a' THEN stay ELSE 1000000000 END AS keep_a
      FROM (SELECT *, CASE WHEN fault IN ('b', 'd') THEN 1000000000 WHEN fault = 't' THEN 5 ELSE 0 END::BIGINT AS stay FROM faulty)) f
    ON w.conv = f.conv AND f.n = w.n + 1)),
ended AS (
  SELECT w.conv, list_sort([w.s[1], w.s[4]])[1] AS best FROM walk w JOIN counts c ON w.conv = c.conv AND w.n = c.rows)
SELECT e.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(d.best.c, 0)::BIGINT AS cost, coalesce(d.best.a, '') AS audit,
  sha256(coalesce(substr(d.best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counts c ON c.conv = coalesce(e.conv_id::VARCHAR, '')
LEFT JOIN ended d ON d.conv = c.conv
"""
