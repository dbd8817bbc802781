"""Run analysis: usage totals, arm summaries, paired deltas, bootstrap intervals, integrity report."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import constants as K
from ledgerlens import scale
from ledgerlens.functions.draws import AT_ONCE, md5_numbers
from ledgerlens.operators.validation import usage_problem
from ledgerlens.session import written


def summarize_usage(usage: DataFrame, run_id: str | None = None) -> DataFrame:
    """Rows (section, key, reason, n, total_tokens, share_percent) over valid observations.

    One aggregation over the data; the sections are built from its few result rows.
    Unknown counts stay null and never enter a total.
    """
    ok = usage.where(usage_problem().isNull())
    if run_id is not None:
        ok = ok.where(F.col("run_id") == run_id)
    base = ok.groupBy("activity_category", "source", "unavailable_reason").agg(F.count(F.lit(1)).alias("n"), F.sum("total_tokens").alias("t"))
    known = base.where("source <> 'unavailable'")
    total = known.agg(F.sum("t").alias("t"))
    none = F.lit(None).cast("string")
    share = F.round(F.col("total_tokens") * 100 / F.nullif(total.scalar(), F.lit(0)), 6)
    cat = known.groupBy("activity_category").agg(F.sum("n").alias("n"), F.sum("t").alias("total_tokens")).select(
        F.lit("category").alias("section"), F.col("activity_category").alias("key"), none.alias("reason"), "n", "total_tokens", share.alias("share_percent"))
    src = known.groupBy("source").agg(F.sum("n").alias("n"), F.sum("t").alias("total_tokens")).select(
        F.lit("source").alias("section"), F.col("source").alias("key"), none.alias("reason"), "n", "total_tokens", F.lit(None).cast("double").alias("share_percent"))
    gone = base.where("source = 'unavailable'").groupBy("activity_category", "unavailable_reason").agg(F.sum("n").alias("n")).select(
        F.lit("unavailable").alias("section"), F.col("activity_category").alias("key"), F.col("unavailable_reason").alias("reason"), "n",
        F.lit(None).cast("bigint").alias("total_tokens"), F.lit(None).cast("double").alias("share_percent"))
    head = base.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("source") != "unavailable", F.col("t"))).alias("total_tokens")).select(
        F.lit("all").alias("section"), none.alias("key"), none.alias("reason"), "n", "total_tokens", F.lit(None).cast("double").alias("share_percent"))
    return reduce(DataFrame.unionByName, [head, cat, src, gone])


def quality(weights: dict[str, float] | None = None):
    """Weighted quality of a run; weights must cover all metrics and sum to 1."""
    w = weights or {m: 1 / len(K.METRIC_FIELDS) for m in K.METRIC_FIELDS}
    if set(w) != set(K.METRIC_FIELDS) or abs(sum(w.values()) - 1) > 1e-9:
        raise ValueError("quality weights must cover all metrics and sum to 1")
    return reduce(lambda a, b: a + b, [F.col(m) * F.lit(w[m]) for m in K.METRIC_FIELDS])


def comparison_tokens():
    return F.coalesce("provider_total_tokens", "standardized_tokens")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str, width: int = 1000) -> DataFrame:
    """Exact median per key without holding a key's values in one task.

    Equal values are counted map-side, cumulative counts run in two levels over the value
    order, and the one or two middle values are picked by their cumulative count.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    cum = scale.running_sum(counts, keys, value, F.col("_n"), "_cum", width)
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    j = cum.join(total, keys)
    lo, hi = F.floor((F.col("_total") + 1) / 2), F.ceil((F.col("_total") + 1) / 2)
    before = F.col("_cum") - F.col("_n")
    hit = lambda pos: F.when((before < pos) & (F.col("_cum") >= pos), F.col(value))
    return j.groupBy(*keys).agg(((F.max(hit(lo)) + F.max(hit(hi))) / 2).alias(name))


def completed(runs: DataFrame) -> DataFrame:
    return runs.where("run_status = 'completed' AND evaluation_status = 'completed'")


def condition_summary(runs: DataFrame) -> DataFrame:
    """Rates, means, medians and totals per arm over completed, evaluated runs."""
    c = completed(runs).withColumn("tokens", comparison_tokens()).withColumn("quality", quality())
    r = lambda x: F.round(x, 6)
    g = c.groupBy("condition").agg(
        F.count(F.lit(1)).alias("run_count"), r(F.avg("audit_ready_success")).alias("audit_ready_success_rate"), r(F.avg("quality")).alias("mean_quality"),
        r(F.avg("tokens")).alias("mean_total_tokens"), F.sum("model_calls").alias("total_model_calls"), F.sum("mcp_calls").alias("total_mcp_calls"),
        F.sum("filesystem_calls").alias("total_filesystem_calls"), F.sum("tool_response_bytes").alias("total_tool_response_bytes"),
        r(F.avg("latency_ms")).alias("mean_latency_ms"), r(F.sum("cost_usd")).alias("total_cost_usd"),
        F.sum("unsupported_claim_count").alias("unsupported_claim_count"), F.sum("policy_violation_count").alias("policy_violation_count"),
        r(F.sum("tokens") / F.nullif(F.count(F.when(F.col("task_success") == 1, 1)), F.lit(0))).alias("tokens_per_successful_run"))
    return g.join(exact_median(c, ["condition"], "tokens", "median_total_tokens"), "condition")


def paired_deltas(runs: DataFrame, a: str, b: str) -> DataFrame:
    """Differences b - a per (task, repetition); incomplete pairs stay as rows with ``complete`` false."""
    c = completed(runs).where(F.col("condition").isin(a, b)).withColumn("tokens", comparison_tokens()).withColumn("quality", quality())
    pick = lambda arm, col: F.max(F.when(F.col("condition") == arm, F.col(col)))
    diff = lambda col: F.round(pick(b, col) - pick(a, col), 6)
    both = F.count(F.when(F.col("condition") == a, 1)).cast("boolean") & F.count(F.when(F.col("condition") == b, 1)).cast("boolean")
    return c.groupBy("task_id", "repetition").agg(
        both.alias("complete"), diff("quality").alias("quality_delta"), diff("audit_ready_success").alias("audit_ready_delta"),
        diff("tokens").alias("token_delta"), diff("latency_ms").alias("latency_delta"), diff("cost_usd").alias("cost_delta"),
        pick(a, "event_id").alias("pair_no"))


SHARE = 32  # equal values that share one draw
POISSON_TERMS = 128  # a Poisson draw of mean 32 beyond this has a chance below 1e-36


def _mixed(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def poisson_draws(keys: np.ndarray, means: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """Poisson numbers (rows x samples) by inversion of uniforms that hash (seed, key, sample): the same wherever they are drawn."""
    step = np.uint64(0x9E3779B97F4A7C15)
    start = _mixed(keys.astype(np.uint64) * step + np.uint64(seed))
    u = (_mixed(start[:, None] + np.arange(1, samples + 1, dtype=np.uint64)[None, :] * step) >> np.uint64(11)).astype(np.float64) / 2.0**53
    out = np.zeros(u.shape, np.int64)
    for mean in np.unique(means):
        rows = means == mean
        terms = np.exp(-float(mean)) * np.cumprod(np.concatenate([[1.0], float(mean) / np.arange(1, POISSON_TERMS)]))
        out[rows] = np.searchsorted(np.cumsum(terms), u[rows], "right")
    return out


def bootstrap_ci(df: DataFrame, by: Sequence[str], value: str, samples: int = 5000, seed: int = 0, digits: int = 6) -> DataFrame:
    """Mean and 95 % Poisson bootstrap interval per group; values are taken to ``digits`` digits.

    Equal values are counted map-side.  A value that occurs c times weighs Poisson(c) in each resample, drawn for shares of
    at most ``SHARE`` occurrences from a hash of (seed, value, share, resample), so neither partitioning nor a driver-side
    generator matters.  A task adds the weights and weighted values of all its shares per resample; one row per group and
    resample leaves it, whatever the number of observations.
    """
    by = list(by)
    unit = 10**digits
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.round(F.col(value) * unit).cast("bigint").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_c") - 1) / SHARE)))).select(
        *by, "_v", "_share", F.least(F.lit(SHARE).cast("bigint"), F.col("_c") - F.col("_share") * SHARE).alias("_n"))
    kinds = {f.name: f.dataType for f in counts.schema.fields}
    schema = ", ".join(f"`{b}` {kinds[b].simpleString()}" for b in by) + ", _b int, _w bigint, _s double"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            names, found = list(sums), [sums[k] for k in sums]
            columns = [pa.array([k[i] for k in names for _ in range(samples)], group_kinds[i]) for i in range(len(by))]
            both = np.concatenate(found, axis=1)
            columns += [pa.array(np.tile(np.arange(samples, dtype=np.int32), len(names))), pa.array(both[0].astype(np.int64)), pa.array(both[1])]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, [*by, "_b", "_w", "_s"])

        group_kinds = None
        for batch in batches:
            group_kinds = [batch.schema.field(b).type for b in by]
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                v, share, n = (part.column(c).to_numpy() for c in ("_v", "_share", "_n"))
                weights = poisson_draws(v * 1_000_003 + share, n, samples, seed)
                groups: dict[tuple, list[int]] = {}
                for i, g in enumerate(zip(*[part.column(b).to_pylist() for b in by])):
                    groups.setdefault(g, []).append(i)
                for g, rows in groups.items():
                    w = weights[rows]
                    add_ = np.stack([w.sum(0).astype(np.float64), (v[rows] / unit) @ w])
                    sums[g] = sums[g] + add_ if g in sums else add_
                if len(sums) >= 256:
                    yield flush()
        if sums:
            yield flush()

    drawn = counts.mapInArrow(add, schema).groupBy(*by, "_b").agg((F.sum("_s") / F.nullif(F.sum("_w"), F.lit(0))).alias("_m"))
    means = drawn.where("_m IS NOT NULL").withColumn("_m", F.round("_m", 9))
    w = Window.partitionBy(*by).orderBy("_m", "_b")
    ranked = means.withColumn("_r", F.row_number().over(w) - 1)
    pick = lambda q: F.max(F.when(F.col("_r") == int(q * (samples - 1)), F.col("_m")))
    ci = ranked.groupBy(*by).agg(pick(0.025).alias("ci_low"), pick(0.975).alias("ci_high"))
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    single = F.col("n") == 1
    out = sizes.join(ci, by, "left")
    return out.select(*by, "n", F.round("mean", 6).alias("mean"),
                      F.round(F.when(single, F.col("mean")).otherwise(F.col("ci_low")), 6).alias("ci_low"),
                      F.round(F.when(single, F.col("mean")).otherwise(F.col("ci_high")), 6).alias("ci_high"))


VALUE_BLOCK = 65_536  # values in a packed row


def resampled_ci(df: DataFrame, by: Sequence[str], order: str, value: str, samples: int = 5000, seed: int = 0,
                 small: int = 1 << 24) -> DataFrame:
    """Mean and 95 % bootstrap interval per group: every resample draws as many observations as there are, one by one.

    Draw j of resample b takes the row number md5(seed:b:j) mod n, so the draws do not depend on
    partitioning or on a driver-side generator.  The numbered values are written once, packed; a task
    holds ``small`` of them at most and makes the draws of its share of the resamples, of which only
    sums leave it, so no draw is ever a row.  A group of more values is held in several pieces, for
    each of which the draws are made again.
    """
    by = list(by)
    spark = df.sparkSession
    values = written(df.where(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias("_x")), "values")
    width = min(small, VALUE_BLOCK)
    per_piece = small // width
    span = per_piece * width
    keys = [values.schema[c] for c in by]
    packed_schema = T.StructType(keys + [T.StructField("_block", T.LongType()), T.StructField("_n", T.LongType()),
                                         T.StructField("_s", T.DoubleType()), T.StructField("_values", T.BinaryType())])

    def pack(block: pa.Table) -> pa.Table:
        x = block.sort_by("_pos").column("_x").to_numpy()
        made = pa.table({"_n": pa.array([len(x)]), "_s": pa.array([float(x.sum())]), "_values": pa.array([x.astype("<f8").tobytes()], pa.binary())})
        head = block.slice(0, 1).select([*by, "_block"])
        return pa.table([*head.columns, *made.columns], names=[f.name for f in packed_schema])

    numbered = scale.position_in_key(values, by, order, "_pos").withColumn("_block", F.floor((F.col("_pos") - 1) / width).cast("bigint"))
    packed = written(numbered.select(*by, "_pos", "_block", "_x").groupBy(*by, "_block").applyInArrow(pack, packed_schema), "packed")
    sizes = packed.groupBy(*by).agg(F.sum("_n").alias("n"), (F.sum("_s") / F.sum("_n")).alias("mean"))

    parts = min(samples, 4 * spark.sparkContext.defaultParallelism)
    task = [*by, "_part", "_piece"]
    work = packed.join(sizes.select(*by, "n"), by).select(
        *by, "n", F.floor(F.col("_block") / per_piece).cast("bigint").alias("_piece"), "_block", "_values", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    work = work.repartitionByRange(parts, *task).sortWithinPartitions(*task, "_block")
    sums_schema = T.StructType(keys + [T.StructField("n", T.LongType()), T.StructField("_b", T.LongType()), T.StructField("_s", T.DoubleType())])

    def drawn(held: np.ndarray, start: int, n: int, low: int, high: int) -> np.ndarray:
        """Sums of the draws of resamples low to high that fall on the values from number ``start`` on."""
        sums = np.zeros(high - low)
        for at in range(low * n, high * n, AT_ONCE):
            place = np.arange(at, min(at + AT_ONCE, high * n), dtype=np.int64)
            b = place // n
            numbers = md5_numbers(seed, b, place - b * n)
            pos = (numbers - numbers // np.uint64(n) * np.uint64(n)).astype(np.int64) - start
            if len(held) < n:
                mine = (pos >= 0) & (pos < len(held))
                b, pos = b[mine], pos[mine]
            if len(b):
                sums[b[0] - low:b[-1] - low + 1] += np.bincount(b - b[0], weights=held[pos])
        return sums

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a (group, part, piece) follow each other, in the order of their blocks."""
        now, head, held, filled = None, None, np.empty(0), 0

        def flush() -> pa.RecordBatch:
            n, part, piece = head.column("n")[0].as_py(), head.column("_part")[0].as_py(), head.column("_piece")[0].as_py()
            low, high = samples * part // parts, samples * (part + 1) // parts
            sums = drawn(held, piece * span, n, low, high)
            same = head.select([*by, "n"]).take(pa.array(np.zeros(high - low, dtype=np.int64)))
            return pa.RecordBatch.from_arrays([*same.columns, pa.array(np.arange(low, high)), pa.array(sums)], names=[f.name for f in sums_schema])

        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(c)[i].as_py() for c in task)
                if key != now:
                    if now is not None:
                        yield flush()
                    now, head, filled = key, batch.select([*by, "n", "_part", "_piece"]).take(pa.array([i])), 0
                    held = np.empty(min(head.column("n")[0].as_py() - key[-1] * span, span))
                block = np.frombuffer(batch.column("_values")[i].as_buffer(), dtype="<f8")
                held[filled:filled + len(block)] = block
                filled += len(block)
        if now is not None:
            yield flush()

    means = work.mapInArrow(draw, sums_schema).groupBy(*by, "n", "_b").agg(F.round(F.sum("_s") / F.col("n"), 9).alias("_m"))
    w = Window.partitionBy(*by).orderBy("_m", "_b")
    ranked = means.withColumn("_r", F.row_number().over(w) - 1)
    pick = lambda q: F.max(F.when(F.col("_r") == int(q * (samples - 1)), F.col("_m")))
    ci = ranked.groupBy(*by).agg(pick(0.025).alias("ci_low"), pick(0.975).alias("ci_high"))
    single = F.col("n") == 1
    out = sizes.join(ci, by, "left")
    return out.select(*by, "n", F.round("mean", 6).alias("mean"),
                      F.round(F.when(single, F.col("mean")).otherwise(F.col("ci_low")), 6).alias("ci_low"),
                      F.round(F.when(single, F.col("mean")).otherwise(F.col("ci_high")), 6).alias("ci_high"))


def unsafe_assertion():
    bypass = (
        (F.col("condition") == "mcp_claim_gate") & (F.col("material_claim_emitted") == 1) & (F.col("gate_required") == 1)
        & ((F.col("gate_called") == 0) | (F.col("gate_status") == "blocked")))
    return ((F.col("unsafe_material_claim") == 1) | bypass).cast("int")


def integrity_report(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Safety, coverage, mechanism use and burden per arm; a stratum that is absent yields null."""
    state = tasks.groupBy("task_id").agg(F.min("evidence_state").alias("evidence_state"))
    j = runs.where("run_status = 'completed'").where(F.col("condition").isin(*K.INTEGRITY_CONDITIONS)).join(state, "task_id")
    scored = F.col("evaluation_status") == "completed"
    clean = scored & (F.col("evidence_state") == "current_supported")
    fault = scored & (F.col("evidence_state") != "current_supported")
    covered = (
        (F.col("answer_emitted") == 1) & (F.col("false_block") == 0) & (F.col("evidence_binding_valid") == 1)
        & (F.col("citation_support_valid") == 1) & (F.col("citation_support_complete") == 1)).cast("int")
    rate = lambda cond, x: F.round(F.avg(F.when(cond, x)), 6)
    c = F.col
    return j.groupBy("condition").agg(
        F.count(F.when(scored, 1)).alias("run_count"), F.count(F.when(~scored, 1)).alias("unscored_completed_run_count"),
        rate(fault, unsafe_assertion()).alias("fault_unsafe_rate"), rate(clean, covered).alias("clean_coverage"),
        rate(clean, c("false_block")).alias("false_block_rate"), rate(scored, c("evidence_binding_valid")).alias("binding_accuracy"),
        rate(scored, c("citation_support_valid")).alias("citation_precision"), rate(scored, c("citation_support_complete")).alias("citation_recall"),
        rate(scored & (c("gate_required") == 1), c("gate_called")).alias("gate_recall"),
        rate(scored & (c("gate_required") == 0), c("gate_called")).alias("over_gating_rate"),
        rate(scored, c("provider_total_tokens")).alias("mean_total_tokens"), rate(scored, c("latency_ms")).alias("mean_latency_ms"),
        rate(scored, c("mcp_calls")).alias("mean_mcp_calls"), rate(scored, c("gate_calls")).alias("mean_gate_calls"))


def unsafe_deltas(tasks: DataFrame, runs: DataFrame, a: str = "filesystem", b: str = "mcp_claim_gate") -> DataFrame:
    """Unsafe-assertion difference b - a per complete pair of a fault task."""
    faults = tasks.groupBy("task_id").agg(F.min("evidence_state").alias("s")).where("s <> 'current_supported'")
    c = completed(runs).where(F.col("condition").isin(a, b)).join(faults.select("task_id"), "task_id", "left_semi").withColumn("u", unsafe_assertion())
    pick = lambda arm, col: F.max(F.when(F.col("condition") == arm, F.col(col)))
    p = c.groupBy("task_id", "repetition").agg(pick(a, "u").alias("ua"), pick(b, "u").alias("ub"), pick(a, "event_id").alias("pair_no"))
    return p.where("ua IS NOT NULL AND ub IS NOT NULL").select("task_id", "repetition", "pair_no", (F.col("ub") - F.col("ua")).cast("double").alias("delta"))


def telemetry(traces: DataFrame) -> DataFrame:
    """Per trial: usage of the last completed turn, calls by kind, tool names, usage limit."""
    turn = F.when(F.col("type") == "turn.completed", F.col("seq"))
    mcp = F.col("item_type") == "mcp_tool_call"
    g = traces.groupBy("trial_id").agg(
        F.max_by("input_tokens", turn).alias("input_tokens"), F.max_by("output_tokens", turn).alias("output_tokens"),
        F.count(F.when(mcp, 1)).alias("mcp_calls"), F.count(F.when(F.col("item_type") == "command_execution", 1)).alias("filesystem_calls"),
        F.count(F.when(mcp & (F.col("tool") == "memory_gate_claim"), 1)).alias("gate_calls"),
        F.countDistinct(F.when(mcp, F.col("tool"))).alias("n_tools"), F.max(turn).isNotNull().alias("turn_completed"),
        F.bool_or(F.coalesce((F.col("type") == "error") & F.contains(F.lower("message"), F.lit("usage limit")), F.lit(False))).alias("usage_limit_reached"))
    return g.withColumn("provider_total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def index_metrics(views: dict[str, DataFrame]) -> DataFrame:
    """Row count per view."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("view"), "row_count") for n, df in views.items()]
    return reduce(DataFrame.unionByName, parts)


def even_positions(df: DataFrame, keys: Sequence[str], position: str, m: int) -> DataFrame:
    """Sampling operator: rows at round(i (n-1)/(m-1)), i = 0..m-1 (half to even), all rows when n <= m."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = df.join(n, list(keys))
    step = (F.col("_n") - 1) / max(1, m - 1)
    near = F.round((F.col(position) - 1) / step).cast("bigint")
    picks = [F.bround(i * step, 0).cast("bigint") for i in range(m)]
    keep = (F.col("_n") <= m) | F.array_contains(F.array(*picks), (F.col(position) - 1).cast("bigint"))
    return j.where(keep).drop("_n")


def extreme_texts(df: DataFrame, by: Sequence[str], text: str, order: str) -> DataFrame:
    """Shortest, median and longest text per group by (length, order), positions 0, n/2, n-1.

    Positions come from counts per length (map-side) and a rank inside the one length that
    holds the position, so no group is sorted as a whole.
    """
    by = list(by)
    d = df.select(*by, order, F.length(text).cast("bigint").alias("len"))
    counts = d.groupBy(*by, "len").agg(F.count(F.lit(1)).alias("_n"))
    cum = scale.running_sum(counts, by, "len", F.col("_n"), "_cum", 1000).withColumn("_before", F.col("_cum") - F.col("_n"))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    c = cum.join(total, by)
    spots = F.array(*[F.struct(F.lit(n).alias("pick"), p.cast("bigint").alias("pos")) for n, p in (
        ("shortest", F.lit(0)), ("median", F.floor(F.col("_total") / 2)), ("longest", F.col("_total") - 1))])
    c = c.select(*by, "len", "_before", "_cum", F.explode(spots).alias("s")).where("s.pos >= _before AND s.pos < _cum")
    c = c.select(*by, "len", "s.pick", (F.col("s.pos") - F.col("_before") + 1).alias("_place"))
    inside = scale.position_in_key(d.join(c.select(*by, "len").distinct(), [*by, "len"], "left_semi"), [*by, "len"], order, "_place")
    return inside.join(c, [*by, "len", "_place"]).select(*by, "pick", order, "len")
