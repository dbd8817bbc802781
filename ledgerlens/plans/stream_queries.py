"""Structured Streaming flows over the given tables, run until the available data is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.operators import evidence as E
from ledgerlens.operators import vectors as VX
from ledgerlens.plans import tables as T
from ledgerlens.plans.registry import CTES, query
from ledgerlens.session import new_folder, written
from ledgerlens.streaming import flows as S
from ledgerlens.streaming import refresh as R

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark, d, name):
    return S.file_stream(spark, d, T.load(spark, d, name).schema, f"{name}.parquet")


def write_arrivals(spark, parts, folder) -> int:
    """Write the parts one after the other, so that they arrive in this order; returns how many files a trigger has to take
    for one part.  A part is dealt over that many files: one file would be written, and its input be made, by one task."""
    files = spark.sparkContext.defaultParallelism
    for part in parts:
        part.repartition(files).write.mode("append").parquet(folder)
    return files


@query("m1_file_stream", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events GROUP BY event_type")
def m1(spark, d):
    out = new_folder(spark, "m1")
    S.run_available(table_stream(spark, d, "events"), f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"))


@query("m2_incremental_view", """
SELECT 'rec_'||user_id AS event_id, max(event_id) AS position, sha256(arg_max(event_type||'|'||value, event_id)) AS text_sha256 FROM events GROUP BY user_id""")
def m2(spark, d):
    """Several files arrive one per trigger; the view holds the newest row per key with its embedding."""
    base = new_folder(spark, "m2")
    rows = T.load(spark, d, "events").select(
        F.concat(F.lit("rec_"), "user_id").alias("event_id"), F.col("event_id").alias("position"),
        F.concat_ws("|", "event_type", F.col("value").cast("string")).alias("text"))
    rows = rows.withColumn("text_sha256", F.sha2("text", 256))
    rows.repartitionByRange(4, "position").write.parquet(f"{base}/in")

    def embed(df):
        v = VX.embed_blake2b(df, "event_id", "text", 16).withColumnRenamed("doc_id", "event_id")
        return df.join(v, "event_id", "left")

    stream = S.file_stream(spark, f"{base}/in", rows.schema, "*.parquet", per_trigger=1)
    S.run_available(stream, S.upsert_view(f"{base}/view", "event_id", "text_sha256", embed, buckets=8), f"{base}/checkpoint")
    return S.read_upserted(spark, f"{base}/view", 8).where("size(vector) = 16").select("event_id", "position", "text_sha256")


@query("m3_refresh_gate", "SELECT event_id FROM ledger_events WHERE event_type <> 'reference_document'")
def m3(spark, d):
    out = new_folder(spark, "m3")
    e = T.events(spark, d).select("event_id", "event_type")
    e.write.parquet(f"{out}/in")
    S.run_available(S.refresh_stream(S.file_stream(spark, f"{out}/in", e.schema, "*.parquet")), f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data").select("event_id")


CTES["range_corrections"] = """SELECT 'evt_'||position AS event_id, greatest(1, line_end // 2) AS line_end FROM ledger_events WHERE position % 10 = 0 AND position % 35 <> 0"""


@query("m2_corrections_refresh", """
SELECT e.event_id, (l.line_no - 1) // 64 AS page, sha256(string_agg(l.line_no||': '||l.text, chr(10) ORDER BY l.line_no)) AS text_sha256
FROM ledger_events e LEFT JOIN range_corrections c USING (event_id) JOIN source_lines l ON l.path = e.source_path AND l.line_no BETWEEN e.line_start AND coalesce(c.line_end, e.line_end) GROUP BY ALL""")
def m2_refresh(spark, d):
    """Events arrive, then corrections of the end of every fifth event's range: half of them pending, some with a wrong recorded value."""
    base = new_folder(spark, "m2-refresh")
    names = [c.split()[0] for c in R.LEDGER_DDL.split(", ")]
    e = written(T.events(spark, d).select(*[c.split()[0] for c in R.EVENT_DDL.split(", ") if c.split()[0] != "summary"]), "m2-events")
    rows = e.selectExpr("*", "event_id AS summary", "CAST(NULL AS STRING) AS target_id", "CAST(NULL AS STRING) AS field", "CAST(NULL AS LONG) AS recorded", "CAST(NULL AS LONG) AS corrected")
    fixes = e.where("position % 5 = 0").selectExpr(
        "concat('fix_', position) AS event_id", "position + 1000000000 AS position", "'amendment' AS event_type", "CASE WHEN position % 10 = 0 THEN 'completed' ELSE 'proposed' END AS status",
        "CAST(NULL AS STRING) AS source_path", "CAST(NULL AS STRING) AS heading", "CAST(NULL AS LONG) AS line_start", "CAST(NULL AS LONG) AS line_end", "'' AS summary",
        "event_id AS target_id", "'line_end' AS field", "line_end + CAST(position % 35 = 0 AS INT) AS recorded", "greatest(1L, CAST(floor(line_end / 2) AS LONG)) AS corrected")
    parts = rows.where("position % 2 = 0"), rows.where("position % 2 = 1"), fixes
    files = write_arrivals(spark, [part.select(*names) for part in parts], f"{base}/in")
    blocks = T.line_blocks(spark, d)

    def passages_of(events):
        ranges = events.select("event_id", F.col("source_path").alias("path"), F.col("line_start").alias("first_line"), F.col("line_end").alias("last_line")).where("last_line >= first_line")
        return E.render_pages(ranges, blocks, "event_id").withColumn("text_sha256", F.sha2("content", 256))

    def embed(passages):
        v = VX.embed_blake2b(passages.select("text_sha256", "content").distinct(), "text_sha256", "content", 16).withColumnRenamed("doc_id", "text_sha256")
        return passages.join(v, "text_sha256", "left")  # a text whose signed features cancel out has no vector

    views = R.RefreshedViews(spark, f"{base}/views", passages_of, embed, buckets=8)
    S.run_available(S.file_stream(spark, f"{base}/in", rows.select(*names).schema, "*.parquet", per_trigger=files), views, f"{base}/checkpoint")
    return views.passages().where("vector IS NULL OR size(vector) = 16").select("event_id", "page", "text_sha256")


@query("m4_stream_unique_ids", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def m4(spark, d):
    """Ids that come again in later files are rejected, however much later."""
    out = new_folder(spark, "m4")
    e = T.load(spark, d, "events").select("user_id", "event_id")
    bounds = e.agg(F.expr("percentile_approx(event_id, array(0.1, 0.5))").alias("b")).first().b
    parts = [e.where(f"event_id > {low} AND event_id <= {high}") for low, high in zip([-1, *bounds], [*bounds, 1 << 62])]
    files = write_arrivals(spark, parts, f"{out}/in")
    sink = S.UniqueIds(spark, f"{out}/ids", "user_id", "event_id", buckets=8, pages=2)
    S.run_available(S.file_stream(spark, f"{out}/in", e.schema, "*.parquet", per_trigger=files), sink, f"{out}/checkpoint")
    return sink.accepted(e.schema)


@query("m4_watermarked_ids", "SELECT DISTINCT user_id FROM events")
def m4_watermark(spark, d):
    out = new_folder(spark, "m4-watermark")
    e = table_stream(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    S.run_available(S.unique_stream(e, "user_id", "ts", "60 days"), f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data").select("user_id")


@query("m5_stream_state_machine", """
SELECT run_id, sequence, problem FROM (SELECT run_id, sequence, CASE WHEN from_state IS DISTINCT FROM prev THEN 'from_state'
 WHEN (coalesce(prev, ''), to_state) NOT IN (('','created'),('created','materialized'),('materialized','preflight_passed'),('preflight_passed','governor_running'),('governor_running','governed'),('governed','workers_running'),('workers_running','completed')) THEN 'transition' END AS problem
 FROM (SELECT *, lag(to_state) OVER (PARTITION BY run_id ORDER BY sequence) AS prev FROM runtime_events)) WHERE problem IS NOT NULL""")
def m5(spark, d):
    out = new_folder(spark, "m5")
    e = written(T.runtime_events(spark, d).select("run_id", "sequence", "from_state", "to_state"), "m5-events")
    parts = [e.where(F.floor(F.col("sequence") / 2) % 3 == part) for part in (2, 0, 1)]  # out of order: events wait for those before them
    files = write_arrivals(spark, parts, f"{out}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        stream = S.file_stream(spark, f"{out}/in", e.schema, "*.parquet", per_trigger=files)
        S.run_available(S.check_transitions_stream(stream, K.RUN_TRANSITIONS), f"{out}/data", f"{out}/checkpoint")
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema("run_id STRING, sequence BIGINT, problem STRING").parquet(f"{out}/data")


@query("m6_running_usage", """
SELECT activity_category, source, count(*) AS n, sum(total_tokens)::BIGINT AS total_tokens FROM usage_checked WHERE message IS NULL GROUP BY activity_category, source""")
def m6(spark, d):
    out = new_folder(spark, "m6")
    u = T.usage(spark, d).drop("ts")
    u.repartitionByRange(3, "event_id").write.parquet(f"{out}/in")
    save = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/totals")
    S.run_available(S.running_usage(S.file_stream(spark, f"{out}/in", u.schema, "*.parquet", per_trigger=1)), save, f"{out}/checkpoint", "complete")
    return spark.read.parquet(f"{out}/totals")
