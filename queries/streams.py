"""The streaming forms, run over all the files there are."""

from pyspark.sql import functions as F

from postlabel import fixed
from postlabel.operators import model as ml
from postlabel.session import scratch_path
from postlabel.streaming import (
    dedupe_stream as deduped,
    label_counts_stream as counted,
    label_stream as labelled,
    late_counts,
    predict_stream as predicted,
    read_stage,
    read_stream,
    run_available,
    run_once,
    split_late,
    thin_stream,
)

from .base import cascade_sql, documents, query
from .learning import grid_models

_DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
# Documents as posts that arrive a minute apart.
_ARRIVING_SQL = "SELECT doc_id AS ex_id, doc_id AS ordinal, text, 'post' AS source FROM documents"


def _arriving(spark, sf):
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    ts = F.timestamp_seconds(start + F.col("doc_id") * 60)
    return read_stream(spark, sf, _DOCUMENTS, "documents.parquet", "doc_id").select(
        F.col("doc_id").alias("ex_id"), ts.alias("ts"), "text", F.lit(fixed.POST).alias("source")
    )


@query(
    f"""WITH arriving AS ({_ARRIVING_SQL}),
{cascade_sql("arriving")}
SELECT ex_id, label, note FROM labelled"""
)
def label_stream(spark, sf):
    stream = labelled(_arriving(spark, sf)).select("ex_id", "label", "note")
    return run_once(stream, "label-stream")


# Which copy arrives first is open, so the texts are compared and not the ids.
@query("SELECT DISTINCT sha256(text) AS text_hash FROM documents")
def dedupe_stream(spark, sf):
    stream = deduped(_arriving(spark, sf), delay="3650 days").select("text_hash")
    return run_once(stream, "dedupe-stream")


@query(
    f"""WITH arriving AS ({_ARRIVING_SQL}),
{cascade_sql("arriving")}
SELECT strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(ex_id // 60), '%Y-%m-%d %H:%M') AS start,
  label, CAST(count(*) AS BIGINT) AS rows
FROM labelled GROUP BY ALL"""
)
def label_counts_stream(spark, sf):
    changes = run_once(counted(labelled(_arriving(spark, sf))), "label-counts", "update")
    latest = changes.groupBy("start", "label").agg(F.max_by("rows", "batch").alias("rows"))
    return latest.select(
        F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "label", "rows"
    )


# --- lots that arrive one after another --------------------------------------
LOTS = 4
_POSTS = "ex_id BIGINT, ts TIMESTAMP, text STRING, source STRING"


def _lots(spark, sf, late=False):
    """Documents as posts a minute apart, with the lot they arrive in; some come two lots late."""
    doc = F.col("doc_id")
    rows = documents(spark, sf)
    top = rows.agg(F.max("doc_id")).first()[0]
    lot = F.floor(doc * LOTS / F.lit(top + 1))
    if late:
        lot = F.when(doc % 7 == 3, F.least(lot + 2, F.lit(LOTS - 1))).otherwise(lot)
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    return rows.select(
        doc.alias("ex_id"),
        F.timestamp_seconds(start + doc * 60).alias("ts"),
        "text",
        F.lit(fixed.POST).alias("source"),
        lot.alias("lot"),
    )


def _arrive(rows, folder, lot):
    rows.where(F.col("lot") == lot).drop("lot").write.mode("append").parquet(folder)


@query(
    """SELECT doc_id AS ex_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS model_version,
  TRUE AS sums_to_one, TRUE AS confidence_is_largest, TRUE AS label_is_largest, TRUE AS same_as_batch
FROM documents"""
)
def predict_stream(spark, sf):
    """Even documents arrive, the query stops, another model is published, odd ones arrive, it goes on."""
    models, folder, out, progress = (scratch_path(spark, f"predict-stream-{x}") for x in ("models", "in", "out", "progress"))
    rows = _lots(spark, sf).withColumn("lot", F.col("ex_id") % 2)
    batches = []
    for lot, model in enumerate(grid_models(spark, sf)):
        version = ml.publish_model(model, models)
        _arrive(rows, folder, lot)
        stream = read_stream(spark, folder, _POSTS, "*.parquet")
        scored = run_available(predicted(stream, models), out, progress)
        own = ml.predict(rows.where(F.col("lot") == lot), ml.current_model(spark, models, version)[1])
        batches.append(own.select("ex_id", F.lit(version).alias("v"), F.struct("predicted_label", "confidence", F.map_entries("all_scores").alias("s")).alias("batch")))
    scores = F.map_values("all_scores")
    record = F.struct("predicted_label", "confidence", F.map_entries("all_scores").alias("s"))
    return scored.join(batches[0].unionByName(batches[1]), "ex_id", "left").select(
        "ex_id",
        F.col("model_version").cast("bigint").alias("model_version"),
        (F.abs(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) - 1) < 0.001).alias("sums_to_one"),
        (F.col("confidence") == F.array_max(scores)).alias("confidence_is_largest"),
        (F.col("all_scores")[F.col("predicted_label")] == F.col("confidence")).alias("label_is_largest"),
        F.coalesce((record == F.col("batch")) & (F.col("model_version") == F.col("v")), F.lit(False)).alias("same_as_batch"),
    )


# A text's state goes once the latest time seen is two delays past its first row; its next copy is
# emitted again. Of a text's copies in a lot the first counts.
@query(
    f"""WITH RECURSIVE arriving AS (
  SELECT doc_id AS id, sha256(text) AS text_hash, doc_id * {LOTS} // (max(doc_id) OVER () + 1) AS lot FROM documents),
latest AS (SELECT lot, max(max(id)) OVER (ORDER BY lot) AS m FROM arriving GROUP BY lot),
firsts AS (SELECT text_hash, lot, min(id) AS id, count(*) AS rows FROM arriving GROUP BY text_hash, lot),
placed AS (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY lot) AS k FROM firsts),
walk AS (
  SELECT text_hash, k, id AS kept, TRUE AS emitted FROM placed WHERE k = 1
  UNION ALL
  SELECT p.text_hash, p.k, CASE WHEN w.kept + 120 <= l.m THEN p.id ELSE w.kept END, w.kept + 120 <= l.m
  FROM walk w JOIN placed p ON p.text_hash = w.text_hash AND p.k = w.k + 1 JOIN latest l ON l.lot = p.lot - 1)
SELECT text_hash, CAST(count(*) FILTER (WHERE emitted) AS BIGINT) AS emitted,
  CAST(count(*) FILTER (WHERE emitted) - 1 AS BIGINT) AS again, max(kept) AS last_id,
  CAST((SELECT count(*) FROM arriving a WHERE a.text_hash = w.text_hash) AS BIGINT) AS copies FROM walk w GROUP BY text_hash"""
)
def dedupe_stream_expiry(spark, sf):
    """Four lots through two stages, with a delay of an hour: each lot is thinned, then deduped."""
    folder, thin, out, first, second = (scratch_path(spark, f"expiry-{x}") for x in ("in", "thin", "out", "first", "second"))
    rows = _lots(spark, sf)
    hashed = f"{_POSTS}, text_hash STRING"
    for lot in range(LOTS):
        _arrive(rows, folder, lot)
        stream = read_stream(spark, folder, _POSTS, "*.parquet").withColumn("text_hash", F.sha2("text", 256))
        thin_stream(stream, thin, first, order=("ts", "ex_id"))
        kept = run_available(deduped(read_stage(spark, thin, hashed)), out, second)
    copies = rows.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("copies"))
    emitted = kept.groupBy("text_hash").agg(F.count(F.lit(1)).alias("emitted"), F.max("ex_id").alias("last_id"))
    return emitted.join(copies, "text_hash").select("text_hash", "emitted", (F.col("emitted") - 1).alias("again"), "last_id", "copies")


# A row is late if its hour had ended an hour before the latest time in earlier lots.
@query(
    f"""WITH arriving AS (
  SELECT doc_id AS ex_id, doc_id AS ordinal, text, 'post' AS source FROM documents),
{cascade_sql("arriving")},
lots AS (
  SELECT ex_id, label, ex_id // 60 AS hour, CASE WHEN ex_id % 7 = 3 THEN least(lot + 2, {LOTS - 1}) ELSE lot END AS lot
  FROM (SELECT ex_id, label, ex_id * {LOTS} // (max(ex_id) OVER () + 1) AS lot FROM labelled)),
latest AS (SELECT lot, max(max(ex_id)) OVER (ORDER BY lot) AS m FROM lots GROUP BY lot),
judged AS (SELECT l.*, coalesce((l.hour + 1) * 60 <= p.m - 60, FALSE) AS late FROM lots l LEFT JOIN latest p ON p.lot = l.lot - 1)
SELECT strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(hour), '%Y-%m-%d %H:%M') AS start, label,
  CAST(count(*) FILTER (WHERE NOT late) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE late) AS BIGINT) AS late
FROM judged GROUP BY ALL"""
)
def label_counts_late(spark, sf):
    """Counts by hour of rows in time, and of rows that came too late, over four lots."""
    folder, staged, out, first, second = (scratch_path(spark, f"late-{x}") for x in ("in", "staged", "out", "first", "second"))
    rows = _lots(spark, sf, late=True)
    schema = "ex_id BIGINT, ts TIMESTAMP, label STRING"
    for lot in range(LOTS):
        _arrive(rows, folder, lot)
        stream = labelled(read_stream(spark, folder, _POSTS, "*.parquet", "ex_id")).select("ex_id", "ts", "label")
        split_late(stream, staged, first)
        changes = run_available(counted(read_stage(spark, staged, schema, late=False)), out, second, "update")
    latest = changes.groupBy("start", "label").agg(F.max_by("rows", "batch").alias("rows"))
    both = latest.join(late_counts(spark, staged, schema, ["label"]).drop("end"), ["start", "label"], "full")
    none = F.lit(0).cast("bigint")
    return both.select(
        F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "label", F.coalesce("rows", none).alias("rows"), F.coalesce("late", none).alias("late")
    )
