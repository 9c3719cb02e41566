"""Query log, results, history and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.functions import rules

# The query log: one row per prediction request with its lifecycle columns.
QUERY_LOG_SCHEMA = (
    "query_id bigint, min_lat double, max_lat double, min_lon double, max_lon double, status string, "
    "request_payload string, progress_percent int, status_message string, error_code string, error_message string, "
    "started_at timestamp_ntz, completed_at timestamp_ntz, updated_at timestamp_ntz, image_url string, "
    "image_width int, image_height int, prediction_result string, created_at timestamp_ntz"
)
DELETABLE = ("completed", "failed")
BACKFILL_MESSAGE = "Historical completed prediction"


def write_query_log(log: DataFrame, path: str) -> None:
    """Partitioned by status, sorted by time inside a file: pruning takes the place of the index."""
    log.sortWithinPartitions("created_at").write.mode("overwrite").partitionBy("status").parquet(path)


def read_query_log(spark, path: str) -> DataFrame:
    return spark.read.schema(QUERY_LOG_SCHEMA).parquet(path)


def _field(name: str) -> Column:
    return F.get_json_object("prediction_result", f"$.{name}")


def result_source(log: DataFrame) -> DataFrame:
    """Where the result of a completed query is: its stored path, an embedded document, or nowhere."""
    path, legacy = F.nullif(_field("result_path"), F.lit("")), _field("geojson")
    embedded = legacy.startswith("{")
    return log.filter("status = 'completed'").select(
        "query_id",
        F.when(path.isNotNull(), F.lit("path")).when(embedded, F.lit("embedded")).alias("kind"),
        path.alias("path"),
        F.when(path.isNull() & embedded, legacy).alias("geojson"),
    )


def result_metadata(df: DataFrame) -> DataFrame:
    """Stored metadata document and summary text of a run; the variant only for zero-shot runs."""
    zero = F.col("model_type") == "zeroshot"
    noun = (
        F.when(F.col("prediction_type") == "water_detection", F.lit("water polygons"))
        .when(F.col("prediction_type") == "object_detection", F.lit("objects"))
        .when(zero, F.concat(F.array_join("keywords", ", "), F.lit(" polygons/clusters")))
        .otherwise(F.lit("tree polygons/clusters"))
    )
    merged = F.concat(F.lit("Found "), F.col("feature_count").cast("string"), F.lit(" polygons/clusters for "), F.array_join("keywords", ", "))
    single = F.concat(F.lit("Found "), F.col("feature_count").cast("string"), F.lit(" "), noun)
    summary = F.when(F.size("keywords") > 1, merged).otherwise(single)
    with_summary = df.withColumn("summary", summary)
    document = F.to_json(
        F.struct(
            "prediction_type", "model_name", "result_path", "feature_count", "summary", "model_type",
            F.when(zero, F.col("model_variant")).alias("model_variant"), "keywords", "source_type",
        )
    )
    return with_summary.withColumn("prediction_result", document)


def history_items(log: DataFrame) -> DataFrame:
    """History entries out of the stored result documents."""
    return log.select(
        "query_id", "status", "created_at", "min_lat", "max_lat", "min_lon", "max_lon",
        _field("prediction_type").alias("prediction_type"),
        _field("model_name").alias("model_name"),
        rules.model_variant(_field("model_variant"), _field("model_name")).alias("model_variant"),
        _field("summary").alias("summary"),
        F.coalesce(F.from_json(_field("keywords"), "array<string>"), F.array().cast("array<string>")).alias("keywords"),
        _field("feature_count").try_cast("bigint").alias("feature_count"),
    )


def history(log: DataFrame, limit: int = 10) -> DataFrame:
    """Newest completed queries; ties by id."""
    done = log.filter("status = 'completed'").orderBy(F.col("created_at").desc(), "query_id").limit(limit)
    return history_items(done).drop("status")


def plan_deletes(log: DataFrame, ids: DataFrame) -> DataFrame:
    """Decision per id: not found, conflict while active, or delete."""
    found = ids.select("query_id").distinct().join(log.select("query_id", "status"), "query_id", "left")
    decision = (
        F.when(F.col("status").isNull(), F.lit("not_found"))
        .when(F.col("status").isin(*DELETABLE), F.lit("delete"))
        .otherwise(F.lit("conflict"))
    )
    return found.withColumn("decision", decision)


def apply_deletes(log: DataFrame, plan: DataFrame) -> DataFrame:
    """The log without the deletable ids."""
    return log.join(plan.filter("decision = 'delete'").select("query_id"), "query_id", "left_anti")


def backfill(log: DataFrame) -> DataFrame:
    """Old completed rows get full progress and a fixed message."""
    done = F.col("status") == "completed"
    return log.withColumn("progress_percent", F.when(done, F.lit(100)).otherwise(F.col("progress_percent"))).withColumn(
        "status_message", F.when(done, F.lit(BACKFILL_MESSAGE)).otherwise(F.col("status_message"))
    )


def join_exports(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Export requests with their result, or the reason why there is none."""
    state = log.select("query_id", "status")
    source = result_source(log)
    joined = requests.join(state, "query_id", "left").join(source, "query_id", "left")
    outcome = (
        F.when(F.coalesce(F.col("status") != "completed", F.lit(True)), F.lit("Completed prediction not found"))
        .when(F.col("kind").isNull(), F.lit("Prediction GeoJSON file not found"))
        .otherwise(F.lit("ok"))
    )
    return joined.withColumn("outcome", outcome)


def list_exports(manifests: DataFrame, query_id=None) -> DataFrame:
    """Exports newest first, of one query if asked."""
    kept = manifests if query_id is None else manifests.filter(F.col("query_id") == query_id)
    return kept.orderBy(F.col("created_at").desc(), "export_id")


def lookup_artifact(manifests: DataFrame, requests: DataFrame) -> DataFrame:
    """Artifact by export id and name; no row where either is unknown."""
    listed = manifests.select("export_id", F.inline("artifacts"))
    return requests.join(listed, ["export_id", "name"])


def latest_artifact(manifests: DataFrame, name: str) -> DataFrame:
    """The named artifact of the latest export of each query."""
    latest = manifests.groupBy("query_id").agg(
        F.max_by(F.struct("export_id", "artifacts"), F.struct("created_at", "export_id")).alias("e")
    )
    return latest.select("query_id", "e.export_id", F.inline("e.artifacts")).filter(F.col("name") == name)
