"""Schemas of the catalog's tables and the checks that their keys stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the tables, by name; the first columns listed under KEYS are their keys.
TABLES = {
    "media_files": "id string, file_path string, original_path string, file_name string, file_size long, mime_type string, sha256_hash string, quick_hash string, phash binary, width int, height int, media_type string, created_at string, modified_at string, scanned_at string, source_type string, thumbnail string, scan_phase int, comment string",
    "media_exif": "media_id string, date_taken string, camera_make string, camera_model string, lens_model string, focal_length double, aperture double, iso int, gps_latitude double, gps_longitude double, gps_altitude double, orientation int",
    "tags": "id string, name string, category string, created_at string",
    "media_tags": "media_id string, tag_id string, confidence double, source string",
    "albums": "id string, name string, description string, cover_media_id string, auto_generated boolean, created_at string",
    "album_media": "album_id string, media_id string, sort_order int",
    "duplicate_groups": "id string, match_type string, similarity_score double, status string",
    "duplicate_members": "group_id string, media_id string, is_preferred boolean",
    "bcut_groups": "id string, group_reason string, member_count int, status string",
    "bcut_members": "group_id string, media_id string, quality_score double, sharpness_score double, exposure_score double, is_best boolean",
    "classification_rules": "id string, name string, priority int, conditions_json string, action_type string, action_value string, enabled boolean",
    "source_folders": "id string, path string, name string, added_at string, last_scanned_at string",
    "undo_journal": "id string, batch_id string, batch_name string, sequence int, operation string, source_path string, target_path string, metadata_json string, status string, executed_at string, undone_at string",
    "app_settings": "key string, value string",
    "nas_uploads": "id string, media_id string, sha256 string, source_path string, remote_path string, uploaded_at string",
    "watch_activity_log": "id string, folder_path string, event_type string, file_path string, detected_at string, processed boolean",
    "schedules": "id string, name string, cron_expression string, task_type string, task_params_json string, enabled boolean, last_run_at string, next_run_at string, created_at string",
    "schedule_runs": "id string, schedule_id string, started_at string, finished_at string, status string, result_json string",
    "sync_history": "id string, preset_id string, source_dir string, target_dir string, started_at string, finished_at string, files_copied long, files_updated long, files_skipped long, bytes_transferred long, status string, error_message string",
    "sync_file_checksums": "id string, sync_history_id string, file_path string, xxhash64 string, file_size long, modified_at string, synced_at string",
    "known_devices": "uuid string, label string, last_mount_point string, associated_source_folder string, first_seen_at string, last_seen_at string",
}
# Unique keys and references.
KEYS = {
    "media_files": [["id"], ["file_path"]], "media_exif": [["media_id"]], "tags": [["id"], ["name"]], "media_tags": [["media_id", "tag_id"]], "albums": [["id"]], "album_media": [["album_id", "media_id"]],
    "duplicate_groups": [["id"]], "duplicate_members": [["group_id", "media_id"]], "bcut_groups": [["id"]], "bcut_members": [["group_id", "media_id"]], "source_folders": [["id"], ["path"]], "nas_uploads": [["id"], ["media_id", "remote_path"]],
    "undo_journal": [["id"]], "app_settings": [["key"]], "classification_rules": [["id"]], "schedules": [["id"]], "schedule_runs": [["id"]], "sync_history": [["id"]], "known_devices": [["uuid"]],
}
REFERENCES = {
    "media_exif": [("media_id", "media_files", "id")], "media_tags": [("media_id", "media_files", "id"), ("tag_id", "tags", "id")], "album_media": [("album_id", "albums", "id"), ("media_id", "media_files", "id")],
    "duplicate_members": [("group_id", "duplicate_groups", "id"), ("media_id", "media_files", "id")], "bcut_members": [("group_id", "bcut_groups", "id"), ("media_id", "media_files", "id")], "schedule_runs": [("schedule_id", "schedules", "id")],
}


def struct(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], struct(table))


def reset(spark: SparkSession) -> dict[str, DataFrame]:
    """An empty library."""
    return {t: empty(spark, t) for t in TABLES}


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rule, n: keys that repeat and references that lead nowhere."""
    found = []
    for name, df in tables.items():
        for key in KEYS.get(name, ()):
            filled = df.dropna(subset=key)
            repeats = filled.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1")
            found.append(repeats.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit("unique " + ", ".join(key)).alias("rule"), "n"))
        for column, other, key in REFERENCES.get(name, ()):
            if other in tables:
                lost = df.where(F.col(column).isNotNull()).join(tables[other].select(F.col(key).alias(column)), column, "left_anti")
                found.append(lost.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(f"{column} in {other}").alias("rule"), "n"))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.where("n > 0")
