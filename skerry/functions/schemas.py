"""Schemas of the entities that tables, files and nested columns hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = "id string, content string, source_file string, file_type string, page_number int, section_header string, metadata map<string,string>, chunk_type string"
CITATION = "source_file string, excerpt string, page_number int, section string, chunk_id string, relevance_score double"
MESSAGE = f"id string, role string, content string, citations array<struct<{CITATION.replace(' ', ':').replace(',:', ',')}>>, metadata map<string,string>, created_at timestamp"
THREAD = "id string, user_id string, title string, created_at timestamp, updated_at timestamp, metadata map<string,string>, deleted boolean"
DOCUMENT = "id string, user_id string, filename string, file_hash string, file_path string, file_size bigint, file_type string, chunk_count int, created_at timestamp, updated_at timestamp"
COLLECTION = "id string, name string, owner_id string, description string, created_at timestamp, updated_at timestamp"
AUDIT_EVENT = "event_type string, user_id string, timestamp timestamp, action string, resource string, details map<string,string>, ip_address string, user_agent string, success boolean, error_message string, session_id string"
TRACE = "trace_id string, ts_start_ms bigint, ts_end_ms bigint, total_ms bigint, meta map<string,string>, events array<struct<name:string,t0_ms:bigint,t1_ms:bigint,ms:bigint,data:map<string,string>,error:string>>"
EMBEDDING = "text string, embedding array<float>, model string"
SEARCH_RESULT = "id string, content string, score double, metadata map<string,string>"


def to_dict(rows: DataFrame) -> DataFrame:
    """One JSON text per row, in a column `json`; nulls are written."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_dict(rows: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """Rows of an entity from JSON texts; missing keys are null, malformed texts give a row of nulls."""
    return rows.select(F.from_json(column, schema).alias("x")).select("x.*")


def flat_metadata(metadata: Column) -> Column:
    """Custom keys as a flat store wants them: prefixed, nulls dropped."""
    kept = F.map_filter(metadata, lambda k, v: v.isNotNull())
    return F.transform_keys(kept, lambda k, v: F.concat(F.lit("custom_"), k))


def nested_metadata(flat: Column) -> Column:
    custom = F.map_filter(flat, lambda k, v: k.startswith("custom_"))
    return F.transform_keys(custom, lambda k, v: F.substring(k, 8, 1 << 20))
