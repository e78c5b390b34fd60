"""The thirteen canonical tables. Column names, types and order; VARCHAR unless a type is given."""

from __future__ import annotations

from pyspark.sql import types as T

TAIL = "source_path source_file file_sha256 ingest_batch_id ingested_at:ts schema_version:u8"

#: Columns in order as name or name:type; partition columns; sort key. Types: ts time without zone, json text, i32, i64, u8, u32, f64, bool.
TABLES = {
    "events": ("host channel provider_name provider_guid event_id:i32 version:u8 time_created:ts computer record_id:i64 process_id:u32 thread_id:u32 user_sid level:u8 level_name task:u32 opcode:u8 keywords activity_id related_activity_id event_data:json raw_xml", "host channel", "time_created"),
    "web_logs": ("host log_type time_created:ts client_ip server_ip server_port method uri_stem uri_query protocol_version status:i32 substatus:i32 win32_status:i32 bytes_sent:i64 bytes_received:i64 time_taken_ms:i64 username user_agent referer extra:json", "host log_type", "time_created"),
    "web_error_logs": ("host log_type time_created:ts severity pid_or_thread client_ip client_port server_ip server_port protocol_version method uri status:i32 logger message extra:json", "host log_type", "time_created"),
    "scheduled_tasks": ("host task_path task_name author description date_registered:ts enabled:bool hidden:bool principal_user_id principal_run_level principal_logon_type action_command action_arguments action_working_directory action_types trigger_types actions:json triggers:json", "host", "task_path"),
    "exchange_message_tracking": ("host time_created:ts client_ip client_hostname server_ip server_hostname source_context connector_id source event_id internal_message_id message_id network_message_id recipient_address recipient_status total_bytes:i64 recipient_count:i32 related_recipient_address reference message_subject sender_address return_path directionality tenant_id extra:json", "host", "time_created"),
    "exchange_logs": ("host log_type time_created:ts fields:json", "host log_type", "time_created"),
    "syslog": ("host time_created:ts hostname facility severity app_name proc_id msg_id message structured_data:json", "host", "time_created"),
    "auditd_logs": ("host time_created:ts audit_serial:i64 record_type syscall success exe comm uid auid pid ppid key fields:json", "host record_type", "time_created"),
    "journal_logs": ("host time_created:ts hostname unit syslog_identifier priority:i32 pid uid comm exe message fields:json", "host", "time_created"),
    "db_logs": ("host log_type time_created:ts severity component error_code thread_id user_name database_name client_address query_time_sec:f64 rows_examined:i64 message extra:json", "host log_type", "time_created"),
    "qcloud_logs": ("host log_type time_created:ts severity module code_file source_line process_id thread_id event_type user_name source_ip destination_port blocked:bool subject_process_id file_path file_md5 trace_id message raw_line extra:json", "host log_type", "time_created"),
    "aegis_logs": ("host log_type component logger time_created:ts severity context_id event_type task_name task_id duration_ms:i64 message raw_line extra:json", "host log_type", "time_created"),
    "registry": ("host hive_type hive_root key_path full_path key_last_write_time:ts value_name value_type value_text value_int:i64 value_data_hex value_size:i32 entropy:f64 transaction_log_applied:bool", "host hive_type", "full_path"),
}

_TYPES = {"": T.StringType(), "json": T.StringType(), "ts": T.TimestampNTZType(), "i32": T.IntegerType(), "i64": T.LongType(), "u8": T.ShortType(), "u32": T.LongType(), "f64": T.DoubleType(), "bool": T.BooleanType()}


def columns(table: str) -> list[tuple[str, str]]:
    """(name, type code) of each column, tail included."""
    return [tuple((c + ":").split(":")[:2]) for c in f"{TABLES[table][0]} {TAIL}".split()]


def schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in columns(table)])


def json_columns(table: str) -> list[str]:
    """Columns that hold JSON objects: not lists."""
    return [n for n, t in columns(table) if t == "json" and n not in ("actions", "triggers")]


def partition_by(table: str) -> list[str]:
    return TABLES[table][1].split()


def sort_key(table: str) -> str:
    return TABLES[table][2]
