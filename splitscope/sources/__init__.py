from .sessions import (
    CSV_COLUMNS,
    CSV_TIME,
    SESSION_SCHEMA,
    conform,
    load_test_sessions,
    read_sessions,
    read_sessions_csv,
    sessions_from_events,
    write_sessions,
    write_sessions_csv,
)

__all__ = [
    "CSV_COLUMNS",
    "CSV_TIME",
    "SESSION_SCHEMA",
    "conform",
    "load_test_sessions",
    "read_sessions",
    "read_sessions_csv",
    "sessions_from_events",
    "write_sessions",
    "write_sessions_csv",
]
