"""Every registered query against its DuckDB twin at sf0.01: same columns, same rows."""

import math
import os

import duckdb
import pytest
from conftest import SF01

import __spark_entry__ as entry

QUERIES = entry._QUERIES  # the optional training-data part has tests of its own
ORACLE = entry._ORACLE


def _canon(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        return "<nan>" if math.isnan(v) else repr(v)
    return str(v)


def _rows(cols, tuples):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_canon(r[i]) for i in order) for r in tuples)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events",):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF01, t)}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle_or_is_documented():
    rows_only = set(QUERIES) - set(ORACLE)
    assert not rows_only, rows_only
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    sdf = QUERIES[name](spark, SF01)
    s_cols, s_rows = _rows(sdf.columns, [tuple(r) for r in sdf.collect()])
    rel = duck.sql(ORACLE[name])
    d_cols, d_rows = _rows(rel.columns, rel.fetchall())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows


def test_logit_rows_and_entry(spark):
    out = QUERIES["logit_model"](spark, SF01).collect()
    terms = {r.term for r in out}
    assert "treatment_B" in terms and "intercept" in terms
    flagship = entry.entry(spark)
    assert flagship.count() == 2


def test_output_types_are_hash_stable(spark, duck):
    # both engines must print the same Python values: only BIGINT, DOUBLE, VARCHAR
    for name, q in QUERIES.items():
        if name == "logit_model":
            continue
        kinds = {f.dataType.simpleString() for f in q(spark, SF01).schema.fields}
        assert kinds <= {"bigint", "double", "string"}, (name, kinds)
    for name, sql in ORACLE.items():
        kinds = {str(t) for t in duck.sql(sql).types}
        assert kinds <= {"BIGINT", "DOUBLE", "VARCHAR"}, (name, kinds)


@pytest.mark.parametrize(
    "name", ["clean_sessions", "prep_summary", "daily_trend", "monthly_trend", "weekday_trend", "hourly_trend"]
)
def test_time_queries_ignore_session_time_zone(spark, duck, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        # analyzed plans keep the zone they were built under: rebuild the shared base plan
        entry._sessions.cache_clear()
        entry._clean.cache_clear()
        sdf = QUERIES[name](spark, SF01)
        s_cols, s_rows = _rows(sdf.columns, [tuple(r) for r in sdf.collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
        entry._sessions.cache_clear()
        entry._clean.cache_clear()
    rel = duck.sql(ORACLE[name])
    d_cols, d_rows = _rows(rel.columns, rel.fetchall())
    assert s_cols == d_cols and s_rows == d_rows


def test_survey_ids_cover_every_query_and_row():
    assert set(entry.SURVEY_IDS) == set(QUERIES)
    ids = " ".join(entry.SURVEY_IDS.values())
    for i in range(1, 31):
        assert f"Q{i:02d}" in ids, i
    for i in range(1, 17):
        assert f"D{i:02d}" in ids, i
