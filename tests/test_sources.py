"""Session readers: the published CSV header, renames and exact decimals."""

from decimal import Decimal

import splitscope as ss


def test_csv_reader_renames_and_types(spark, tmp_path):
    p = tmp_path / "sessions.csv"
    p.write_text(
        ",".join(ss.CSV_COLUMNS)
        + "\n"
        + "u1,s1,2025-01-01 10:00:00,A,desktop,US,new_user,3.25,4,2,151.50,0,1\n"
        + "u2,s2,2025-01-02 11:30:00,B,mobile,IN,anonymous,-0.40,0,0,700.00,1,0\n"
    )
    df = ss.read_sessions_csv(spark, str(p))
    assert df.columns == [f.name for f in ss.SESSION_SCHEMA.fields]
    rows = df.orderBy("session_id").collect()
    assert rows[0].page_load_time_sec == Decimal("3.25") and rows[0].group_id == "A"
    assert str(rows[0].session_timestamp) == "2025-01-01 10:00:00"
    q = {r.session_id: r.data_quality for r in ss.clean(df).collect()}
    assert q == {"s1": "Normal", "s2": "Anomaly"}


def test_parquet_round_trip(spark, tmp_path):
    src = ss.load_test_sessions(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "t")
    ss.write_sessions(src, path, partition_by="group_id")
    back = ss.read_sessions(spark, path)
    assert back.count() == src.count()
    assert sorted(back.columns) == sorted(src.columns)
