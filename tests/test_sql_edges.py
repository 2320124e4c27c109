"""Queries against their SQL, value by value, on small tables with what the given ones lack."""

import duckdb

from ledgerloom.plans.queries import QUERIES, SQL


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables given as SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    return sorted(tuple(r[c] for c in names) for r in QUERIES[name](spark, str(folder)).collect()), sorted(want.fetchall())


def test_bucket_counts_of_an_entity_without_items(spark, tmp_path):
    customers = "SELECT * FROM (VALUES (1::BIGINT, 'BUILDING'), (2, 'BUILDING'), (2, 'BUILDING'), (3, 'OTHER')) v(c_custkey, c_mktsegment)"
    orders = "SELECT k::BIGINT AS o_orderkey, c::BIGINT AS o_custkey, s AS o_orderstatus, '1' AS o_orderpriority, DATE '2024-01-01' AS o_orderdate, 1.0 AS o_totalprice FROM (VALUES (1, 2, 'F'), (2, 2, 'O'), (3, 3, 'P')) v(k, c, s)"
    got, want = both(spark, tmp_path, "G03_bucket_counts", customer=customers, orders=orders)
    assert got == want == [(1, 0, 0, 0), (2, 1, 0, 1)]


def test_sheet_profile_of_a_text_of_exactly_the_long_length(spark, tmp_path):
    documents = "SELECT * FROM (VALUES (1::BIGINT, 'a', repeat('x', 200)), (3, 'a', 'x'), (4, 'b', repeat('x', 199)), (6, 'b', 'x'), (7, 'c', NULL)) v(doc_id, source, text)"
    got, want = both(spark, tmp_path, "G13_sheet_profile", documents=documents)
    assert got == want == [("a", 1, 1, 1, "text"), ("b", 1, 1, 0, "markdown"), ("c", 1, 0, 0, "markdown")]


def test_stream_due_of_times_between_milliseconds(spark, tmp_path):
    events = "SELECT CAST(t AS TIMESTAMP) AS ts, u::BIGINT AS user_id FROM (VALUES ('2024-01-01 10:00:00.000700', 1), ('2024-01-01 10:15:00.000200', 2), ('2024-01-01 10:15:00.002', 3), ('2024-01-01 11:00:00.001600', 4)) v(t, u)"
    got, want = both(spark, tmp_path, "T05_stream_due", events=events)
    assert got == want
    assert [(u, t.strftime("%H:%M:%S.%f")) for u, t in want] == [(1, "10:45:00.000000"), (2, "11:00:00.000000")]


def test_stream_due_at_the_clock_itself(spark, tmp_path):
    events = "SELECT CAST(t AS TIMESTAMP) AS ts, u::BIGINT AS user_id FROM (VALUES ('2024-01-01 10:15:00', 1), ('2024-01-01 11:00:00', 2)) v(t, u)"
    got, want = both(spark, tmp_path, "T05_stream_due", events=events)
    assert got == want
