import __spark_entry__ as entry


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert entry.entry(spark).count() > 0


def test_general_queries_run(spark, data):
    from chunkloom.plans import dealt

    for name, query in dealt.QUERIES.items():
        assert query(spark, data).count() >= 0, name
    assert dealt.p3_found(spark, data).columns == ["record_kind", "record_key", "pos", "utc_us"]


def test_queries_equal_their_sql(spark, data):
    """Every general query with SQL on the smallest tables, as bags of rows."""
    import glob
    import os
    from collections import Counter

    import duckdb

    from chunkloom.plans import chunking, dealt

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    for module in (chunking, dealt):
        for name, sql in module.SQL.items():
            got = module.QUERIES[name](spark, data)
            columns = sorted(got.columns)
            rows = Counter(repr(tuple(r[c] for c in columns)) for r in got.collect())
            want = db.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({sql})").fetchall()
            assert rows == Counter(map(repr, want)), name
