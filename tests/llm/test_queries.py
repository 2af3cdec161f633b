import glob
import os
from collections import Counter

from chunkloom.llm import queries


def test_found_columns(spark, data):
    want = {"p2_found": ["delivery_id"], "p4_found": ["record_kind", "record_key", "pos"], "p5_found": ["delivery_id", "line_no"], "p6_found": ["id"], "p7_found": ["source_kind", "domain", "language", "n_tokens"],
            "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id_a", "doc_id_b"]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, data).columns == columns, name


def test_queries_equal_their_sql(spark, data):
    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    for name, sql in queries.SQL.items():
        got = queries.QUERIES[name](spark, data)
        columns = sorted(got.columns)
        rows = Counter(repr(tuple(r[c] for c in columns)) for r in got.collect())
        want = db.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({sql})").fetchall()
        assert rows == Counter(map(repr, want)), name
