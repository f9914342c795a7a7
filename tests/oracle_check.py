"""Compares catalog queries with their SQL on DuckDB.

    python tests/oracle_check.py [directory] [query ...]
"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TESTDATA = "/root/testdata"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, name, sf_dir):
    """(problem or None, row count, Spark seconds, SQL seconds)."""
    from riskweave.plans.catalog import QUERIES
    from riskweave.plans.oracles import ORACLES

    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    found = df.collect()
    spark_seconds = time.time() - start
    if name not in ORACLES:
        return None, len(found), spark_seconds, 0.0
    start = time.time()
    rel = con.sql(ORACLES[name])
    wanted = rel.fetchall()
    sql_seconds = time.time() - start
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {df.columns} / {rel.columns}", len(found), spark_seconds, sql_seconds
    a, b = _rows(df.columns, found), _rows(rel.columns, wanted)
    problem = None
    if a != b:
        sa, sb = set(a), set(b)
        problem = (f"{len(a)} / {len(b)} rows; {sorted(df.columns)} only Spark "
                   f"{sorted(sa - sb, key=repr)[:3]} only SQL {sorted(sb - sa, key=repr)[:3]}")
    return problem, len(found), spark_seconds, sql_seconds


if __name__ == "__main__":
    from riskweave.plans.catalog import QUERIES
    from riskweave.session import build_session

    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = build_session("oracle", "local[8]", {
        "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8"})
    session.sparkContext.setLogLevel("ERROR")
    con = connect(directory)
    for name in sys.argv[2:] or QUERIES:
        try:
            problem, rows, ours, theirs = compare(session, con, name, directory)
        except Exception as error:
            problem, rows, ours, theirs = f"{type(error).__name__}: {str(error)[:600]}", 0, 0, 0
        print(f"{'FAIL' if problem else 'ok':4} {name} rows={rows} spark={ours:.1f}s sql={theirs:.1f}s"
              + (f"\n     {problem}" if problem else ""), flush=True)
