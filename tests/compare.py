"""Run a registered query on both engines and compare the rows."""

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "<null>"
    if isinstance(value, float):
        return repr(value + 0.0)
    return f"{type(value).__name__}:{value}"


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = [tuple(canonical(r[i]) for i in order) for r in cur.fetchall()]
    return sorted(names), sorted(rows)


def spark_rows(df):
    names = sorted(df.columns)
    rows = [tuple(canonical(r[c]) for c in names) for r in df.collect()]
    return names, sorted(rows)


def differences(df, con, sql):
    ours, theirs = spark_rows(df), sql_rows(con, sql)
    if ours[0] != theirs[0]:
        return f"columns differ: {ours[0]} / {theirs[0]}"
    if ours[1] == theirs[1]:
        return None
    only_spark = sorted(set(ours[1]) - set(theirs[1]))[:2]
    only_sql = sorted(set(theirs[1]) - set(ours[1]))[:2]
    text = f"rows {len(ours[1])} / {len(theirs[1])}"
    if only_spark and only_sql:
        for a, b in zip(only_spark, only_sql):
            diff = [(n, x, y) for n, x, y in zip(ours[0], a, b) if x != y]
            text += f"\n   {diff[:6]}"
    return text + f"\n   spark {only_spark[:1]}\n   sql   {only_sql[:1]}"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = "/root/testdata/" + sys.argv[1]
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, run in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            problem = differences(df, con, oracles[name]) if name in oracles else None
            note = "" if name in oracles else f" rows={df.count()} (no SQL)"
        except Exception as error:  # report and go on with the next query
            problem, note = f"{type(error).__name__}: {str(error)[:1500]}", ""
        bad += problem is not None
        print(f"{name}: {'ok' if problem is None else problem}{note} [{time.time() - start:.1f}s]", flush=True)
    print("failed:", bad)
