"""Runs registered queries beside their SQL and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        if isinstance(x, float):
            return f"{x:.9g}" if x else "0"
        return str(x)

    return sorted(tuple(value(r[k]) for k in order) for r in rows)


def differences(spark, con, sf_dir, run, sql):
    df = run(spark, sf_dir)
    got = df.collect()
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = canonical(got, df.columns), canonical(want, names)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    return next((f"{x} and {y}" for x, y in zip(a, b, strict=True) if x != y), None)
