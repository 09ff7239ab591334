"""Runs a query and its SQL side by side."""
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)
    return v if v is None or isinstance(v, (bool, str)) else round(float(v), 6) if not isinstance(v, int) else v


def compare(con, spark, sf_dir, query, sql):
    """None if alike, else what differs."""
    own = query(spark, sf_dir)
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(own.columns) != sorted(names):
        return f"columns {sorted(own.columns)} and {sorted(names)}"
    order = sorted(names)
    a = Counter(tuple(plain(r[c]) for c in order) for r in own.collect())
    at = [names.index(c) for c in order]
    b = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if a != b:
        return f"{sum(a.values())} and {sum(b.values())} rows; only in Spark {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"
    return None if a else "no rows"
