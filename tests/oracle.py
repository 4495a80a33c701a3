"""Compare a registered query with its SQL in DuckDB, as multisets of rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 5) + 0.0)
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(plain(x)) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v.isoformat()
    return repr(v)


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    names = sorted(spark_df.columns)
    ours = Counter(tuple(plain(r[n]) for n in names) for r in spark_df.toLocalIterator())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    if sorted(columns) != names:
        return False, f"columns {names} != {sorted(columns)}"
    at = [columns.index(n) for n in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    if ours == theirs:
        pairs = {n: (t, kinds[n]) for n, t in spark_df.dtypes}
        odd = {n: p for n, p in pairs.items() if _kind(p[0]) != _kind(p[1])}
        return True, f"{sum(ours.values())} rows" + (f" types {odd}" if odd else "")
    extra, lack = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return False, (
        f"rows {sum(ours.values())} vs {sum(theirs.values())} on {names}\n"
        f"    only spark ({sum((ours - theirs).values())}): {extra}\n"
        f"    only sql   ({sum((theirs - ours).values())}): {lack}")[:1800]


def _kind(t: str) -> str:
    t = t.lower()
    for kind, names in {
        "int64": ("bigint", "int64"), "int32": ("int", "integer", "int32"), "double": ("double", "float64"),
        "string": ("string", "varchar"), "bool": ("boolean", "bool"),
    }.items():
        if t in names:
            return kind
    if t.startswith("timestamp"):
        return "ts"
    if t.startswith("array") or t.endswith("[]"):
        return "list"
    return t
