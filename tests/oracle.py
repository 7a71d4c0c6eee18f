"""Run a registered query in Spark and its SQL twin in DuckDB and compare."""
from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if hasattr(v, "item"):
        return _canon(v.item())
    return v


def _rows(table):
    cols = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in cols]
    rows = [tuple(_canon(v) for v in row) for row in zip(*data)]
    return cols, sorted(rows, key=repr)


def compare(spark, con, sf, fn, sql):
    got = fn(spark, sf).toArrow()
    want = con.execute(sql).to_arrow_table()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    problems = []
    if gc != wc:
        problems.append(f"columns {gc} != {wc}")
    types = {c: (str(got.schema.field(c).type), str(want.schema.field(c).type)) for c in gc if c in wc}
    odd = {c: t for c, t in types.items() if t[0].replace("large_", "") != t[1].replace("large_", "")}
    if odd:
        problems.append(f"types {odd}")
    if len(gr) != len(wr):
        problems.append(f"rows {len(gr)} != {len(wr)}")
    elif gr != wr:
        bad = [(a, b) for a, b in zip(gr, wr) if a != b]
        problems.append(f"{len(bad)} rows differ, first: {[(c, x, y) for c, x, y in zip(gc, *bad[0]) if x != y]}")
    return problems, len(gr)
