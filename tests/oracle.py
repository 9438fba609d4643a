"""Run a registered query and its DuckDB counterpart and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if hasattr(value, "asDict"):
        return _cell(list(value.asDict().values()))
    if isinstance(value, dict):
        return _cell(list(value.values()))
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r))
    )


def _family(kind: str) -> str:
    """What a type of either engine holds, whatever its width."""
    kind = kind.lower()
    if kind.startswith(("array", "struct", "map")) or kind.endswith("]") or kind in ("list", "json"):
        return "nested"
    if kind.endswith("int") or kind in ("integer", "hugeint", "number"):
        return "number"
    if kind.startswith(("decimal", "double", "float", "real")):
        return "number"
    return {"varchar": "string", "timestamp_ntz": "timestamp", "datetime": "timestamp"}.get(kind, kind)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def compare(spark, sf_dir, name, run, sql) -> str:
    """A text that starts with ``ok`` when both sides agree."""
    frame = run(spark, sf_dir)
    got = frame.collect()
    if sql is None:
        return f"ok rows-only {len(got)}"
    cursor = connect(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns differ: {sorted(frame.columns)} and {sorted(names)}"
    mine, theirs = _rows(frame.columns, got), _rows(names, cursor.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}; e.g. {mine[:2]} / {theirs[:2]}"
    for a, b in zip(mine, theirs):
        if a != b:
            diffs = [(n, x, y) for n, x, y in zip(sorted(names), a, b) if x != y]
            return f"rows differ in {diffs}"[:1500]
    for n, t in frame.dtypes:
        d = str(cursor.description[names.index(n)][1])
        if _family(t) != _family(d):
            return f"type of {n}: {t} and {d}"
    return f"ok {len(mine)} rows"
