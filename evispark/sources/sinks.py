"""Writers: guarded CSV, small JSON and Markdown documents, atomic replacement."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import unsafe_cell


def write_guarded_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with exactly ``columns`` in order; arrays are joined by `` | ``. Fails before writing if
    any text would be run as a formula."""
    if sorted(df.columns) != sorted(columns):
        raise ValueError(f"columns {df.columns} differ from {columns}")
    texts = {f.name for f in df.schema if f.dataType.typeName() == "string"}
    flat = [F.array_join(c, " | ").alias(c) if df.schema[c].dataType.typeName() == "array" else F.col(c) for c in columns]
    out = df.select(*flat)
    tests = [unsafe_cell(F.col(c)) for c in columns if c in texts or df.schema[c].dataType.typeName() == "array"]
    bad = F.lit(False)
    for test in tests:
        bad = bad | test
    if not out.where(bad).isEmpty():
        raise ValueError("a cell starts like a formula")
    out.write.csv(path, header=True)


def replace_file(path: str, data: bytes) -> None:
    """Write a small driver-side file whole: a temporary beside it is synced and renamed."""
    target = Path(path)
    if target.is_symlink():
        raise ValueError(f"{path} is a link")
    fd, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def canonical_json(value: object) -> bytes:
    """Sorted, compact UTF-8 JSON without NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def require_private(path: str, roots: list[str]) -> None:
    """Refuse a destination outside the private roots or behind a link."""
    target = Path(os.path.abspath(path))
    if str(path).startswith(("\\\\", "//")) or any(p.is_symlink() for p in (target, *target.parents)):
        raise ValueError(f"{path}: behind a link or on a share")
    if not any(Path(os.path.abspath(r)) in target.parents for r in roots):
        raise ValueError(f"{path}: not below a private root")


def counts_markdown(title: str, df: DataFrame, label: str, count: str) -> str:
    """A small report of group counts, sorted by label; ``None`` if there are none."""
    rows = df.groupBy(label).agg(F.sum(count).alias("n")).orderBy(label).collect()
    body = "\n".join(f"- {r[0]}: {r[1]}" for r in rows) or "None"
    return f"# {title}\n\n{body}\n"
