"""Write-once sinks, checkpoints of provider calls, and a cache of computed values."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import tempfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_json(value) -> str:
    """Sorted keys, compact separators, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256(value) -> str:
    """Hash of the canonical form."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_json_once(path: str | os.PathLike, value, *, allow_replace: bool = False) -> bool:
    """Write a manifest by rename. The same content again is no change (False); other content is refused unless `allow_replace`."""
    path, text = Path(path), json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"
    if path.exists():
        if path.read_text(encoding="utf-8") == text:
            return False
        if not allow_replace:
            raise FileExistsError(f"{path} holds something else")
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, path)
    return True


def write_table_once(df: DataFrame, path: str) -> None:
    """Write a table that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def answered(requests: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (annotator, item, request_sha256) with a stored answer for the same request, and those still to be made."""
    key = ["annotator", "item", "request_sha256"]
    return requests.join(stored, key), requests.join(stored.select(*key), key, "left_anti")


def with_cache(values: DataFrame, column: str, cache: DataFrame | None, compute: Callable[[list[str]], list[list[float]]]) -> tuple[DataFrame, DataFrame]:
    """(values with `vector`, new cache rows): only distinct values that the cache lacks are computed, in Arrow batches."""
    known = values.sparkSession.createDataFrame([], "key string, vector array<float>") if cache is None else cache
    wanted = values.select(F.sha2(column, 256).alias("key"), F.col(column).alias("v")).where("v is not null").dropDuplicates(["key"]).join(known, "key", "left_anti")

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            out = compute(texts)
            if len(out) != len(texts):
                raise ValueError("the provider returned another number of vectors")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=["key", "vector"])

    fresh = wanted.mapInArrow(run, "key string, vector array<float>")
    both = known.unionByName(fresh)
    return values.join(both, F.sha2(values[column], 256) == both["key"], "left").drop("key"), fresh


def markdown(rows: DataFrame, order: str, columns: list[str], title: str) -> str:
    """A report of a small summary table (one row a case or strategy)."""
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    cell = lambda x: "n/a" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines += ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows.orderBy(order).select(*columns).toLocalIterator()]
    return "\n".join(lines) + "\n"


def unversioned(path: str | os.PathLike) -> Path:
    """`path` as an absolute path, if no repository would take up what is written there: it's ignored, or in none; else an error."""
    path = Path(path).absolute()
    folder = next(p for p in (path, *path.parents) if p.is_dir())
    inside = subprocess.run(["git", "-C", str(folder), "rev-parse", "--is-inside-work-tree"], capture_output=True, text=True)
    if inside.returncode == 0 and inside.stdout.strip() == "true" and subprocess.run(["git", "-C", str(folder), "check-ignore", "-q", str(path)]).returncode:
        raise ValueError(f"{path} would be taken into the repository")
    return path
