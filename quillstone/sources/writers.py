"""Writers of the run directory: atomic, ordered, NaN-free."""

from __future__ import annotations

import contextlib
import json
import os
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import Any, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@contextlib.contextmanager
def atomic_text(path: str | Path) -> Iterator[TextIO]:
    """A text file that appears whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            yield f
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(temp)
        raise


def save_json(path: str | Path, data: Any) -> None:
    """Strict JSON: NaN and infinities are errors and leave the target as it was."""
    text = json.dumps(data, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False)
    with atomic_text(path) as f:
        f.write(text + "\n")


def append_json_line(path: str | Path, record: dict[str, Any]) -> None:
    line = json.dumps(record, ensure_ascii=False, allow_nan=False)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a", encoding="utf-8", newline="") as f:
        f.write(line + "\n")
        f.flush()
        os.fsync(f.fileno())


def write_json_lines(path: str | Path, records: Iterable[dict[str, Any]]) -> None:
    with atomic_text(path) as f:
        for r in records:
            f.write(json.dumps(r, ensure_ascii=False, allow_nan=False) + "\n")


def finite(df: DataFrame) -> DataFrame:
    """``df`` with every double checked: NaN and infinities are errors."""
    checks = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            c = F.col(name)
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            checks[name] = F.when(bad, F.raise_error(F.lit(f"{name} is not finite")).cast(kind)).otherwise(c)
    return df.withColumns(checks) if checks else df


def write_csv(df: DataFrame, path: str, *order: str, columns: Iterable[str] = ("operation", "solution")) -> None:
    """An ordered CSV with header; the order is global over the part files."""
    ordered = df.orderBy(*order) if order else df
    asis = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    ordered.select(*columns).write.mode("overwrite").options(**asis).option("header", True).option("escape", '"').option("lineSep", "\n").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    finite(df).write.mode("overwrite").json(path)


def append_json(df: DataFrame, path: str) -> None:
    """New immutable files in a directory: what a file stream can pick up."""
    finite(df).write.mode("append").json(path)
