"""Settings from the environment, a file of NAME=value lines, and the Spark session."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def setting(name: str, spark: SparkSession | None = None, path: str = ".env", given: str | None = None) -> str | None:
    """A setting, or None: as given by the caller, else of the session (docspark.<name>), of the environment (<NAME>), or of the file.

    Names don't tell upper from lower case.  In the file blank lines and lines that start with # say nothing, values may be quoted.
    """
    if given is not None:
        return given
    if spark is not None and (value := spark.conf.get(f"docspark.{name.lower()}", None)) is not None:
        return value
    for key, value in os.environ.items():
        if key.lower() == name.lower():
            return value
    if not Path(path).is_file():
        return None
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        key, sep, value = line.strip().removeprefix("export ").partition("=")
        if sep and not key.startswith("#") and key.strip().lower() == name.lower():
            value = value.strip()
            return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return None
