"""Named files from tables of (book_id, name, content)."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Executors get this module's code with the job, wherever the package lies.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class EmptyExport(ValueError):
    """There is nothing to export."""


def write_files(files: DataFrame, folder: str) -> int:
    """Write each row to <folder>/<book_id>/<name>, under a name of its own first and then moved, so that repeated tasks do no harm; returns how many."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            n = 0
            for book, name, content in zip(*(batch[c].to_pylist() for c in ("book_id", "name", "content"))):
                fs.create_dir(f"{base}/{book}/{name}".rpartition("/")[0], recursive=True)
                held = f"{base}/{book}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(held, compression=None) as f:
                    f.write(content if isinstance(content, bytes) else (content or "").encode())
                fs.move(held, f"{base}/{book}/{name}")
                n += 1
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    folder = folder if "://" in folder else f"file://{folder}"
    total = files.select("book_id", "name", "content").mapInArrow(run, "n long").groupBy().sum("n").first()[0]
    if not total:
        raise EmptyExport("no pages to export")
    return total


def copy_files(files: DataFrame, folder: str) -> int:
    """Copy `path` of each row to <folder>/<book_id>/<name>; returns how many.  A file that lacks is an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = [*zip(*(batch[c].to_pylist() for c in ("book_id", "name", "path")))]
            for book, name, path in rows:
                source, place = pyarrow.fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
                fs.create_dir(f"{base}/{book}", recursive=True)
                held = f"{base}/{book}/.{uuid.uuid4().hex}"
                pyarrow.fs.copy_files(place, held, source_filesystem=source, destination_filesystem=fs)
                fs.move(held, f"{base}/{book}/{name}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(rows)], pa.int64())})

    folder = folder if "://" in folder else f"file://{folder}"
    return files.select("book_id", "name", "path").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0


def cache_files(analysis: DataFrame) -> DataFrame:
    """Page analyses (sha8, page_index, paragraphs, words, raw_markdown) as the files that readers.page_cache() reads, for write_files(): book_id is sha8."""
    page = F.concat(F.lit("page_"), F.format_string("%04d", F.col("page_index") + 1), F.lit("/"))
    both = F.array(F.struct(F.concat(page, F.lit("analysis.json")).alias("name"), F.to_json(F.struct("paragraphs", "words")).alias("content")), F.struct(F.concat(page, F.lit("raw.md")).alias("name"), F.coalesce("raw_markdown", F.lit("")).alias("content")))
    return analysis.select(F.col("sha8").alias("book_id"), F.inline(both))


def write_cache(analysis: DataFrame, path: str) -> None:
    """Page analyses as a table by book hash, settings and page."""
    analysis.write.partitionBy("sha8").mode("append").parquet(path)
