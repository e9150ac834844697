"""SentencePiece encoding and decoding over a table of distinct chunks.

If no piece of the model has a whitespace marker after another character, no merge crosses the place before
a marker, and a text's ids are those of its marked words ("▁word", with all markers before it) one after the
other.  Blanks that occur in no longer piece part chunks as well.  Each Python worker process keeps, over all its tasks, a
table from distinct chunk to ids: a chunk is segmented by the library once, and ids are joined back by position.
The table is bounded, so it never grows with the corpus; a chunk that fell out is segmented again.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Executors get this module's code with the job, wherever the package lies.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distinct chunks that a worker keeps, and the longest chunk that it keeps.
TABLE_ROWS, CHUNK_CHARS = 100_000, 48
#: Characters of text that are worked on at a time.
BATCH_CHARS = 2_000_000

MARK = "▁"


class ChunkTable:
    """Encodes texts exactly as the model's library does, without sampling or control ids."""

    def __init__(self, model: str, rows: int = TABLE_ROWS):
        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()) if not self.lib.is_control(i) and not self.lib.is_byte(i) and not self.lib.is_unknown(i)]
        joined = {c for p in pieces if len(p) > 1 for c in p}
        #: Pieces cross no marker, and the library marks the start of a text (checked, not assumed).
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces) and self.lib.encode("a b", out_type=str)[0].startswith(MARK) and self.lib.decode(self.lib.encode("  a  b ")) == "  a  b "
        alone = [c for c in "\n\t\r\x0b\x0c" if c not in joined]
        self.alone = next((c for c in alone if self.lib.encode(c)[:1] == self.lib.encode("")[:1] or len(self.lib.encode(c)) == 2), "")
        apart = "".join(map(re.escape, alone)) if self.alone else ""
        self.cut = re.compile(f"[{apart}]|{MARK}*[^{MARK}{apart}]+|{MARK}+" if apart else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.table: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.rows = rows

    def _segment(self, chunks: list[str]) -> list[bytes]:
        # a chunk with a marker is the library's own view of the text after it; others follow a character that stands alone
        marked = [c[0] == MARK for c in chunks]
        texts = [(c[1:] if m else self.alone + c).replace(MARK, " ") for c, m in zip(chunks, marked)]
        mark = [self.lib.piece_to_id(MARK)]
        found = self.lib.encode(texts, num_threads=1)
        # the library leaves an empty text without its marker
        return [np.array((mark if m and not t else ids) if m else ids[2:], dtype=np.int32).tobytes() for ids, m, t in zip(found, marked, texts)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.splits:
            return [np.array(ids, dtype=np.int32) for ids in self.lib.encode(texts, num_threads=1)]
        cut, table = self.cut.findall, self.table
        chunks = [cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = [c for c in set().union(*chunks) if c not in table]
        ids = dict(zip(new, self._segment(new)))
        if len(table) + len(ids) > self.rows:
            kept = {c: table[c] for c in set().union(*chunks) if c in table}
            table.clear()
            table.update(kept)
        once = {c: v for c, v in ids.items() if len(c) > CHUNK_CHARS}
        table.update((c, v) for c, v in ids.items() if len(c) <= CHUNK_CHARS)
        if once:
            joined = (b"".join([table[c] if c in table else once[c] for c in words]) for words in chunks)
        else:
            joined = (b"".join([table[c] for c in words]) for words in chunks)
        return [np.frombuffer(x, dtype=np.int32) for x in joined]


def worker_table(model: str) -> ChunkTable:
    """The table that this Python process keeps for a model, made on first use.

    It lives outside this module, whose code comes anew with each job.
    """
    kept = sys.modules.setdefault("_docspark_worker_tables", types.ModuleType("_docspark_worker_tables")).__dict__
    key = f"{model}|{os.path.getmtime(model)}|{os.path.getsize(model)}"
    if key not in kept:
        kept[key] = ChunkTable(model)
    return kept[key]


def by_chars(batches: Iterable[pa.RecordBatch], column: str, most: int = BATCH_CHARS, as_bytes: bool = False) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches of about `most` bytes of text (one row at least), with their texts (or UTF-8 bytes); null is empty."""
    none = b"" if as_bytes else ""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            part = batch.slice(start, stop - start)
            texts = part[column].cast(pa.binary()) if as_bytes else part[column]
            yield part, [t or none for t in texts.to_pylist()]
            start = stop


def tidied(run: Callable) -> Callable:
    """`run`, a function for mapInArrow, after which the worker gives back the memory that it doesn't use while it waits for its next task."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            with contextlib.suppress(OSError, AttributeError):  # of other C libraries
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def encode_decode(docs: DataFrame, model: str, text: str = "text", end_id: bool = True) -> DataFrame:
    """`docs` without `text`, with ids (array of int, the end id last if asked for) and decoded (the library's decode of them).

    Null texts are empty: the end id alone, decoded to nothing.  Rows are worked on in slices of bounded text, each
    whole; a single text is held as a whole.  Columns called ids or decoded are replaced.
    """
    keep = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(model)
        end = np.array([table.lib.eos_id()] * end_id, dtype=np.int32)
        for part, texts in by_chars(batches, text):
            ids = [np.concatenate([x, end]) for x in table.encode(texts)]
            decoded = table.lib.decode([x.tolist() for x in ids])
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            column = pa.ListArray.from_arrays(offsets, np.concatenate(ids), type=pa.list_(pa.field("element", pa.int32(), False)))
            yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), column, pa.array(decoded, pa.string())], names=[*keep, "ids", "decoded"])

    small_batches(docs.sparkSession)
    return docs.select(*keep, text).mapInArrow(tidied(run), schema)


def lengths(docs: DataFrame, model: str, text: str = "text", end_id: bool = False) -> DataFrame:
    """doc_id, n_tokens: encoded length of every text (null: empty)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(model)
        for part, texts in by_chars(batches, text):
            counts = [len(x) + end_id for x in table.encode(texts)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", text).mapInArrow(tidied(run), T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType())]))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_decode()'s rows."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
