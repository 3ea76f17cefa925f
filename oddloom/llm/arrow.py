"""Arrow plumbing shared by the operators that run Python inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows handed to a batch function at once, so that memory follows a few texts and not an Arrow batch.
ROWS = 64


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it."""
    while name in columns:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[pa.Array]]], fields: str,
              keep: tuple[str, ...] = ("doc_id",), rows: int = ROWS) -> DataFrame:
    """``keep`` columns plus what ``make()(texts)`` returns, one row per document; a null text counts as empty.

    ``make`` runs once per task, so that models are loaded once. Other columns of ``docs`` are left out.
    """
    lead = [F.col(f"`{c}`") for c in keep]
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for part in slices(batches, rows):
            columns = [part.column(i) for i in range(len(keep))]
            made = each(part.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays(columns + made, names=[*keep, *names])

    names = [f.strip().split(" ", 1)[0].strip("`") for f in _split_fields(fields)]
    return docs.select(*lead, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"{kept}, {fields}")


def replace_text(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[str | None]]], rows: int = ROWS) -> DataFrame:
    """The same rows and columns with ``text`` rewritten; a null text stays null."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for part in slices(batches, rows):
            texts = part.column(at).to_pylist()
            new = iter(each([t for t in texts if t is not None]))
            made = pa.array([None if t is None else next(new) for t in texts], type=part.schema.field(at).type)
            yield part.set_column(at, part.schema.field(at), made)

    return docs.mapInArrow(run, docs.schema)


def _split_fields(fields: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(fields[last:i])
            last = i + 1
    return [*out, fields[last:]]


def lists(values: list[bytes], kind: pa.DataType, width: int) -> pa.Array:
    """A list array from the raw little-endian bytes of each row's values."""
    ends, total = [0], 0
    for v in values:
        total += len(v) // width
        ends.append(total)
    flat = pa.Array.from_buffers(kind, total, [None, pa.py_buffer(b"".join(values))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
