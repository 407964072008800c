"""Whole families through array kernels: rows of text are dealt out by family once, and no row of residues is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seqloom.functions import cells
from seqloom.shared import dealt


def typed(rows: DataFrame, *fields: str) -> str:
    """A schema of these fields: 'name type', or a bare name with the type it has in rows."""
    own = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ", ".join(f if " " in f else f"{f} {own[f]}" for f in fields)


def by_family(rows: DataFrame, run: Callable[[cells.Block], dict[str, object] | Iterator[dict[str, object]]], schema: str) -> DataFrame:
    """run over blocks of whole families (its result, or each of its results: a column for each name of the schema), each
    family in one task.

    A task holds the texts of one family, or of a batch of small ones, and arrays of their letters.
    """
    order = [c for c in ("family", "rank", "run_id") if c in rows.columns]
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cells.blocks(batches):
            got = run(b)
            for x in [got] if isinstance(got, dict) else got:
                yield pa.RecordBatch.from_arrays([_array(x[f.name], f.type) for f in arrow], schema=arrow)

    return dealt(rows, "family").sortWithinPartitions(*order).mapInArrow(stream, schema)


def _array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not isinstance(values, pa.Array):
        return pa.array(values, kind)
    return values if values.type == kind else values.cast(kind)


def both(ref: DataFrame, test: DataFrame) -> DataFrame:
    """Two alignments of the same rows as runs 0 and 1."""
    one = lambda x, k: x.select("family", "rank", F.lit(k).alias("run_id"), "aligned")
    return one(ref, 0).unionByName(one(test, 1))
