"""Several tables from one pass over files: rows of all of them in one frame, told apart by the column that is not null."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.stage import cut


def tables(files: DataFrame, schemas: dict[str, str], rows_of: Callable[[tuple], Iterator[tuple[str, tuple]]], size: int = 2000) -> dict[str, DataFrame]:
    """One table for each schema; ``rows_of`` gives (table, row) pairs of one file.  Files are read and parsed once, and what they hold is checkpointed."""
    types = {k: StructType.fromDDL(s) for k, s in schemas.items()}
    whole = StructType()
    for k, t in types.items():
        whole.add(k, t)
    arrow = to_arrow_schema(whole)
    names = {k: t.names for k, t in types.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                for table, row in rows_of(tuple(c[i].as_py() for c in batch.columns)):
                    held.append({table: dict(zip(names[table], row, strict=True))})
                    if len(held) >= size:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    found = cut(files.mapInArrow(run, whole))
    return {k: found.where(F.col(k).isNotNull()).select(f"{k}.*") for k in schemas}
