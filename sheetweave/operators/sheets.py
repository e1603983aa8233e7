"""Steps that need all rows of a sheet, run in NumPy over many whole sheets at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Columns = dict[str, np.ndarray]
#: Stands for a sheet_id that is null.
NO_SHEET = np.iinfo(np.int64).min


def whole_sheets(df: DataFrame, run: Callable[[Columns], dict], schema: str, *, order: list[str | Column] | None = None, least: int = 50_000) -> DataFrame:
    """run over the rows of df, some whole sheets of about ``least`` rows together at a time, sorted by sheet and order.

    run gets the columns by name and gives those of the schema. A call for each sheet would cost more than the work on it;
    memory follows the largest sheet.
    """
    to = to_arrow_schema(StructType.fromDDL(schema))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in (b for b in batches if b.num_rows):
            held.append(batch)
            n += batch.num_rows
            if n >= least:
                last = batch["sheet_id"][-1].as_py()
                if held[0]["sheet_id"][0].as_py() != last:
                    table = pa.Table.from_batches(held)
                    rest = int(np.searchsorted(sheet_of(table), NO_SHEET if last is None else last))
                    yield table[:rest]
                    held = table[rest:].to_batches()
                    n -= rest
        if held:
            yield pa.Table.from_batches(held)

    def sheet_of(table: pa.Table) -> np.ndarray:
        return table["sheet_id"].fill_null(NO_SHEET).to_numpy()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cut_up(batches):
            got = run({c: sheet_of(table) if c == "sheet_id" else table[c].to_numpy() for c in table.column_names})
            columns = []
            for f in to:
                x = np.ma.asarray(got[f.name])
                columns.append(pa.array(x.data, f.type, mask=x.data == NO_SHEET if f.name == "sheet_id" else np.ma.getmaskarray(x) if x.mask is not np.ma.nomask else None, from_pandas=True))
            yield from pa.Table.from_arrays(columns, schema=to).to_batches(10_000)

    return df.repartition("sheet_id").sortWithinPartitions("sheet_id", *(order or [])).mapInArrow(each, schema)


def begins(sheet: np.ndarray) -> np.ndarray:
    """Where each sheet begins, and the end."""
    return np.concatenate((np.flatnonzero(np.concatenate(([True], sheet[1:] != sheet[:-1])))[: len(sheet)], [len(sheet)]))


def pair_codes(sheet: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """For each array of values one of numbers that order the pairs of sheet (sorted) and value as the pairs themselves; equal for equal pairs."""
    known, code = np.unique(np.concatenate(values), return_inverse=True)
    place = np.repeat(np.arange(len(b := begins(sheet)) - 1), np.diff(b)) * len(known)
    return [place + c for c in np.split(code.reshape(-1), np.cumsum([len(v) for v in values])[:-1])]
