"""Work that depends on the order of a sheet's rows, sheet by sheet but in batches of many sheets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_sheet(df: DataFrame, f: Callable[..., Iterable[tuple]], schema: str, prepare: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Rows that f gives for each sheet, from its columns as arrays; prepare works on a batch of whole sheets at once. A sheet's rows must fit in a task."""
    names = [part.split()[0] for part in schema.split(",")]

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            s = b.sheet.to_numpy()
            last = int(np.searchsorted(s, s[-1])) if len(s) else 0
            if last:
                yield b.iloc[:last]
            held = b.iloc[last:]
        if held is not None and len(held):
            yield held

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole(batches):
            b = prepare(b) if prepare else b
            cols = {c: b[c].to_numpy() for c in b.columns}
            cuts = np.flatnonzero(np.diff(cols["sheet"])) + 1
            out: list[tuple] = []
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
                if y > x:
                    sheet = int(cols["sheet"][x])
                    out += [(sheet, *row) for row in f(**{c: v[x:y] for c, v in cols.items() if c != "sheet"})]
            yield pd.DataFrame(out, columns=names)

    return df.repartition("sheet").sortWithinPartitions("sheet").mapInPandas(run, schema)
