"""A campaign's memory as streaming state: each new epoch's factor merges into one triangle, and an epoch counts once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skyloom.operators.evidence import triangle

OUT = "campaign string, width int, r array<double>, z array<double>, log_offset double, n_observed long, n_epochs long"


class _Memory(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "width int, r array<double>, z array<double>, log_offset double, n_observed long, n_epochs long")
        self.seen = handle.getMapState("seen", "epoch string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        width, r, z, offset, n, epochs = self.total.get() if self.total.exists() else (None, None, None, 0.0, 0, 0)
        top = None if width is None else np.column_stack([np.reshape(r, (width, width)), z])
        for pdf in rows:
            for row in pdf.itertuples(index=False):
                if self.seen.containsKey((row.epoch,)):
                    continue
                self.seen.updateValue((row.epoch,), (epochs,))
                width = int(row.width)
                new = np.column_stack([np.reshape(row.r, (width, width)), row.z])
                u = triangle(new if top is None else np.vstack([top, new]))
                top = u[:width]
                offset, n, epochs = offset + row.log_offset - float(u[width, width] ** 2) / 2, n + int(row.n_observed), epochs + 1
        if top is None:
            return
        state = (width, top[:, :-1].ravel().tolist(), top[:, -1].tolist(), float(offset), n, epochs)
        self.total.update(state)
        yield pd.DataFrame([(key[0], *state)], columns=["campaign", "width", "r", "z", "log_offset", "n_observed", "n_epochs"])

    def close(self) -> None:
        pass


def remember(factors: DataFrame) -> DataFrame:
    """A stream of factors (campaign and the columns of evidence.DDL) as a stream of each campaign's memory after every batch.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    return factors.groupBy("campaign").transformWithStateInPandas(_Memory(), outputStructType=OUT, outputMode="Update", timeMode="None")
