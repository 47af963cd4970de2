"""A campaign's ordered epochs as streaming state: a tree of segments, so that epochs may come late, in any order and twice.

Epochs of neighbouring numbers are leaves of one node, nodes of neighbouring numbers children of the next; a node keeps the segment that each child amounts to.
A batch changes the nodes above its epochs and no others, and the root is the whole campaign's segment. An epoch that has come before is refused.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skyloom.operators.chain import Transition, _Segment

#: Children of a node, as a power of two; levels that numbers of 64 bits need.
BITS = 6
LEVELS = 11
OUT = "campaign string, width int, r array<double>, z array<double>, log_offset double, n_observed long, n_epochs long, n_refused long"


class _Chain(StatefulProcessor):
    def __init__(self, transition: Transition):
        self.transition = transition

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a node's children as (number, segment, epochs, observed), in order
        self.nodes = handle.getMapState("nodes", "level int, at string", "children binary")
        self.refused = handle.getValueState("refused", "n long")

    def _children(self, level: int, at: int) -> dict:
        key = (level, str(at))
        return pickle.loads(self.nodes.getValue(key)[0]) if self.nodes.containsKey(key) else {}

    def _whole(self, children: dict) -> tuple:
        """What the children amount to, one after the other."""
        (segment, epochs, observed), *rest = (children[i] for i in sorted(children))
        for other, n, m in rest:
            segment, epochs, observed = segment.then(other, self.transition), epochs + n, observed + m
        return segment, epochs, observed

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        refused = self.refused.get()[0] if self.refused.exists() else 0
        new: dict[int, tuple] = {}
        for pdf in rows:
            for row in pdf.itertuples(index=False):
                seq = int(row.seq) + (1 << 63)  # never negative
                if seq in new:
                    refused += 1
                    continue
                width = int(row.width)
                r = np.reshape(np.asarray(row.r, float), (-1, width))
                new[seq] = _Segment(r, np.asarray(row.z, float), float(row.log_offset), True), 1, int(row.n_observed)
        whole = None
        for level in range(LEVELS):
            above: dict[int, dict] = {}
            for seq, x in new.items():
                above.setdefault(seq >> BITS, {})[seq] = x
            new = {}
            for at, changed in above.items():
                children = self._children(level, at)
                if level == 0:
                    known = changed.keys() & children.keys()
                    refused += len(known)
                    changed = {k: v for k, v in changed.items() if k not in known}
                    if not changed:
                        continue
                children |= changed
                self.nodes.updateValue((level, str(at)), (pickle.dumps(children),))
                new[at] = self._whole(children)
        self.refused.update((refused,))
        whole = new.get(0) or self._root()
        if whole is None:
            return
        segment, epochs, observed = whole
        r, z, offset = segment.closed(self.transition)
        yield pd.DataFrame([(key[0], r.shape[1], r.ravel().tolist(), z.tolist(), float(offset), observed, epochs, refused)], columns=["campaign", "width", "r", "z", "log_offset", "n_observed", "n_epochs", "n_refused"])

    def _root(self) -> tuple | None:
        children = self._children(LEVELS - 1, 0)
        return self._whole(children) if children else None

    def close(self) -> None:
        pass


def remember_chain(epochs: DataFrame, transition: Transition) -> DataFrame:
    """A stream of epochs (campaign, seq and the columns of evidence.DDL) as a stream of each campaign's marginal over theta after every batch: what
    chain.chain_marginal gives of the epochs so far, in whatever order and batches they came. n_refused counts those whose seq had come before.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    slim = epochs.selectExpr("campaign", "cast(seq as long) as seq", "width", "r", "z", "log_offset", "n_observed")
    return slim.groupBy("campaign").transformWithStateInPandas(_Chain(transition), outputStructType=OUT, outputMode="Update", timeMode="None")
