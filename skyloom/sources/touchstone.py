"""Touchstone (version 1) files of one or two ports as a table (path, freq_hz, row, col, re, im)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from skyloom.errors import IngestError

# Hertz of the units a file can name, and where each number pair of a two-port line belongs.
UNITS = {"HZ": 1.0, "KHZ": 1e3, "MHZ": 1e6, "GHZ": 1e9}
PAIRS = {1: [(1, 1)], 2: [(1, 1), (2, 1), (1, 2), (2, 2)]}


def parse(text: str, ports: int, flipped: bool = False) -> Iterator[tuple[float, int, int, float, float]]:
    """(freq_hz, row, col, re, im). Refuses a file without exactly one option line that names unit and format, or out of order."""
    option, before = None, -math.inf
    for line in text.splitlines():
        line = line.split("!")[0].strip()
        if line.startswith("#"):
            if option:
                raise IngestError("two option lines")
            words = line[1:].upper().split()
            unit = next((UNITS[w] for w in words if w in UNITS), None)
            form = next((w for w in words if w in ("RI", "MA", "DB")), None)
            if unit is None or form is None or "S" not in words:
                raise IngestError("the option line must name a unit, S and a format")
            option = unit, form
            continue
        if not line:
            continue
        if not option:
            raise IngestError("data before the option line")
        x = [float(w) for w in line.split()]
        if len(x) != 1 + 2 * len(PAIRS[ports]):
            raise IngestError(f"a line of {len(x)} numbers in a file of {ports} ports")
        if not x[0] > before:
            raise IngestError("frequencies must ascend")
        before = x[0]
        for (row, col), a, b in zip(PAIRS[ports], x[1::2], x[2::2]):
            size = 10 ** (a / 20) if option[1] == "DB" else a
            re, im = (a, b) if option[1] == "RI" else (size * math.cos(math.radians(b)), size * math.sin(math.radians(b)))
            yield x[0] * option[0], 3 - row if flipped else row, 3 - col if flipped else col, re, im
    if not option:
        raise IngestError("no option line")


def read_touchstone(spark: SparkSession, path: str, flipped: bool = False) -> DataFrame:
    """All .s1p and .s2p files at path; one file is read in one piece, as it is a few thousand lines at most."""
    if flipped and not path.lower().endswith(".s2p"):
        raise IngestError("only files of two ports can be flipped")

    def of(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                ports = {"s1p": 1, "s2p": 2}.get(name.lower().rsplit(".", 1)[-1])
                if ports is None:
                    raise IngestError(f"{name} is neither .s1p nor .s2p")
                yield pd.DataFrame([(name, *r) for r in parse(content.decode(), ports, flipped)], columns=["path", "freq_hz", "row", "col", "re", "im"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(of, "path string, freq_hz double, row int, col int, re double, im double")
