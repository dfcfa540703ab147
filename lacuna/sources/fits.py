"""Binary tables of FITS files (FITS standard 4.0), read by a partitioned Python data source."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 2880
ROWS = 250_000  # a partition

#: The standard's type codes, with NumPy's and Spark's.
TYPES = {"L": ("u1", "boolean"), "B": ("u1", "short"), "I": (">i2", "short"), "J": (">i4", "int"), "K": (">i8", "long"), "E": (">f4", "double"), "D": (">f8", "double"), "A": ("S", "string")}


def _header(f) -> dict[str, str]:
    cards = {}
    while True:
        block = f.read(BLOCK).decode("ascii", "replace")
        if len(block) < BLOCK:
            raise ValueError("a FITS header without an end")
        for k in range(0, BLOCK, 80):
            card = block[k : k + 80]
            name = card[:8].strip()
            if name == "END":
                return cards
            if card[8:10] == "= ":
                value = card[10:]
                cards[name] = value.split("'")[1].strip() if value.lstrip().startswith("'") else value.split("/")[0].strip()


def _skip(f, head: dict[str, str]) -> None:
    size = abs(int(head.get("BITPIX", "8"))) // 8 if int(head.get("NAXIS", "0")) else 0
    for k in range(1, int(head.get("NAXIS", "0")) + 1):
        size *= int(head[f"NAXIS{k}"])
    size += int(head.get("PCOUNT", "0"))
    f.seek(-(-size // BLOCK) * BLOCK, 1)


def describe(path: str, hdu: int = 1) -> tuple[int, int, int, list[tuple[str, str, int]]]:
    """Where the table's data start, bytes a row, rows, and its columns (name, type code, repeat)."""
    with open(path, "rb") as f:
        head = _header(f)
        for _ in range(hdu):
            _skip(f, head)
            head = _header(f)
        if head.get("XTENSION") != "BINTABLE":
            raise ValueError("only binary tables are read")
        columns = []
        for k in range(1, int(head["TFIELDS"]) + 1):
            repeat, code = re.match(r"(\d*)([A-Z])", head[f"TFORM{k}"]).groups()
            if code not in TYPES or (code != "A" and repeat not in ("", "1")):
                raise ValueError(f"column {k}: format {head[f'TFORM{k}']} isn't read")
            columns.append((head.get(f"TTYPE{k}", f"col{k}"), code, int(repeat or 1)))
        return f.tell(), int(head["NAXIS1"]), int(head["NAXIS2"]), columns


class _Rows(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class FitsReader(DataSourceReader):
    def __init__(self, path: str, hdu: int):
        self.path = path
        self.start, self.width, self.rows, self.columns = describe(path, hdu)

    def partitions(self):
        return [_Rows(a, min(ROWS, self.rows - a)) for a in range(0, self.rows, ROWS)] or [_Rows(0, 0)]

    def read(self, partition):
        dtype = np.dtype([(n, f"S{r}" if c == "A" else TYPES[c][0]) for n, c, r in self.columns])
        with open(self.path, "rb") as f:
            f.seek(self.start + partition.first * self.width)
            table = np.frombuffer(f.read(partition.count * self.width), dtype)
        arrays = []
        for name, code, _ in self.columns:
            v = table[name]
            if code == "A":
                arrays.append(pa.array([x.decode("ascii", "replace").rstrip() for x in v.tolist()]))
            elif code == "L":
                arrays.append(pa.array(v == ord("T")))
            else:
                arrays.append(pa.array(v.astype({"B": "i2", "E": "f8"}.get(code, v.dtype.newbyteorder("=")))))
        yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _, _ in self.columns])


class FitsSource(DataSource):
    @classmethod
    def name(cls):
        return "fits_table"

    def _path(self) -> str:
        return re.sub(r"^file:(//)?", "", self.options["path"])

    def schema(self):
        return ", ".join(f"`{n}` {TYPES[c][1]}" for n, c, _ in describe(self._path(), int(self.options.get("hdu", "1")))[3])

    def reader(self, schema):
        return FitsReader(self._path(), int(self.options.get("hdu", "1")))


def read(spark: SparkSession, path: str, hdu: int = 1) -> DataFrame:
    """A binary table of a file that all executors see."""
    spark.dataSource.register(FitsSource)
    return spark.read.format("fits_table").option("hdu", str(hdu)).load(path)
