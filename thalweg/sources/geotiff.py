"""A data source for single-image GeoTIFF files: ``spark.read.format("geotiff").load(path)`` gives row_i, col_i, band, v.

Strips and tiles are read by the tasks that return them, so a large image is never whole in one
process. Strips and tiles may be uncompressed or deflated, without or with horizontal differencing,
with the bands of a pixel together or in planes of their own. Files are opened where their URI says,
on local disks or in the stores that pyarrow knows. Comparisons of row_i, col_i and band with numbers
choose the blocks that are read with the option ``push``, which needs Spark's setting
``spark.sql.python.filterPushdown.enabled``; ``read`` chooses them by bounds in any case.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from ..operators.grid import GridMeta

#: Fixed values of the file format: bytes of a field type, and number types by (sample format, bits).
_TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
_TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_SAMPLES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _STRIPS, _PER_PIXEL, _STRIP_ROWS, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 284, 317
_STRIP_BYTES, _TILE_W, _TILE_H, _TILES, _TILE_BYTES, _FORMAT = 279, 322, 323, 324, 325, 339
_SCALE, _TIE, _KEYS, _NODATA = 33550, 33922, 34735, 42113


def _opened(path: str):
    """A file that can be read anywhere in it."""
    if "://" not in path:
        return open(path, "rb")
    store, place = pyarrow.fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


@dataclass(frozen=True)
class Layout:
    order: str
    width: int
    height: int
    bands: int
    sample: str
    compression: int
    predictor: int
    block_w: int
    block_h: int
    tiled: bool
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    scale: tuple[float, ...]
    tie: tuple[float, ...]
    geographic: bool
    nodata: float | None
    planar: bool = False
    crs: int | None = None

    def places(self) -> int:
        """Blocks of one plane."""
        return -(-self.width // self.block_w) * -(-self.height // self.block_h)

    def corner(self, number: int) -> tuple[int, int]:
        """First row and column of a block."""
        down, right = divmod(number % self.places(), -(-self.width // self.block_w))
        return down * self.block_h, right * self.block_w


def _tags(f, order: str) -> dict[int, tuple]:
    f.seek(4)
    (at,) = struct.unpack(order + "I", f.read(4))
    f.seek(at)
    (n,) = struct.unpack(order + "H", f.read(2))
    found = {}
    for tag, kind, count, raw in (struct.unpack(order + "HHI4s", f.read(12)) for _ in range(n)):
        if kind in _TYPE_CODES or kind == 2:
            found[tag] = (kind, count, raw)
    out = {}
    for tag, (kind, count, raw) in found.items():
        size = _TYPE_BYTES[kind] * count
        if size > 4:
            f.seek(struct.unpack(order + "I", raw)[0])
            raw = f.read(size)
        out[tag] = (raw[:size].split(b"\0")[0].decode("ascii", "replace"),) if kind == 2 else struct.unpack(order + f"{count}{_TYPE_CODES[kind]}", raw[:size])
    return out


def layout(path: str) -> Layout:
    """What the header says; an error names what is not supported."""
    with _opened(path) as f:
        head = f.read(4)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or struct.unpack(order + "H", head[2:])[0] != 42:
            raise ValueError(f"{path} is not a TIFF file")
        t = _tags(f, order)
    one = lambda tag, default: t.get(tag, (default,))[0]
    bits, kind = t.get(_BITS, (1,)), t.get(_FORMAT, (1,))
    sample = _SAMPLES.get((kind[0], bits[0]))
    if sample is None or len(set(bits)) > 1 or len(set(kind)) > 1:
        raise ValueError(f"samples of format {kind} and {bits} bits are not supported")
    if one(_COMPRESSION, 1) not in (1, 8, 32946):
        raise ValueError(f"compression {one(_COMPRESSION, 1)} is not supported")
    bands, planar = one(_PER_PIXEL, 1), one(_PLANAR, 1) == 2
    if one(_PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"predictor {one(_PREDICTOR, 1)} is not supported")
    tiled = _TILES in t
    width, height = t[_WIDTH][0], t[_HEIGHT][0]
    keys = t.get(_KEYS, ())
    # Keys come in fours after a header of four: number, place, count, value; 1024 is the model, 2 geographic.
    key = lambda number: next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] == number), None)
    model = key(1024)
    crs = key(2048) if model == 2 else key(3072)
    text = str(one(_NODATA, "")).strip()
    return Layout(
        order, width, height, bands, sample, one(_COMPRESSION, 1), one(_PREDICTOR, 1),
        one(_TILE_W, width) if tiled else width, one(_TILE_H, height) if tiled else min(one(_STRIP_ROWS, height), height), tiled,
        t[_TILES if tiled else _STRIPS], t[_TILE_BYTES if tiled else _STRIP_BYTES], t.get(_SCALE, (1.0, 1.0, 0.0)), t.get(_TIE, (0.0,) * 6), model == 2, float(text) if text else None,
        bands > 1 and planar, crs if crs != 32767 else None,
    )


def meta(path: str) -> GridMeta:
    """The georeference; a tie point fixes the pixel whose upper left corner it names."""
    got = layout(path)
    x0, y0 = got.tie[3] - got.tie[0] * got.scale[0], got.tie[4] + got.tie[1] * got.scale[1]
    return GridMeta(x0, got.scale[0], y0, -got.scale[1], got.height, got.width, got.geographic, got.crs)


def block(path: str, got: Layout, number: int) -> tuple[int, int, np.ndarray]:
    """(first row, first column, rows x columns x bands) of a strip or tile, cut at the image's edge; of planes one band."""
    with _opened(path) as f:
        f.seek(got.offsets[number])
        raw = f.read(got.sizes[number])
    if got.compression != 1:
        raw = zlib.decompress(raw)
    row, col = got.corner(number)
    deep = 1 if got.planar else got.bands
    rows = got.block_h if got.tiled else min(got.block_h, got.height - row)
    values = np.frombuffer(raw, got.order + got.sample, rows * got.block_w * deep).reshape(rows, got.block_w, deep)
    if got.predictor == 2:
        values = np.cumsum(values, axis=1, dtype=values.dtype.newbyteorder("="))
    return row, col, values[: got.height - row, : got.width - col]


@dataclass
class Blocks(InputPartition):
    numbers: tuple[int, ...]


#: Columns by which blocks are chosen.
_CHOICE = ("row_i", "col_i", "band")


@dataclass
class Choice:
    """Lowest and highest row, column and band wanted."""

    low: dict[str, float]
    high: dict[str, float]

    @classmethod
    def of(cls, options) -> Choice:
        get = lambda name, default: float(options.get(name, default))
        return cls({c: get(f"min_{c}", float("-inf")) for c in _CHOICE}, {c: get(f"max_{c}", float("inf")) for c in _CHOICE})

    def narrow(self, f: Filter) -> None:
        """Take a filter into account as far as it bounds a column; Spark tests the rows itself, too."""
        name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        if name not in _CHOICE:
            return
        if isinstance(f, In):
            known = [v for v in f.value if v is not None]
            low, high = min(known, default=float("inf")), max(known, default=float("-inf"))
        elif isinstance(f, EqualTo):
            low = high = f.value
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):  # of whole numbers
            low, high = math.floor(f.value) + 1 if isinstance(f, GreaterThan) else f.value, float("inf")
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            low, high = float("-inf"), math.ceil(f.value) - 1 if isinstance(f, LessThan) else f.value
        else:
            return
        self.low[name], self.high[name] = max(self.low[name], low), min(self.high[name], high)

    def wants(self, got: Layout, number: int) -> bool:
        row, col = got.corner(number)
        band = number // got.places() + 1 if got.planar else None
        inside = self.low["row_i"] < row + got.block_h and row <= self.high["row_i"] and self.low["col_i"] < col + got.block_w and col <= self.high["col_i"]
        return inside and (band is None or self.low["band"] <= band <= self.high["band"])


class _Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int, choice: Choice):
        self.path, self.per_task, self.choice = path, per_task, choice
        self.layout = layout(path)

    def partitions(self) -> list[Blocks]:
        wanted = [n for n in range(len(self.layout.offsets)) if self.choice.wants(self.layout, n)]
        return [Blocks(tuple(wanted[i : i + self.per_task])) for i in range(0, len(wanted), self.per_task)] or [Blocks(())]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        for number in partition.numbers:
            row, col, values = block(self.path, self.layout, number)
            first = number // self.layout.places() + 1 if self.layout.planar else 1
            bands = [k for k in range(values.shape[2]) if self.choice.low["band"] <= first + k <= self.choice.high["band"]]
            v = values[:, :, bands].astype(np.float64)
            unknown = np.isnan(v) if self.layout.nodata is None else np.isnan(v) | (v == self.layout.nodata)
            r, c, b = np.indices(v.shape)
            which = np.array(bands, np.int64)[b] + first
            yield pa.RecordBatch.from_arrays(
                [pa.array((r + row).ravel().astype(np.int64)), pa.array((c + col).ravel().astype(np.int64)), pa.array(which.ravel().astype(np.int32)), pa.array(v.ravel(), mask=unknown.ravel())],
                names=["row_i", "col_i", "band", "v"],
            )


class _Pushed(_Reader):
    """Spark refuses readers with this method where its setting for pushed filters is off."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            self.choice.narrow(f)
        return filters


class GeoTiff(DataSource):
    """Options: ``path``; ``blocks``, the strips or tiles of a task (16); ``min_`` and ``max_`` of row_i, col_i and band; ``push``.

    No-data and NaN values are null. Blocks outside the bounds are not read; others are whole.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "row_i long, col_i long, band int, v double"

    def reader(self, schema) -> _Reader:
        kind = _Pushed if str(self.options.get("push", "")).lower() == "true" else _Reader
        return kind(self.options["path"], int(self.options.get("blocks", 16)), Choice.of(self.options))


def read(spark: SparkSession, path: str, band: int = 1, window: tuple[int, int, int, int] | None = None) -> tuple[DataFrame, GridMeta]:
    """(cells row_i, col_i, z of one band, georeference), of the rows and columns in ``window`` (first and last row, first and last column).

    The path must be one that the executors can open; only blocks of the band and window are read.
    """
    spark.dataSource.register(GeoTiff)
    reader = spark.read.format("geotiff").option("min_band", int(band)).option("max_band", int(band))
    test = f"band = {int(band)}"
    if window is not None:
        for name, value in zip(("min_row_i", "max_row_i", "min_col_i", "max_col_i"), window):
            reader = reader.option(name, int(value))
        test += f" and row_i between {int(window[0])} and {int(window[1])} and col_i between {int(window[2])} and {int(window[3])}"
    return reader.load(path).where(test).selectExpr("row_i", "col_i", "v as z"), meta(path)
