"""Arrays on disk as long tables: Zarr (version 2) stores and NetCDF classic files, read chunk by chunk on the executors.

``read_array`` gives one row per position of the main dimensions (those of the variables with most of them): their
coordinates, then the variables; variables over some of the dimensions are repeated along the others. Every chunk (or
stretch of records) is a partition of its own and becomes Arrow batches, so nothing passes through the driver but
the metadata. Paths are those of any file system pyarrow knows, and must be reachable from all executors.

Values follow the usual conventions: ``_FillValue`` and ``missing_value`` are missing (NULL), ``scale_factor`` and ``add_offset``
are applied, ``<unit> since <date>`` makes a coordinate a timestamp (days of the standard calendars). Chunks that are not
stored hold the fill value. Compressors: none, zlib, gzip, bz2, lzma, zstd; another one is an error that names it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: values of a NetCDF file in one partition
STRETCH = 4_000_000


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _decompress(data: bytes, codec: dict | None) -> bytes:
    name = (codec or {}).get("id")
    if name is None:
        return data
    if name == "zlib":
        import zlib

        return zlib.decompress(data)
    if name in ("gzip", "bz2", "lzma"):
        return __import__(name).decompress(data)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"no decompressor for {name}")


class ZarrStore:
    """Metadata of a Zarr group, and blocks of its arrays."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = _files(path)
        self.dims, self.variables, self.meta = {}, {}, {}
        for info in self.fs.get_file_info(fs.FileSelector(self.root)):
            name = info.base_name
            if info.type != fs.FileType.Directory or self._json(f"{name}/.zarray") is None:
                continue
            m, attrs = self._json(f"{name}/.zarray"), self._json(f"{name}/.zattrs") or {}
            if m.get("filters"):
                raise ValueError(f"{name}: filters are not supported")
            dims = tuple(attrs.get("_ARRAY_DIMENSIONS") or (f"{name}_{i}" for i in range(len(m["shape"]))))
            self.dims |= dict(zip(dims, m["shape"]))
            self.variables[name], self.meta[name] = (dims, np.dtype(m["dtype"]), attrs), m
        if not self.variables:
            raise ValueError(f"no arrays in {path}")

    def _bytes(self, name: str) -> bytes | None:
        try:
            with self.fs.open_input_stream(f"{self.root}/{name}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def _json(self, name: str) -> dict | None:
        raw = self._bytes(name)
        return None if raw is None else json.loads(raw)

    def block(self, name: str) -> tuple[int, ...]:
        return tuple(self.meta[name]["chunks"])

    def fill(self, name: str):
        return self.meta[name].get("fill_value")

    def read(self, name: str, lo: Sequence[int], hi: Sequence[int]) -> np.ndarray:
        m, dtype = self.meta[name], self.variables[name][1]
        chunks, fill = m["chunks"], m.get("fill_value")
        fill = {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf, None: 0}.get(fill, fill) if isinstance(fill, (str, type(None))) else fill
        out = np.full([b - a for a, b in zip(lo, hi)], fill, dtype)
        first = [a // c for a, c in zip(lo, chunks)]
        for at in np.ndindex(*[-(-b // c) - f for b, c, f in zip(hi, chunks, first)]):
            at = [i + f for i, f in zip(at, first)]
            raw = self._bytes(f"{name}/{m.get('dimension_separator', '.').join(map(str, at)) or '0'}")
            if raw is None:
                continue
            chunk = np.frombuffer(_decompress(raw, m["compressor"]), dtype).reshape(chunks, order=m.get("order", "C"))
            start = [i * c for i, c in zip(at, chunks)]
            a, b = [max(s, x) for s, x in zip(start, lo)], [min(s + c, x) for s, c, x in zip(start, chunks, hi)]
            out[tuple(slice(x - y, z - y) for x, y, z in zip(a, lo, b))] = chunk[tuple(slice(x - s, z - s) for x, s, z in zip(a, start, b))]
        return out


class NetcdfStore:
    """Header of a NetCDF classic file (versions 1, 2 and 5), and blocks of its variables."""

    TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}

    def __init__(self, path: str):
        self.fs, self.root = _files(path)
        with self.fs.open_input_file(self.root) as f:
            if (magic := f.read(4))[:3] != b"CDF" or magic[3] not in (1, 2, 5):
                raise ValueError(f"{path} is no NetCDF classic file")
            wide, far = magic[3] == 5, magic[3] != 1
            number = lambda: int.from_bytes(f.read(8 if wide else 4), "big")
            text = lambda: (s := f.read(n := number()), f.read(-n % 4))[0].decode()

            def attributes() -> dict:
                f.read(4)
                out = {}
                for _ in range(number()):
                    name, kind, n = text(), int.from_bytes(f.read(4), "big"), 0
                    n = number()
                    raw = f.read(np.dtype(self.TYPES[kind]).itemsize * n)
                    f.read(-len(raw) % 4)
                    v = np.frombuffer(raw, self.TYPES[kind])
                    out[name] = raw.decode(errors="replace") if kind == 2 else v[0].item() if len(v) == 1 else v.tolist()
                return out

            records = number()
            f.read(4)
            sizes = [(text(), number()) for _ in range(number())]
            self.record = next((n for n, s in sizes if s == 0), None)
            self.attributes = attributes()
            f.read(4)
            self.variables, self.at, slots = {}, {}, []
            for _ in range(number()):
                name = text()
                dims = tuple(sizes[number()][0] for _ in range(number()))
                attrs, kind, size = attributes(), int.from_bytes(f.read(4), "big"), number()
                self.at[name] = int.from_bytes(f.read(8 if far else 4), "big")
                self.variables[name] = (dims, np.dtype(self.TYPES[kind]), attrs)
                if dims[:1] == (self.record,) and self.record is not None:
                    slots.append((name, size))
            inner = lambda n: int(np.prod([dict(sizes)[d] for d in self.variables[n][0][1:]])) * self.variables[n][1].itemsize
            # a single record variable is not padded
            self.stride = inner(slots[0][0]) if len(slots) == 1 else sum(-(-inner(n) // 4) * 4 for n, _ in slots)
            streaming = (1 << (64 if wide else 32)) - 1
            if records == streaming:
                start = min((self.at[n] for n, _ in slots), default=0)
                records = (self.fs.get_file_info(self.root).size - start) // self.stride if slots else 0
            self.dims = {n: (records if n == self.record else s) for n, s in sizes}

    def block(self, name: str) -> tuple[int, ...]:
        shape = [self.dims[d] for d in self.variables[name][0]]
        return (max(1, STRETCH // max(1, int(np.prod(shape[1:])))), *shape[1:])

    def fill(self, name: str):
        return None

    def read(self, name: str, lo: Sequence[int], hi: Sequence[int]) -> np.ndarray:
        dims, dtype, _ = self.variables[name]
        shape = [self.dims[d] for d in dims]
        row = int(np.prod(shape[1:])) * dtype.itemsize
        first, last = (lo[0], hi[0]) if shape else (0, 1)
        with self.fs.open_input_file(self.root) as f:
            if shape and dims[0] == self.record:
                parts = []
                for i in range(first, last):
                    f.seek(self.at[name] + i * self.stride)
                    parts.append(f.read(row))
                raw = b"".join(parts)
            else:
                f.seek(self.at[name] + first * row)
                raw = f.read(row * (last - first))
        a = np.frombuffer(raw, dtype).reshape([last - first, *shape[1:]] if shape else [])
        return a[tuple(slice(None) if i == 0 else slice(x, y) for i, (x, y) in enumerate(zip(lo, hi)))].astype(dtype.newbyteorder("="))


_UNITS = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}


def _since(attrs: dict) -> tuple[int, np.datetime64] | None:
    """(microseconds of the unit, start) of a time coordinate."""
    unit, _, start = str(attrs.get("units", "")).partition(" since ")
    unit = unit.strip().lower().rstrip("s")
    if not start or unit not in _UNITS or attrs.get("calendar", "standard") not in ("standard", "gregorian", "proleptic_gregorian"):
        return None
    return _UNITS[unit], np.datetime64(start.strip().replace(" ", "T").removesuffix("Z").removesuffix("TUTC"), "us")


class Layout:
    """Which columns a store gives and in which blocks."""

    def __init__(self, store, wanted: Sequence[str] | None = None):
        self.store = store
        coordinates = {n for n, (d, *_) in store.variables.items() if d == (n,)}
        names = [n for n, (_, t, _) in store.variables.items() if n not in coordinates and t.kind in "iuf"]
        lost = set(wanted or ()) - set(names)
        if lost:
            raise ValueError(f"missing variables: {', '.join(sorted(lost))}")
        self.names = list(wanted) if wanted else names
        if not self.names:
            raise ValueError("no variables")
        self.main = max(self.names, key=lambda n: len(store.variables[n][0]))
        self.dims = store.variables[self.main][0]
        self.names = [n for n in self.names if set(store.variables[n][0]) <= set(self.dims)]
        self.coordinates = {d: d in coordinates for d in self.dims}

    def _packed(self, name: str) -> bool:
        attrs = self.store.variables[name][2]
        return any(k in attrs for k in ("scale_factor", "add_offset"))

    def types(self) -> dict[str, str]:
        kind = lambda t: {"f4": "float", "f2": "float", "f8": "double", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "u8": "bigint"}[t.str[1:]]
        out = {d: ("timestamp_ntz" if _since(self.store.variables[d][2]) else kind(self.store.variables[d][1])) if real else "bigint" for d, real in self.coordinates.items()}
        return out | {n: "double" if self._packed(n) else kind(self.store.variables[n][1]) for n in self.names}

    def blocks(self) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        shape, size = [self.store.dims[d] for d in self.dims], self.store.block(self.main)
        every = np.ndindex(*[-(-n // b) for n, b in zip(shape, size)])
        return [(tuple(i * b for i, b in zip(at, size)), tuple(min((i + 1) * b, n) for i, b, n in zip(at, size, shape))) for at in every]

    def _values(self, name: str, lo: Sequence[int], hi: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """(decoded values, which are missing)"""
        raw, attrs = self.store.read(name, lo, hi), self.store.variables[name][2]
        gone = np.isnan(raw) if raw.dtype.kind == "f" else np.zeros(raw.shape, bool)
        for k in ("_FillValue", "missing_value"):
            for v in np.atleast_1d(attrs.get(k, [])):
                gone |= raw == v
        if self._packed(name):
            raw = raw * float(attrs.get("scale_factor", 1.0)) + float(attrs.get("add_offset", 0.0))
        return raw, gone

    def batches(self, lo: Sequence[int], hi: Sequence[int], rows: int = 65_536) -> Iterator[pa.RecordBatch]:
        shape = [b - a for a, b in zip(lo, hi)]
        columns: dict[str, tuple[np.ndarray, np.ndarray | None]] = {}
        for i, (d, real) in enumerate(self.coordinates.items()):
            v = self.store.read(d, [lo[i]], [hi[i]]) if real else np.arange(lo[i], hi[i])
            if real and (since := _since(self.store.variables[d][2])):
                v = since[1] + np.rint(v.astype(float) * since[0]).astype("timedelta64[us]")
            columns[d] = (np.broadcast_to(v.reshape([-1 if j == i else 1 for j in range(len(shape))]), shape).ravel(), None)
        for n in self.names:
            dims = self.store.variables[n][0]
            at = [self.dims.index(d) for d in dims]
            v, gone = self._values(n, [lo[i] for i in at], [hi[i] for i in at])
            order = np.argsort(at)
            full = [shape[i] if i in at else 1 for i in range(len(shape))]
            columns[n] = tuple(np.broadcast_to(a.transpose(order).reshape(full), shape).ravel() for a in (v, gone))
        kinds = {"float": pa.float32(), "double": pa.float64(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "timestamp_ntz": pa.timestamp("us")}
        types = self.types()
        for s in range(0, int(np.prod(shape)), rows):
            part = {c: pa.array(np.ascontiguousarray(v[s: s + rows]), mask=None if gone is None else gone[s: s + rows]).cast(kinds[types[c]]) for c, (v, gone) in columns.items()}
            yield pa.RecordBatch.from_arrays(list(part.values()), names=list(part))


class _Block(InputPartition):
    def __init__(self, lo: tuple[int, ...], hi: tuple[int, ...]):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class _ArrayReader(DataSourceReader):
    def __init__(self, layout: Layout):
        self.layout = layout

    def partitions(self) -> list[InputPartition]:
        return [_Block(*b) for b in self.layout.blocks()]

    def read(self, partition: _Block) -> Iterator[pa.RecordBatch]:
        yield from self.layout.batches(partition.lo, partition.hi)


class ZarrSource(DataSource):
    """``spark.read.format("zarr").option("variables", "a,b").load(path)``"""

    store = ZarrStore

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def _layout(self) -> Layout:
        wanted = [v.strip() for v in self.options.get("variables", "").split(",") if v.strip()]
        return Layout(self.store(self.options["path"]), wanted)

    def schema(self) -> str:
        return ", ".join(f"`{c}` {t}" for c, t in self._layout().types().items())

    def reader(self, schema) -> DataSourceReader:
        return _ArrayReader(self._layout())


class NetcdfSource(ZarrSource):
    """``spark.read.format("netcdf").load(path)``"""

    store = NetcdfStore

    @classmethod
    def name(cls) -> str:
        return "netcdf"


def read_array(spark: SparkSession, path: str, kind: str = "zarr", variables: Sequence[str] = ()) -> DataFrame:
    """The long table of a ``zarr`` store or a ``netcdf`` file."""
    spark.dataSource.register({"zarr": ZarrSource, "netcdf": NetcdfSource}[kind])
    return spark.read.format(kind).option("variables", ",".join(variables)).load(path)


def write_zarr(path: str, arrays: dict[str, tuple[Sequence[str], np.ndarray, dict]], chunks: dict[str, int]) -> None:
    """A Zarr store of arrays that fit into memory (grids, statistics, small cubes): name -> (dimensions, values, attributes)."""
    import zlib
    from pathlib import Path

    root = Path(path)
    for name, (dims, a, attrs) in arrays.items():
        at, a = root / name, np.ascontiguousarray(a)
        at.mkdir(parents=True, exist_ok=False)
        size = [min(chunks.get(d, n), n) or 1 for d, n in zip(dims, a.shape)]
        (at / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": a.shape, "chunks": size, "dtype": a.dtype.str, "compressor": {"id": "zlib", "level": 1}, "fill_value": None, "order": "C", "filters": None}))
        (at / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": list(dims), **attrs}))
        for k in np.ndindex(*[-(-n // c) for n, c in zip(a.shape, size)]):
            part = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(k, size))]
            part = np.pad(part, [(0, c - n) for c, n in zip(size, part.shape)])
            (at / (".".join(map(str, k)) or "0")).write_bytes(zlib.compress(part.tobytes(), 1))
    (root / ".zgroup").write_text('{"zarr_format": 2}')
