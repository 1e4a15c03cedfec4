"""Indexed mzML as a Python data source: a file is split by the offsets of its own index, so that a large one is read by many tasks.

``spark.read.format("mzml_index").load(path)`` after ``register``; options ``spectra`` (spectra in a partition) and ``level``. Rows are those of ``mzml.spectra`` with their level: spectra
without a time are left out, those without arrays have no peaks. The reader takes comparisons of ``level`` and ``rt`` with constants: other
spectra are not decoded, parts of a file outside of the times are not read (times rise with the offsets), and a part is left at the first later spectrum. Paths are opened by tasks
through ``pyarrow.fs``: local ones must be shared. Files without an index are an error; ``mzml.spectra`` reads them.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "sample_id string, scan long, level int, rt double, peaks array<struct<mz:double,intensity:double>>"
_ARROW = pa.schema([("sample_id", pa.string()), ("scan", pa.int64()), ("level", pa.int32()), ("rt", pa.float64()), ("peaks", pa.list_(pa.struct([("mz", pa.float64()), ("intensity", pa.float64())])))])
SPECTRA = 2_000
#: Bytes at the end of a file that hold where its index starts.
TAIL = 4_096


@dataclass
class Part(InputPartition):
    path: str
    offsets: list[int]
    end: int


def listed(path: str) -> list[str]:
    system, root = files.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (files.LocalFileSystem(), path)
    info = system.get_file_info(root)
    if info.type == files.FileType.File:
        return [path]
    found = [x.path for x in system.get_file_info(files.FileSelector(root, recursive=True)) if x.type == files.FileType.File and x.path.lower().endswith(".mzml")]
    if not found:
        raise FileNotFoundError(f"no mzML files below {path}")
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return sorted(scheme + x for x in found)


def opened(path: str):
    system, root = files.FileSystem.from_uri(path) if "://" in path else (files.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(root)


def offsets(path: str) -> tuple[list[int], int]:
    """Where the spectra of a file start, and where its index does."""
    with opened(path) as f:
        size = f.size()
        tail = f.read_at(min(TAIL, size), max(0, size - TAIL))
        start = re.search(rb"<indexListOffset>\s*(\d+)\s*</indexListOffset>", tail)
        if not start or not int(start[1]) < size:
            raise ValueError(f"{path} has no index")
        at = int(start[1])
        index = f.read_at(size - at, at)
    spectra = re.search(rb'<index\s+name="spectrum"[^>]*>(.*?)</index>', index, re.S)
    return sorted(int(x) for x in re.findall(rb"<offset[^>]*>\s*(\d+)\s*</offset>", spectra[1])) if spectra else [], at


def _params(element) -> dict[str, dict[str, str]]:
    return {p.get("name"): p.attrib for p in element.findall("cvParam")}


def _values(arrays: list, name: str, place: int) -> np.ndarray:
    named = [a for a in arrays if any(name in k for k in _params(a))]
    a = named[0] if named else arrays[place] if place < len(arrays) else None
    text = a.findtext("binary") if a is not None else None
    if not text:
        return np.zeros(0)
    raw, params = base64.b64decode(text), _params(a)
    raw = zlib.decompress(raw) if raw and any("zlib" in k for k in params) else raw
    return np.frombuffer(raw, "<f4" if any("32-bit" in k for k in params) else "<f8").astype(float)


def head(chunk: bytes) -> tuple[int | None, int | None, float | None, object]:
    """Index, level and time in minutes of a spectrum, and its element."""
    e = ElementTree.fromstring(chunk[: chunk.rindex(b"</spectrum>") + len(b"</spectrum>")])
    scan = e.find("scanList/scan")
    time = _params(scan).get("scan start time") if scan is not None else None
    level = _params(e).get("ms level", {}).get("value")
    rt = None
    if time is not None:
        try:
            rt = float(time["value"]) / (60.0 if re.search("^s$|second", time.get("unitName", "").lower()) else 1.0)
        except (KeyError, ValueError):
            rt = None
    return (int(e.get("index")) if e.get("index") else None), (int(level) if level and level.isdigit() else None), rt, e


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("spectra", SPECTRA))
        self.level = int(options["level"]) if "level" in options else None
        self.low, self.high = -np.inf, np.inf

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps the bounds; every filter but those of the level is checked again, since a bound may be open."""
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if isinstance(f, EqualTo) and name == ("level",) and self.level in (None, value):
                self.level = value
                continue
            if name == ("rt",) and value is not None:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, value)
            yield f

    def partitions(self) -> list[Part]:
        out = []
        for path in listed(self.path):
            at, end = offsets(path)
            parts = [Part(path, at[i : i + self.size], at[i + self.size] if i + self.size < len(at) else end) for i in range(0, len(at), self.size)]
            if np.isfinite(self.low) or np.isfinite(self.high):
                with opened(path) as f:
                    first = [head(f.read_at((p.offsets[1] if len(p.offsets) > 1 else p.end) - p.offsets[0], p.offsets[0]))[2] for p in parts]
                after = [*first[1:], None]
                parts = [p for p, t, u in zip(parts, first, after, strict=True) if not ((t is not None and t > self.high) or (u is not None and u < self.low))]
            out += parts
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        sample, rows = re.sub(r"(?i)\.mzml$", "", part.path.rsplit("/", 1)[-1]), []
        with opened(part.path) as f:
            for start, end in zip(part.offsets, [*part.offsets[1:], part.end], strict=True):
                scan, level, rt, e = head(f.read_at(end - start, start))
                if rt is not None and rt > self.high:
                    break
                if rt is None or rt < self.low or (self.level is not None and level != self.level):
                    continue
                arrays = e.findall("binaryDataArrayList/binaryDataArray")
                m, y = _values(arrays, "m/z array", 0), _values(arrays, "intensity array", 1)
                rows.append({"sample_id": sample, "scan": scan, "level": level, "rt": rt, "peaks": [{"mz": a, "intensity": b} for a, b in zip(m.tolist(), y.tolist(), strict=True)]})
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class IndexedSpectra(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mzml_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """With the setting that lets Python sources see filters; Spark refuses readers that can take them without it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexedSpectra)


def spectra(spark: SparkSession, path: str, level: int = 1, per_partition: int = SPECTRA):
    """The same rows as ``mzml.spectra``, by many tasks a file."""
    register(spark)
    rows = spark.read.format("mzml_index").option("spectra", per_partition).option("level", level).load(path)
    return rows.select("sample_id", "scan", "rt", "peaks")
