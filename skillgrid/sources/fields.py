"""Array files of forecast fields as a Python data source: ``spark.read.format("forecast_fields")``.

A folder of raw fields has the layout ``{root}/{year}/{YYYYMMDD}_{cycle}/fHHH_{level}.npy``. The names say what a
file holds, so filters on ``init_date``, ``fhour`` and ``lead`` are answered from them: years and runs that they rule
out are not listed, files that they rule out are not opened. Files are read wherever Arrow's file systems
reach (a path without a scheme is local), by several tasks, each with up to ``files_per_task`` files.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

FILE = re.compile(r"f(\d{3})_[^/]*\.npy")
NAMED = ("init_date", "fhour", "lead")
SCHEMA = "model string, init_date date, fhour int, lead int, cell_id int, value double"
_COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


@dataclass
class Files(InputPartition):
    found: tuple[tuple[str, date, int], ...]  # path, init date, forecast hour


class FieldReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.model, self.cycle = options["path"].rstrip("/"), options["model"], options.get("cycle", "12z")
        self.shape = int(options["n_lat"]), int(options["n_lon"])
        self.per_task = int(options.get("files_per_task", "16"))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        """Those on what names say are kept; Spark applies the others to the rows."""
        for f in filters:
            if type(f) in _COMPARE and f.attribute[0] in NAMED:
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, **known) -> bool:
        return all(_COMPARE[type(f)](known[f.attribute[0]], f.value) for f in self.filters if f.attribute[0] in known)

    def _year_wanted(self, year: int) -> bool:
        first, last = date(year, 1, 1), date(year, 12, 31)
        for f in self.filters:
            if f.attribute[0] == "init_date":
                values = f.value if isinstance(f, In) else [f.value]
                if isinstance(f, (EqualTo, In)) and not any(first <= v <= last for v in values):
                    return False
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and not _COMPARE[type(f)](last, f.value):
                    return False
                if isinstance(f, (LessThan, LessThanOrEqual)) and not _COMPARE[type(f)](first, f.value):
                    return False
        return True

    def partitions(self):
        store, root = _store(self.root)
        names = lambda at, kind: sorted((x for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.type == kind), key=lambda x: x.path)
        found = []
        for year in names(root, fs.FileType.Directory):
            if not re.fullmatch(r"\d{4}", year.base_name) or not self._year_wanted(int(year.base_name)):
                continue
            for run in names(year.path, fs.FileType.Directory):
                m = re.fullmatch(rf"(\d{{8}})_{re.escape(self.cycle)}", run.base_name)
                init = datetime.strptime(m[1], "%Y%m%d").date() if m else None
                if init is None or not self._wanted(init_date=init):
                    continue
                for file in names(run.path, fs.FileType.File):
                    hour = FILE.fullmatch(file.base_name)
                    if hour and self._wanted(fhour=int(hour[1]), lead=int(hour[1]) // 24):
                        found.append((file.path, init, int(hour[1])))
        return [Files(tuple(found[k : k + self.per_task])) for k in range(0, len(found), self.per_task)] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.root)
        cells = np.arange(self.shape[0] * self.shape[1], dtype=np.int32)
        for path, init, hour in partition.found:
            with store.open_input_file(path) as f:
                field = np.load(io.BytesIO(f.read()), allow_pickle=False)
            if field.shape != self.shape:
                raise ValueError(f"field of {init} hour {hour} is {field.shape}, the grid is {self.shape}")
            value = field.ravel().astype(np.float64)
            same = lambda v, kind: pa.repeat(pa.scalar(v, kind), len(cells))
            yield pa.RecordBatch.from_arrays([same(self.model, pa.string()), same(init, pa.date32()), same(hour, pa.int32()), same(hour // 24, pa.int32()), pa.array(cells), pa.array(value, mask=~np.isfinite(value))], ["model", "init_date", "fhour", "lead", "cell_id", "value"])


class FieldWriter(DataSourceWriter):
    """One file for each row ``init_date, fhour, values``; a file appears under its name when it is whole."""

    def __init__(self, options: dict[str, str], names: list[str]):
        self.root, self.cycle, self.level = options["path"].rstrip("/"), options.get("cycle", "12z"), options.get("level", "surface")
        self.shape, self.names = (int(options["n_lat"]), int(options["n_lon"])), names

    def write(self, rows) -> WriterCommitMessage:
        store, root = _store(self.root)
        for row in rows:
            own = dict(zip(self.names, row, strict=True))
            field = np.array([np.nan if v is None else v for v in own["values"]], np.float32)
            if field.size != self.shape[0] * self.shape[1]:
                raise ValueError(f"field of {own['init_date']} hour {own['fhour']} has {field.size} cells, the grid is {self.shape}")
            folder = f"{root}/{own['init_date']:%Y}/{own['init_date']:%Y%m%d}_{self.cycle}"
            store.create_dir(folder, recursive=True)
            out, name = io.BytesIO(), f"{folder}/f{own['fhour']:03d}_{self.level}.npy"
            np.save(out, field.reshape(self.shape))
            with store.open_output_stream(f"{name}.part") as f:
                f.write(out.getvalue())
            store.move(f"{name}.part", name)
        return WriterCommitMessage()


class ForecastFields(DataSource):
    """Options: ``model``, ``n_lat``, ``n_lon``, and ``cycle`` (12z), ``level`` (surface, for writing), ``files_per_task`` (16)."""

    @classmethod
    def name(cls) -> str:
        return "forecast_fields"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> FieldReader:
        return FieldReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> FieldWriter:
        return FieldWriter(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ForecastFields)
