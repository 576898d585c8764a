"""A Spark data source for the JSON files of documents: pages, OCR caches, grids, extractions, overlays, sidecars, gold sets (SC7-SC11, SC13, SC14).

``spark.read.format("document_files").schema("doc_id string, part string, page_no int, ..., _error string").option("layout", ...)``

Layouts below the root, which also tell what ``part`` and ``page_no`` are:

* ``pages``: ``<doc_id>/p_<page>.json`` (also the OCR line cache): one row per page, ``part`` is the stem, ``page_no`` the number.
* ``parts``: ``<doc_id>/<part>.json`` (grids by block id): one row per file.
* ``documents``: ``<doc_id>.json`` or ``<doc_id>.<part>.json`` (extractions, overlays, sidecars, gold); names that start with an
  underscore are passed over.

Columns of the schema beside ``doc_id``, ``part``, ``page_no``, ``path`` and ``_error`` are read from the file's top level; a string
column takes nested values as JSON text. A file that can't be read or isn't an object gives a row with ``_error`` and nulls, so that
no file is passed over in silence. Filters on doc_id and part, and on page_no, are pushed down: of other documents not even the
folder is listed, other files are not opened. A partition is a group of files of about ``group_bytes`` (8 MB). As a stream, files
come in the order of their modification times; a file that is written again comes again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegralType, MapType, StringType, StructType

OWN = ("doc_id", "part", "page_no", "path", "_error")
PAGE = re.compile(r"^\D*(\d+)$")


class Group(InputPartition):
    """Files of one task: (doc_id, part, page_no, path)."""

    def __init__(self, files: list[tuple]):
        super().__init__(files)


def named(layout: str, folder: str, name: str) -> tuple[str, str, int | None] | None:
    """doc_id, part and page number of a file, None if it is none of the layout."""
    if not name.endswith(".json"):
        return None
    stem = name[:-5]
    if layout == "documents":
        if folder or stem.startswith("_"):
            return None
        doc, _, part = stem.partition(".")
        return (doc, part, None) if doc else None
    if not folder or "/" in folder:
        return None
    page = PAGE.match(stem)
    if layout == "pages" and not page:
        return None
    return folder, stem, int(page[1]) if page and layout == "pages" else None


class Files:
    """The files of a layout below a root, in any file system that pyarrow knows."""

    def __init__(self, options: dict[str, str]):
        self.layout = options.get("layout", "pages")
        if self.layout not in ("pages", "parts", "documents"):
            raise ValueError(f"layout {self.layout!r} is none of pages, parts, documents")
        self.uri = options["path"]
        self.group = int(options.get("group_bytes", 8 << 20))

    def open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (pafs.LocalFileSystem(), self.uri)

    def listed(self, docs: set[str] | None) -> Iterator[tuple[tuple, int, int]]:
        """((doc_id, part, page_no, path), bytes, modification time in ns) of the wanted documents' files."""
        fs, root = self.open()
        nested = self.layout != "documents"
        if nested and docs is not None:
            places = [f"{root}/{d}" for d in sorted(docs) if "/" not in d and d not in ("", ".", "..")]
        else:
            places = [root]
        for place in places:
            for f in sorted(fs.get_file_info(pafs.FileSelector(place, recursive=nested and docs is None, allow_not_found=True)), key=lambda f: f.path):
                if f.type != pafs.FileType.File:
                    continue
                folder, _, name = f.path[len(root) :].lstrip("/").rpartition("/")
                at = named(self.layout, folder, name)
                if at and (docs is None or at[0] in docs):
                    yield (*at, f.path), f.size or 0, f.mtime_ns or 0

    def grouped(self, files: list[tuple[tuple, int, int]]) -> list[Group]:
        out, size = [[]], 0
        for f, n, _ in files:
            if out[-1] and size + n > self.group:
                out.append([])
                size = 0
            out[-1].append(f)
            size += n
        return [Group(g) for g in out if g]


def fitted(v, kind):
    """A JSON value as the column's type, None where it doesn't fit."""
    if v is None:
        return None
    if isinstance(kind, StringType):
        return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if isinstance(kind, BooleanType):
        return v if isinstance(v, bool) else None
    if isinstance(kind, IntegralType):
        return int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) < 2**63 and int(v) == v else None
    if isinstance(kind, (FloatType, DoubleType)):
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    if isinstance(kind, ArrayType):
        return [fitted(x, kind.elementType) for x in v] if isinstance(v, list) else None
    if isinstance(kind, StructType):
        return {f.name: fitted(v.get(f.name), f.dataType) for f in kind.fields} if isinstance(v, dict) else None
    if isinstance(kind, MapType):
        return [(k, fitted(x, kind.valueType)) for k, x in v.items()] if isinstance(v, dict) else None
    raise TypeError(f"no JSON column of type {kind.simpleString()}")


def rows_of(files: Files, schema: StructType, group: Group, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    fs, _ = files.open()
    arrow = to_arrow_schema(schema)
    held: list[dict] = []
    for doc, part, page, path in group.value:
        value, error = {}, None
        try:
            with fs.open_input_stream(path) as f:
                value = json.loads(f.read().decode("utf-8"))
            if not isinstance(value, dict):
                value, error = {}, "not an object"
        except (ValueError, OSError, RecursionError) as e:
            error = f"{type(e).__name__}: {e}"[:500]
        own = {"doc_id": doc, "part": part, "page_no": page, "path": path, "_error": error}
        held.append({f.name: own[f.name] if f.name in own else fitted(value.get(f.name), f.dataType) for f in schema.fields})
        if len(held) == rows:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


class FileReader(DataSourceReader):
    def __init__(self, files: Files, schema: StructType):
        self.files, self.schema = files, schema
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in ("doc_id", "part", "page_no"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Group]:
        keep = lambda f: f[1] in self.wanted.get("part", (f[1],)) and f[2] in self.wanted.get("page_no", (f[2],))
        # Spark reads one empty partition where none is left.
        return self.files.grouped([f for f in self.files.listed(self.wanted.get("doc_id")) if keep(f[0])]) or [Group([])]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        yield from rows_of(self.files, self.schema, partition)


class FileStream(DataSourceStreamReader):
    """Offset: a modification time and the paths of that very time which have been read."""

    def __init__(self, files: Files, schema: StructType):
        self.files, self.schema = files, schema

    def initialOffset(self) -> dict:
        return {"at": -1, "paths": []}

    def latestOffset(self) -> dict:
        times = [(t, f[3]) for f, _, t in self.files.listed(None)]
        at = max((t for t, _ in times), default=-1)
        return {"at": at, "paths": sorted(p for t, p in times if t == at)}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        first, last = (lambda t, p, o=o: t < o["at"] or (t == o["at"] and p in set(o["paths"])) for o in (start, end))
        return self.files.grouped([x for x in self.files.listed(None) if last(x[2], x[0][3]) and not first(x[2], x[0][3])]) or [Group([])]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        yield from rows_of(self.files, self.schema, partition)

    def commit(self, end: dict) -> None:
        pass


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "doc_id string, part string, page_no int, path string, _error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FileReader(Files(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FileStream(Files(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentFiles)


def document_files(spark: SparkSession, path: str, layout: str, columns: str, **options) -> DataFrame:
    """All files of a layout, unreadable ones too: doc_id, part, page_no, path, the columns, _error."""
    register(spark)
    return spark.read.format("document_files").schema(f"doc_id string, part string, page_no int, path string, {columns}, _error string").options(layout=layout, **options).load(path)


def pages(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """SC7, SC9: pages that can be read, by document and page number."""
    return document_files(spark, path, "pages", columns).where("_error is null").drop("_error", "part")


def grids(spark: SparkSession, path: str, columns: str = "grid string") -> DataFrame:
    """SC8: overlays by block id, those with a grid only."""
    return document_files(spark, path, "parts", columns).where("_error is null and grid is not null").drop("_error", "page_no").withColumnRenamed("part", "block_id")


def gold(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """SC14: gold sets, by the doc_id that stands in the file; files without one are left out."""
    register(spark)
    f = document_files(spark, path, "documents", f"gold_id string, {columns}")
    return f.where("_error is null").drop("_error", "part", "page_no")


def quarantined(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """SC10, SC11: files that can't be read, with the reason."""
    return document_files(spark, path, layout, "unused string").where("_error is not null").select("doc_id", "part", "page_no", "path", "_error")
