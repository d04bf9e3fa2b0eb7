"""The result files of motif search tools as a data source: ``spark.read.format("motif_files").option("kind", ...).load(folder)``.

Kinds: meme, mast_xml, mast_text, weeder, pssm. A file is a partition, and where there are many files a run of them; they are read side by side,
and a file has to fit into a task's memory. A schema given to the reader picks columns; what it leaves out is not sent to Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import motifs

KINDS: dict[str, tuple[Callable[[str], list[dict]], str]] = {
    "meme": (motifs.meme, motifs.MOTIFS_DDL),
    "mast_xml": (motifs.mast_xml, motifs.HITS_DDL),
    "mast_text": (motifs.mast_text, motifs.HITS_DDL),
    "weeder": (motifs.weeder, motifs.WEEDER_DDL),
    "pssm": (motifs.pssm, motifs.PSSM_DDL),
}


#: Files up to which each is a partition, bytes of a partition beyond so many files (more, if that many partitions hold all), rows of a batch.
PARTITIONS, BYTES, ROWS = 256, 32 << 20, 4096


class Files(InputPartition):
    """Some files by their URIs."""


def dealt(sizes: list[int]) -> list[tuple[int, int]]:
    """Files of these sizes as runs, by first and end."""
    if len(sizes) <= PARTITIONS:
        return [(i, i + 1) for i in range(len(sizes))]
    most = max(1, min(BYTES, -(-sum(sizes) // PARTITIONS)))
    out, first, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > most:
            out.append((first, i))
            first, held = i, 0
        held += n
    return [*out, (first, len(sizes))]


class MotifFileReader(DataSourceReader):
    def __init__(self, kind: str, path: str, schema: StructType):
        self.kind, self.path, self.schema = kind, path, schema

    def partitions(self) -> list[InputPartition]:
        """Files below the path whose names, and whose folders' names, are not hidden."""
        from pyarrow import fs

        system, at = _system(self.path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))
        shown = lambda x: not any(part.startswith((".", "_")) for part in x.path[len(at) :].split("/"))
        found = [x for x in sorted(found, key=lambda x: x.path) if x.is_file and (info.is_file or shown(x))]
        return [Files([x.path for x in found[i:j]]) for i, j in dealt([x.size or 0 for x in found])]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # of a folder without files
            return
        system, _ = _system(self.path)
        schema = to_arrow_schema(self.schema)
        for path in partition.value:
            with system.open_input_stream(path, compression="detect") as f:
                text = f.read().decode("utf-8", "replace")
            rows = KINDS[self.kind][0](text)
            for i in range(0, len(rows), ROWS):
                part = rows[i : i + ROWS]
                columns = [pa.array([path] * len(part) if x.name == "path" else [r[x.name] for r in part], x.type) for x in schema]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _system(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    if re.match(r"^file:/(?!/)", path):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class MotifFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "motif_files"

    def _kind(self) -> str:
        kind = self.options.get("kind", "")
        if kind not in KINDS:
            raise ValueError(f"no kind of motif files is called {kind or '(none)'}; there are {', '.join(KINDS)}")
        return kind

    def schema(self) -> str:
        return KINDS[self._kind()][1]

    def reader(self, schema: StructType) -> MotifFileReader:
        known = [x.split()[0] for x in motifs._top_level(self.schema())]
        if unknown := sorted(set(schema.fieldNames()) - set(known)):
            raise ValueError(f"these files have no {', '.join(unknown)}")
        return MotifFileReader(self._kind(), self.options["path"], schema)


def registered(spark: SparkSession) -> SparkSession:
    """The session, with the format known to it."""
    spark.dataSource.register(MotifFiles)
    return spark
