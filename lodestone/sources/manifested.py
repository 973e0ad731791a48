"""A sink for JSON lines, CSV and LaTeX tables that writes its own manifest: a Python data source.

Each task writes one part under a name of its own and says what it wrote: rows, bytes and SHA-256. The commit gives the
parts of the tasks that count their final names and writes the manifest last, so that a folder with a manifest is whole,
and parts of failed or repeated tasks are not in it.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "manifest.json"
KINDS = {"jsonl": "json", "csv": "csv", "tex": "tex"}
# How LaTeX writes its special signs.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


@dataclass
class Part(WriterCommitMessage):
    partition: int
    temporary: str
    rows: int
    bytes: int
    sha256: str


def latex(value) -> str:
    """A value as a cell: null is a dash, doubles have up to six digits."""
    if value is None:
        return "--"
    text = f"{value:.6g}" if isinstance(value, float) else str(value)
    return "".join(LATEX.get(c, c) for c in text)


class Lines:
    """Rows as the bytes of a file of one kind."""

    def __init__(self, kind: str, columns: list[str]):
        self.kind, self.columns = kind, columns

    def head(self) -> str:
        if self.kind == "csv":
            return self.csv(self.columns)
        if self.kind == "tex":
            return f"\\begin{{tabular}}{{{'l' * len(self.columns)}}}\n\\hline\n{' & '.join(map(latex, self.columns))} \\\\\n\\hline\n"
        return ""

    def csv(self, values) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerow(["" if v is None else v for v in values])
        return out.getvalue()

    def row(self, row) -> str:
        if self.kind == "csv":
            return self.csv(row)
        if self.kind == "tex":
            return f"{' & '.join(map(latex, row))} \\\\\n"
        return json.dumps(row.asDict(recursive=True), ensure_ascii=False, sort_keys=True, default=str) + "\n"

    def foot(self) -> str:
        return "\\hline\n\\end{tabular}\n" if self.kind == "tex" else ""


def file_system(path: str):
    """(file system, path in it) of a URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class ManifestedWriter(DataSourceWriter):
    def __init__(self, path: str, kind: str, columns: list[str], overwrite: bool):
        self.path, self.kind, self.columns = path, kind, columns
        system, at = file_system(path)
        from pyarrow import fs

        if not overwrite and system.get_file_info(f"{at}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{path} is written already")

    def write(self, iterator) -> Part:
        from pyspark import TaskContext

        system, at = file_system(self.path)
        lines, digest, rows, size = Lines(self.kind, self.columns), hashlib.sha256(), 0, 0
        name = f"{at}/_parts/{uuid.uuid4().hex}"
        system.create_dir(f"{at}/_parts", recursive=True)
        with system.open_output_stream(name) as out:

            def put(text):
                nonlocal size
                data = text.encode()
                digest.update(data)
                size += out.write(data) or len(data)

            put(lines.head())
            for row in iterator:
                put(lines.row(row))
                rows += 1
            put(lines.foot())
        return Part(TaskContext.get().partitionId(), name, rows, size, digest.hexdigest().upper())

    def commit(self, messages: list[Part | None]) -> None:
        system, at = file_system(self.path)
        from pyarrow import fs

        if system.get_file_info(f"{at}/{MANIFEST}").type != fs.FileType.NotFound:  # overwriting: the old table ends here
            system.delete_file(f"{at}/{MANIFEST}")
        for old in system.get_file_info(fs.FileSelector(at)):
            if old.type == fs.FileType.File:
                system.delete_file(old.path)
        files = []
        for part in sorted((m for m in messages if m and m.rows), key=lambda m: m.partition):
            name = f"part-{part.partition:05d}.{KINDS[self.kind]}"
            system.move(part.temporary, f"{at}/{name}")
            files.append({"name": name, "rows": part.rows, "bytes": part.bytes, "sha256": part.sha256})
        self.abort([])
        said = {"format": self.kind, "columns": self.columns, "rows": sum(f["rows"] for f in files), "files": files}
        with system.open_output_stream(f"{at}/{MANIFEST}") as out:
            out.write((json.dumps(said, ensure_ascii=False, sort_keys=True) + "\n").encode())

    def abort(self, messages) -> None:
        system, at = file_system(self.path)
        from pyarrow import fs

        if system.get_file_info(f"{at}/_parts").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/_parts")


class Manifested(DataSource):
    """Options: path, kind (jsonl, csv or tex)."""

    @classmethod
    def name(cls) -> str:
        return "manifested"

    def writer(self, schema, overwrite: bool) -> ManifestedWriter:
        kind = self.options.get("kind", "jsonl")
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {sorted(KINDS)}")
        return ManifestedWriter(self.options["path"], kind, schema.fieldNames(), overwrite)


def write(rows: DataFrame, path: str, kind: str = "jsonl", overwrite: bool = False) -> None:
    """rows under path with their manifest; an error if one is there already, unless overwrite. Empty partitions leave no part. A LaTeX table is one part."""
    rows.sparkSession.dataSource.register(Manifested)
    own = rows.coalesce(1) if kind == "tex" else rows
    own.write.format("manifested").option("kind", kind).mode("overwrite" if overwrite else "append").save(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, rows, bytes, sha256) of the parts that a manifest lists."""
    said = spark.read.schema("files array<struct<name:string,rows:long,bytes:long,sha256:string>>").json(f"{path}/{MANIFEST}")
    return said.select(F.inline("files"))


def verified(spark: SparkSession, path: str) -> DataFrame:
    """(name, rows, intact) of the parts that a manifest lists: whether the file is there with the digest named."""
    from lodestone.sources.files import file_digests

    named = manifest(spark, path)
    if named.isEmpty():
        return named.select("name", "rows", F.lit(True).alias("intact"))
    found = file_digests(spark, f"{path}/part-*").select(F.substring_index("path", "/", -1).alias("name"), F.col("sha256").alias("found"))
    return named.join(found, "name", "left").select("name", "rows", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)).alias("intact"))


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a table of JSON lines. ValueError if a part is missing or changed, or has other rows than the manifest says."""
    checked = verified(spark, path).agg(F.sum("rows"), F.count_if(~F.col("intact"))).first()
    rows = spark.read.schema(schema).json(f"{path}/part-*") if checked[0] else spark.createDataFrame([], schema)
    if checked[1] or rows.count() != (checked[0] or 0):
        raise ValueError(f"{path} is not what its manifest says")
    return rows
