"""Batches over several tables that become visible at once, or not at all.

A batch writes its rows into folders of its own and then publishes one small revision file that
lists the folders in force. Publishing is a compare-and-set: the file of the next revision is put
in place only if nobody else did so first, and it is written against the revision that the batch
was checked against. So

* readers see whole batches only, of one revision;
* a batch that was published before is recognised by its writer's number and changes nothing;
* a writer whose expected revision or file offsets are not the stored ones is refused, and the
  folders it wrote are never listed;
* an empty batch publishes nothing.

A table may be partitioned by one column; a batch can put its partitions in place of the stored
ones of the same values, which is how aggregates are maintained.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.session import empty

OFFSETS = "file_generation_id string, committed_offset long"


class CommitConflict(RuntimeError):
    """Another writer published first, or the batch was made for another state."""


@dataclass(frozen=True)
class Revision:
    number: int = 0
    writers: Mapping[str, int] = field(default_factory=dict)  # writer -> its last batch
    parts: Mapping[str, Mapping[str, list[str]]] = field(default_factory=dict)  # table -> partition -> folders


class CommitLog:
    """The tables under one folder that every executor can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    # --- revisions ---------------------------------------------------------------------------

    def _path(self, text: str):
        return self._hadoop.Path(text)

    def _file_system(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def revision(self) -> Revision:
        """The newest published revision."""
        folder, files = self._path(f"{self.root}/_revisions"), self._file_system()
        if not files.exists(folder):
            return Revision()
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        numbered = [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        if not numbered:
            return Revision()
        text = self.spark.read.text(f"{self.root}/_revisions/{max(numbered)}", wholetext=True).first()[0]
        held = json.loads(text)
        return Revision(held["number"], held["writers"], held["parts"])

    def _publish(self, revision: Revision) -> None:
        files = self._file_system()
        held = {"number": revision.number, "writers": dict(revision.writers), "parts": {t: dict(p) for t, p in revision.parts.items()}}
        draft = self._path(f"{self.root}/_drafts/{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        target = self._path(f"{self.root}/_revisions/{revision.number:012d}.json")
        files.mkdirs(target.getParent())
        context = self._hadoop.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, none)  # never over a file that is there
        except Py4JJavaError as error:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                raise CommitConflict(f"revision {revision.number} was published by another writer") from None
            raise

    # --- reading -------------------------------------------------------------------------------

    def read(self, table: str, schema: str, revision: Revision | None = None) -> DataFrame:
        """Rows of a table in a revision (the newest by default); empty if nothing was written."""
        parts = (revision or self.revision()).parts.get(table, {})
        paths = [f"{self.root}/{table}/commit={folder}" + (f"/{part}" if part else "") for part, folders in parts.items() for folder in folders]
        if not paths:
            return empty(self.spark, schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths).drop("commit")

    def offsets(self, revision: Revision | None = None) -> DataFrame:
        """How far each file generation is committed."""
        return self.read("offsets", OFFSETS, revision).groupBy("file_generation_id").agg(F.max("committed_offset").alias("committed_offset"))

    # --- writing -------------------------------------------------------------------------------

    def commit(
        self, writer: str, batch: int, tables: Mapping[str, DataFrame], *, at: Revision | None = None, expected: int | None = None,
        offsets: DataFrame | None = None, replacing: Mapping[str, Sequence[str]] | None = None, partitioned: Mapping[str, str] | None = None,
    ) -> bool:
        """Publish ``tables`` as batch ``batch`` of ``writer``; False if it changes nothing.

        ``at``: the revision the rows were computed from, ``expected``: the number it must have.
        ``offsets``: file_generation_id, expected_offset, committed_offset; every generation must be
        committed up to its expected offset (0 for a new one). ``partitioned`` names the partition
        column of a table, ``replacing`` the values whose stored rows the new ones take the place of
        (also where there are no new ones).
        """
        current = at or self.revision()
        if expected is not None and current.number != expected:
            raise CommitConflict(f"expected revision {expected}, found {current.number}")
        if current.writers.get(writer, -1) >= batch:
            return False
        written = dict(tables)
        if offsets is not None:
            self._check_offsets(offsets, current)
            written["offsets"] = offsets.select("file_generation_id", "committed_offset").where("committed_offset IS NOT NULL")
        replacing, partitioned = dict(replacing or {}), dict(partitioned or {})
        parts = {t: {k: list(v) for k, v in p.items()} for t, p in current.parts.items()}
        changed = False
        for table, rows in written.items():
            column = partitioned.get(table)
            for value in replacing.get(table, ()):
                changed |= parts.get(table, {}).pop(f"{column}={value}", None) is not None
            folder = uuid.uuid4().hex
            for part in self._write(rows, f"{self.root}/{table}/commit={folder}", column):
                parts.setdefault(table, {}).setdefault(part, []).append(folder)
                changed = True
        if not changed:
            return False
        self._publish(Revision(current.number + 1, {**current.writers, writer: batch}, parts))
        return True

    def _write(self, rows: DataFrame, path: str, column: str | None) -> list[str]:
        """Write rows; the partitions that came to be ("" for a table without partitions)."""
        writer = rows.write.option("compression", "zstd")
        if column is None:
            writer.parquet(path)
            # Whether anything was written shows in the footers, without reading rows.
            return [""] if not self.spark.read.schema(rows.schema).parquet(path).isEmpty() else []
        writer.partitionBy(column).parquet(path)
        files = self._file_system()
        return sorted(s.getPath().getName() for s in files.listStatus(self._path(path)) if s.isDirectory() and "=" in s.getPath().getName())

    def _check_offsets(self, offsets: DataFrame, current: Revision) -> None:
        """Refuse a batch for any other state of its files than the stored one."""
        stored = self.offsets(current).withColumnRenamed("committed_offset", "stored_offset")
        judged = offsets.join(stored, "file_generation_id", "left").where(
            "expected_offset <> coalesce(stored_offset, 0) OR committed_offset < expected_offset OR committed_offset IS NULL OR expected_offset IS NULL"
        )
        wrong = judged.select("file_generation_id", "expected_offset", "stored_offset").first()
        if wrong is not None:
            raise CommitConflict(f"{wrong.file_generation_id} is committed up to {wrong.stored_offset or 0}, not {wrong.expected_offset}")

    def compact(self, table: str, schema: str, writer: str = "compaction") -> bool:
        """Put one folder in place of a table's many; a concurrent batch wins over it."""
        current = self.revision()
        if len(current.parts.get(table, {}).get("", ())) < 2:
            return False
        folder = uuid.uuid4().hex
        self.read(table, schema, current).write.option("compression", "zstd").parquet(f"{self.root}/{table}/commit={folder}")
        parts = {t: dict(p) for t, p in current.parts.items()}
        parts[table] = {"": [folder]}
        self._publish(Revision(current.number + 1, {**current.writers, writer: current.writers.get(writer, -1) + 1}, parts))
        return True
