"""Tables of parts that are replaced whole: a batch rewrites the parts it touches, and readers see all of it or nothing.

A part (a month, a metric's year) is a folder of Parquet files that never change. A manifest names each part's folder;
publishing is the rename of a new manifest to the next number, after everything it names has been written. A writer that
breaks off before leaves folders that no manifest names. One writer at a time; readers may be many.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Helper column that deals rows to their part's folder; part names are kept to characters that folders take as they are.
PART = "_part"
_PLAIN = re.compile(r"[A-Za-z0-9_.=@-]+")


class Parts:
    """A table of parts below root. part: makes the part's name, a string column expression, from a row."""

    def __init__(self, spark: SparkSession, root: str, part: Callable[[], F.Column] | None = None):
        self.spark, self.root, self.part = spark, root.rstrip("/"), part

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        files, path = self._files(), self._path("manifest")
        if not files.exists(path):
            return []
        return sorted(int(m[1]) for f in files.listStatus(path) if (m := re.fullmatch(r"(\d+)\.json", f.getPath().getName())))

    def manifest(self, number: int | None = None) -> dict:
        """number, schema, mark and parts (part -> folder) of the newest manifest, or of an older one; number 0 if none."""
        numbers = self._numbers()
        number = number if number is not None else numbers[-1] if numbers else 0
        if number not in numbers:
            return {"number": 0, "schema": None, "mark": None, "parts": {}}
        lines = self.spark.read.text(f"{self.root}/manifest/{number:08d}.json", wholetext=True).collect()
        return json.loads(lines[0]["value"])

    def changed_since(self, number: int) -> set[str]:
        """Parts that have been written or dropped after a version; all of both if that version's manifest is gone."""
        then, now = self.manifest(number)["parts"], self.manifest()["parts"]
        return {p for p in then.keys() | now.keys() if then.get(p) != now.get(p)}

    def read(self, parts: Iterable[str] | Callable[[str], bool] | None = None, number: int | None = None, schema: T.StructType | None = None) -> DataFrame | None:
        """The rows of the named parts, or of those whose name fits, or of all: only their folders are read. None if the
        table has never been written, unless schema says what its columns would be."""
        m = self.manifest(number)
        if m["schema"] is None and schema is None:
            return None
        schema = T.StructType.fromJson(m["schema"]) if m["schema"] is not None else schema
        wanted = (lambda p: True) if parts is None else parts if callable(parts) else set(parts).__contains__
        paths = sorted(f"{self.root}/{folder}" for p, folder in m["parts"].items() if wanted(p))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, rows: DataFrame, parts: Iterable[str], mark: object = None, most_rows: int = 5_000_000) -> list[str]:
        """Publishes rows as the new content of the named parts, which rows must not leave; a part without rows goes.
        Returns the parts that have been written. mark: kept in the manifest, such as the number of a batch."""
        parts, before = sorted(set(parts)), self.manifest()
        if bad := [p for p in parts if not _PLAIN.fullmatch(p)]:
            raise ValueError(f"names of parts take letters, digits and _.=@- only: {bad[:3]}")
        folder = f"data/{uuid.uuid4().hex}"
        named = rows.withColumn(PART, self.part())
        # A row of another part would be lost, since only the named parts are published.
        named = named.withColumn(PART, F.when(F.col(PART).isin(*parts), F.col(PART)).otherwise(F.raise_error(F.concat(F.lit("row of an unnamed part: "), F.coalesce(PART, F.lit("null"))))))
        # Dealt by part; a part of very many rows is split over tasks, and so over files.
        (named.hint("rebalance", PART) if parts else named.limit(0)).write.partitionBy(PART).option("maxRecordsPerFile", most_rows).parquet(f"{self.root}/{folder}")
        files, top = self._files(), self._path(folder)
        made = {f.getPath().getName()[len(PART) + 1 :] for f in files.listStatus(top) if f.getPath().getName().startswith(f"{PART}=")}
        kept = {p: f for p, f in before["parts"].items() if p not in parts} | {p: f"{folder}/{PART}={p}" for p in sorted(made)}
        self._publish(before["number"] + 1, {"number": before["number"] + 1, "schema": json.loads(rows.schema.json()), "mark": mark, "parts": kept})
        return sorted(made)

    def held(self, rows: DataFrame) -> DataFrame:
        """rows, written beside the table: what reads them again doesn't compute them again. See clear_work."""
        path = f"{self.root}/work/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear_work(self) -> None:
        """Deletes what held() wrote; for when no frame made of it is read any more."""
        self._files().delete(self._path("work"), True)

    def names(self, rows: DataFrame) -> set[str]:
        """The parts that rows belong to: the driver gets a name for each."""
        return {r[0] for r in rows.select(self.part()).distinct().collect()}

    def _publish(self, number: int, manifest: dict) -> None:
        files, to = self._files(), self._path("manifest", f"{number:08d}.json")
        files.mkdirs(self._path("manifest"))
        new = self._path("manifest", f".{uuid.uuid4().hex}")
        out = files.create(new)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if files.exists(to) or not files.rename(new, to):
            files.delete(new, False)
            raise RuntimeError(f"version {number} of {self.root} was published by another writer")

    def drop_unread(self, keep: int = 1) -> int:
        """Deletes manifests but the newest ``keep``, and the folders that those don't name; how many folders went. Readers
        of older versions, and a writer at work, must have ended."""
        files, numbers = self._files(), self._numbers()
        used = {folder for n in numbers[-keep:] for folder in self.manifest(n)["parts"].values()}
        for n in numbers[:-keep]:
            files.delete(self._path("manifest", f"{n:08d}.json"), False)
        gone = 0
        for batch in files.listStatus(self._path("data")) if files.exists(self._path("data")) else ():
            name = batch.getPath().getName()
            own = [f.getPath() for f in files.listStatus(batch.getPath()) if f.getPath().getName().startswith(f"{PART}=")]
            unread = [p for p in own if f"data/{name}/{p.getName()}" not in used]
            for p in unread:
                files.delete(p, True)
            gone += len(unread)
            if len(unread) == len(own):
                files.delete(batch.getPath(), True)
        return gone


def month_part(date: str = "period_date") -> Callable[[], F.Column]:
    """Parts by the month of a date column."""
    return lambda: F.date_format(date, "yyyy-MM")


def year_month_part() -> Callable[[], F.Column]:
    """Parts by the columns year and month."""
    return lambda: F.format_string("%04d-%02d", F.col("year").cast("int"), F.col("month").cast("int"))
