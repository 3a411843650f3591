"""Keyed tables that change by versions: saved scans, stars, settings, the last scan, a short history.

A table is a folder of versions, each a Parquet folder that is never changed, and a pointer file that names the one that counts. A change reads that
version, makes the next one as a plan (what is replaced goes by an anti-join, what is new comes by a union), writes it under a name of its own, and
then moves the pointer by renaming a new pointer file over it. A reader sees the old version or the new one, never a part; a writer that is lost
between writing and moving leaves a folder that nobody reads and that the next change removes.

A change can carry a batch's number: the pointer remembers the last one, and a change with a number that isn't greater does nothing, so that a batch
that is given again after a failure counts once. One writer a table at a time; a writer that finds the pointer moved since it read it gives up with
Conflict, before it changes anything.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER = "current.json"
#: Versions that stay for readers that still read them.
KEPT = 2


class Conflict(RuntimeError):
    """Another writer was there first."""


class Versioned:
    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: tuple[str, ...]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        jvm = spark._jvm
        self._at = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        self._files = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    # The pointer: {"version": folder, "number": n, "batch": last batch's number or null, "past": folders before it}.

    def pointer(self) -> dict:
        if not self._files.exists(self._at(POINTER)):
            return {"version": None, "number": 0, "batch": None, "past": []}
        stream = self._files.open(self._at(POINTER))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _move(self, seen: dict, to: dict) -> None:
        """The pointer becomes `to`, if it still is what was seen."""
        name = f".{POINTER}-{uuid.uuid4().hex}"
        stream = self._files.create(self._at(name), True)
        stream.write(bytearray(json.dumps(to).encode()))
        stream.close()
        if self.pointer() != seen:
            self._files.delete(self._at(name), False)
            raise Conflict(f"{self.path} was changed meanwhile")
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        over = self.spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._files.makeQualified(self._at(name)), self._files.makeQualified(self._at(POINTER)), over)

    def read(self) -> DataFrame:
        """The version that counts now; empty before the first one."""
        now = self.pointer()["version"]
        return self.spark.createDataFrame([], self.schema) if now is None else self.spark.read.schema(self.schema).parquet(f"{self.path}/{now}")

    def change(self, make: Callable[[DataFrame], DataFrame], batch: int | None = None) -> bool:
        """make(rows) is the next version. False: the batch was there already, nothing is done."""
        seen = self.pointer()
        if batch is not None and seen["batch"] is not None and batch <= seen["batch"]:
            return False
        name = f"v{seen['number'] + 1}-{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        make(self.read()).select(*columns).write.parquet(f"{self.path}/{name}")
        past = [p for p in (seen["version"], *seen["past"]) if p][: KEPT - 1]
        self._move(seen, {"version": name, "number": seen["number"] + 1, "batch": seen["batch"] if batch is None else batch, "past": past})
        self._prune({name, *past})
        return True

    def _prune(self, stay: set[str]) -> None:
        """Versions before those that stay, and what lost writers left."""
        for status in self._files.listStatus(self._at()):
            name = status.getPath().getName()
            if status.isDirectory() and name.startswith("v") and name not in stay:
                self._files.delete(status.getPath(), True)

    def upsert(self, rows: DataFrame, batch: int | None = None) -> bool:
        """Rows replace those of their keys; of several with one key any one counts."""
        new = rows.select(*self.schema.names).dropDuplicates(list(self.keys))
        return self.change(lambda old: old.join(new.select(*self.keys), list(self.keys), "left_anti").select(*self.schema.names).unionByName(new), batch)

    def delete(self, keys: DataFrame, batch: int | None = None) -> bool:
        return self.change(lambda old: old.join(keys.select(*self.keys).distinct(), list(self.keys), "left_anti"), batch)

    def toggle(self, rows: DataFrame, batch: int | None = None) -> bool:
        """Rows whose key is there go, the others come."""
        new = rows.select(*self.schema.names).dropDuplicates(list(self.keys))

        def make(old: DataFrame) -> DataFrame:
            out = old.join(new.select(*self.keys), list(self.keys), "left_anti").select(*self.schema.names)
            return out.unionByName(new.join(old.select(*self.keys), list(self.keys), "left_anti").select(*self.schema.names))

        return self.change(make, batch)

    def push(self, rows: DataFrame, order: str, last: int, batch: int | None = None) -> bool:
        """A ring: rows come, and of each key the `last` ones by order stay."""
        newest = Window.partitionBy(*self.keys).orderBy(F.desc(order))
        number = lambda df: df.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= last).drop("__n")
        return self.change(lambda old: number(old.unionByName(rows.select(*self.schema.names))), batch)
