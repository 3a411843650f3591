"""What a dashboard keeps between scans: the last scan's rows and errors, a history of twelve points, saved scans and stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.overview import HISTORY, overview, starred
from ..plans.scan import ScanResult
from ..predicate import apply_filter
from .versioned import Versioned


class Dashboard:
    """Tables below one folder of the cluster. A failing scan changes nothing: the last good one stays."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.errors = Versioned(spark, f"{self.path}/errors", "symbol string, error string", ("symbol",))
        self.history = Versioned(spark, f"{self.path}/history", "name string, as_of timestamp, iron double, silver_net double", ("name",))
        self.saved = Versioned(spark, f"{self.path}/saved", "name string, filter string, sort string, descending boolean, limit int", ("name",))
        self.stars = Versioned(spark, f"{self.path}/stars", "symbol string", ("symbol",))

    def rows_table(self, rows: DataFrame | None = None) -> Versioned:
        """The rows' table has the schema of the scan that wrote it."""
        at = f"{self.path}/rows"
        if rows is not None:
            return Versioned(self.spark, at, rows.schema, ("symbol",))
        now = Versioned(self.spark, at, "symbol string", ("symbol",)).pointer()["version"]
        return Versioned(self.spark, at, self.spark.read.parquet(f"{at}/{now}").schema, ("symbol",))

    def store(self, result: ScanResult, as_of, batch: int | None = None) -> None:
        """A scan without filter and limit becomes the one that readers see; batch: its number, so that a scan that is given again counts once."""
        rows = result.table.filter("error is null").drop("error")
        self.rows_table(rows).change(lambda _: rows, batch)
        self.errors.change(lambda _: result.errors, batch)
        point = overview(rows).select(F.lit("scan").alias("name"), F.lit(as_of).cast("timestamp").alias("as_of"), "iron", "silver_net")
        self.history.push(point, "as_of", HISTORY, batch)

    def rows(self, filter: str | None = None) -> DataFrame:
        """The last scan's rows under another filter; a FilterError for a bad one."""
        return apply_filter(self.rows_table().read(), filter)

    def overview(self) -> DataFrame:
        return overview(self.rows())

    def starred(self) -> DataFrame:
        return starred(self.stars.read(), self.rows())

    def save_scan(self, name: str, filter: str = "", sort: str = "mb_score", descending: bool = True, limit: int = 0) -> None:
        self.saved.upsert(self.spark.createDataFrame([(name, filter, sort, descending, limit)], self.saved.schema))

    def delete_scan(self, name: str) -> None:
        self.saved.delete(self.spark.createDataFrame([(name,)], "name string"))

    def star(self, symbol: str) -> None:
        """Stars a symbol, or takes its star away."""
        self.stars.toggle(self.spark.createDataFrame([(symbol.upper(),)], self.stars.schema))
