"""A stored table of the newest forecasts that follows its files: new, late, rewritten and removed ones.

Two copies are kept, both cut by year and by a hash of the SKU: the newest row per product, month and file, and the
newest row per product and month, which is what is read. A load brings the rows of some files; only the cuts
that these files touch, now or in their older version, are written anew, to new folders. A manifest names
the folders of all cuts and the ledger of files; the latest complete manifest is the table, so readers see a load
whole or not at all. `drop_old_versions` deletes what no manifest names any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import FORECASTS
from ..sources.forecasts import newest_per_month, parse_sheets, read_sheet_lines

PLACE = T.StructType([T.StructField("block", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("pos", T.IntegerType())])
ROWS = T.StructType([*FORECASTS, T.StructField("row_order", PLACE)])
LEDGER = "source_file string, size long, modified_at timestamp"
MANIFEST = "part int, year int, rows string, newest string, ledger string, batch long"
#: Files that one load takes together.
FILES_AT_ONCE = 1000


class ForecastTable:
    """The table below `path`; `parts` is the number of hash parts of each year, for the life of the table."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 8):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    # --- reading ---------------------------------------------------------------

    def current(self) -> DataFrame:
        """The newest row per product and month; every stored row is read once, and a filter on the month is checked against the ranges stored with the rows."""
        cuts = [r for r in self._manifest() if r["newest"] is not None]
        return self._read([(r["newest"], r["part"], r["year"]) for r in cuts]).select(FORECASTS.fieldNames())

    def ledger(self) -> DataFrame:
        """source_file, size and modified_at of the files in the table."""
        folders = {r["ledger"] for r in self._manifest()}
        return self.spark.read.schema(LEDGER).parquet(*folders) if folders else self.spark.createDataFrame([], LEDGER)

    def _versions(self) -> list[int]:
        """Numbers of the complete manifests, in order."""
        hadoop, folder = self.spark._jvm.org.apache.hadoop.fs, f"{self.path}/manifest"
        path = hadoop.Path(folder)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return []
        names = [s.getPath().getName() for s in store.listStatus(path)]
        found = sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))
        return [v for v in found if store.exists(hadoop.Path(f"{folder}/version={v}/_SUCCESS"))]

    def _manifest(self, version: int | None = None) -> list:
        """Rows of the latest manifest: one a cut, and one of the ledger alone."""
        versions = self._versions()
        if not versions:
            return []
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/version={version or versions[-1]}").collect()  # one row per cut

    def _read(self, cuts: list[tuple]) -> DataFrame:
        """Rows of the given (folder, part, year) cuts."""
        roots: dict[str, list] = {}
        for folder, part, year in cuts:
            roots.setdefault(folder, []).append(self._cut(folder, part, year))
        if not roots:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(*[p for paths in roots.values() for p in paths])

    @staticmethod
    def _cut(folder: str, part: int, year) -> str:
        return f"{folder}/cut_part={part}/cut_year={'none' if year is None else year}"

    # --- loading ---------------------------------------------------------------

    def load(self, source: str) -> None:
        """Follow the sheets below `source`: take in new and rewritten ones, and take back rows of removed ones.

        A file is the same as long as its path, size and time are. Only changed files are read. The listing and the ledger are
        compared by Spark; the names of FILES_AT_ONCE files at a time reach the driver.
        """
        listed = (self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(source)
                  .select(F.col("_metadata.file_path").alias("raw"), F.col("_metadata.file_size").alias("size"),
                          F.col("_metadata.file_modification_time").alias("modified_at"))
                  .withColumn("source_file", F.url_decode("raw")))
        while True:
            same = ["source_file", "size", "modified_at"]
            changed = listed.join(self.ledger(), same, "left_anti").orderBy("raw").limit(FILES_AT_ONCE).collect()
            if not changed:
                break
            names = [r["raw"] for r in changed]
            lines = read_sheet_lines(self.spark, source, only=names)
            files = self.spark.createDataFrame([(r["source_file"], r["size"], r["modified_at"]) for r in changed], LEDGER)
            self.merge(parse_sheets(lines), files)
        gone = self.ledger().join(listed, "source_file", "left_anti").select("source_file").limit(FILES_AT_ONCE)
        while names := [r["source_file"] for r in gone.collect()]:
            self.merge(self.spark.createDataFrame([], ROWS), self.spark.createDataFrame([], LEDGER), removed=names)
            gone = self.ledger().join(listed, "source_file", "left_anti").select("source_file").limit(FILES_AT_ONCE)

    def merge(self, rows: DataFrame, files: DataFrame, batch: int | None = None, removed: list[str] = ()) -> None:
        """Put the forecast rows of `files` (LEDGER) in place of what the table has of them, and take back `removed` ones.

        `batch` is the number of a stream's batch; one that the table already holds is not merged again.
        """
        versions, manifest = self._versions(), self._manifest()
        done = max((r["batch"] for r in manifest if r["batch"] is not None), default=None)
        if batch is not None and done is not None and batch <= done:
            return
        load = uuid.uuid4().hex
        files = self._stored(files, f"files/{load}", LEDGER)
        by_file = newest_per_month(rows, keys=("vendor_sku", "forecast_month", "source_file"))
        fresh = self._stored(by_file.select(ROWS.fieldNames()), f"incoming/{load}", ROWS)
        replaced = files.select("source_file").unionByName(self.spark.createDataFrame([(n,) for n in removed], "source_file string"))
        known = self.ledger().join(replaced, "source_file", "left_semi")
        cuts = [(r["rows"], r["part"], r["year"]) for r in manifest if r["rows"] is not None]
        touched = {tuple(r) for r in self._with_cut(fresh).select("cut_part", "cut_year").distinct().collect()}  # a row a cut
        if not known.isEmpty():  # rows of an older version of these files: their cuts change too
            old = self._read(cuts).join(F.broadcast(replaced), "source_file", "left_semi")  # names of at most FILES_AT_ONCE files
            touched |= {tuple(r) for r in self._with_cut(old).select("cut_part", "cut_year").distinct().collect()}
        stay = self._read([c for c in cuts if c[1:] in touched]).join(F.broadcast(replaced), "source_file", "left_anti")
        merged = self._write(stay.unionByName(fresh), f"rows/{load}")
        self._write_newest(merged, f"newest/{load}")
        left = {tuple(r) for r in self._with_cut(merged).select("cut_part", "cut_year").distinct().collect()}
        ledger = self.ledger().join(replaced, "source_file", "left_anti").unionByName(files)
        self._stored(ledger, f"ledger/{load}", LEDGER)
        lines = [(r["part"], r["year"], r["rows"], r["newest"]) for r in manifest if r["rows"] is not None and (r["part"], r["year"]) not in touched]
        lines += [(part, year, f"{self.path}/rows/{load}", f"{self.path}/newest/{load}") for part, year in sorted(left, key=str)]
        batch = done if batch is None else batch
        lines = [(*x, f"{self.path}/ledger/{load}", batch) for x in lines] + [(None, None, None, None, f"{self.path}/ledger/{load}", batch)]
        (self.spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("errorifexists")
         .json(f"{self.path}/manifest/version={(versions or [0])[-1] + 1}"))

    def _with_cut(self, rows: DataFrame) -> DataFrame:
        """Rows with `cut_part` and `cut_year`; rows without a SKU go by their file."""
        sku = F.trim("vendor_sku")
        key = F.when(F.coalesce(sku != "", F.lit(False)), sku).otherwise(F.col("source_file"))
        return rows.withColumns({"cut_part": F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int"), "cut_year": F.year("forecast_month")})

    def _stored(self, df: DataFrame, name: str, schema) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows by cut, each row in the folder of its cut."""
        cut = self._with_cut(rows).withColumn("cut_year", F.coalesce(F.col("cut_year").cast("string"), F.lit("none")))
        (cut.hint("rebalance", "cut_part", "cut_year").write.partitionBy("cut_part", "cut_year").parquet(f"{self.path}/{name}"))
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/{name}")

    def _write_newest(self, rows: DataFrame, name: str) -> None:
        """The newest of the rows, by cut: a product's month lies in one cut, so one shuffle brings together what is compared and what is written."""
        cut = self._with_cut(rows).repartition("cut_part", "cut_year")
        newest = newest_per_month(cut, keys=("vendor_sku", "forecast_month", "cut_part", "cut_year"))
        newest = newest.withColumn("cut_year", F.coalesce(F.col("cut_year").cast("string"), F.lit("none")))
        newest.write.partitionBy("cut_part", "cut_year").parquet(f"{self.path}/{name}")

    def drop_old_versions(self, keep: int = 2) -> None:
        """Delete all but the last `keep` manifests and the folders that only older ones name, such as those of loads that failed."""
        versions = self._versions()
        used = {folder for v in versions[-keep:] for r in self._manifest(v) for folder in (r["rows"], r["newest"], r["ledger"]) if folder}
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for kind in ("rows", "newest", "ledger", "incoming", "files"):
            path = hadoop.Path(f"{self.path}/{kind}")
            store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in store.listStatus(path) if store.exists(path) else []:
                if f"{self.path}/{kind}/{status.getPath().getName()}" not in used:
                    store.delete(status.getPath(), True)
        for v in versions[:-keep]:
            path = hadoop.Path(f"{self.path}/manifest/version={v}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
