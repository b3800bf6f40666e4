"""All questions over one set of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import accuracy, coverage, filters, monthly, postings, ranking, risk, search, supply
from ..operators.questions import answer, asked_entities
from ..operators.root_cause import root_cause
from ..schemas import ACK_LINES, FORECASTS, INVENTORY
from ..sources.acks import read_ack_lines
from ..sources.forecasts import read_forecasts
from ..sources.inventory import read_inventory

ALL_KEYS = ("vendor_sku", "upc", "buyer_part_number")


class Workspace:
    """Forecasts, acknowledgement lines and inventory, and what can be asked about them.

    Every method returns a lazy DataFrame (or several); nothing is copied or cached.
    """

    def __init__(self, forecasts: DataFrame, acks: DataFrame, inventory: DataFrame | None = None, folders: dict | None = None):
        self.spark: SparkSession = acks.sparkSession
        self.forecasts, self.acks = forecasts, acks
        self.inventory = inventory if inventory is not None else self.spark.createDataFrame([], INVENTORY)
        self._folders = folders

    @classmethod
    def from_folders(cls, spark: SparkSession, forecasts: str | None = None, acks: str | None = None,
                     inventory: str | None = None) -> Workspace:
        """Read the files below the given folders."""
        return cls(
            read_forecasts(spark, forecasts) if forecasts else spark.createDataFrame([], FORECASTS),
            read_ack_lines(spark, acks) if acks else spark.createDataFrame([], ACK_LINES),
            read_inventory(spark, inventory) if inventory else None,
            dict(forecasts=forecasts, acks=acks, inventory=inventory))

    def refresh(self) -> Workspace:
        """The same folders, listed and read anew."""
        return Workspace.from_folders(self.spark, **self._folders) if self._folders else self

    def dataset_status(self) -> DataFrame:
        return supply.dataset_status(self.forecasts, self.acks)

    def report_summary(self) -> DataFrame:
        return supply.report_summary(self.forecasts, self.acks)

    def forecast_summary(self) -> DataFrame:
        return monthly.forecast_summary(self.forecasts)

    def forecast_vs_actual(self) -> DataFrame:
        return monthly.forecast_vs_actual(self.forecasts, self.acks)

    def filter_options(self) -> DataFrame:
        return filters.filter_options(self.forecasts, self.acks)

    def date_ranges(self) -> DataFrame:
        return filters.date_ranges(self.forecasts, self.acks)

    def filtered(self, selections: dict) -> Workspace:
        """A workspace over the selected records."""
        f, a = filters.filter_data(self.forecasts, self.acks, selections)
        return Workspace(f, a, self.inventory)

    def search(self, query: str | None) -> tuple[DataFrame, DataFrame]:
        return search.search_records(self.forecasts, self.acks, query)

    def search_inventory(self, query: str | None) -> DataFrame:
        return search.search_inventory_snapshot(self.inventory, query)

    def product_timeline(self, query: str) -> DataFrame:
        return monthly.product_timeline(*self.search(query))

    def top_risk_products(self, top_n: int = 10) -> DataFrame:
        return ranking.top_risk_products(self.acks, top_n)

    def cut_supply(self, query: str | None = None) -> DataFrame:
        return coverage.cut_supply(self.acks, self.inventory, query)

    def cut_supply_of_search(self, query: str) -> DataFrame:
        """Coverage of the SKUs that mention `query` or stand on an acknowledgement line that does."""
        _, lines = search.search_records(self.forecasts, self.acks, query, expand=False)
        skus = lines.select("vendor_sku").filter(F.col("vendor_sku").isNotNull()).distinct().withColumn("on_line", F.lit(True))
        named = coverage.shortage_coverage(self.acks, self.inventory, query).select("vendor_sku").withColumn("named", F.lit(True))
        some_named = named.limit(1).agg((F.count("*") > 0).alias("any"))
        result = (coverage.shortage_coverage(self.acks, self.inventory)
                  .join(named, "vendor_sku", "left").join(skus, "vendor_sku", "left"))
        return (result.filter(F.when(some_named.scalar(), F.col("named")).otherwise(F.col("on_line")))
                .drop("named", "on_line").orderBy(F.desc("uncovered_short_qty"), F.desc("short_qty"), "vendor_sku"))

    def kpis(self) -> DataFrame:
        return supply.dashboard_kpis(self.forecasts, self.acks)

    def vendor_performance(self) -> DataFrame:
        return supply.vendor_performance(self.acks)

    def vendor_reliability(self) -> DataFrame:
        return risk.vendor_reliability(self.acks)

    def forecast_errors(self) -> DataFrame:
        return accuracy.error_by_month(self.forecasts, self.acks)

    def root_cause(self, product: str, po_number: str | None = None, vendor: str | None = None,
                   customer: str | None = None, lookback_months: int | None = 12, as_of=None) -> DataFrame:
        """The report of one product identifier or PO number, as one row.

        Only records of that product or PO are read on, all under one entity.
        """
        f, a = search.product_records(self.forecasts, self.acks, product=product, po_number=product if po_number is None else po_number)
        text = str(product).strip()
        one = self.spark.range(1).select(F.lit(text).alias("entity"))
        asked = lambda df: df.withColumn("asked_for", F.lit(text))
        return root_cause(asked(f), asked(a), self.inventory, keys=("asked_for",), entities=one, vendor=vendor,
                          customer=customer, lookback_months=lookback_months, as_of=as_of, line_samples=10)

    def root_causes(self, entities: DataFrame | None = None, **options) -> DataFrame:
        """Reports of all product identifiers and PO numbers (or of the given `entity` values) in one job."""
        return root_cause(self.forecasts, self.acks, self.inventory, keys=ALL_KEYS, expand_po=True,
                          entities=entities, **options)

    def investigate(self, query: str, **options) -> dict[str, DataFrame]:
        """Everything about one search text."""
        f, a = self.search(query)
        return {"forecast_matches": f, "ack_matches": a, "timeline": monthly.product_timeline(f, a),
                "root_report": self.root_cause(query, **options)}

    def investigate_all(self, texts: DataFrame, **options) -> dict[str, DataFrame]:
        """Everything about a table of plain search texts (column `query`), each row with its `query` or `entity`."""
        f, a = postings.search_texts(self.forecasts, self.acks, texts)
        entities = texts.select(F.trim("query").alias("entity")).filter("entity != ''").distinct()
        return {"forecast_matches": f, "ack_matches": a, "timeline": monthly.keyed_months(f, a, F.col("query")),
                "root_report": self.root_causes(entities, **options)}

    def write_index(self, folder: str, blocks: int = postings.BLOCKS) -> None:
        """Stores a search index of forecasts and lines in a new folder."""
        postings.write_index(self.forecasts, search.FORECAST_FIELDS, f"{folder}/forecasts", blocks)
        postings.write_index(self.acks, search.ACK_FIELDS, f"{folder}/acks", blocks)

    def search_index(self, folder: str, query: str | None) -> tuple[DataFrame, DataFrame]:
        """What `search` finds, through an index that `write_index` has stored."""
        return postings.search_index(postings.SearchIndex(self.spark, f"{folder}/forecasts", search.FORECAST_FIELDS),
                                     postings.SearchIndex(self.spark, f"{folder}/acks", search.ACK_FIELDS), query)

    def answer(self, questions: DataFrame, **options) -> DataFrame:
        """Answers to a table of questions (column `question`)."""
        asked = asked_entities(questions, self.forecasts, self.acks, names=(*ALL_KEYS, "po_number"))
        return answer(questions, self.root_causes(asked, **options), self.vendor_performance())
