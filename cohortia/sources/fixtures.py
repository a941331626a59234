"""Cohort-shaped views over the given order tables.

The given tables hold no missing values, so they are put in by key arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.eligibility import map_groups
from ..operators.split import HoldOut, assign_split
from ..operators.visits import attach_outcome, first_visits, outcome_in_window, with_first
from ..session import cut_lineage, stored, tune

# Study parameters that the queries and their SQL share.
EXTERNAL_SITES = ["NATION_0", "NATION_5", "NATION_10"]
EXCLUDED_SITES = ["NATION_1", "NATION_2"]
EXTRACTION_OVERRIDES = {"NATION_6": "2001-12-01", "NATION_7": "1998-01-01"}
CUTOFF_SITE = "NATION_7"
INTRODUCTION_YEARS = {f"NATION_{k}": 1995 + k % 5 for k in range(17)}
DRUG_GROUPS = {
    "G1": ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#6"],
    "G2": ["Brand#7", "Brand#8", "Brand#9", "Brand#10"],
    "G3": ["Brand#11 ", "Brand#12"],
    "G4": ["Brand#13"],
    "G5": ["Brand#14"],
}
SPLIT_SEED = "7202"
HOLD_OUT = HoldOut("Code", EXTERNAL_SITES)
CATEGORICAL = ["segment", "priority", "p_type", "treatment_group", "single"]
NUMERIC = ["HAQ0", "CDAI0", "Weight", "Height", "price", "four", "ten", "eleven", "ten_null", "rare50", "rare20", "rare19"]


class Views:
    """The views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder
        self.read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A given table; its footer is read once."""
        if name not in self.read:
            self.read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.read[name]

    def raw_visits(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("visit_id"),
            F.col("o_custkey").alias("ID"),
            F.col("o_orderstatus").alias("ttt_course"),
            F.col("o_orderdate").cast("date").alias("Visit_date"),
            F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice") / 10000.0).alias("CDAI"),
            "o_totalprice",
            "o_orderpriority",
        )

    def visits(self) -> DataFrame:
        """Visits with their course start and first visit, from one aggregate per course."""
        return with_first(self.raw_visits(), "ttt_startDate")

    def sites(self) -> DataFrame:
        """One row per patient: site and registry facts."""
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        return (
            self.table("customer")
            .join(nation, "c_nationkey", "left")
            .select(
                F.col("c_custkey").alias("ID"),
                F.when(F.col("c_custkey") % 101 != 0, F.col("n_name")).alias("Code"),
                F.when(F.col("c_mktsegment") == "HOUSEHOLD", "other").otherwise("ra").alias("disease"),
                (F.col("c_acctbal") / 100).alias("Weight"),
                F.col("c_mktsegment").alias("segment"),
            )
        )

    def drugs(self) -> DataFrame:
        """Drug of each order: the brand and type of its smallest part key."""
        lines = self.table("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"))
        parts = self.table("part").select("p_partkey", "p_brand", "p_type")
        return lines.join(parts, "p_partkey").select(
            F.col("l_orderkey").alias("visit_id"), F.col("p_brand").alias("generic_name"), "p_type"
        )

    def baseline(self, drugs: bool = False) -> DataFrame:
        """One row per course, from its first visit; ``drugs=True`` adds drug columns."""
        visit, patient = F.col("visit_id"), F.col("ID")
        start = F.col("Visit_date")
        first = first_visits(self.raw_visits()).join(self.sites(), "ID")
        rows = first.select(
            visit,
            patient,
            "ttt_course",
            F.concat_ws("-", "ID", "ttt_course").alias("ID_ttt"),
            F.when(patient % 17 != 0, patient).alias("ID_original"),
            start,
            start.alias("ttt_startDate"),
            "Code",
            "disease",
            F.year(start).cast("bigint").alias("year"),
            F.when(visit % 3 != 0, F.date_add(start, (visit % 1000).cast("int"))).alias("ttt_stopDate"),
            F.when((visit % 3 == 0) & (visit % 2 == 0), F.date_add(start, (visit % 500).cast("int"))).alias(
                "lostFUDate"
            ),
            F.when(visit % 9 != 3, F.lit("2001-08-01").cast("date")).alias("extraction_date"),
            "Weight",
            F.when(patient % 11 == 0, F.lit(None))
            .when(patient % 13 == 0, F.lit(0))
            .otherwise(140 + patient % 60)
            .cast("double")
            .alias("Height"),
            F.when(visit % 9 != 0, (visit % 25) / 8.0).alias("HAQ0"),
            F.col("CDAI").alias("CDAI0"),
            "o_totalprice",
            "o_orderpriority",
            "segment",
        )
        return rows.join(self.drugs(), "visit_id", "left") if drugs else rows

    def correction(self) -> DataFrame:
        """Corrected values for every fourth patient, one row per patient."""
        first = F.min(F.struct("ttt_course", "Visit_date")).alias("first")
        chosen = self.baseline().where(F.col("ID") % 4 == 0).groupBy("ID").agg(first)
        patient = F.col("ID")
        return chosen.select(
            patient.alias("ID_original"),
            F.col("first.Visit_date").alias("Visit_date"),
            F.when(patient % 3 != 0, (patient % 24) / 8.0).alias("HAQ_corrected"),
            F.when(patient % 12 != 0, F.floor(patient / 8).cast("bigint")).alias("pair_id"),
        )

    def cohort(self) -> DataFrame:
        """Baseline rows with an outcome."""
        return attach_outcome(self.baseline(drugs=True), outcome_in_window(self.visits()), null_keys=False)

    def features(self) -> DataFrame:
        """Cohort rows with columns of every kind the profiling and encoding steps meet."""
        visit, patient = F.col("visit_id"), F.col("ID")
        nan = F.lit(float("nan"))
        grouped = map_groups(self.cohort(), DRUG_GROUPS, flags=False)
        return grouped.select(
            visit.alias("row_id"),
            "Code",
            F.col("CDAI24_10").alias("CDAI_response"),
            "HAQ0",
            "CDAI0",
            "Weight",
            "Height",
            F.when(visit % 23 == 0, nan).otherwise(F.col("o_totalprice")).alias("price"),
            F.when(visit % 19 != 0, visit % 4).alias("four"),
            (visit % 10).alias("ten"),
            (visit % 11).alias("eleven"),
            F.when(visit % 19 != 0, visit % 10).alias("ten_null"),
            F.when(patient % 6 != 0, F.col("segment")).alias("segment"),
            F.col("o_orderpriority").alias("priority"),
            "p_type",
            "treatment_group",
            F.lit("A").alias("single"),
            *[(visit % k == 0).cast("bigint").alias(f"rare{k}") for k in (50, 20, 19)],
            F.lit(1.0).alias("constant"),
            F.lit(None).cast("double").alias("all_null"),
            (visit % 3 == 0).alias("every_third"),
            *[
                (visit % 7).alias(name)
                for name in ("EQ5_a", "previous_a", "SF36_a", "reasonStop_a", "time_a", "foo_n", "score12")
            ],
            "Visit_date",
            "ttt_startDate",
            "generic_name",
        )

    def split_features(self) -> DataFrame:
        """Features with their split; the joins behind them run once, the split then reads them thrice."""
        return assign_split(cut_lineage(self.features()), "CDAI_response", "row_id", SPLIT_SEED, HOLD_OUT)

    def orders_with_site(self) -> DataFrame:
        """Orders with patient facts; adaptive execution may split a patient with very many orders."""
        row, price = F.col("o_orderkey"), F.col("o_totalprice")
        orders = self.table("orders").select(
            row.alias("row_id"),
            F.col("o_custkey").alias("ID"),
            (F.col("o_orderstatus") == "F").cast("bigint").alias("y"),
            F.round(price / 500000, 3).alias("p"),
            F.when(row % 20 != 0, F.col("o_orderpriority")).alias("grp"),
            F.when(row % 10 != 0, price / 10000.0).alias("CDAI0"),
            (price / 10000 + row % 7 < 12).cast("bigint").alias("y2"),
            (row % 7).cast("double").alias("k7"),
            F.month("o_orderdate").cast("double").alias("month"),
            F.when(row % 23 == 0, F.lit(float("nan"))).otherwise(price).alias("price"),
        )
        return orders.join(self.sites().select("ID", "Code", "Weight", "segment"), "ID")

    def scored(self) -> DataFrame:
        """Rows with a label, a given score, a group, a baseline score and their split.

        The join behind them runs once; the split then reads its result three times.
        """
        rows = cut_lineage(self.orders_with_site().select("row_id", "y", "p", "grp", "CDAI0", "Code"))
        return assign_split(rows, "y", "row_id", SPLIT_SEED, HOLD_OUT).select(
            "row_id", "y", "p", "grp", "CDAI0", "split"
        )

    def training(self) -> DataFrame:
        """Rows with a label that the features explain, some of them missing."""
        rows = assign_split(stored(self.orders_with_site()), "y2", "row_id", SPLIT_SEED, HOLD_OUT)
        group = F.col("grp")
        levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
        dummies = [
            F.coalesce((group == level).cast("double"), F.lit(0.0)).alias(f"treatment_group.{level}")
            for level in levels
        ]
        return rows.select(
            "row_id",
            F.col("y2").alias("y"),
            "split",
            group.alias("treatment_group"),
            "CDAI0",
            "k7",
            "month",
            "price",
            "Weight",
            *dummies,
        )

    def shap_given(self) -> DataFrame:
        """Attributions in long form without a model: twelve variables for every order."""
        names = [*[f"f{k}" for k in range(1, 11)], "treatment_group.G1", "treatment_group.G2"]
        row = F.col("o_orderkey")
        cells = [
            F.struct(
                F.lit(name).alias("variable"),
                F.when((row + k) % 31 != 0, ((row * k) % 101 - 50) / 100.0 + k / 50.0).alias("value"),
            )
            for k, name in enumerate(names, 1)
        ]
        return self.table("orders").select(row.alias("row_id"), F.inline(F.array(*cells)))

    def row_groups(self) -> DataFrame:
        row = F.col("o_orderkey")
        group = F.when(row % 20 != 0, F.col("o_orderpriority"))
        return self.table("orders").select(row.alias("row_id"), group.alias("treatment_group"))
