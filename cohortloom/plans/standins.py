"""Cohort-shaped views of the star-schema tables used by the registered queries.

A subject is an order.  Its two measurement phases are the line statuses (O = phase n, F = phase r),
its two positions the return flags (N, R); averages are NULL where a subject has no line in a cell,
which is how missing measurements arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.scalars import rnd
from cohortloom.sources.files import read_table

PHASE = {"n": "O", "r": "F"}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
TRAITS = ["qty_n", "qty_r", "disc_max_n", "disc_max_r", "price_n", "tax_avg"]


def _if(cond: Column, value: Column) -> Column:
    return F.when(cond, value)


def line_traits(spark: SparkSession, folder: str) -> DataFrame:
    """Per-subject traits from the line items."""
    li = read_table(spark, folder, "lineitem")
    aggs = [
        F.count("*").alias("n_lines"),
        rnd(F.avg("l_extendedprice")).alias("avg_price"),
        rnd(F.avg("l_tax")).alias("tax_avg"),
        rnd(F.max("l_extendedprice")).alias("price_max"),
    ]
    for p, status in PHASE.items():
        on = F.col("l_linestatus") == status
        aggs += [
            F.nullif(F.count_if(on), F.lit(0)).alias(f"cnt_{p}"),
            rnd(F.avg(_if(on, F.col("l_quantity")))).alias(f"qty_{p}"),
            rnd(F.avg(_if(on, F.col("l_extendedprice")))).alias(f"price_{p}"),
            rnd(F.min(_if(on, F.col("l_discount")))).alias(f"disc_min_{p}"),
            rnd(F.max(_if(on, F.col("l_discount")))).alias(f"disc_max_{p}"),
        ]
    return li.groupBy("l_orderkey").agg(*aggs)


def cohort(spark: SparkSession, folder: str) -> DataFrame:
    """One row per subject: covariates, traits (nullable), baseline flag and binary outcome."""
    orders = read_table(spark, folder, "orders")
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = read_table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    lines = line_traits(spark, folder)
    y = F.when(
        F.col("avg_price").isNotNull(),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("avg_price") <= 50000).otherwise(F.col("avg_price") > 50000),
    )
    return (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
        .join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderdate").alias("visit"),
            (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("base"),
            (F.col("c_acctbal") / 1000.0).alias("acct"),
            F.col("c_mktsegment").alias("segment"),
            F.col("n_regionkey").alias("region"),
            rnd(F.col("o_totalprice")).alias("total"),
            "n_lines", "avg_price", "tax_avg", "price_max",
            *[f"{t}_{p}" for p in PHASE for t in ("cnt", "qty", "price", "disc_min", "disc_max")],
            y.cast("int").alias("y"),
        )
    )


def imputed_long(spark: SparkSession, folder: str, m: int = 10) -> DataFrame:
    """m filled copies of the cohort keyed by (imp, id); every missing cell gets a deterministic
    filler that differs between copies."""
    base = cohort(spark, folder)
    copies = base.withColumn("imp", F.explode(F.array(*[F.lit(i) for i in range(1, m + 1)])))
    filler = ((F.col("id") * 31 + F.col("imp") * 17) % 101) / F.lit(101.0)
    return copies.withColumns({
        "qty_n": F.coalesce("qty_n", rnd(10.0 + 30.0 * filler)),
        "qty_r": F.coalesce("qty_r", rnd(40.0 - 30.0 * filler)),
        "disc_max_n": F.coalesce("disc_max_n", rnd(filler / 10.0)),
    })


# Inline dictionary of the trait columns (NULL cells on purpose): id, folder, display_name, type, calculation, units
DICTIONARY = [
    ("QTY_N", "Measurements/Lines/Quantity", "Average quantity in phase n", "numeric", None, "units"),
    ("Qty_R", "Measurements/Lines/Quantity", "Average quantity in phase r", None, "", "units"),
    ("disc_max_n", "Measurements/Lines/Discount", None, "numeric", None, "percent"),
    ("Disc_Max_R", "Measurements/Lines/Discount", "Maximum discount >=3% in phase r", "numeric", None, "percent"),
    ("disc_min_n", "Measurements/Lines/Discount", "Minimum discount >= 4% in phase n", "numeric", None, "percent"),
    ("disc_min_r", "Measurements/Lines/Discount", "Minimum discount >=2% in phase r", "numeric", None, "percent"),
    ("PRICE_N", "Measurements/Lines/Price", "Average price in phase n", "numeric", "qty_n * unit", "money"),
    ("price_r", "Measurements/Lines/Price", "Average price in phase r", "numeric", None, "money"),
    ("price_max", "Measurements/Lines/Architecture", "Highest price", "numeric", "price_top", "money"),
    ("avg_price", "Measurements/Lines/Architecture", "Average price", "numeric", "price_n + price_r", "money"),
    ("tax_avg", "Measurements/Lines/Tax", "Average tax", "numeric", None, "percent"),
    ("visit", "Measurements/Lines/Tax", "Visit day", "time of day", None, None),
    ("n_lines", "Measurements/Lines/Quality", "Number of lines", "numeric", None, "count"),
    ("cnt_n", "Administrative/Lines", "Number of lines in phase n", "numeric", None, "count"),
    ("cnt_r", None, "Number of lines in phase r", "numeric", None, "count"),
    ("not_there", "Measurements/Lines/Quantity", "A variable without a column", "numeric", None, None),
]
DICTIONARY_SCHEMA = "id string, folder string, display_name string, type string, calculation string, units string"


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DICTIONARY, DICTIONARY_SCHEMA)


def phase_traits(spark: SparkSession, folder: str) -> DataFrame:
    """Paired traits per subject.  Names: measure, phase (N/R), position (O = flag N, P = flag R) and event
    type (B = quantity above 25, S = the rest); times are per phase and position."""
    li = read_table(spark, folder, "lineitem")
    qty, disc = F.col("l_quantity"), F.col("l_discount")
    aggs = []
    for ph, status in (("N", "O"), ("R", "F")):
        in_phase = F.col("l_linestatus") == status
        aggs += [rnd(F.min(F.when(in_phase, disc))).alias(f"Dmn{ph}"), rnd(F.max(F.when(in_phase, disc))).alias(f"Dmx{ph}")]
        for pos, flag in (("O", "N"), ("P", "R")):
            here = in_phase & (F.col("l_returnflag") == flag)
            aggs += [rnd(F.sum(F.when(here, qty * 60.0))).alias(f"Tim{ph}{pos}"),
                     rnd(F.avg(F.when(here, disc))).alias(f"Chg{ph}{pos}")]
            for ev, cond in (("B", qty > 25), ("S", qty <= 25)):
                cell = here & cond
                count = F.nullif(F.count_if(cell), F.lit(0))
                aggs += [count.alias(f"Cnt{ph}{pos}{ev}"), rnd(F.avg(F.when(cell, qty))).alias(f"Len{ph}{pos}{ev}"),
                         (count * 1.0).alias(f"Rph{ph}{pos}{ev}")]
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(*aggs)


def pair_dictionary_rows() -> list[tuple]:
    """Dictionary text of the paired traits, in the wording the pair rules read."""
    rows = []
    for ph, name in (("N", "NREM"), ("R", "REM")):
        tail = f"sleep ({name}), "
        rows.append((f"dmn{ph.lower()}", "Measurements/Lines/Discount", f"Minimum discount {tail}all", "numeric", None, "percent"))
        rows.append((f"dmx{ph.lower()}", "Measurements/Lines/Discount", f"Maximum discount {tail}all", "numeric", None, "percent"))
        for pos, place in (("O", "Non-supine, "), ("P", "supine ")):
            where = f"{tail}{place}>=3% oxygen desaturation"
            rows.append((f"CHG{ph}{pos}", "Measurements/Lines/Discount", f"Average change {where}", "numeric", None, "percent"))
            for ev, kind in (("B", "Bulk"), ("S", "Small")):
                rows.append((f"Cnt{ph}{pos}{ev}", "Measurements/Lines/Events", f"Number of {kind} {where}s", "numeric", None, "events"))
                rows.append((f"Len{ph}{pos}{ev}", "Measurements/Lines/Events", f"Average {kind} length {where}s", "numeric", None, "seconds"))
                rows.append((f"Rph{ph}{pos}{ev}", "Measurements/Lines/Events", f"{kind} per hour {where}s", "numeric", None, "events per hour"))
    return rows


PAIR_TIMES = {"Nonsupine": ("TimNO", "TimRO")}
PAIR_OTHER_TIMES = ("TimNP", "TimRP")


def pair_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pair_dictionary_rows(), DICTIONARY_SCHEMA)
