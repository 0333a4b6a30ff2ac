"""Chart tables: inequality curve, matrix, tree map and flows, flat or as nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hirelens.constants import MEAN_BANDS
from hirelens.functions.salary import mean_band
from hirelens.operators.describe import top_k
from hirelens.operators.prefix import running_totals, same_keys, value_bucket, value_counts
from hirelens.session import settle


def _income_ranks(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Distinct values with people and income ahead of them and in all."""
    counts = value_counts(df, col, by).withColumn("income", F.col("n") * F.col("value"))
    return running_totals(counts, ["n", "income"], by, ["value"], value_bucket(F.col("value")))


def lorenz(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Points of the Lorenz curve, one per distinct value: share of people and share of income up to it."""
    by = by or []
    return _income_ranks(df, col, by).select(
        *by, "value", "n",
        ((F.col("n_before") + F.col("n")) / F.col("n_total")).alias("people_share"),
        F.try_divide(F.col("income_before") + F.col("income"), F.col("income_total")).alias("income_share"))


def gini(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Gini coefficient from ranks of distinct values: 2*sum(rank*value)/(n*sum(value)) - (n+1)/n."""
    by = by or []
    n = F.col("n")
    ranks = n * F.col("n_before") + n * (n + 1) / F.lit(2.0)
    sums = _income_ranks(df, col, by).groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("income").alias("_income"), F.sum(ranks * F.col("value")).alias("_ranked"))
    return sums.select(
        *by, "n",
        (F.try_divide(F.lit(2.0) * F.col("_ranked"), n * F.col("_income")) - (n + 1) / n).alias("gini"))


def matrix_mean(df: DataFrame, row: str, col: str, val: str, digits: int = 1) -> DataFrame:
    """Cells of a mean matrix with dense indexes x (columns) and y (rows), both in label order."""
    # settled: the cells are as many as pairs of labels, and are read three times
    cells = settle(df.where(F.col(val).isNotNull()).groupBy(row, col).agg(F.avg(val).alias("_mean")))
    index = lambda name, out: cells.select(name).distinct().withColumn(out, F.row_number().over(Window.orderBy(name)) - 1)
    placed = same_keys(same_keys(cells, index(col, "x"), [col]), index(row, "y"), [row])
    return placed.select(row, col, "x", "y", F.round(F.round("_mean", 6), digits).alias("mean"))


def treemap(df: DataFrame, city: str, job: str, val: str, k: int = 6) -> DataFrame:
    """The k largest jobs per city with mean and label; the parent's value is the sum of the shown children."""
    cells = df.groupBy(city, job).agg(F.count(F.lit(1)).alias("n"), F.round(F.round(F.avg(val), 6), 1).alias("mean_salary"))
    shown = top_k(cells, [city], k, F.desc("n"), job)
    label = F.concat(F.col(job), F.lit("\n("), F.format_string("%.1f", "mean_salary"), F.lit("K)"))
    return shown.withColumn("parent_value", F.sum("n").over(Window.partitionBy(city))).withColumn("label", label)


def treemap_json(tree: DataFrame, city: str) -> DataFrame:
    """One JSON node per city with its children (at most k per city)."""
    child = F.struct(F.col("rank"), F.struct(F.col("label").alias("name"), F.col("n").alias("value"), F.col("mean_salary").alias("avgSalary")).alias("node"))
    return tree.groupBy(city, "parent_value").agg(F.sort_array(F.collect_list(child)).alias("_kids")).select(
        city,
        F.to_json(F.struct(
            F.col(city).alias("name"), F.col("parent_value").alias("value"),
            F.transform("_kids", lambda k: k["node"]).alias("children"))).alias("node"))


def sankey(df: DataFrame, stages: list[str | Column]) -> DataFrame:
    """Edges (stage, source, target, value) between adjacent stages; a row with any stage NULL is left out.

    All stages are counted together first, so every edge table comes from that one small result and
    flow in equals flow out at every inner node.
    """
    cols = [s if isinstance(s, Column) else F.col(s) for s in stages]
    paths = df.select(*[c.alias(f"s{i}") for i, c in enumerate(cols)]).dropna("any").groupBy(
        *[f"s{i}" for i in range(len(cols))]).agg(F.count(F.lit(1)).alias("n"))
    edges = F.array(*[
        F.struct(F.lit(i + 1).alias("stage"), F.col(f"s{i}").alias("source"), F.col(f"s{i + 1}").alias("target"), F.col("n").alias("n"))
        for i in range(len(cols) - 1)])
    return paths.select(F.inline(edges)).groupBy("stage", "source", "target").agg(F.sum("n").alias("value"))


def flow_nodes(edges: DataFrame) -> DataFrame:
    """The distinct node names of an edge table."""
    return edges.select(F.explode(F.array("source", "target")).alias("name")).where(F.col("name").isNotNull()).distinct()


def mean_band_flow(df: DataFrame, job: str, val: str) -> DataFrame:
    """Job to the band of its mean salary; the weight is the mean."""
    means = df.where(F.col(val).isNotNull()).groupBy(job).agg(F.round(F.avg(val), 6).alias("value"))
    return means.select(F.col(job).alias("source"), mean_band(F.col("value")).alias("target"), "value")


def mean_band_nodes(edges: DataFrame) -> DataFrame:
    """Node names of `mean_band_flow`: its jobs and all five bands, used or not."""
    bands = edges.sparkSession.createDataFrame([(label,) for _, label in MEAN_BANDS], "name string")
    return edges.select(F.col("source").alias("name")).union(bands).distinct()
