"""Footprints and energy of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.functions.scalars import round2
from halyard.operators.config import config_keys


def footprint(stats: DataFrame, config: DataFrame) -> DataFrame:
    """(id, footprint): ``<metric>_<stat>`` to value for every footprint metric of the
    job's subcluster, 0 where a job has no such statistic. ``stats``: id, metric, avg,
    min, max, and the job's cluster and subcluster where the configuration is kept by
    them (a job has one of each)."""
    place = config_keys(stats, config)
    wanted = config.where("footprint <> ''").select(*place, "metric", "footprint")
    name = F.concat_ws("_", "metric", "footprint")
    value = F.when(F.col("footprint") == "avg", F.col("avg")).when(F.col("footprint") == "min", F.col("min")).when(F.col("footprint") == "max", F.col("max"))
    # Every job asks for all metrics of its place; its statistics fill some of them.
    asked = stats.select("id", *place).distinct().withColumn("k", F.lit(None).cast("string")).withColumn("v", F.lit(None).cast("double"))
    found = stats.join(wanted, [*place, "metric"]).select("id", *place, name.alias("k"), value.alias("v"))
    maps = asked.unionByName(found).groupBy("id", *place).agg(F.map_from_entries(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))).alias("found"))
    keys = wanted.groupBy(*place).agg(F.array_sort(F.collect_list(name)).alias("keys"))
    out = maps.join(keys, place, "left") if place else maps.crossJoin(keys)
    keys_or_none = F.coalesce("keys", F.array().cast("array<string>"))
    filled = F.transform(keys_or_none, lambda k: F.struct(k, F.coalesce(F.try_element_at("found", k), F.lit(0.0))))
    return out.select("id", F.map_from_entries(filled).alias("footprint"))


def split_footprint(jobs: DataFrame) -> DataFrame:
    """(id, metric, stat, value), split at the last underscore of the key."""
    rows = jobs.select("id", F.explode("footprint").alias("k", "value"))
    return rows.select("id", F.regexp_extract("k", r"^(.*)_([^_]*)$", 1).alias("metric"), F.substring_index("k", "_", -1).alias("stat"), "value")


def energy(jobs: DataFrame, stats: DataFrame, config: DataFrame) -> DataFrame:
    """(id, energy_footprint, energy) in kWh of the jobs with statistics: power
    metrics by average, nodes and hours; ``energy`` metrics count as 0. Statistics
    carry cluster and subcluster where the configuration is kept by them."""
    place = config_keys(stats, config)
    kinds = config.where("energy IN ('power', 'energy')").select(*place, "metric", F.col("energy").alias("kind"))
    size = jobs.select("id", "num_nodes", "duration")
    rows = stats.join(kinds, [*place, "metric"]).join(size, "id")
    used = F.when(F.col("kind") == "power", round2(F.col("avg") * F.col("num_nodes") * (F.col("duration") / 3600) / 1000)).otherwise(0.0)
    return rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("metric", used))).alias("energy_footprint"), round2(F.sum(used)).alias("energy"))
