"""Lookups in the configuration of clusters, by cluster, subcluster and metric.

``read_cluster_config`` gives rows for each (cluster, subcluster, metric). Rows of
samples or jobs find theirs by as many of these keys as the configuration has; a
configuration of metrics alone holds for all. Nothing here asks for a broadcast:
the configuration is small, and AQE sees its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.functions.scalars import expand_node_list

PLACE = ("cluster", "subcluster")


def place_of(frame: DataFrame) -> list[str]:
    return [c for c in PLACE if c in frame.columns]


def host_keys(left: DataFrame, right: DataFrame) -> list[str]:
    """Hosts are told apart by cluster where both sides know it."""
    return ["cluster", "hostname"] if "cluster" in left.columns and "cluster" in right.columns else ["hostname"]


def config_keys(rows: DataFrame, config: DataFrame, *more: str) -> list[str]:
    keys = place_of(config)
    if missing := [k for k in keys if k not in rows.columns]:
        raise ValueError(f"the configuration is kept by {', '.join(keys)}; the rows have no {', '.join(missing)} (with_subcluster adds it)")
    return [*keys, *more]


def with_config(rows: DataFrame, config: DataFrame, *columns: str) -> DataFrame:
    """Rows with columns of their metric's configuration; a metric that is not
    configured, or removed on the row's subcluster, goes."""
    keys = config_keys(rows, config, "metric")
    return rows.join(config.select(*keys, *(columns or [c for c in config.columns if c not in keys])), keys)


def host_subclusters(node_lists: DataFrame) -> DataFrame:
    """(cluster, hostname, subcluster) of the listed hosts; of several lists with one
    host the first subcluster by name. ``node_lists``: cluster, subcluster, nodes."""
    listed = node_lists.where("nodes <> '*'").select("cluster", F.explode(expand_node_list(F.col("nodes"))).alias("hostname"), "subcluster")
    return listed.groupBy("cluster", "hostname").agg(F.min("subcluster").alias("subcluster"))


def with_subcluster(rows: DataFrame, node_lists: DataFrame) -> DataFrame:
    """Adds the subcluster of each row's host: the one that lists it, else the
    cluster's catch-all (list ``*``), else null."""
    named = host_subclusters(node_lists).withColumnRenamed("subcluster", "_listed")
    rest = node_lists.where("nodes = '*'").groupBy("cluster").agg(F.min("subcluster").alias("_rest"))
    out = rows.join(named, ["cluster", "hostname"], "left").join(rest, "cluster", "left")
    return out.withColumn("subcluster", F.coalesce("_listed", "_rest")).drop("_listed", "_rest")
