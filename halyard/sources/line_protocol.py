"""Line protocol to samples, by columns alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = r"^([^,\s]+)((?:,[^,=\s]+=[^,\s]+)*)\s+(\S+)(?:\s+(-?\d+))?\s*$"
NUMBER = r"^value=(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)[iu]?$"


def parse_line_protocol(lines: DataFrame, default_cluster: str, config: DataFrame, column: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """``measurement,tags value=x ts`` rows to samples. Unknown measurements, other
    fields and path-like names are skipped; ``type=node`` has no component. ``keep``: columns carried along."""
    part = lambda k: F.regexp_extract(F.col(column), LINE, k)
    # Generated rows are fences: each line is matched and split once, while plain columns
    # would be copied into all that reads them, filters too.
    once = lambda **of: F.inline(F.array(F.struct(*[c.alias(n) for n, c in of.items()])))
    rows = lines.select(*keep, once(metric=part(1), tagged=part(2), field=part(3), ts=part(4))).where((F.col("metric") != "") & (F.col("ts") != ""))
    tags = F.str_to_map(F.substring("tagged", 2, 1 << 30), F.lit(","), F.lit("="))
    rows = rows.select("metric", "ts", *keep, once(t=tags, number=F.regexp_extract("field", NUMBER, 1)))
    tag = lambda *names: F.coalesce(*[F.try_element_at("t", F.lit(n)) for n in names])
    kind = F.coalesce(tag("type"), F.lit("node"))
    scope = F.when(kind == "cpu", "hwthread").otherwise(kind)
    out = rows.select(
        F.coalesce(tag("cluster"), F.lit(default_cluster)).alias("cluster"), tag("hostname", "host").alias("hostname"), scope.alias("scope"),
        F.when(kind == "node", "").otherwise(F.coalesce(tag("type-id"), F.lit(""))).alias("scope_id"), "metric", F.col("ts").cast("long").alias("ts"),
        F.when(F.col("number") != "", F.col("number")).cast("double").alias("value"), *keep,
    )
    odd = lambda c: F.col(c).rlike(r"\.\.|/|\\")
    clean = out.where(F.col("value").isNotNull() & F.col("hostname").isNotNull() & ~odd("cluster") & ~odd("hostname") & ~odd("scope_id"))
    return clean.join(F.broadcast(config.select("metric").distinct()), "metric", "left_semi").select("cluster", "hostname", "scope", "scope_id", "metric", "ts", "value", *keep)
