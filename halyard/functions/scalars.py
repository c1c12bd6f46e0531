"""Scalar functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SI prefixes and their powers of a thousand.
PREFIXES = ("", "K", "M", "G", "T", "P", "E")
HWTHREAD_ALIASES = {"cpu": "hwthread"}
COMPONENT = r"^(socket|memoryDomain|core|hwthread|cpu|accelerator)(\d.*)$"


def effective_duration(now: int) -> Column:
    """Running jobs: seconds since their start; others: the stored duration."""
    return F.when(F.col("job_state") == "running", F.lit(now) - F.col("start_time")).otherwise(F.col("duration"))


def round_half_up(value: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, the same in every engine."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def prefix_power(prefix: Column) -> Column:
    """0 for none, 1 for K, 2 for M, ..."""
    return F.array_position(F.array(*map(F.lit, PREFIXES)), F.coalesce(prefix, F.lit(""))).cast("int") - 1


def normalize_unit(avg: Column, prefix: Column) -> tuple[Column, Column]:
    """(factor, new prefix): over 1000 the value is divided by 1000 until it is
    at most 1000, below 1 it is multiplied until it is at least 1."""
    up = sum((F.when(avg > 1000.0**k, 1).otherwise(0) for k in range(1, 7)), F.lit(0))
    down = sum((F.when(avg < 1000.0**-k, 1).otherwise(0) for k in range(0, 6)), F.lit(0))
    steps = F.when(avg <= 0, 0).when(avg > 1000, up).when(avg < 1, -down).otherwise(0)
    power = F.least(F.greatest(prefix_power(prefix) + steps, F.lit(0)), F.lit(len(PREFIXES) - 1))
    factor = F.element_at(F.array(*[F.lit(1000.0**-k) for k in range(-6, 7)]), (steps + 7).cast("int"))
    name = F.element_at(F.array(*map(F.lit, PREFIXES)), (power + 1).cast("int"))
    return factor, F.when(steps == 0, F.coalesce(prefix, F.lit(""))).otherwise(name)


def convert_prefix(value: Column, source: Column, target: Column) -> Column:
    return value * F.pow(F.lit(1000.0), (prefix_power(source) - prefix_power(target)).cast("double"))


def split_component(name: Column) -> tuple[Column, Column]:
    """(scope, id) of a component name; a digit must follow a known prefix."""
    scope = F.regexp_extract(name, COMPONENT, 1)
    known = scope != ""
    scope = F.when(scope == "cpu", F.lit("hwthread")).otherwise(scope)
    return F.when(known, scope).otherwise(name), F.when(known, F.regexp_extract(name, COMPONENT, 2)).otherwise(F.lit(""))


def expand_node_list(expr: Column) -> Column:
    """Hosts of ``w[01-03,7],x1``: one bracket a term, zero padding kept."""
    terms = F.regexp_extract_all(expr, F.lit(r"([^,\[\]]+(?:\[[^\]]*\])?)[^,]*"), F.lit(1))

    def hosts(term: Column) -> Column:
        stem = F.regexp_extract(term, r"^([^\[]*)", 1)
        inside = F.regexp_extract(term, r"\[([^\]]*)\]", 1)

        def numbers(part: Column) -> Column:
            low, high = F.element_at(F.split(part, "-"), 1), F.element_at(F.split(part, "-"), -1)
            run = F.sequence(low.cast("long"), high.cast("long"))
            return F.transform(run, lambda k: F.concat(stem, F.lpad(k.cast("string"), F.greatest(F.length(low), F.length(k.cast("string"))), F.lit("0"))))

        listed = F.flatten(F.transform(F.split(inside, ","), numbers))
        return F.when(inside == "", F.array(stem)).otherwise(listed)

    return F.flatten(F.transform(terms, hosts))


def scheduler_state(states: Column) -> Column:
    """One state out of several, by priority, whatever their case."""
    low = F.transform(states, F.lower)
    has = lambda s: F.array_contains(low, s)
    return (
        F.when(has("allocated"), "allocated").when(has("reserved"), "reserved").when(has("idle") & has("down"), "down")
        .when(has("idle"), "idle").when(has("down"), "down").when(has("mixed"), "mixed").otherwise("unknown")
    )


def energy_hardware(metric: Column) -> Column:
    """Hardware kind by name; lower, title and upper spellings count."""
    out = None
    for part, kind in (("cpu", "CPU"), ("acc", "Accelerator"), ("mem", "Memory"), ("core", "Core")):
        hit = metric.rlike(f"{part}|{part.capitalize()}|{part.upper()}")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("Other")


def carbon_mass(energy: Column, grams_per_kwh: float) -> Column:
    """Kilograms, to two digits."""
    return F.floor(energy * F.lit(float(grams_per_kwh)) / 10 + F.lit(0.5)) / 100


def footprint_quality(value: Column, peak: Column, normal: Column, caution: Column, alert: Column, lower_is_better: Column) -> Column:
    """3 alert, 2 caution, 1 normal, 0 above normal, -1 above peak, 4 no thresholds."""
    low = (
        F.when((value <= peak) & (value >= alert), 3).when((value < alert) & (value >= caution), 2)
        .when((value < caution) & (value >= 0), 1).otherwise(-1)
    )
    high = (
        F.when((value <= alert) & (value >= 0), 3).when((value <= caution) & (value > alert), 2)
        .when((value <= normal) & (value > caution), 1).when((value <= peak) & (value > normal), 0).otherwise(-1)
    )
    return F.when(peak.isNull(), 4).when(lower_is_better, low).otherwise(high)


def scaled_threshold(threshold: Column, shared: Column, stat: Column, hwthreads: Column, node_threads: Column) -> Column:
    """Shared jobs' thresholds, other than of averages, go by their share of the node."""
    part = F.floor(threshold * hwthreads / node_threads + F.lit(0.5)).cast("double")
    return F.when((shared == "none") | (stat == "avg"), threshold).otherwise(part)


def peak_fraction(stat: Column, peak: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(stat, peak)), F.lit(0.0))


def arithmetic_intensity(flops: Column, bandwidth: Column) -> Column:
    return F.try_divide(flops, bandwidth)


def scale_by(value: Column, factor: float) -> Column:
    """0 and 1 leave the value."""
    return value if factor in (0, 1) else value * F.lit(float(factor))


def sanitize_stats(avg: Column, low: Column, high: Column) -> list[Column]:
    """All three are 0 if one is missing."""
    missing = avg.isNull() | low.isNull() | high.isNull()
    return [F.when(missing, 0.0).otherwise(c) for c in (avg, low, high)]


def legacy_footprint(flat: dict[str, tuple[Column, bool]]) -> Column:
    """Flat columns to a footprint map; marked ones only where not 0."""
    optional = [k for k, (_, drop_zero) in flat.items() if drop_zero]
    made = F.create_map(*[x for k, (c, _) in flat.items() for x in (F.lit(k), c.cast("double"))])
    return F.map_filter(made, lambda k, v: ~(k.isin(*optional) & (F.coalesce(v, F.lit(0.0)) == 0))) if optional else made


def round2(value: Column) -> Column:
    return round_half_up(value, 2)
