"""Live views: predicates, staleness, enrichment, ranked and paged reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions.scalars import level_of_service, severity_rank

# Seconds to live by type (crowd, feed, longest life), severities by type, permissive licences.
DECAY_S = {
    "congestion": (300, 600, 3600),
    "hazard": (900, 1800, 7200),
    "accident": (1800, 3600, 14400),
    "road_closure": (14400, 28800, 86400),
    "lane_closure": (14400, 28800, 86400),
    "roadworks": (604800, 1209600, 2592000),
    "transit_disruption": (1800, 3600, 14400),
    "accessibility": (7200, 14400, 43200),
    "equipment_fault": (7200, 14400, 43200),
}
DECAY_FALLBACK = (900, 1800, 7200)
TYPE_SEVERITY = {"obstruction": "medium", "detour": "low", "roadworks": "low", "broken_down_vehicle": "low", "weather": "low", "road_condition": "low", "speed_restriction": "low", "dimension_restriction": "low", "transit_disruption": "low"}
DELAY_HIGH_S = 1200
RELEASED = ["authoritative", "aggregate", "crowd_pseudonym", "dp_noised", "k_anon"]
# Declared severities by format, and types by a source's code: type, category, planned.
SEVERITIES = {
    "open511": {"minor": "low", "moderate": "medium", "major": "high"},
    "datex2": {"lowest": "low", "low": "low", "medium": "medium", "high": "high", "highest": "critical"},
}
TYPES = {
    ("accident", "incident", False): "accident incident crash accident_report preliminary_accident_report",
    ("broken_down_vehicle", "incident", False): "vehicleobstruction",
    ("lane_closure", "incident", False): "roadorcarriagewayorlanemanagement",
    ("detour", "conditions", False): "reroutingmanagement detour",
    ("speed_restriction", "conditions", False): "speedmanagement",
    ("obstruction", "incident", False): "generalobstruction",
    ("hazard", "incident", False): "infrastructuredamageobstruction environmentalobstruction",
    ("hazard", "conditions", False): "hazard warning general",
    ("roadworks", "planned", True): "maintenanceworks constructionworks construction work-zone roadworks road_work",
    ("other", "conditions", False): "generalnetworkmanagement",
    ("road_closure", "incident", False): "roadclosure closure",
    ("congestion", "conditions", False): "abnormaltraffic congestion",
    ("weather", "conditions", False): "weatherrelated poorenvironmentconditions weather_condition",
    ("road_condition", "conditions", False): "roadsurfaceconditions road_condition",
    ("public_event", "planned", True): "publicevent special_event",
    ("authority", "incident", False): "authority exempted_transport",
    ("transit_disruption", "incident", False): "transitdisruption",
    ("equipment_fault", "conditions", False): "equipmentorsystemfault",
    ("security", "incident", False): "securityincident",
    ("dimension_restriction", "conditions", False): "dimensionrestriction weight_restriction",
    ("contraflow", "conditions", False): "contraflow",
}
CLOSURES = ["road_closure", "lane_closure"]


def envelope_overlaps(west: float, south: float, east: float, north: float) -> Column:
    return (F.col("max_lon") >= west) & (F.col("min_lon") <= east) & (F.col("max_lat") >= south) & (F.col("min_lat") <= north)


def checked_bbox(west: float, south: float, east: float, north: float) -> tuple[float, float, float, float]:
    """Refuses boxes out of range, empty, or over the antimeridian."""
    if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
        raise ValueError("bbox must be west < east and south < north within the world")
    return west, south, east, north


def live(now: Column) -> Column:
    ends = [F.col(c).isNull() | (F.col(c) > now) for c in ("valid_to", "expires_at")]
    return (F.col("status") == "active") & ends[0] & ends[1]


def min_severity(name: str) -> Column:
    return severity_rank(F.col("severity")) >= severity_rank(F.lit(name))


def within_horizon(now: Column, days: int) -> Column:
    return F.col("valid_from").isNull() | (F.col("valid_from") <= now + F.expr(f"interval {days} days"))


def routing_eligible() -> Column:
    return ~((F.col("origin_kind") == "crowd") & ~F.col("routing_eligible"))


def read_live(obs: DataFrame, bbox: tuple[float, float, float, float], now: Column, domain: str | None = None, kind: str | None = None, types: list[str] | None = None, least: str | None = None, horizon_days: int | None = None, routing_only: bool = False, limit: int = 2000) -> DataFrame:
    """Filters, then the worst first (ties by id), cut before any dedup."""
    out = obs.where(envelope_overlaps(*checked_bbox(*bbox)) & live(now))
    for column, value in (("domain", domain), ("kind", kind)):
        out = out.where(F.col(column) == value) if value else out
    out = out.where(F.col("type").isin(types)) if types else out
    out = out.where(min_severity(least)) if least else out
    out = out.where(within_horizon(now, horizon_days)) if horizon_days is not None else out
    out = out.where(routing_eligible()) if routing_only else out
    return out.orderBy(severity_rank(F.col("severity")).desc(), "id").limit(limit)


def with_staleness(obs: DataFrame, status: DataFrame, now: Column) -> DataFrame:
    """is_stale: the source never succeeded, or not within its window. The status table has a row per source."""
    joined = obs.join(status.select("source", "last_success", "window_s"), "source", "left")
    stale = F.col("last_success").isNull() | (F.col("last_success") + F.make_interval(secs=F.col("window_s")) < now)
    return joined.withColumn("is_stale", stale).drop("last_success", "window_s")


def record_stale(updated: Column, window_s: Column, now: Column) -> Column:
    return F.unix_seconds(now) - F.unix_seconds(updated) >= window_s


def derived_severity(state: Column, affected: Column, total: Column) -> Column:
    by_lanes = F.when(affected >= total, "high").when(affected * 3 >= total, "medium").otherwise("low")
    return F.when(state == "closed", "high").when((total > 0) & (affected > 0), by_lanes).when(state.isin("some_lanes_closed", "single_lane_alternating"), "medium").otherwise("unknown")


def enriched_severity(severity: Column, state: Column, affected: Column, total: Column, kind: Column, delay_s: Column) -> Column:
    """Unknown severities from lanes, then type; a long delay lifts to high. Never lowers."""
    by_type = F.lit("unknown")
    for name, value in TYPE_SEVERITY.items():
        by_type = F.when(kind == name, value).otherwise(by_type)
    derived = derived_severity(state, affected, total)
    first = F.when(severity != "unknown", severity).when(derived != "unknown", derived).otherwise(by_type)
    return F.when((delay_s >= DELAY_HIGH_S) & (severity_rank(first) < 3), "high").otherwise(first)


def normalised_severity(raw: Column, form: str) -> Column:
    """A format's declared severity in the engine's words; unknown for others."""
    out = F.lit("unknown")
    for name, value in SEVERITIES.get(form, {}).items():
        out = F.when(F.lower(raw) == name, value).otherwise(out)
    return out


def source_type(code: Column) -> Column:
    """(type, category, planned) of a source's code, whatever its case and prefix before a colon; other, conditions, not planned for unknown ones."""
    bare = F.lower(F.regexp_replace(code, "^[^:]*:", ""))
    entry = lambda t: F.struct(F.lit(t[0]).alias("type"), F.lit(t[1]).alias("category"), F.lit(t[2]).alias("planned"))
    out = entry(("other", "conditions", False))
    for kind, codes in TYPES.items():
        out = F.when(bare.isin(codes.split()), entry(kind)).otherwise(out)
    return out


def excludable(at: Column) -> Column:
    """Whether routing must avoid a row at a time: an active event of a feed or an eligible crowd, a closure or critical, in its window."""
    routable = (F.col("origin_kind") == "feed") | ((F.col("origin_kind") == "crowd") & F.coalesce("routing_eligible", F.lit(False)))
    heavy = F.coalesce(F.col("type").isin(CLOSURES), F.lit(False)) | F.coalesce(F.col("severity") == "critical", F.lit(False))
    inside = ~F.coalesce(F.col("valid_from") > at, F.lit(False)) & ~F.coalesce(F.col("valid_to") < at, F.lit(False))
    return F.coalesce((F.col("kind") == "event") & (F.col("status") == "active") & routable, F.lit(False)) & heavy & inside


def decay_seconds(kind: Column, origin: Column) -> Column:
    crowd, feed = F.lit(DECAY_FALLBACK[0]), F.lit(DECAY_FALLBACK[1])
    for name, (c, f, _) in DECAY_S.items():
        crowd, feed = F.when(kind == name, c).otherwise(crowd), F.when(kind == name, f).otherwise(feed)
    return F.when(origin == "crowd", crowd).otherwise(feed)


def reclassified(flows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Level of service from the sensor's baseline, only where it is unknown and no free flow came with it."""
    j = flows.join(baseline.select("sensor_key", F.col("free_flow_kph").alias("base_kph")), "sensor_key", "left")
    use = (F.col("los") == "unknown") & F.col("free_flow_kph").isNull() & (F.col("base_kph") > 0)
    ratio = F.when(use, F.col("speed_kph") / F.col("base_kph"))
    return j.withColumns({"los": F.when(use, level_of_service(ratio)).otherwise(F.col("los")), "free_flow_kph": F.when(use, F.col("base_kph")).otherwise(F.col("free_flow_kph"))}).drop("base_kph")


def with_congestion_events(flows: DataFrame) -> DataFrame:
    """Flows, and an event for each that is queuing or worse."""
    return flows.withColumn("record", F.lit("flow")).unionByName(flows.where(F.col("los").isin("queuing", "stationary")).withColumn("record", F.lit("congestion")))


def archive_rows(obs: DataFrame, now: Column) -> DataFrame:
    """Active, unexpired, of a released privacy class; without a class only feed rows."""
    released = F.col("privacy_class").isin(RELEASED)
    return obs.where(live(now) & F.when(F.col("privacy_class").isNull() | (F.col("privacy_class") == "unknown"), F.col("origin_kind") == "feed").otherwise(released))


def page_after(rows: DataFrame, by: list[str], after: tuple | None, size: int, most: int, descending: bool = True) -> DataFrame:
    """Keyset page over two columns: rows beyond the cursor, in order, ``size`` of them."""
    a, b = F.col(by[0]), F.col(by[1])
    if after is not None:
        x, y = F.lit(after[0]), F.lit(after[1])
        rows = rows.where((a < x) | ((a == x) & (b < y)) if descending else (a > x) | ((a == x) & (b > y)))
    return rows.orderBy(*([a.desc(), b.desc()] if descending else [a, b])).limit(min(max(size, 1), most))
