"""Column builders: speeds and bins, times, severity, geometry on the sphere, text."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

BIN_KPH, BINS = 2.0, 128
EARTH_M = 6_371_000.0

# Ranks of severities, low to high.
SEVERITY_RANKS = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def speed_bin(speed: Column) -> Column:
    """2 kph bins, 128 of them; a speed that isn't finite is in bin 0."""
    finite = speed.isNotNull() & ~F.isnan(speed) & (F.abs(speed) < float("inf"))
    return F.when(finite, F.least(F.greatest(F.floor(speed / BIN_KPH), F.lit(0)), F.lit(BINS - 1))).otherwise(0).cast("int")


def bin_midpoint(b: Column) -> Column:
    return (b * 2 + 1).cast("double")


def plausible_speed(speed: Column) -> Column:
    return (speed > 0) & (speed < 250)


def dow0(ts: Column) -> Column:
    """Day of the week with Sunday 0."""
    return F.dayofweek(ts) - 1


def severity_rank(severity: Column) -> Column:
    c = F.lit(0)
    for name, rank in SEVERITY_RANKS.items():
        c = F.when(severity == name, rank).otherwise(c)
    return c


def level_of_service(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "unknown").when(ratio >= 0.85, "free_flow").when(ratio >= 0.5, "heavy").when(ratio >= 0.15, "queuing").otherwise("stationary")


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def azimuth_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Planar bearing in degree space, from north."""
    d = F.degrees(F.atan2(lon2 - lon1, lat2 - lat1))
    return F.when(d < 0, d + 360).otherwise(d)


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits, of two characters at least."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda x: F.length(x) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    """0 when either side is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def road_tokens(text: Column) -> Column:
    """Road numbers in a text, capital letters and digits alone (A 3 and a-3 are A3); the whole text so if it holds none."""
    up = F.upper(text)
    bare = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    found = F.regexp_extract_all(up, F.lit(r"(\b[A-Z]{1,3}[\s./-]?[0-9]{1,4}[A-Z]?\b)"), F.lit(1))
    own = F.when(F.size(found) > 0, F.transform(found, bare)).otherwise(F.array(bare(text)))
    return F.array_distinct(F.filter(own, lambda x: x != ""))


def same_road(a: Column, b: Column) -> Column:
    """Names that are equal but for case and marks, or one the end of the other."""
    x, y = (F.regexp_replace(F.upper(c), "[^A-Z0-9]", "") for c in (a, b))
    return (x != "") & (y != "") & (F.endswith(x, y) | F.endswith(y, x))


def redacted(url: Column, secrets: list[str] = ("key", "token", "apikey", "api_key", "access_token", "password", "secret")) -> Column:
    """A url without its user and the values of parameters that hold secrets."""
    bare = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1***@")
    return F.regexp_replace(bare, rf"(?i)([?&](?:{'|'.join(secrets)})=)[^&#]*", "$1***")


def expanded(template: str, values: dict[str, str], allowed: list[str]) -> str:
    """A url template with the values of its {names}; a name that isn't allowed or known is an error."""
    names = re.findall(r"\{([A-Za-z0-9_]+)\}", template)
    if bad := [n for n in names if n not in allowed or n not in values]:
        raise ValueError(f"no value for {bad}")
    return re.sub(r"\{([A-Za-z0-9_]+)\}", lambda m: quote(values[m[1]], safe=""), template)


def iso_instant(text: Column) -> Column:
    """Timestamps from ISO texts with a T; without a zone they are UTC; days that no calendar has are null."""
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
    zoned = F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(shape), F.try_to_timestamp(zoned))


def duration_between(start: Column, end: Column) -> Column:
    """ISO duration from one time of day (h:mm) to the next other, over midnight if need be; equal times are a whole day."""
    minutes = lambda c: F.regexp_extract(c, r"^([0-9]{1,2}):[0-9]{2}", 1).try_cast("int") * 60 + F.regexp_extract(c, r"^[0-9]{1,2}:([0-9]{2})", 1).try_cast("int")
    gap = minutes(end) - minutes(start)
    total = F.when(gap <= 0, gap + 1440).otherwise(gap)
    h, m = F.floor(total / 60), total % 60
    return F.when(total.isNotNull(), F.concat(F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise("")))


def schedule(start_date: Column, end_date: Column, start_time: Column, end_time: Column, days: Column) -> Column:
    """A local schedule: weekly on its days, else daily, with the duration between its times."""
    some = F.coalesce(F.size(days) > 0, F.lit(False))
    return F.struct(F.when(some, "P1W").otherwise("P1D").alias("repeat_frequency"), start_date.alias("start_date"), end_date.alias("end_date"), start_time.alias("start_time"), end_time.alias("end_time"), duration_between(start_time, end_time).alias("duration"), F.when(some, days).alias("by_day"))


def wall_clock(text: Column, zone: str = "Europe/Berlin", pattern: str = "dd.MM.yyyy HH:mm") -> Column:
    """The instant of a local time, daylight saving included."""
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(pattern)), zone)


def maxspeed_kph(text: Column) -> Column:
    n = F.regexp_extract(F.trim(text), r"^([0-9]+(?:\.[0-9]+)?)\s*(?:km/h|mph)?$", 1)
    value = F.when(n != "", n.cast("double"))
    return F.when(F.trim(text).endswith("mph"), value * 1.609344).otherwise(value)


def instant(value: Column) -> Column:
    """Timestamps from epoch seconds, epoch milliseconds (1e11 and more) or ISO strings; else null."""
    number = F.when(value.rlike(r"^-?[0-9]+$"), value.cast("decimal(20,0)").cast("long"))
    return F.coalesce(F.when(F.abs(number) < 100_000_000_000, F.timestamp_seconds(number)), F.timestamp_millis(number), F.try_to_timestamp(value))


def time_bucket(ts: Column, seconds: int = 300) -> Column:
    return F.floor(F.unix_seconds(ts) / seconds)


def json_hash(*parts: Column) -> Column:
    """SHA-256 of the JSON array of strings."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def min_zoom(highway: Column) -> Column:
    return F.when(highway.isin("motorway", "trunk"), 5).when(highway == "primary", 8).when(highway == "secondary", 10).when(highway == "tertiary", 12).otherwise(13)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.radians(lon) * r, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * r
