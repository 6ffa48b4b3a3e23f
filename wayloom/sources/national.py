"""National flow feeds: landed documents (value) to flows (id, speed_kph, free_flow_kph, los, direction, points, measured_at).

Places that come apart from the feed are a table of sites (site, points). Rows
without a place or a usable value are skipped one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions import geometry
from wayloom.functions.scalars import level_of_service
from wayloom.sources.datex import ABSURD_KPH, bare, leaf, number, records
from wayloom.sources.formats import MPH, at, items, parser

# Names of direction sensors, words and codes of levels of service.
TMS_SENSORS = {"KESKINOPEUS_5MIN_LIUKUVA_SUUNTA1": "1", "KESKINOPEUS_5MIN_LIUKUVA_SUUNTA2": "2"}
BONN_WORDS = [(("frei", "normal"), "free_flow"), (("erhöht", "erhoeht", "dicht"), "heavy"), (("zäh", "zaeh"), "queuing"), (("stock",), "queuing"), (("stau", "gestaut"), "stationary")]
MADRID_LEVELS = {"0": "free_flow", "1": "heavy", "2": "queuing", "3": "stationary"}
BCN_STATUS = {"1": "free_flow", "2": "free_flow", "3": "heavy", "4": "queuing", "5": "stationary", "6": "blocked"}


def flow(source: str, local: Column, points: Column, measured: Column, speed: Column | None = None, free: Column | None = None, los: Column | None = None, direction: Column | None = None) -> list[Column]:
    none = F.lit(None)
    ratio = F.when(free > 0, speed / free) if free is not None and speed is not None else none.cast("double")
    return [
        F.concat(F.lit(f"{source}:"), local).alias("id"), (none if speed is None else speed).cast("double").alias("speed_kph"), (none if free is None else free).cast("double").alias("free_flow_kph"),
        (level_of_service(ratio) if los is None else los).alias("los"), (none if direction is None else direction).cast("string").alias("direction"), points.cast(geometry.POSITIONS).alias("points"), measured.cast("string").alias("measured_at"),
    ]


def value_of(words: dict[str, str], c: Column) -> Column:
    return F.coalesce(*[F.when(c == k, v) for k, v in words.items()])


def point(lon: Column, lat: Column) -> Column:
    return F.when(geometry.plausible_wgs84(lon, lat), F.array(F.struct(lon.alias("lon"), lat.alias("lat"))))


@parser("fintraffic")
def fintraffic(raw: DataFrame, sites: DataFrame, source: str) -> DataFrame:
    """One flow per direction sensor of a station."""
    st = items(raw, "$.stations").select(at("doc", "$.id").alias("site"), at("doc", "$.dataUpdatedTime").alias("updated"), F.explode(F.from_json(at("doc", "$.sensorValues"), "array<string>")).alias("doc"))
    s = st.withColumns({"dir": value_of(TMS_SENSORS, at("doc", "$.name")), "v": at("doc", "$.value").try_cast("double")}).where("dir is not null and v >= 0").join(sites, "site")
    return s.select(*flow(source, F.concat_ws("-", "site", "dir"), F.col("points"), F.coalesce(at("doc", "$.measuredTime"), "updated"), F.col("v"), direction=F.concat(F.lit("SUUNTA"), "dir")))


@parser("nycdot")
def nycdot(raw: DataFrame, source: str) -> DataFrame:
    """Links with points as text (lat,lon pairs), miles to kilometres."""
    pairs = F.transform(F.split(F.trim(at("doc", "$.link_points")), r"\s+"), lambda p: F.struct(F.try_element_at(F.split(p, ","), F.lit(2)).try_cast("double").alias("lon"), F.try_element_at(F.split(p, ","), F.lit(1)).try_cast("double").alias("lat")))
    s = items(raw, "$").withColumns({"points": F.filter(pairs, lambda p: p.lon.isNotNull() & p.lat.isNotNull()), "v": F.trim(at("doc", "$.speed")).try_cast("double"), "site": at("doc", "$.link_id")})
    return s.where("site is not null and v >= 0 and size(points) >= 2").select(*flow(source, F.col("site"), F.col("points"), at("doc", "$.data_as_of"), F.col("v") * MPH))


@parser("ohgo")
def ohgo(raw: DataFrame, source: str) -> DataFrame:
    """Points with their own normal speed as free flow, miles to kilometres."""
    n = lambda k: at("doc", f"$.{k}").try_cast("double")
    s = items(raw, "$.Results").withColumns({"points": point(n("Longitude"), n("Latitude")), "v": n("CurrentAvgSpeed") * MPH, "f": F.when(n("NormalAvgSpeed") > 0, n("NormalAvgSpeed") * MPH), "site": at("doc", "$.Id")})
    return s.where("site is not null and v is not null and points is not null").select(*flow(source, F.col("site"), F.col("points"), at("doc", "$.LastUpdated"), F.col("v"), F.col("f"), direction=F.nullif(at("doc", "$.Direction"), F.lit(""))))


@parser("trafikverket")
def trafikverket(raw: DataFrame, source: str) -> DataFrame:
    """Two levels of results; places as WKT points."""
    s = items(raw, "$.RESPONSE.RESULT").select(F.explode(F.from_json(at("doc", "$.TrafficFlow"), "array<string>")).alias("doc"))
    s = s.withColumns({"points": geometry.wkt_positions(F.regexp_extract(at("doc", "$.Geometry.WGS84"), r"(?i)POINT\s*\(([^)]*)\)", 1)), "v": at("doc", "$.AverageVehicleSpeed").try_cast("double"), "site": at("doc", "$.SiteId")})
    return s.where("site is not null and v >= 0 and size(points) = 1").select(*flow(source, F.col("site"), F.col("points"), at("doc", "$.MeasurementTime"), F.col("v")))


@parser("bonn")
def bonn(raw: DataFrame, source: str) -> DataFrame:
    """One flow per line of a stretch, with a speed or a level by words."""
    words = F.lower(F.trim(at("doc", "$.properties.verkehrsstatus")))
    los = F.lit("unknown")
    for some, level in reversed(BONN_WORDS):
        hit = F.lit(False)
        for w in some:
            hit = hit | F.coalesce(F.contains(words, F.lit(w)), F.lit(False))
        los = F.when(hit, level).otherwise(los)
    many = at("doc", "$.geometry.type") == "MultiLineString"
    lines = F.when(many, F.from_json(at("doc", "$.geometry.coordinates"), "array<string>")).when(at("doc", "$.geometry.type") == "LineString", F.array(at("doc", "$.geometry.coordinates")))
    ok = F.filter(F.transform(lines, lambda x: geometry.positions(x)), lambda p: F.size(p) >= 2)
    s = items(raw, "$.features").withColumns({"site": at("doc", "$.properties.strecke_id"), "v": at("doc", "$.properties.geschwindigkeit").try_cast("double"), "los": los, "lines": ok})
    s = s.withColumn("v", F.when(F.col("v") >= 0, F.col("v"))).where("site is not null and (los <> 'unknown' or v is not null)").select("*", F.posexplode("lines").alias("i", "points"))
    return s.select(*flow(source, F.when(F.size("lines") > 1, F.concat_ws(":", "site", F.col("i").cast("string"))).otherwise(F.col("site")), F.col("points"), at("doc", "$.properties.auswertezeit"), F.col("v"), los=F.col("los")))


@parser("madrid")
def madrid(elements: DataFrame, source: str) -> DataFrame:
    """Measuring points (pm elements) with a level of service alone; UTM zone 30 with decimal commas."""
    own = elements.withColumn("value", bare(F.col("value")))
    n = lambda p: F.replace(F.replace(leaf(p), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    lon, lat = utm(n("/pm/st_x"), n("/pm/st_y"), 30)
    s = own.select(leaf("/pm/idelem").alias("site"), F.coalesce(leaf("/pm/error"), F.lit("")).alias("error"), value_of(MADRID_LEVELS, leaf("/pm/nivelServicio")).alias("los"), point(lon, lat).alias("points"))
    return s.where("error <> 'S' and site is not null and los is not null and points is not null").select(*flow(source, F.col("site"), F.col("points"), F.lit(None), los=F.col("los")))


def utm(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude of northern UTM coordinates on GRS80, by the inverse series to the sixth order of the flattening's small parameter."""
    a, f, k0 = 6378137.0, 1 / 298.257222101, 0.9996
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    xi, eta = y / (k0 * big), (x - 500_000.0) / (k0 * big)
    p, q = xi, eta
    for j, b in enumerate(beta, 1):
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(p) / F.cosh(q))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return (zone * 6 - 183) + F.degrees(F.atan2(F.sinh(q), F.cos(p))), F.degrees(lat)


@parser("lta_speedbands")
def lta_speedbands(raw: DataFrame, source: str) -> DataFrame:
    """Two-point links; the middle of the band, or the end it has."""
    n = lambda k: F.nullif(at("doc", f"$.{k}"), F.lit("")).try_cast("double")
    lo, hi = n("MinimumSpeed"), n("MaximumSpeed")
    ends = F.array(F.struct(n("StartLon").alias("lon"), n("StartLat").alias("lat")), F.struct(n("EndLon").alias("lon"), n("EndLat").alias("lat")))
    s = items(raw, "$.value").withColumns({"v": F.coalesce((lo + hi) / 2, hi, lo), "points": ends, "site": at("doc", "$.LinkID")})
    return s.where("site is not null and v is not null and forall(points, p -> p.lon is not null and p.lat is not null)").select(*flow(source, F.col("site"), F.col("points"), F.lit(None), F.col("v")))


@parser("miv")
def miv(elements: DataFrame, sites: DataFrame, source: str) -> DataFrame:
    """Measuring points (meetpunt elements): the harmonic speed of the vehicle class with the highest intensity, the first of equals; defect ones are skipped."""
    own = elements.withColumn("value", bare(F.col("value")))
    own = own.select("value", leaf("/meetpunt/@unieke_id").alias("site"), leaf("/meetpunt/tijd_waarneming").alias("at"), F.coalesce(leaf("/meetpunt/defect"), F.lit("")).alias("defect")).where("defect <> '1'")
    n = lambda p: F.replace(leaf(p), F.lit(","), F.lit(".")).try_cast("double")
    c = records(own, "meetdata", ["site", "at"]).select("site", "at", "ord", n("/meetdata/verkeersintensiteit").alias("i"), n("/meetdata/voertuigsnelheid_harmonisch").alias("v"))
    best = F.max(F.struct("i", (-F.col("ord")).alias("o"), "v")).alias("x")
    g = c.where(f"i > 0 and v >= 0 and v < {ABSURD_KPH}").groupBy("site", "at").agg(best).join(sites, "site")
    return g.select(*flow(source, F.col("site"), F.col("points"), F.col("at"), F.col("x.v")))


@parser("turin")
def turin(elements: DataFrame, source: str, generated: Column | None = None) -> DataFrame:
    """Detectors (FDT_data elements) with a confident measurement."""
    own = elements.withColumn("value", bare(F.col("value")))
    s = own.select(leaf("/FDT_data/@lcd1").alias("site"), number("/FDT_data/@accuracy").alias("sure"), point(number("/FDT_data/@lng"), number("/FDT_data/@lat")).alias("points"), number("/FDT_data/speedflow/@speed").alias("v"), leaf("/FDT_data/@direction").alias("d"))
    s = s.where(f"site is not null and sure > 0 and points is not null and v >= 0 and v < {ABSURD_KPH}")
    return s.select(*flow(source, F.col("site"), F.col("points"), F.lit(None) if generated is None else generated, F.col("v"), direction=F.col("d")))


@parser("barcelona")
def barcelona(lines: DataFrame, sites: DataFrame, source: str) -> DataFrame:
    """Lines of site#time#status (value); code 0 and unknown codes are skipped."""
    p = F.split("value", "#")
    s = lines.where(F.size(p) >= 3).select(F.trim(p[0]).alias("site"), F.to_timestamp(F.trim(p[1]), "yyyyMMddHHmmss").alias("at"), value_of(BCN_STATUS, F.trim(p[2])).alias("los")).where("los is not null").join(sites, "site")
    return s.select(*flow(source, F.col("site"), F.col("points"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), los=F.col("los")))


@parser("exploded_lines")
def exploded_lines(raw: DataFrame, source: str, fields: dict[str, str]) -> DataFrame:
    """GeoJSON lines, those of many lines cut into one flow each; fields: paths of id and speed."""
    lines = F.when(at("doc", "$.geometry.type") == "MultiLineString", F.from_json(at("doc", "$.geometry.coordinates"), "array<string>")).otherwise(F.array(at("doc", "$.geometry.coordinates")))
    s = items(raw, "$.features").select(at("doc", f"$.{fields['id']}").alias("site"), at("doc", f"$.{fields['speed']}").try_cast("double").alias("v"), F.size(lines).alias("n"), F.posexplode(lines).alias("i", "line"))
    s = s.withColumn("points", geometry.positions(F.col("line"))).where("site is not null and v >= 0 and size(points) >= 2")
    return s.select(*flow(source, F.when(F.col("n") > 1, F.concat_ws(":", "site", F.col("i").cast("string"))).otherwise(F.col("site")), F.col("points"), F.lit(None), F.col("v")))


def congestion(flows: DataFrame) -> DataFrame:
    """The event of each flow that queues or worse: (id, type, severity, headline)."""
    hit = flows.where(F.col("los").isin("queuing", "stationary", "blocked"))
    return hit.select(F.concat("id", F.lit(":congestion")).alias("id"), F.lit("congestion").alias("type"), F.when(F.col("los") == "queuing", "high").otherwise("critical").alias("severity"), F.concat(F.lit("Traffic congestion ("), F.regexp_replace("id", "^[^:]*:", ""), F.lit(")")).alias("headline"), "points")
