"""National event feeds: landed documents (value) to events (id, type, category, planned, severity, road_state, direction, road, headline, valid_from, valid_to, points).

Records without a usable place are skipped one by one; times stay as the feed writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions import geometry
from wayloom.operators.read import source_type
from wayloom.sources.datex import bare, leaf, number
from wayloom.sources.formats import at, items, parser
from wayloom.sources.national import point, value_of

# The feeds' words for types and states of roads, and the categories of types.
LTA_TYPES = {"accident": "accident", "roadwork": "roadworks", "vehicle breakdown": "broken_down_vehicle", "unattended vehicle": "broken_down_vehicle", "heavy traffic": "congestion", "obstacle": "obstruction", "road block": "road_closure", "diversion": "detour", "flooding": "weather", "weather": "weather", "plant/animal hazards": "hazard"}
TRV_TYPES = {"olycka": "accident", "vägarbete": "roadworks", "hinder": "obstruction", "avstängning": "road_closure", "avstängd väg": "road_closure", "vägförhållande": "road_condition", "restriktion": "speed_restriction"}
OHGO_TYPES = {"crash": "accident", "accident": "accident", "vehicle crash": "accident", "disabled vehicle": "hazard", "vehicle fire": "hazard", "debris": "hazard", "road debris": "hazard", "hazard": "hazard", "flooding": "weather", "weather": "weather", "police activity": "authority", "closure": "road_closure", "road closure": "road_closure"}
OHGO_STATES = {"open": "open", "closed": "closed", "all lanes closed": "closed", "lanes closed": "some_lanes_closed", "some lanes closed": "some_lanes_closed", "alternating traffic": "single_lane_alternating"}
VIC_TYPES = {"roadworks": "roadworks", "road works": "roadworks", "maintenance": "roadworks", "construction": "roadworks", "special event": "public_event", "event": "public_event", "crash": "accident", "accident": "accident", "collision": "accident", "incident": "accident", "hazard": "hazard", "fallen tree": "hazard", "traffic hazard": "hazard", "flooding": "weather", "weather": "weather", "fire": "hazard", "closure": "road_closure", "road closure": "road_closure", "congestion": "congestion"}
IBI_TYPES = {"roadwork": "roadworks", "closures": "road_closure", "accidentsandincidents": "accident"}
IBI_SEVERITIES = {"minor": "low", "low": "low", "moderate": "medium", "medium": "medium", "major": "high", "high": "high", "severe": "critical", "critical": "critical"}
DT_STATES = [(["ROAD_CLOSED", "INTERMITTENT_SHORT_TERM_CLOSURE", "SINGLE_CARRIAGEWAY_CLOSED"], "closed"), (["SINGLE_LANE_CLOSED", "MULTIPLE_LANES_CLOSED", "NARROW_LANES"], "some_lanes_closed"), (["SINGLE_ALTERNATE_LINE_TRAFFIC", "TRAFFIC_LIGHTS"], "single_lane_alternating")]
INCIDENTS = ["accident", "road_closure", "broken_down_vehicle", "obstruction"]


def event(source: str, local: Column, kind: Column, points: Column, category: Column | None = None, planned: Column | None = None, **more: Column) -> list[Column]:
    named = {k: more.get(k, F.lit(None)).cast("string").alias(k) for k in ("road_state", "direction", "road", "headline", "valid_from", "valid_to")}
    return [
        F.concat(F.lit(f"{source}:"), local).alias("id"), kind.alias("type"), (category_of(kind) if category is None else category).alias("category"), ((kind == "roadworks") if planned is None else planned).alias("planned"),
        more.get("severity", F.lit("unknown")).alias("severity"), *named.values(), points.cast(geometry.POSITIONS).alias("points"),
    ]


def category_of(kind: Column) -> Column:
    return F.when(kind == "roadworks", "planned").when(kind.isin(INCIDENTS), "incident").otherwise("conditions")


def short_hash(c: Column) -> Column:
    """The djb2 hash of a text's characters modulo 2 to the 32, in base 36: the feeds' local ids."""
    chars = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.lower(F.conv(F.aggregate(chars, F.lit(5381).cast("long"), lambda h, x: (h * 33 + x) % (1 << 32)).cast("string"), 10, 36))


def text_or(*some: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in some])


@parser("gddkia")
def gddkia(elements: DataFrame, source: str) -> DataFrame:
    """Obstructions (utr elements): closed roads, broken bridges, then accidents and works by their letter."""
    own = elements.withColumn("value", bare(F.col("value")))
    flag = lambda p: F.coalesce(leaf(p), F.lit("")).isin("true", "1", "T")
    kind = F.when(flag("/utr/droga_zamknieta"), "road_closure").when(flag("/utr/awaria_mostu"), "hazard").when(leaf("/utr/typ") == "W", "accident").when(leaf("/utr/typ") == "U", "roadworks").otherwise("other")
    lat, lon = leaf("/utr/geo_lat"), leaf("/utr/geo_long")
    local = short_hash(F.concat_ws("|", F.coalesce(leaf("/utr/nr_drogi"), F.lit("")), F.coalesce(leaf("/utr/km"), F.lit("")), lat, lon))
    got = own.select("value", kind.alias("kind"), local.alias("local"), point(lon.try_cast("double"), lat.try_cast("double")).alias("p")).where("p is not null")
    return got.select(*event(source, F.col("local"), F.col("kind"), F.col("p"), direction=leaf("/utr/kierunek"), road=leaf("/utr/nr_drogi"), headline=F.coalesce(leaf("/utr/objazd", "/utr/nazwa_odcinka", "/utr/nr_drogi"), F.lit("Utrudnienie")), valid_from=leaf("/utr/data_powstania"), valid_to=leaf("/utr/data_likwidacji"))).dropDuplicates(["id"])


@parser("lta")
def lta(raw: DataFrame, source: str) -> DataFrame:
    kind = F.coalesce(value_of(LTA_TYPES, F.lower(F.trim(at("doc", "$.Type")))), F.lit("other"))
    text = lambda k: F.coalesce(at("doc", f"$.{k}"), F.lit(""))
    s = items(raw, "$.value").withColumns({"kind": kind, "p": point(at("doc", "$.Longitude").try_cast("double"), at("doc", "$.Latitude").try_cast("double")), "local": short_hash(F.concat_ws("|", text("Type"), text("Latitude"), text("Longitude"), text("Message")))})
    return s.where("p is not null").select(*event(source, F.col("local"), F.col("kind"), F.col("p"), headline=F.coalesce(text_or(at("doc", "$.Message"), F.trim(at("doc", "$.Type"))), F.lit("Traffic incident")))).dropDuplicates(["id"])


@parser("ohgo_events")
def ohgo_events(raw: DataFrame, source: str) -> DataFrame:
    """Incidents and work zones (those with a start date); names of fields in either case."""
    either = lambda k: F.coalesce(at("doc", f"$.{k}"), at("doc", f"$.{k[0].upper()}{k[1:]}"))
    s = items(raw.select(F.coalesce(F.when(F.get_json_object("value", "$.Results").isNotNull(), F.col("value")), F.regexp_replace("value", r'^\s*\{\s*"results"', '{"Results"')).alias("value")), "$.Results")
    work = either("startDate").isNotNull()
    kind = F.when(work, "roadworks").otherwise(F.coalesce(value_of(OHGO_TYPES, F.lower(either("category"))), F.lit("other")))
    s = s.withColumns({"kind": kind, "work": work, "p": point(either("longitude").try_cast("double"), either("latitude").try_cast("double")), "local": text_or(either("id"))}).where("p is not null and local is not null")
    state = value_of(OHGO_STATES, F.lower(either("roadStatus")))
    return s.select(*event(source, F.col("local"), F.col("kind"), F.col("p"), F.when(F.col("work"), "planned").otherwise("incident"), F.col("work"), road_state=state, direction=text_or(either("direction")), road=text_or(either("routeName")), headline=F.coalesce(text_or(either("location"), either("description"), either("routeName")), F.lit("OHGO event")), valid_from=either("startDate"), valid_to=either("endDate"))).dropDuplicates(["id"])


@parser("trafikverket_events")
def trafikverket_events(raw: DataFrame, source: str) -> DataFrame:
    """Results, situations, deviations; a point before a line, both as WKT; severity by code."""
    many = lambda c: F.explode(F.from_json(c, "array<string>"))
    s = items(raw, "$.RESPONSE.RESULT").select(many(at("doc", "$.Situation")).alias("doc")).select(many(at("doc", "$.Deviation")).alias("doc"))
    kind = F.coalesce(value_of(TRV_TYPES, F.lower(F.trim(at("doc", "$.MessageType")))), F.lit("other"))
    inside = lambda p, w: geometry.wkt_positions(F.regexp_extract(at("doc", p), rf"(?i){w}\s*\(([^)]*)\)", 1))
    pt, ln = inside("$.Geometry.Point.WGS84", "POINT"), inside("$.Geometry.Line.WGS84", "LINESTRING")
    s = s.withColumns({"kind": kind, "p": F.when(F.size(pt) == 1, pt).when(F.size(ln) >= 2, ln), "code": at("doc", "$.SeverityCode").try_cast("int")}).where("p is not null")
    severity = F.when(F.col("code") == 5, "critical").when(F.col("code") == 4, "high").when(F.col("code") == 3, "medium").when(F.col("code").isin(1, 2), "low").otherwise("unknown")
    return s.select(*event(source, F.coalesce(at("doc", "$.Id"), F.sha2("doc", 256)), F.col("kind"), F.col("p"), severity=severity, road=text_or(at("doc", "$.RoadName")), headline=F.coalesce(text_or(at("doc", "$.Message"), F.trim(at("doc", "$.MessageType"))), F.col("kind")), valid_from=at("doc", "$.StartTime"), valid_to=at("doc", "$.EndTime"))).dropDuplicates(["id"])


@parser("ibi511")
def ibi511(raw: DataFrame, source: str) -> DataFrame:
    """Events with an encoded polyline, else one or two positions; a full closure overrides the type."""
    n = lambda k: at("doc", f"$.{k}").try_cast("double")
    coded = geometry.decoded_polyline(F.coalesce(at("doc", "$.EncodedPolyline"), F.lit("")))
    a, b = F.struct(n("Longitude").alias("lon"), n("Latitude").alias("lat")), F.struct(n("LongitudeSecondary").alias("lon"), n("LatitudeSecondary").alias("lat"))
    pair = F.when(a.lon.isNotNull() & a.lat.isNotNull(), F.when(b.lon.isNotNull() & b.lat.isNotNull() & (a != b), F.array(a, b)).otherwise(F.array(a)))
    full = F.coalesce(at("doc", "$.IsFullClosure") == "true", F.lit(False))
    kind = F.when(full, "road_closure").otherwise(F.coalesce(value_of(IBI_TYPES, F.regexp_replace(F.lower(at("doc", "$.EventType")), "[^a-z]", "")), F.lit("other")))
    s = items(raw, "$").withColumns({"kind": kind, "p": F.when(F.size(coded) > 0, coded).otherwise(pair)}).where("p is not null")
    severity = F.coalesce(value_of(IBI_SEVERITIES, F.lower(at("doc", "$.Severity"))), F.lit("unknown"))
    road = text_or(at("doc", "$.RoadwayName"))
    return s.select(*event(source, F.coalesce(at("doc", "$.ID"), F.sha2("doc", 256)), F.col("kind"), F.col("p"), severity=severity, direction=text_or(at("doc", "$.DirectionOfTravel")), road=road, headline=F.coalesce(text_or(at("doc", "$.Description")), road, F.col("kind")), valid_from=at("doc", "$.StartDate"), valid_to=at("doc", "$.PlannedEndDate"))).dropDuplicates(["id"])


@parser("vic")
def vic_disruptions(raw: DataFrame, source: str) -> DataFrame:
    """Planned disruptions (of ``disruptions``) and unplanned ones (of ``features``); the first name that is known gives the type."""

    def named(*some: Column) -> Column:
        return F.coalesce(*[value_of(VIC_TYPES, F.lower(c)) for c in some], F.lit("other"))

    d = lambda k: at("doc", f"$.{k}")
    p = items(raw, "$.disruptions").withColumns({"kind": named(d("eventSubtype"), d("eventType"), d("impact.impactType")), "local": text_or(d("id"), d("disruptionId"), d("eventId")), "p": geometry.positions(F.coalesce(d("geometry"), F.lit("")))})
    planned = p.where("local is not null and size(p) > 0").select(*event(source, F.col("local"), F.col("kind"), F.col("p"), F.lit("planned"), F.lit(True), direction=d("impact.direction"), road=text_or(d("roadName"), d("road")), headline=F.coalesce(text_or(d("name"), d("title"), d("description"), d("roadName")), F.lit("Planned disruption")), valid_from=d("duration.start"), valid_to=d("duration.end")))
    q = lambda k: at("doc", f"$.properties.{k}")
    u = items(raw, "$.features").withColumns({"kind": named(F.coalesce(q("eventSubType"), q("eventSubtype")), q("eventType"), q("status")), "local": text_or(q("id"), at("doc", "$.id"), q("eventId")), "p": geometry.positions(F.coalesce(at("doc", "$.geometry"), F.lit("")))})
    unplanned = u.where("local is not null and size(p) > 0").select(*event(source, F.col("local"), F.col("kind"), F.col("p"), F.lit("incident"), F.lit(False), direction=q("direction"), road=text_or(q("roadName"), q("road")), headline=F.coalesce(text_or(q("name"), q("title"), q("description"), q("roadName")), F.lit("Road disruption")), valid_from=q("created"), valid_to=q("endTime")))
    return planned.unionByName(unplanned).dropDuplicates(["id"])


@parser("digitraffic")
def digitraffic(raw: DataFrame, source: str) -> DataFrame:
    """Messages of one announcement: the state and severity are the worst of its phases', the speed limit the lowest."""
    a = lambda k: at("doc", f"$.properties.announcements[0].{k}")
    phases = F.coalesce(F.from_json(a("roadWorkPhases"), "array<struct<severity:string,restrictions:array<struct<type:string,restriction:struct<quantity:double>>>>>"), F.array().cast("array<struct<severity:string,restrictions:array<struct<type:string,restriction:struct<quantity:double>>>>>"))
    bounds = F.flatten(F.transform(phases, lambda x: F.coalesce(x.restrictions, F.array().cast("array<struct<type:string,restriction:struct<quantity:double>>>"))))
    kinds = F.transform(bounds, lambda r: r.type)
    state = F.lit(None).cast("string")
    for words, name in reversed(DT_STATES):
        state = F.when(F.arrays_overlap(F.filter(kinds, lambda k: k.isNotNull()), F.array(*[F.lit(w) for w in words])), name).otherwise(state)
    limit = F.array_min(F.transform(F.filter(bounds, lambda r: r.type == "SPEED_LIMIT"), lambda r: r.restriction.quantity))
    has = lambda v: F.exists(phases, lambda x: F.upper(x.severity) == v)
    severity = F.when(has("HIGHEST"), "critical").when(has("HIGH"), "high").when(has("LOW"), "low").otherwise("unknown")
    code = F.coalesce(at("doc", "$.properties.trafficAnnouncementType"), at("doc", "$.properties.situationType"), F.lit(""))
    s = items(raw, "$.features").withColumns({"t": source_type(code), "p": geometry.positions(F.coalesce(at("doc", "$.geometry"), F.lit("")))}).where("size(p) > 0")
    place = "locationDetails.roadAddressLocation"
    direction = F.coalesce(text_or(a(f"{place}.directionDescription")), F.nullif(F.upper(a(f"{place}.direction")), F.lit("UNKNOWN")))
    road = text_or(a(f"{place}.primaryPoint.roadAddress.road"), a(f"{place}.primaryPoint.roadName"))
    own = event(source, F.coalesce(at("doc", "$.properties.situationId"), F.sha2("doc", 256)), F.col("t.type"), F.col("p"), F.col("t.category"), F.col("t.planned"), severity=severity, road_state=state, direction=direction, road=road, headline=F.coalesce(text_or(a("title")), F.col("t.type")), valid_from=a("timeAndDuration.startTime"), valid_to=a("timeAndDuration.endTime"))
    return s.select(*own, limit.alias("speed_limit")).dropDuplicates(["id"])


def measurement_sites(elements: DataFrame) -> DataFrame:
    """(site, points) of DATEX II measurement site records (value)."""
    lat, lon = number("(.//latitude)[1]"), number("(.//longitude)[1]")
    return elements.select(leaf("/*/@id").alias("site"), point(lon, lat).alias("points")).where("site is not null and points is not null")


def registry_geojson(raw: DataFrame, id_path: str = "$.id") -> DataFrame:
    """(site, points) of a station registry as GeoJSON."""
    s = items(raw, "$.features").select(at("doc", id_path).alias("site"), geometry.positions(at("doc", "$.geometry")).alias("points"))
    return s.where("site is not null and size(points) > 0")


def registry_csv(rows: DataFrame, site: str, lon: str, lat: str) -> DataFrame:
    """(site, points) of a registry read as a table of text; decimal commas are allowed."""
    n = lambda c: F.replace(F.trim(F.col(c)), F.lit(","), F.lit(".")).try_cast("double")
    return rows.select(F.trim(F.col(site)).alias("site"), point(n(lon), n(lat)).alias("points")).where("site <> '' and points is not null")


def registry_miv(elements: DataFrame) -> DataFrame:
    """(site, points) of measuring points (meetpunt elements) of the Flemish configuration."""
    own = elements.withColumn("value", bare(F.col("value")))
    n = lambda p: F.replace(leaf(p), F.lit(","), F.lit(".")).try_cast("double")
    s = own.select(leaf("/meetpunt/@unieke_id").alias("site"), point(n("/meetpunt/lengtegraad_EPSG_4326"), n("/meetpunt/breedtegraad_EPSG_4326")).alias("points"))
    return s.where("site is not null and points is not null")
