"""DATEX II from landed XML: situations to events, measured and elaborated data to flows. JVM expressions over one element's text a row.

Large files are cut at an element's end tag while they are read, so a file
fills several tasks; an element whose XML can't be read gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import geometry
from wayloom.functions.scalars import iso_instant, level_of_service, schedule
from wayloom.operators.read import derived_severity, normalised_severity, source_type

ABSURD_KPH = 250
# A published status of traffic in the engine's levels of service, probabilities in its words of confidence.
STATUS_LOS = {"freeflow": "free_flow", "heavy": "heavy", "congested": "queuing", "slowtraffic": "queuing", "queuing": "queuing", "stationary": "stationary", "impossible": "blocked", "blocked": "blocked"}
PROBABILITY = {"certain": "observed", "probable": "likely", "riskof": "possible", "improbable": "unknown"}


def elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(value): the text of every element ``tag`` of the files, whatever its namespace's prefix was (``bare`` takes it off)."""
    text = spark.read.option("lineSep", f"{tag}>").text(path)
    return cut(text, tag)


def cut(chunks: DataFrame, tag: str) -> DataFrame:
    """Elements from chunks that end in ``</tag>`` or ``</prefix:tag`` (its last sign may be gone), prefixes taken off."""
    name = tag.split(":")[-1]
    text = bare(F.col("value"))
    whole = F.regexp_extract(text, rf"(?s)(<{name}[\s>].*)</(?:{name})?>?\s*$", 1)
    return chunks.select(F.concat(whole, F.lit(f"</{name}>")).alias("value")).where(F.length("value") > len(name) + 3)


def bare(xml: Column) -> Column:
    """XML without prefixes of elements and attributes."""
    plain = F.regexp_replace(xml, r"(</?)[A-Za-z_][\w.-]*:", "$1")
    return F.regexp_replace(plain, r"(\s)(?!xmlns)[A-Za-z_][\w.-]*:([A-Za-z_][\w.-]*\s*=)", "$1$2")


def records(parent: DataFrame, tag: str, keep: list[str]) -> DataFrame:
    """(…keep, value): one row per child element ``tag`` (not nested in itself) of each row's element."""
    parts = F.transform(F.filter(F.split("value", f"</{tag}>"), lambda x: x.rlike(rf"<{tag}[\s>]")), lambda x: F.concat(F.regexp_extract(x, rf"(?s)(<{tag}[\s>].*)$", 1), F.lit(f"</{tag}>")))
    return parent.select(*keep, F.posexplode(parts).alias("ord", "value"))


def leaf(*paths: str) -> Column:
    """The text at the first of the paths that has any."""
    return F.coalesce(*[F.nullif(F.trim(F.xpath_string("value", F.lit(p))), F.lit("")) for p in paths])


def number(*paths: str) -> Column:
    return leaf(*paths).try_cast("double")


def road_state(raw: Column) -> Column:
    """By what the management's name contains, the first that fits."""
    has = lambda s: F.contains(F.lower(raw), F.lit(s))
    return (
        F.when(has("contraflow") | has("alternat"), "single_lane_alternating").when(has("carriageway") & has("clos"), "closed").when(has("roadclos"), "closed")
        .when(has("lane") & has("clos"), "some_lanes_closed").when(has("clos"), "closed")
    )


def positions_of(lon_first: bool = False) -> Column:
    """Positions of a record: its first position list, else its points in order; those off the globe are left out."""
    numbers = F.transform(F.split(F.trim(leaf("(.//posList)[1]")), r"\s+"), lambda x: x.try_cast("double"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size(numbers) / 2).cast("int") - 1), lambda i: F.struct(numbers[i * 2 + (0 if lon_first else 1)].alias("lon"), numbers[i * 2 + (1 if lon_first else 0)].alias("lat")))
    line = F.when(F.size(numbers) >= 4, pairs)
    lats, lons = F.xpath("value", F.lit(".//*[latitude and longitude]/latitude/text()")), F.xpath("value", F.lit(".//*[latitude and longitude]/longitude/text()"))
    points = F.zip_with(lats, lons, lambda a, b: F.struct(b.try_cast("double").alias("lon"), a.try_cast("double").alias("lat")))
    return F.filter(F.coalesce(line, points), lambda p: geometry.plausible_wgs84(p.lon, p.lat))


def situations(elements: DataFrame, source: str, now: Column, lon_first: bool = False) -> DataFrame:
    """One event per record with a place of each situation (value).

    Severity: the situation's, else the record's; an unknown one is medium if the
    record is about safety, else derived from lanes and state. A record whose
    validity isn't stated is active. Ids are source:record, or a hash of the record
    where it has none. Records without a place give no row.
    """
    s = elements.withColumn("situation_severity", leaf("/situation/overallSeverity", "/situation/overallImpact"))
    r = records(s, "situationRecord", ["situation_severity"])
    closed, total = number(".//impact/numberOfLanesRestricted", "/*/numberOfLanesRestricted"), number("(.//originalNumberOfLanes)[1]")
    operational = number(".//impact/numberOfOperationalLanes", "/*/numberOfOperationalLanes")
    status = F.lower(leaf(".//validity/validityStatus", "(.//validityStatus)[1]"))
    probability = F.lower(leaf("/*/probabilityOfOccurrence"))
    confidence = F.coalesce(*[F.when(probability == k, v) for k, v in PROBABILITY.items()])
    kind = F.regexp_extract("value", r"^<situationRecord[^>]*\stype\s*=\s*[\"']([^\"']*)", 1)
    declared = lambda c: F.nullif(normalised_severity(c, "datex2"), F.lit("unknown"))
    safety = F.lower(F.coalesce(leaf("/*/safetyRelatedMessage", "(.//safetyRelatedMessage)[1]"), F.lit(""))).isin("true", "1")
    out = r.select(
        F.concat(F.lit(f"{source}:"), F.coalesce(leaf("/*/@id"), F.sha2("value", 256))).alias("id"), F.lit(source).alias("source"), source_type(kind).alias("t"),
        F.coalesce(declared(F.col("situation_severity")), declared(leaf("/*/severity"))).alias("declared"), safety.alias("safety"),
        road_state(leaf("/*/roadOrCarriagewayOrLaneManagementType")).alias("road_state"), closed.cast("int").alias("lanes_closed"), F.coalesce(total, closed + operational).cast("int").alias("lanes_total"),
        F.when(status.isin("suspended", "definedbyvaliditytimespec", "active") | status.isNull(), F.when(status == "suspended", "inactive").otherwise("active")).otherwise("active").alias("status"),
        iso_instant(leaf(".//overallStartTime", "(.//overallStartTime)[1]")).alias("valid_from"), iso_instant(leaf("(.//overallEndTime)[1]")).alias("valid_to"),
        F.coalesce(iso_instant(leaf("/*/situationRecordVersionTime", "/*/situationRecordCreationTime")), now).alias("updated_at"),
        leaf("(.//generalPublicComment//value)[1]", "(.//comment//value)[1]").alias("headline"), leaf(".//cause/causeType", "/*/accidentType", "/*/obstructionType", "/*/environmentalObstructionType", "/*/vehicleObstructionType").alias("subtype"),
        F.coalesce(leaf("(.//roadNumber)[1]"), leaf("(.//roadName)[1]")).alias("road"), number("/*/temporarySpeedLimit").alias("speed_limit"), confidence.alias("confidence"),
        F.when(F.xpath_boolean("value", F.lit(".//recurringTimePeriodOfDay")), schedule(leaf("(.//startOfPeriod)[1]"), leaf("(.//endOfPeriod)[1]"), leaf("(.//startTimeOfPeriod)[1]"), leaf("(.//endTimeOfPeriod)[1]"), F.lit(None).cast("array<string>"))).alias("schedule"),
        positions_of(lon_first).alias("points"),
    )
    derived = derived_severity(F.col("road_state"), F.col("lanes_closed"), F.col("lanes_total"))
    severity = F.coalesce("declared", F.when(F.col("safety"), "medium"), derived)
    return out.where("size(points) > 0").withColumns({"severity": severity, "type": F.col("t.type"), "category": F.col("t.category"), "planned": F.col("t.planned")}).drop("t", "declared", "safety").dropDuplicates(["id"])


def flow_los(status: Column, ratio: Column) -> Column:
    """A published status, else the level of the ratio."""
    known = F.coalesce(*[F.when(F.lower(status) == k, v) for k, v in STATUS_LOS.items()])
    return F.coalesce(known, level_of_service(ratio))


def measured(elements: DataFrame, sites: DataFrame, source: str) -> DataFrame:
    """One flow per site of siteMeasurements elements (value): the speed with the most input values, the first of equals; the first free flow.

    A sample counts without a data error, with 0 to 250 kph and at least one
    input value. sites: (site, points); a site that isn't known gives no row.
    """
    e = elements.withColumn("site", leaf("/*/measurementSiteReference/@id", "/*/measurementSiteReference")).withColumn("measured_at", iso_instant(leaf("/*/measurementTimeDefault")))
    r = records(e, "measuredValue", ["site", "measured_at"])
    speed = number("(.//averageVehicleSpeed/speed)[1]", "(.//averageVehicleSpeed)[1]")
    wrong = F.lower(F.coalesce(leaf("(.//averageVehicleSpeed/dataError)[1]", "(.//dataError)[1]"), F.lit("false"))).isin("true", "1")
    inputs = F.coalesce(number("(.//averageVehicleSpeed/@numberOfInputValuesUsed)[1]", "(.//numberOfInputValuesUsed)[1]"), F.lit(1.0))
    v = r.select("site", "measured_at", "ord", speed.alias("speed"), wrong.alias("wrong"), inputs.alias("inputs"), number("(.//freeFlowSpeed/speed)[1]", "(.//freeFlowSpeed)[1]").alias("free"))
    ok = F.coalesce(~F.col("wrong") & (F.col("speed") >= 0) & (F.col("speed") < ABSURD_KPH) & (F.col("inputs") > 0), F.lit(False))
    best = F.max(F.when(ok, F.struct("inputs", (-F.col("ord")).alias("o"), "speed"))).alias("x")
    g = v.where("site is not null").groupBy("site").agg(best, F.min(F.when(F.col("free").isNotNull(), F.struct("ord", "free"))).alias("f"), F.max("measured_at").alias("measured_at"))
    ratio = F.when(F.col("f.free") > 0, F.col("x.speed") / F.col("f.free"))
    return g.where("x is not null").join(sites, "site").select(F.concat(F.lit(f"{source}:"), "site").alias("id"), "site", F.col("x.speed").alias("speed_kph"), F.col("f.free").alias("free_flow_kph"), level_of_service(ratio).alias("los"), "measured_at", "points")


def elaborated(elements: DataFrame, sites: DataFrame, source: str) -> DataFrame:
    """One flow per site of elaboratedData elements (value): speeds, volumes and statuses of a site come in elements of their own."""
    kind = F.regexp_extract("value", r"<basicData[^>]*\stype\s*=\s*[\"'](?:[^\"':]*:)?([^\"']*)", 1)
    site = leaf("(.//predefinedLocationReference/@id)[1]", "(.//predefinedLocationReference)[1]", "(.//measurementSiteReference/@id)[1]")
    speed = F.when(kind == "TrafficSpeed", number("(.//averageVehicleSpeed/speed)[1]", "(.//averageVehicleSpeed)[1]"))
    v = elements.select(
        site.alias("site"), F.when((speed >= 0) & (speed < ABSURD_KPH), speed).alias("speed"), F.coalesce(number("(.//@numberOfInputValuesUsed)[1]"), F.lit(0.0)).alias("inputs"),
        F.when(kind == "TrafficFlow", number("(.//vehicleFlowRate)[1]", "(.//vehicleFlow)[1]")).alias("volume"), F.when(kind == "TrafficStatus", leaf("(.//trafficStatusValue)[1]", "(.//trafficStatus)[1]")).alias("status"),
        iso_instant(leaf("(.//measurementOrCalculationTime)[1]", "(.//timeValue)[1]")).alias("at"),
    )
    g = v.where("site is not null").groupBy("site").agg(F.max(F.when(F.col("speed").isNotNull(), F.struct("inputs", "speed"))).alias("x"), F.max("volume").alias("volume"), F.max("status").alias("status"), F.max("at").alias("measured_at"))
    j = g.where("x is not null or status is not null").join(sites, "site")
    return j.select(F.concat(F.lit(f"{source}:"), "site").alias("id"), "site", F.col("x.speed").alias("speed_kph"), "volume", flow_los(F.col("status"), F.lit(None).cast("double")).alias("los"), "measured_at", "points")


def predefined_locations(elements: DataFrame) -> DataFrame:
    """(site, points) of predefinedLocation elements (value): those with an id and a place."""
    return elements.select(leaf("/*/@id").alias("site"), positions_of().alias("points")).where("site is not null and size(points) > 0")
