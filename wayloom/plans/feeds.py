"""Queries on feed formats: documents made from the driver's tables as text, parsed; the SQL makes the same rows without the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions import geometry, scalars
from wayloom.operators import read
from wayloom.plans.adapters import Tables
from wayloom.plans.registry import query
from wayloom.sources import datex, national


def key():
    return F.col("s_suppkey")


def text(c):
    return c.cast("string")


def first_point(flows: DataFrame) -> DataFrame:
    return flows.withColumns({"lon": F.round(F.col("points")[0].lon, 6), "lat": F.round(F.col("points")[0].lat, 6), "vertices": F.size("points")}).drop("points")


def one_doc(rows: DataFrame, element, head: str, tail: str) -> DataFrame:
    """Documents of many elements each, as feeds come."""
    S = key()  # noqa: N806
    return rows.groupBy((S % 8).alias("doc")).agg(F.concat(F.lit(head), F.array_join(F.collect_list(element), ","), F.lit(tail)).alias("value")).select("value")


def sites(t: Tables) -> DataFrame:
    S = key()  # noqa: N806
    return t.read("supplier").where("s_suppkey % 9 <> 0").select(text(S).alias("site"), F.array(F.struct((4 + S % 90 * 0.01).alias("lon"), (50 + S % 70 * 0.01).alias("lat"))).alias("points"))


SITE = "round(4 + s_suppkey % 90 * 0.01::DOUBLE, 6) AS lon, round(50 + s_suppkey % 70 * 0.01::DOUBLE, 6) AS lat, 1 AS vertices"


# --- DATEX II ----------------------------------------------------------------

STATES = ["carriagewayClosures", "laneClosures", "contraflow", "roadClosed", "newRoadworksLayout"]


@query("""SELECT 'nl:r' || s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'accident' WHEN 1 THEN 'roadworks' WHEN 2 THEN 'lane_closure' ELSE 'other' END AS type, s_suppkey % 4 = 1 AS planned,
  CASE WHEN s_suppkey % 7 = 0 THEN 'critical' WHEN s_suppkey % 7 = 1 THEN 'low' WHEN s_suppkey % 11 = 0 THEN 'medium' WHEN s_suppkey % 5 IN (0, 3) THEN 'high' WHEN s_suppkey % 3 >= 2 THEN 'high' WHEN s_suppkey % 3 = 1 THEN 'medium' WHEN s_suppkey % 5 IN (1, 2) THEN 'medium' ELSE 'unknown' END AS severity,
  CASE s_suppkey % 5 WHEN 0 THEN 'closed' WHEN 1 THEN 'some_lanes_closed' WHEN 2 THEN 'single_lane_alternating' WHEN 3 THEN 'closed' END AS road_state, 1704067200 + s_suppkey * 60 AS from_s, round(4 + s_suppkey % 90 * 0.01::DOUBLE, 6) AS lon, round(50 + s_suppkey % 70 * 0.01::DOUBLE, 6) AS lat,
  CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS vertices, CASE WHEN s_suppkey % 6 = 0 THEN 'PT8H30M' END AS duration FROM supplier WHERE s_suppkey % 13 <> 0""")
def datex_situations(t: Tables) -> DataFrame:
    S = key()  # noqa: N806
    x, y = text(F.round(4 + S % 90 * 0.01, 6)), text(F.round(50 + S % 70 * 0.01, 6))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Accident", "MaintenanceWorks", "RoadOrCarriagewayOrLaneManagement", "SomethingElse")]), (S % 4 + 1).cast("int"))
    state = F.element_at(F.array(*[F.lit(k) for k in STATES]), (S % 5 + 1).cast("int"))
    severity = F.when(S % 7 == 0, "highest").when(S % 7 == 1, "lowest").otherwise("unknown")
    place = F.when(S % 13 == 0, F.lit("<d2:locationReference/>")).when(S % 2 == 0, F.format_string("<d2:locationReference><loc:posList>%s %s %s 5.1</loc:posList></d2:locationReference>", y, x, y))
    place = place.otherwise(F.format_string("<d2:locationReference><d2:pointCoordinates><d2:latitude>%s</d2:latitude><d2:longitude>%s</d2:longitude></d2:pointCoordinates></d2:locationReference>", y, x))
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + S * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    daily = F.when(S % 6 == 0, F.lit("<d2:validPeriod><d2:recurringTimePeriodOfDay><d2:startTimeOfPeriod>22:00:00</d2:startTimeOfPeriod><d2:endTimeOfPeriod>06:30:00</d2:endTimeOfPeriod></d2:recurringTimePeriodOfDay></d2:validPeriod>")).otherwise("")
    lanes = F.when(S % 3 > 0, F.format_string("<d2:impact><d2:numberOfLanesRestricted>%d</d2:numberOfLanesRestricted><d2:numberOfOperationalLanes>%d</d2:numberOfOperationalLanes></d2:impact>", S % 3, F.when(S % 3 == 1, 2).otherwise(0))).otherwise("")
    record = F.concat(
        F.format_string('<d2:situationRecord xsi:type="d2:%s" id="r%d">', kind, S), F.when(S % 11 == 0, F.lit("<d2:safetyRelatedMessage>true</d2:safetyRelatedMessage>")).otherwise(""),
        F.format_string("<d2:validity><d2:validityStatus>active</d2:validityStatus><d2:validityTimeSpecification><d2:overallStartTime>%s</d2:overallStartTime>%s</d2:validityTimeSpecification></d2:validity>", when, daily),
        lanes, F.format_string("<d2:roadOrCarriagewayOrLaneManagementType>%s</d2:roadOrCarriagewayOrLaneManagementType>", state), place, F.lit("</d2:situationRecord>"),
    )
    chunk = F.concat(F.lit('<?xml version="1.0"?><d2:payload xmlns:d2="u" xmlns:xsi="v">'), F.format_string('<d2:situation id="s%d"><d2:overallSeverity>%s</d2:overallSeverity>', S, severity), record, F.lit("</d2:"))
    raw = t.read("supplier").select(F.concat(chunk, F.lit("situation")).alias("value"))
    e = datex.situations(datex.cut(raw, "situation"), "nl", F.lit("2024-01-01").cast("timestamp"))
    return first_point(e).select("id", "type", "planned", "severity", "road_state", F.unix_seconds("valid_from").alias("from_s"), "lon", "lat", "vertices", F.col("schedule.duration").alias("duration"))


@query(f"""SELECT 'nl:' || s_suppkey AS id, (60 + s_suppkey % 50)::DOUBLE AS speed_kph, CASE WHEN s_suppkey % 2 = 0 THEN 100.0::DOUBLE END AS free_flow_kph,
  CASE WHEN s_suppkey % 2 > 0 THEN 'unknown' WHEN (60 + s_suppkey % 50) >= 85 THEN 'free_flow' ELSE 'heavy' END AS los, {SITE} FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 10 <> 0""")
def datex_measured(t: Tables) -> DataFrame:
    """The second of three values has the most inputs; a faulty one has more, a later one as many."""
    S = key()  # noqa: N806
    v = lambda speed, n, wrong: F.format_string('<m:measuredValue index="%d"><m:basicData xsi:type="TrafficSpeed"><m:averageVehicleSpeed numberOfInputValuesUsed="%d"><m:dataError>%s</m:dataError><m:speed>%s</m:speed></m:averageVehicleSpeed></m:basicData></m:measuredValue>', n, n, F.lit(wrong), text(speed))
    free = F.when(S % 2 == 0, F.lit("<m:measuredValue><m:basicData><m:freeFlowSpeed><m:speed>100</m:speed></m:freeFlowSpeed></m:basicData></m:measuredValue>")).otherwise("")
    fine = F.when(S % 10 == 0, F.lit(-1)).otherwise(60 + S % 50)
    values = F.concat(v(F.lit(20), F.lit(3), "true"), v(F.when(S % 10 == 0, 300).otherwise(12), F.lit(1), "false"), v(fine, F.lit(2), "false"), v(F.when(S % 10 == 0, 999).otherwise(13), F.lit(2), "false"), free)
    raw = t.read("supplier").select(F.concat(F.lit("<x/><m:siteMeasurements>"), F.format_string('<m:measurementSiteReference id="%d"/><m:measurementTimeDefault>2024-01-01T00:00:00Z</m:measurementTimeDefault>', S), values, F.lit("</m:siteMeasurements>")).alias("value"))
    return first_point(datex.measured(datex.cut(raw, "siteMeasurements"), sites(t), "nl")).select("id", "speed_kph", "free_flow_kph", "los", "lon", "lat", "vertices")


@query(f"""SELECT 'de:' || s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 THEN (50 + s_suppkey % 40)::DOUBLE END AS speed_kph, (s_suppkey % 1000)::DOUBLE AS volume, CASE WHEN s_suppkey % 3 < 2 THEN 'queuing' ELSE 'unknown' END AS los, {SITE} FROM supplier WHERE s_suppkey % 9 <> 0""")
def datex_elaborated(t: Tables) -> DataFrame:
    S = key()  # noqa: N806
    e = lambda kind, inner: F.concat(F.lit(f'<e:elaboratedData><e:basicData xsi:type="e:{kind}"><e:pertinentLocation><e:predefinedLocationReference id="'), text(S), F.lit('"/></e:pertinentLocation>'), inner, F.lit("</e:basicData></e:elaboratedData>"))
    speed = lambda v, n: F.format_string('<e:averageVehicleSpeed numberOfInputValuesUsed="%d"><e:speed>%s</e:speed></e:averageVehicleSpeed>', F.lit(n), text(v))
    all_ = F.array(
        F.when(S % 3 > 0, e("TrafficSpeed", speed(F.lit(11), 1))), F.when(S % 3 > 0, e("TrafficSpeed", speed(50 + S % 40, 5))), e("TrafficSpeed", speed(F.lit(400), 9)),
        e("TrafficFlow", F.format_string("<e:vehicleFlow><e:vehicleFlowRate>%d</e:vehicleFlowRate></e:vehicleFlow>", S % 1000)), F.when(S % 3 < 2, e("TrafficStatus", F.lit("<e:trafficStatus><e:trafficStatusValue>congested</e:trafficStatusValue></e:trafficStatus>"))),
    )
    raw = t.read("supplier").select(F.explode(F.array_compact(all_)).alias("value"))
    return first_point(datex.elaborated(datex.cut(raw, "elaboratedData"), sites(t), "de")).select("id", "speed_kph", "volume", "los", "lon", "lat", "vertices")


@query(f"SELECT s_suppkey::VARCHAR AS site, {SITE.replace('1 AS', 'CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS')} FROM supplier WHERE s_suppkey % 5 <> 0")
def predefined_locations(t: Tables) -> DataFrame:
    S = key()  # noqa: N806
    x, y = text(F.round(4 + S % 90 * 0.01, 6)), text(F.round(50 + S % 70 * 0.01, 6))
    place = F.when(S % 5 == 0, F.lit("<name/>")).when(S % 2 == 0, F.format_string("<gmlLineString><posList>%s %s 51 5</posList></gmlLineString>", y, x)).otherwise(F.format_string("<pointCoordinates><latitude>%s</latitude><longitude>%s</longitude></pointCoordinates>", y, x))
    raw = t.read("supplier").select(F.concat(F.format_string('<predefinedLocation id="%d">', S), place, F.lit("</predefinedLocation>")).alias("value"))
    return first_point(datex.predefined_locations(datex.cut(raw, "predefinedLocation")))


# --- national feeds ----------------------------------------------------------

ALL = ["id", "speed_kph", "free_flow_kph", "los", "direction", "measured_at", "lon", "lat", "vertices"]
COLS = "{speed} AS speed_kph, {free} AS free_flow_kph, {los} AS los, {direction} AS direction, {at} AS measured_at"
NONE = {"speed": "NULL::DOUBLE", "free": "NULL::DOUBLE", "los": "'unknown'", "direction": "NULL::VARCHAR", "at": "NULL::VARCHAR"}


def cols(**given: str) -> str:
    return COLS.format(**(NONE | given))


@query(f"SELECT 'fi:' || s_suppkey || '-' || d AS id, {cols(speed='(s_suppkey % 120)::DOUBLE', direction=chr(39) + 'SUUNTA' + chr(39) + ' || d', at=chr(39) + 'm' + chr(39) + ' || d')}, {SITE} FROM supplier, (VALUES (1), (2)) v(d) WHERE s_suppkey % 9 <> 0 AND (d = 1 OR s_suppkey % 2 = 0)")
def flow_fintraffic(t: Tables) -> DataFrame:
    S = key()  # noqa: N806
    s = F.format_string('{"id":%d,"dataUpdatedTime":"m2","sensorValues":[{"name":"KESKINOPEUS_5MIN_LIUKUVA_SUUNTA1","value":%d,"measuredTime":"m1"},{"name":"OTHER","value":5},{"name":"KESKINOPEUS_5MIN_LIUKUVA_SUUNTA2","value":%d}]}', S, S % 120, F.when(S % 2 == 0, S % 120).otherwise(-1))
    return first_point(national.fintraffic(one_doc(t.read("supplier"), s, '{"stations":[', "]}"), sites(t), "fi")).select(ALL)


@query(f"SELECT 'nyc:' || s_suppkey AS id, {cols(speed='(s_suppkey % 60) * 1.609344::DOUBLE', at=chr(39) + 'now' + chr(39))}, {SITE.replace('1 AS', '2 AS')} FROM supplier WHERE s_suppkey % 4 <> 0")
def flow_nycdot(t: Tables) -> DataFrame:
    S = key()  # noqa: N806
    x, y = text(F.round(4 + S % 90 * 0.01, 6)), text(F.round(50 + S % 70 * 0.01, 6))
    s = F.format_string('{"link_id":"%d","speed":"%s","link_points":"%s,%s 51,5 bad","data_as_of":"now"}', S, F.when(S % 4 == 0, F.lit(" ")).otherwise(text(S % 60)), y, x)
    return first_point(national.nycdot(one_doc(t.read("supplier"), s, "[", "]"), "nyc")).select(ALL)


@query(f"SELECT 'oh:' || s_suppkey AS id, {cols(speed='(s_suppkey % 60) * 1.609344::DOUBLE', free='CASE WHEN s_suppkey % 3 > 0 THEN 60 * 1.609344::DOUBLE END', los='CASE WHEN s_suppkey % 3 = 0 THEN ' + chr(39) + 'unknown' + chr(39) + ' WHEN s_suppkey % 60 >= 51 THEN ' + chr(39) + 'free_flow' + chr(39) + ' WHEN s_suppkey % 60 >= 30 THEN ' + chr(39) + 'heavy' + chr(39) + ' WHEN s_suppkey % 60 >= 9 THEN ' + chr(39) + 'queuing' + chr(39) + ' ELSE ' + chr(39) + 'stationary' + chr(39) + ' END', direction='CASE WHEN s_suppkey % 2 = 0 THEN ' + chr(39) + 'N' + chr(39) + ' END', at=chr(39) + 'u' + chr(39))}, {SITE} FROM supplier")
def flow_ohgo(t: Tables) -> DataFrame:
    S = key()  # noqa: N806
    x, y = text(F.round(4 + S % 90 * 0.01, 6)), text(F.round(50 + S % 70 * 0.01, 6))
    s = F.format_string('{"Id":"%d","Latitude":%s,"Longitude":%s,"CurrentAvgSpeed":%d,"NormalAvgSpeed":%d,"Direction":"%s","LastUpdated":"u"}', S, y, x, S % 60, F.when(S % 3 > 0, 60).otherwise(0), F.when(S % 2 == 0, "N").otherwise(""))
    return first_point(national.ohgo(one_doc(t.read("supplier"), s, '{"Results":[', "]}"), "oh")).select(ALL)


@query(f"SELECT 'se:' || s_suppkey AS id, {cols(speed='(s_suppkey % 120)::DOUBLE', at=chr(39) + 't' + chr(39))}, {SITE} FROM supplier WHERE s_suppkey % 5 <> 0")
def flow_trafikverket(t: Tables) -> DataFrame:
    S = key()  # noqa: N806
    x, y = text(F.round(4 + S % 90 * 0.01, 6)), text(F.round(50 + S % 70 * 0.01, 6))
    s = F.format_string('{"SiteId":%d,"AverageVehicleSpeed":%d,"MeasurementTime":"t","Geometry":{"WGS84":"%s (%s %s)"}}', S, S % 120, F.when(S % 5 == 0, "LINE").otherwise("POINT"), x, y)
    return first_point(national.trafikverket(one_doc(t.read("supplier"), s, '{"RESPONSE":{"RESULT":[{"TrafficFlow":[', "]}]}}"), "se")).select(ALL)


WORDS = ["freie Fahrt", "Dichter Verkehr", "zäh", "stockend", "Stau", "nichts"]


@query(f"""SELECT 'bonn:' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ':' || i ELSE '' END AS id, {cols(speed='CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey % 70)::DOUBLE END', los='CASE s_suppkey % 6 WHEN 0 THEN ' + chr(39) + 'free_flow' + chr(39) + ' WHEN 1 THEN ' + chr(39) + 'heavy' + chr(39) + ' WHEN 2 THEN ' + chr(39) + 'queuing' + chr(39) + ' WHEN 3 THEN ' + chr(39) + 'queuing' + chr(39) + ' WHEN 4 THEN ' + chr(39) + 'stationary' + chr(39) + ' ELSE ' + chr(39) + 'unknown' + chr(39) + ' END', at=chr(39) + 'z' + chr(39))}, round(4 + s_suppkey % 90 * 0.01::DOUBLE, 6) + i AS lon, round(50 + s_suppkey % 70 * 0.01::DOUBLE, 6) AS lat, 2 AS vertices
FROM supplier, (VALUES (0), (1)) v(i) WHERE (i = 0 OR s_suppkey % 2 = 0) AND (s_suppkey % 6 < 5 OR s_suppkey % 4 > 0)""")
def flow_bonn(t: Tables) -> DataFrame:
    S = key()  # noqa: N806
    x, y = F.round(4 + S % 90 * 0.01, 6), text(F.round(50 + S % 70 * 0.01, 6))
    line = lambda i: F.format_string("[[%s,%s],[9,51]]", text(x + i), y)
    geo = F.when(S % 2 == 0, F.concat(F.lit('{"type":"MultiLineString","coordinates":['), line(0), F.lit(","), line(1), F.lit("]}"))).otherwise(F.concat(F.lit('{"type":"LineString","coordinates":'), line(0), F.lit("}")))
    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (S % 6 + 1).cast("int"))
    s = F.format_string('{"geometry":%s,"properties":{"strecke_id":%d,"geschwindigkeit":%s,"verkehrsstatus":"%s","auswertezeit":"z"}}', geo, S, F.when(S % 4 > 0, text(S % 70)).otherwise("null"), word)
    f = first_point(national.bonn(one_doc(t.read("supplier"), s, '{"features":[', "]}"), "bonn"))
    return f.select(ALL)


@query("""SELECT 'bonn:' || s_suppkey || ':congestion' AS id, CASE WHEN s_suppkey % 6 = 4 THEN 'critical' ELSE 'high' END AS severity, 'Traffic congestion (' || s_suppkey || ')' AS headline FROM supplier WHERE s_suppkey % 6 IN (2, 3, 4)""")
def congestion_of_flows(t: Tables) -> DataFrame:
    S = key()  # noqa: N806
    f = t.read("supplier").select(F.concat(F.lit("bonn:"), text(S)).alias("id"), F.element_at(F.array(*[F.lit(x) for x in ("free_flow", "heavy", "queuing", "queuing", "stationary", "unknown")]), (S % 6 + 1).cast("int")).alias("los"), F.array().cast(geometry.POSITIONS).alias("points"))
    return national.congestion(f).select("id", "severity", "headline")


@query(f"SELECT 'md:' || s_suppkey AS id, {cols(los='CASE s_suppkey % 5 WHEN 0 THEN ' + chr(39) + 'free_flow' + chr(39) + ' WHEN 1 THEN ' + chr(39) + 'heavy' + chr(39) + ' WHEN 2 THEN ' + chr(39) + 'queuing' + chr(39) + ' ELSE ' + chr(39) + 'stationary' + chr(39) + ' END')} FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 < 4")
def flow_madrid(t: Tables) -> DataFrame:
    S = key()  # noqa: N806
    raw = t.read("supplier").select(F.format_string("<pm><idelem>%d</idelem><st_x>440.500,5</st_x><st_y>4.474.000</st_y><nivelServicio>%d</nivelServicio><error>%s</error></pm>", S, S % 5, F.when(S % 7 == 0, "S").otherwise("N")).alias("value"))
    return first_point(national.madrid(datex.cut(raw, "pm"), "md")).select(*ALL[:6])


@query(f"SELECT 'sg:' || s_suppkey AS id, {cols(speed='CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 80)::DOUBLE ELSE (s_suppkey % 80) + 5.0::DOUBLE END')}, {SITE.replace('1 AS', '2 AS')} FROM supplier WHERE s_suppkey % 4 <> 0")
def flow_lta_speedbands(t: Tables) -> DataFrame:
    S = key()  # noqa: N806
    x, y = text(F.round(4 + S % 90 * 0.01, 6)), text(F.round(50 + S % 70 * 0.01, 6))
    s = F.format_string('{"LinkID":"%d","MinimumSpeed":"%d","MaximumSpeed":"%s","StartLon":"%s","StartLat":"%s","EndLon":"%s","EndLat":"51"}', S, S % 80, F.when(S % 3 == 0, "").otherwise(text(S % 80 + 10)), x, y, F.when(S % 4 == 0, "").otherwise("5"))
    return first_point(national.lta_speedbands(one_doc(t.read("supplier"), s, '{"value":[', "]}"), "sg")).select(ALL)


@query(f"SELECT 'be:' || s_suppkey AS id, {cols(speed='(s_suppkey % 100)::DOUBLE + 0.5', at=chr(39) + 't' + chr(39))}, {SITE} FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 4 <> 0")
def flow_miv(t: Tables) -> DataFrame:
    S = key()  # noqa: N806
    d = lambda i, v: F.format_string("<meetdata><verkeersintensiteit>%s</verkeersintensiteit><voertuigsnelheid_harmonisch>%s</voertuigsnelheid_harmonisch></meetdata>", text(i), v)
    raw = t.read("supplier").select(F.concat(F.format_string('<meetpunt unieke_id="%d"><tijd_waarneming>t</tijd_waarneming><defect>%d</defect>', S, F.when(S % 4 == 0, 1).otherwise(0)), d(F.lit(3), F.lit("10")), d(F.lit(7), F.concat(text(S % 100), F.lit(",5"))), d(F.lit(7), F.lit("11")), d(F.lit(9), F.lit("252")), F.lit("</meetpunt>")).alias("value"))
    return first_point(national.miv(datex.cut(raw, "meetpunt"), sites(t), "be")).select(ALL)


@query(f"SELECT 'it:' || s_suppkey AS id, {cols(speed='(s_suppkey % 130)::DOUBLE', direction=chr(39) + 'positive' + chr(39))}, {SITE} FROM supplier WHERE s_suppkey % 3 <> 0")
def flow_turin(t: Tables) -> DataFrame:
    S = key()  # noqa: N806
    x, y = text(F.round(4 + S % 90 * 0.01, 6)), text(F.round(50 + S % 70 * 0.01, 6))
    raw = t.read("supplier").select(F.format_string('<FDT_data lcd1="%d" accuracy="%d" lng="%s" lat="%s" direction="positive"><speedflow flow="1" speed="%d"/></FDT_data>', S, S % 3, x, y, S % 130).alias("value"))
    return first_point(national.turin(datex.cut(raw, "FDT_data"), "it")).select(ALL)


@query(f"SELECT 'bcn:' || s_suppkey AS id, {cols(los='CASE s_suppkey % 8 WHEN 1 THEN ' + chr(39) + 'free_flow' + chr(39) + ' WHEN 2 THEN ' + chr(39) + 'free_flow' + chr(39) + ' WHEN 3 THEN ' + chr(39) + 'heavy' + chr(39) + ' WHEN 4 THEN ' + chr(39) + 'queuing' + chr(39) + ' WHEN 5 THEN ' + chr(39) + 'stationary' + chr(39) + ' ELSE ' + chr(39) + 'blocked' + chr(39) + ' END', at=chr(39) + '2024-01-02T03:04:05' + chr(39))}, {SITE} FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 8 BETWEEN 1 AND 6")
def flow_barcelona(t: Tables) -> DataFrame:
    S = key()  # noqa: N806
    raw = t.read("supplier").select(F.format_string("%d#20240102030405#%d#0", S, S % 8).alias("value"))
    return first_point(national.barcelona(raw, sites(t), "bcn")).select(ALL)


# --- crosswalks and clocks ---------------------------------------------------


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'unknown' ELSE 'medium' END AS open511, CASE s_suppkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' WHEN 2 THEN 'unknown' ELSE 'unknown' END AS datex2,
  CASE s_suppkey % 4 WHEN 0 THEN 'roadworks' WHEN 1 THEN 'accident' WHEN 2 THEN 'other' ELSE 'weather' END AS type, CASE s_suppkey % 4 WHEN 0 THEN 'planned' WHEN 1 THEN 'incident' ELSE 'conditions' END AS category, s_suppkey % 4 = 0 AS planned FROM supplier""")
def crosswalks(t: Tables) -> DataFrame:
    S = key()  # noqa: N806
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (S % 4 + 1).cast("int"))
    k = read.source_type(pick("ns:ConstructionWorks", "CRASH", "what", "poorEnvironmentConditions"))
    return t.read("supplier").select("s_suppkey", read.normalised_severity(pick("Major", "MINOR", "x", "Moderate"), "open511").alias("open511"), read.normalised_severity(pick("Highest", "lowest", "none", "Moderate"), "datex2").alias("datex2"), k.type.alias("type"), k.category.alias("category"), k.planned.alias("planned"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch(ts)::BIGINT - 0 WHEN 1 THEN floor(epoch(ts))::BIGINT WHEN 2 THEN floor(epoch(ts))::BIGINT - 7200 END AS s, CASE WHEN event_id % 24 = 0 THEN 'PT24H' ELSE 'PT' || CASE WHEN event_id % 24 = 0 THEN 24 ELSE 24 - event_id % 24 END || 'H' END AS duration FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def instants_and_durations(t: Tables) -> DataFrame:
    k = F.col("event_id")
    day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    shown = F.when(k % 4 == 0, day).when(k % 4 == 1, F.concat(day, F.lit("Z"))).when(k % 4 == 2, F.concat(day, F.lit("+02:00"))).otherwise(F.lit("2024-02-31T10:00:00"))
    d = scalars.duration_between(F.format_string("%d:15", k % 24), F.lit("0:15"))
    return t.events().select("event_id", F.unix_seconds(scalars.iso_instant(shown)).alias("s"), d.alias("duration"))


@query("SELECT event_id, floor(epoch(timezone('Europe/Berlin', date_trunc('minute', ts))))::BIGINT AS s FROM events")
def berlin_clock(t: Tables) -> DataFrame:
    return t.events().select("event_id", F.unix_seconds(scalars.wall_clock(F.date_format("ts", "dd.MM.yyyy HH:mm"))).alias("s"))


@query("SELECT s_suppkey, 'https://***@h/p?a=1&token=***&b=' || s_suppkey AS url FROM supplier")
def redacted_urls(t: Tables) -> DataFrame:
    S = key()  # noqa: N806
    return t.read("supplier").select("s_suppkey", scalars.redacted(F.format_string("https://user:pw@h/p?a=1&token=x%d&b=%d", S, S)).alias("url"))


@query("SELECT s_suppkey, 3 AS n, -120.2::DOUBLE AS lon, 38.5::DOUBLE AS lat, 43.252::DOUBLE AS last_lat FROM supplier")
def polylines(t: Tables) -> DataFrame:
    S = key()  # noqa: N806
    p = geometry.decoded_polyline(F.concat(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@"), F.when(S < 0, "x").otherwise("")))
    return t.read("supplier").select("s_suppkey", F.size(p).alias("n"), p[0].lon.alias("lon"), p[0].lat.alias("lat"), p[2].lat.alias("last_lat"))
