"""Road networks: ways from GeoJSON lines, the graph of their nodes, location code tables and what codes resolve to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions import geometry
from wayloom.functions.scalars import same_road
from wayloom.operators.resolution import shared_checkpoints
from wayloom.sources.formats import at

# Functional road classes by highway.
FRC = {"motorway": 0, "trunk": 1, "primary": 2, "secondary": 3, "tertiary": 4, "unclassified": 5, "residential": 6, "living_street": 7, "service": 7}


def geojson_ways(lines: DataFrame) -> DataFrame:
    """Ways from line-delimited GeoJSON features (value), a record separator before them or not; lines of two positions and more."""
    doc = lines.select(F.regexp_replace("value", "^\x1e", "").alias("doc"))
    tag = lambda k: F.coalesce(at("doc", f"$.properties.{k}"), at("doc", f"$.properties.tags.{k}"))
    own = F.regexp_extract(F.coalesce(at("doc", "$.id"), at("doc", "$.properties.@id")), "([0-9]+)$", 1)
    w = doc.select(own.try_cast("long").alias("way_id"), tag("highway").alias("highway"), tag("ref").alias("ref"), tag("maxspeed").alias("maxspeed"), F.coalesce(tag("oneway").isin("yes", "1", "-1", "true"), F.lit(False)).alias("oneway"), geometry.positions(at("doc", "$.geometry.coordinates")).alias("coords"), at("doc", "$.geometry.type").alias("kind"))
    return w.where("kind = 'LineString' and way_id is not null and highway is not null and size(coords) >= 2").drop("kind")


def road_class(highway: Column) -> Column:
    """Functional class by highway, a link as its road; 7 for others."""
    bare = F.regexp_replace(highway, "_link$", "")
    return F.coalesce(*[F.when(bare == k, v) for k, v in FRC.items()], F.lit(7))


def form_of_way(highway: Column, junction: Column, oneway: Column) -> Column:
    """1 motorway, 2 dual and 3 single carriageway, 4 roundabout, 6 slip road."""
    return F.when(junction == "roundabout", 4).when(highway.endswith("_link"), 6).when(highway == "motorway", 1).when(oneway & highway.isin("trunk", "primary"), 2).otherwise(3)


def graph(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ways (way_id, highway, junction, oneway, nodes: (node, lon, lat)): an edge for each pair of neighbours, and its reverse unless oneway."""
    pairs = F.expr("transform(slice(nodes, 2, size(nodes)), (b, i) -> struct(nodes[i].node AS a, b.node AS b))")
    e = ways.select("way_id", road_class(F.col("highway")).alias("frc"), form_of_way(F.col("highway"), F.col("junction"), F.col("oneway")).alias("fow"), "oneway", F.explode(pairs).alias("p"))
    both = F.when(F.col("oneway"), F.array(F.struct("p.a", "p.b"))).otherwise(F.array(F.struct("p.a", "p.b"), F.struct(F.col("p.b").alias("a"), F.col("p.a").alias("b"))))
    edges = e.withColumn("q", F.explode(both)).select("way_id", F.col("q.a").alias("start_node"), F.col("q.b").alias("end_node"), "frc", "fow", "oneway")
    nodes = ways.select(F.inline("nodes")).groupBy("node").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"))
    return nodes, edges


def location_table(points: DataFrame, offsets: DataFrame, roads: DataFrame, segments: DataFrame) -> DataFrame:
    """(code, lon, lat, road, pos, neg) from the parts of a location code list, as read by ``spark.read.csv(sep=";", header=True)``.

    Coordinates are hundred thousandths of degrees; a point's road is its road's
    number, else its segment's.
    """
    code = lambda c: F.when(F.trim(F.col(c)).try_cast("int") > 0, F.trim(F.col(c)).try_cast("int"))
    r = roads.where("ROADNUMBER <> ''").select(F.trim("LCD").alias("road_lcd"), F.trim("ROADNUMBER").alias("by_road"))
    s = segments.select(F.trim("LCD").alias("seg_lcd"), F.trim("ROADNUMBER").alias("own"), F.trim("ROA_LCD").alias("road_lcd")).join(r, "road_lcd", "left").select("seg_lcd", F.coalesce(F.nullif("own", F.lit("")), "by_road").alias("by_segment"))
    o = offsets.select(code("LCD").alias("code"), code("POS_OFF_LCD").alias("pos"), code("NEG_OFF_LCD").alias("neg"))
    p = points.select(code("LCD").alias("code"), (F.trim("XCOORD").try_cast("int") / 1e5).alias("lon"), (F.trim("YCOORD").try_cast("int") / 1e5).alias("lat"), F.trim("ROA_LCD").alias("road_lcd"), F.trim("SEG_LCD").alias("seg_lcd"))
    p = p.where("code is not null and lon is not null and lat is not null").join(r, "road_lcd", "left").join(s, "seg_lcd", "left")
    return p.select("code", "lon", "lat", F.coalesce("by_road", "by_segment").alias("road")).join(o, "code", "left")


def resolved_codes(refs: DataFrame, table: DataFrame, country: str, table_no: float, version: str, most: int = 200) -> DataFrame:
    """(id, reason, points, via_road) of references (id, country, table_no, version, road, primary, secondary).

    A reference of another version holds only where the points known lie on its
    road. Between two codes the chain of offsets is walked, forward, then back, at
    most ``most`` steps; without a chain the two points are joined straight.
    """
    v = lambda c: F.coalesce(F.format_string("%.2f", c.try_cast("double")), F.upper(F.trim(c)))
    t = lambda n: table.select(F.col("code").alias(n), F.struct("lon", "lat").alias(f"{n}_at"), F.col("road").alias(f"{n}_road"))
    j = refs.join(t("primary"), "primary", "left").join(t("secondary"), "secondary", "left")
    known = (F.upper(F.trim("country")) == country.upper()) & (F.col("table_no").isNull() | (F.trim(F.col("table_no").cast("string")) == "") | (F.col("table_no").try_cast("double") == table_no))
    on_road = lambda n: F.col(f"{n}_road").isNull() | F.coalesce(same_road(F.col(f"{n}_road"), F.col("road")), F.lit(False))
    by_road = (F.col("primary_road").isNotNull() | F.col("secondary_road").isNotNull()) & on_road("primary") & on_road("secondary")
    same = v(F.col("version")) == v(F.lit(version))
    reason = (
        F.when(F.coalesce("primary", F.lit(0)) == 0, "no-reference").when(~F.coalesce(known, F.lit(False)), "no-table").when(F.coalesce("version", F.lit("")) == "", "version-missing")
        .when(~same & ~by_road, "version-mismatch").when(F.col("primary_at").isNull(), "unknown-code")
    )
    j = j.withColumns({"reason": reason, "via_road": reason.isNull() & ~same})
    ask = j.where("reason is null and secondary_at is not null and secondary <> primary")
    found = walked(ask.select("primary", "secondary").distinct(), table, most)
    j = j.join(found, ["primary", "secondary"], "left")
    straight = F.when(F.col("secondary_at").isNotNull() & (F.col("secondary") != F.col("primary")), F.array("secondary_at", "primary_at")).otherwise(F.array("primary_at"))
    return j.select("id", "reason", F.when(F.col("reason").isNull(), F.coalesce("chain", straight)).alias("points"), "via_road")


def walked(pairs: DataFrame, table: DataFrame, most: int) -> DataFrame:
    """(primary, secondary, chain): the positions from secondary to primary along the offsets, forward before back.

    Steps are doubled: a few joins give what lies 1, 2, 4 … steps on from each
    code, and each of a pair's up to ``most`` steps is the sum of such.
    """
    shared_checkpoints(table.sparkSession)
    out = None
    for rank, side in enumerate(("pos", "neg")):
        jump = table.where(F.col(side).isNotNull()).select(F.col("code").alias("here"), F.col(side).alias("next"))
        at = pairs.select("primary", "secondary", F.col("secondary").alias("here"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"))
        for bit in range(most.bit_length()):
            jump = jump.checkpoint()
            set_ = F.col("k").bitwiseAND(1 << bit) > 0
            at = at.join(jump, "here", "left").where(~set_ | F.col("next").isNotNull()).select("primary", "secondary", "k", F.when(set_, F.col("next")).otherwise(F.col("here")).alias("here"))
            jump = jump.join(jump.select(F.col("here").alias("next"), F.col("next").alias("far")), "next").select("here", F.col("far").alias("next"))
        at = at.checkpoint()
        goal = at.where("here = primary").groupBy("primary", "secondary").agg(F.min("k").alias("last"))
        got = at.join(goal, ["primary", "secondary"]).where("k <= last").select("primary", "secondary", F.lit(rank).alias("rank"), "k", F.col("here").alias("code"))
        got = got.union(goal.select("primary", "secondary", F.lit(rank), F.lit(0), F.col("secondary")))
        out = got if out is None else out.union(got)
    placed = out.join(table.select("code", "lon", "lat"), "code").groupBy("primary", "secondary", "rank").agg(F.array_sort(F.collect_list(F.struct("k", F.struct("lon", "lat").alias("p")))).alias("c"))
    best = placed.groupBy("primary", "secondary").agg(F.min(F.struct("rank", "c")).alias("x"))
    return best.select("primary", "secondary", F.transform("x.c", lambda x: x.p).alias("chain"))
