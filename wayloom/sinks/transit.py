"""GTFS-realtime entities as protocol buffers: alerts and occupancy, one entity a row, in Arrow batches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Field numbers of the public format, route types by mode, occupancy by name.
ROUTE_TYPES = {"tram": 0, "streetcar": 0, "lightrail": 0, "subway": 1, "metro": 1, "rail": 2, "bus": 3, "ferry": 4, "cablecar": 5, "cable_tram": 5, "aerial": 6, "gondola": 6, "funicular": 7, "trolleybus": 11, "monorail": 12}
OCCUPANCY = ["EMPTY", "MANY_SEATS_AVAILABLE", "FEW_SEATS_AVAILABLE", "STANDING_ROOM_ONLY", "CRUSHED_STANDING_ROOM_ONLY", "FULL", "NOT_ACCEPTING_PASSENGERS", "NO_DATA_AVAILABLE", "NOT_BOARDABLE"]
SELECTORS = {"stop": 5, "route": 2, "trip": 4}


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def field(number: int, value: int | str | bytes | None) -> bytes:
    """One field: whole numbers as varints, texts and messages with their length; none for null."""
    if value is None:
        return b""
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def words(text: str | None) -> bytes | None:
    return field(1, field(1, text) + field(2, "en")) if text else None


def selectors(informed: list[tuple[str, str]]) -> list[bytes]:
    """Distinct selectors in order; blank ids and unknown kinds are left out."""
    out = []
    for kind, name in informed:
        name = (name or "").strip()
        if kind == "mode" and name.lower() in ROUTE_TYPES:
            out.append(field(3, ROUTE_TYPES[name.lower()]))
        elif kind in SELECTORS and name:
            out.append(field(SELECTORS[kind], field(1, name) if kind == "trip" else name))
    return list(dict.fromkeys(out))


def alert(r: dict) -> bytes | None:
    """An alert's entity, none without a selector; it ends with its validity, else its expiry."""
    chosen = selectors([(x["kind"], x["id"]) for x in json.loads(r["informed"] or "[]")])
    if not chosen:
        return None
    period = field(1, r["start_s"]) + field(2, r["end_s"])
    body = (field(1, period) if period else b"") + b"".join(field(5, s) for s in chosen) + field(6, r["cause"]) + field(7, r["effect"]) + field(8, words(r["url"])) + field(10, words(r["headline"])) + field(11, words(r["description"])) + field(14, r["severity_level"])
    return field(2, field(1, r["id"]) + field(5, body))


def occupancy(r: dict) -> bytes | None:
    """An entity with the vehicle's occupancy, or that after a stop of its trip; none without a trip or either."""
    trip = (r["trip"] or "").strip()
    if r["level"] not in OCCUPANCY or not trip:
        return None
    level, of = OCCUPANCY.index(r["level"]), field(1, field(1, trip))
    if (r["vehicle"] or "").strip():
        return field(2, field(1, r["id"]) + field(4, of + field(5, r["at_s"]) + field(8, field(1, r["vehicle"].strip())) + field(9, level)))
    if r["stop_sequence"] is not None and r["stop_sequence"] >= 0:
        return field(2, field(1, r["id"]) + field(3, of + field(2, field(1, r["stop_sequence"]) + field(7, level))))
    return None


def feed_header(now_s: int | None) -> bytes:
    """What stands before the entities of a feed: version, full data set, its time."""
    return field(1, field(1, "2.0") + field(2, 0) + field(3, now_s))


def entities(rows: DataFrame, make, columns: list[str]) -> DataFrame:
    """(id, entity) of the rows that have one; a feed is feed_header and its entities, in any order."""
    src = rows.select(*columns)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [(r["id"], e) for r in batch.to_pylist() if (e := make(r)) is not None]
            yield pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in made], pa.string()), "entity": pa.array([e for _, e in made], pa.binary())})

    return src.mapInArrow(run, "id string, entity binary")


def alerts(events: DataFrame) -> DataFrame:
    """Entities of events (id, informed: array of (kind, id), valid_from, valid_to, expires_at, cause, effect, severity_level, headline, description, url)."""
    s = events.withColumns({"informed": F.to_json("informed"), "start_s": F.unix_seconds("valid_from"), "end_s": F.unix_seconds(F.coalesce("valid_to", "expires_at"))})
    return entities(s, alert, ["id", "informed", "start_s", "end_s", "cause", "effect", "severity_level", "headline", "description", "url"])


def occupancies(measurements: DataFrame) -> DataFrame:
    """Entities of measurements (id, trip, level, vehicle, stop_sequence, updated_at)."""
    return entities(measurements.withColumn("at_s", F.unix_seconds("updated_at")), occupancy, ["id", "trip", "level", "vehicle", "stop_sequence", "at_s"])


def parsed(data: bytes) -> list[tuple[int, int | bytes]]:
    """(field number, value) of a message, one level deep."""
    out, at = [], 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = number()
        if key & 7 == 0:
            out.append((key >> 3, number()))
        else:
            size = number()
            out.append((key >> 3, data[at : at + size]))
            at += size
    return out
