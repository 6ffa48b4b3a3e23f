"""Legacy archives: ARC versions 1 and 2 parsed by their declared lengths and rewritten as WARC.

An ARC file starts with a version block whose first line, a record header, has
the scheme ``filedesc``; its second line names the version and its third the
fields of all later header lines. Each later record is one header line and as
many bytes as its last field declares. ``convert_arc`` gives a WARC record for
each: identifier, ISO timestamp, type by content (a block that starts as an HTTP
message is a response, whatever the url's scheme), block and payload digest.

Cases of ``archive_pages``: null html is an empty payload; a null or blank url
gets a ``urn:wayloom:page:`` name, any other stays as it is, but that blanks and
control characters, which a header line can't hold, are escaped;
null page_ids stay null and count as smallest; rows that share payload and the
largest page_id are all responses; further columns are not read; an empty
table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.bpe import rows
from wayloom.llm.common import materialize, maybe_broadcast, open_input, open_output, workspace

# Field names of ARC header lines by version, and the profile of identical payloads.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    payload: bytes = b""
    source: dict[str, str] = field(default_factory=dict)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_arc(records: Iterable[tuple[str, str, bytes]], version: int, date: str = "20240101000000", name: str = "pages.arc") -> bytes:
    """An ARC file of (url, content type, block) in the given version."""
    names = ARC_FIELDS[version]
    body = f"{version} 0 wayloom\n{' '.join(names)}\n\n".encode()
    rest = [] if version == 1 else ["200", "-", "-", "0", name]
    out = [" ".join([f"filedesc://{name}", "0.0.0.0", date, "text/plain", *rest, str(len(body))]).encode() + b"\n" + body]
    for url, kind, block in records:
        line = [url, "0.0.0.0", date, kind]
        if version == 2:
            line += ["200", hashlib.md5(block).hexdigest(), "-", str(sum(map(len, out))), name]
        out.append(" ".join([*line, str(len(block))]).encode() + b"\n" + block + b"\n")
    return b"".join(out)


def read_arc(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of an ARC stream, the version block first."""

    def header() -> list[str] | None:
        line = f.readline()
        while line in (b"\n", b"\r\n"):
            line = f.readline()
        return line.decode("utf-8", "replace").rstrip("\r\n").split(" ") if line else None

    first = header()
    if first is None:
        return
    if not first[0].startswith("filedesc:"):
        raise ValueError("an ARC file starts with its version block")
    body = f.read(int(first[-1]))
    lines = body.decode("utf-8", "replace").splitlines()
    version = int(lines[0].split(" ")[0])
    names = lines[1].split(" ") if len(lines) > 1 and lines[1] else ARC_FIELDS[version]
    yield dict(zip(ARC_FIELDS[2 if len(first) > 5 else 1], first)) | {"version": str(version)}, body
    while (line := header()) is not None:
        if len(line) < len(names):
            raise ValueError(f"an ARC header line has {len(line)} fields, version {version} has {len(names)}")
        if len(line) > len(names):  # blanks inside the url
            extra = len(line) - len(names)
            line = ["%20".join(line[: extra + 1]), *line[extra + 1 :]]
        got = dict(zip(names, line)) | {"version": str(version)}
        size = int(got[names[-1]])
        block = f.read(size)
        if len(block) != size:
            raise ValueError("an ARC record is shorter than it declares")
        yield got, block


def iso_date(digits: str) -> str:
    d = (digits + "00000101000000"[len(digits) :])[:14] if len(digits) < 14 else digits[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head with its blank line, and the payload."""
    for mark in (b"\r\n\r\n", b"\n\n"):
        at = block.find(mark)
        if at >= 0:
            return block[: at + len(mark)], block[at + len(mark) :]
    return block, b""


def convert_arc(f, record_id: Callable[[dict[str, str], int], str] | None = None) -> Iterator[Record]:
    """A WARC record for every ARC record. record_id: from header fields and ordinal; by default a name-based UUID."""
    make = record_id or (lambda h, n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join([*h.values(), str(n)]))}>")
    for n, (h, block) in enumerate(read_arc(f)):
        url, mime = h["URL"], h["Content-type"]
        headers = {"WARC-Record-ID": make(h, n), "WARC-Date": iso_date(h["Archive-date"]), "WARC-Target-URI": url}
        payload = block
        if n == 0:
            headers |= {"WARC-Type": "warcinfo", "WARC-Filename": url.split("//", 1)[-1], "Content-Type": "application/warc-fields"}
            headers.pop("WARC-Target-URI")
            block = payload = f"software: wayloom\r\nformat: WARC File Format 1.0\r\nconverted-from: ARC {h['version']}\r\n".encode()
        elif block.startswith(b"HTTP/"):
            payload = split_http(block)[1]
            headers |= {"WARC-Type": "response", "Content-Type": "application/http; msgtype=response"}
        elif url.startswith("dns:"):
            headers |= {"WARC-Type": "response", "Content-Type": "text/dns"}
        else:
            headers |= {"WARC-Type": "resource", "Content-Type": mime}
        if h.get("IP-address", "-") not in ("-", "0.0.0.0", ""):
            headers["WARC-IP-Address"] = h["IP-address"]
        headers |= {"WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}", "WARC-Block-Digest": f"sha1:{sha1_base32(block)}"}
        yield Record(headers, block, payload, h)


def as_revisit(r: Record, refers_to: str) -> Record:
    """The same capture without its payload, referring to the record that holds it."""
    head = split_http(r.block)[0] if r.headers["WARC-Type"] == "response" else b""
    headers = r.headers | {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": refers_to, "WARC-Block-Digest": f"sha1:{sha1_base32(head)}"}
    return Record(headers, head, b"", r.source)


def dump_warc(r: Record, level: int = 1) -> bytes:
    """One gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", r.headers["WARC-Type"]), *((k, v) for k, v in r.headers.items() if k != "WARC-Type"), ("Content-Length", str(len(r.block)))])
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.0\r\n" + head.encode() + b"\r\n") + z.compress(r.block) + z.compress(b"\r\n\r\n") + z.flush()


def load_warc(f, chunk: int = 1 << 18) -> Iterator[Record]:
    """Records of a WARC stream of gzip members, one member in memory at a time."""
    left = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            data = left or f.read(chunk)
            left = b""
            if not data:
                if parts:
                    raise ValueError("a WARC member is cut off")
                return
            parts.append(z.decompress(data))
        left = z.unused_data
        whole = b"".join(parts)
        head, _, rest = whole.partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(headers["Content-Length"])]
        payload = split_http(block)[1] if headers["WARC-Type"] == "response" and headers["Content-Type"].startswith("application/http") else block
        yield Record(headers, block, payload)


def key_id(key: int | None) -> str:
    """A UUID (version 8) that carries a 64-bit key, so that a reference leads back to it."""
    n = (key or 0) & (2**64 - 1)
    tag = int.from_bytes(b"wayloo", "big")
    middle = (n >> 62) | (0x800 if key is None else 0)
    return f"<urn:uuid:{uuid.UUID(int=(tag << 80) | (8 << 76) | (middle << 64) | (2 << 62) | (n & (2**62 - 1)))}>"


def id_key(name: str) -> int | None:
    n = uuid.UUID(name.strip("<>")).int
    middle = (n >> 64) & 0xFFF
    if middle & 0x800:
        return None
    key = ((middle & 3) << 62) | (n & (2**62 - 1))
    return key - 2**64 if key >= 2**63 else key


def page_url(url: str | None, key: int | None) -> str:
    if url is None or not url.strip():
        return f"urn:wayloom:page:{key}"
    return "".join(c if c > " " and c != "\x7f" and c not in "\x85\xa0  " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = 256 << 20) -> DataFrame:
    """Write WARC files of every page below ``folder``; the manifest (path, records) is a table there.

    The largest page_id of each payload is found by an aggregation of digests,
    which no payload takes part in. Payloads stay where they lie while few
    digests repeat (counted); else they are shuffled once, and adaptive execution
    may split the rows of a payload that very many pages share. Files are named by task and a
    random number, and only those in the manifest count, so tasks can be retried.
    """
    src = pages.select(F.col("page_id").cast("long").alias("k"), F.col("url").alias("u"), F.coalesce("html", F.lit("")).alias("h"))
    src = src.withColumn("d", F.unhex(F.sha1("h")))
    same = src.where(F.octet_length("h") >= min_bytes).groupBy("d").agg(F.max("k").alias("keep"), F.count("*").alias("n")).where("n > 1 and keep is not null").select("d", "keep")
    same = maybe_broadcast(materialize(same, f"{folder}/repeated"))
    joined = src.join(same, "d", "left").select("k", "u", "h", "keep")

    def run(batches):
        from pyspark import TaskContext

        out, path, size, count, part = None, "", 0, 0, 0

        def entry():
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})

        for ks, us, hs, keeps in rows(batches, ("k", "u", "h", "keep"), 64):
            part += 1
            arc = []
            for k, u, h in zip(ks, us, hs):
                data = h.encode()
                url = page_url(u, k)
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
                arc.append((url, "text/html", head + data))
            # Both versions occur, so both header forms are parsed on every run.
            legacy = io.BytesIO(write_arc(arc, 1 + part % 2))
            ids = iter([None, *ks])
            records = convert_arc(legacy, lambda h, n: key_id(next(ids)))
            next(records)  # the version block: the archive's own first record says as much
            for r, k, keep in zip(records, ks, keeps, strict=True):
                if out is None:
                    path = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, count = open_output(path), 0, 0
                    info = next(convert_arc(io.BytesIO(write_arc([], 1))))
                    out.write(dump_warc(info))
                data = dump_warc(r if keep is None or k == keep else as_revisit(r, key_id(keep)))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield entry()
        if out is not None:
            out.close()
            yield entry()

    return materialize(joined.mapInArrow(run, "path string, records long"), f"{folder}/manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives that a manifest names; digests of payloads are verified."""
    n = max(1, min(manifest.count(), 100_000))

    def run(batches):
        for (paths,) in rows(batches, ("path",)):
            for path in paths:
                cols: list[list] = [[] for _ in range(7)]

                def batch(cols=cols):
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "warc_date"]
                    return pa.RecordBatch.from_pydict({c: pa.array(v, t) for c, v, t in zip(names, cols, kinds)})

                with open_input(path) as f:
                    for r in load_warc(f):
                        h = r.headers
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "revisit":
                            head = dict(x.split(": ", 1) for x in r.block.decode("latin-1").split("\r\n")[1:] if ": " in x)
                            size, to = int(head["Content-Length"]), id_key(h["WARC-Refers-To"])
                        else:
                            size, to = len(r.payload), None
                            if sha1_base32(r.payload) != digest:
                                raise ValueError(f"{path}: a payload differs from its digest")
                        for c, v in zip(cols, (id_key(h["WARC-Record-ID"]), size, digest, h["WARC-Type"], to, h["WARC-Target-URI"], h["WARC-Date"])):
                            c.append(v)
                        if len(cols[0]) >= 2000:
                            yield batch()
                            for c in cols:
                                c.clear()
                yield batch()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, warc_date string"
    return manifest.select("path").repartitionByRange(n, "path").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    folder = workspace(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_bytes))
