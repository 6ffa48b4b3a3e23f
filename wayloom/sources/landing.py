"""Landing: fetched bytes become files below the shared folder, which the parsers read.

The transport is the caller's: ``get(url, headers) -> (status, headers, chunks)``.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Get = Callable[[str, dict[str, str]], tuple[int, dict[str, str], Iterable[bytes]]]


class TooLarge(ValueError):
    """A body beyond the bytes allowed."""


@dataclass
class Fetched:
    """unchanged: the server has nothing newer; body is then empty."""

    status: int
    body: bytes
    etag: str | None
    modified: str | None
    unchanged: bool = False


def fetch(get: Get, url: str, etag: str | None = None, modified: str | None = None, most: int = 256 << 20) -> Fetched:
    """One conditional request; gzip bodies are unpacked, and neither form may be longer than ``most``."""
    headers = {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", modified)) if v}
    status, got, chunks = get(url, headers)
    low = {k.lower(): v for k, v in got.items()}
    if status == 304:
        return Fetched(status, b"", low.get("etag", etag), low.get("last-modified", modified), True)
    if status >= 400:
        raise OSError(f"status {status}")
    body = bytearray()
    for c in chunks:
        body += c
        if len(body) > most:
            raise TooLarge(f"more than {most} bytes")
    whole = bytes(body)
    if whole[:2] == b"\x1f\x8b":
        import io

        with gzip.open(io.BytesIO(whole)) as f:
            whole = f.read(most + 1)
        if len(whole) > most:
            raise TooLarge(f"more than {most} bytes")
    return Fetched(status, whole, low.get("etag"), low.get("last-modified"))


def fan_out(spark: SparkSession, get: Get, urls: list[str], tasks: int = 8) -> DataFrame:
    """(url, ord, value, error) of many urls, a part that fails keeps its error; ``failures`` counts them for the swap's guard."""
    todo = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, ord int")

    def run(batches):
        for batch in batches:
            for u, i in zip(batch.column("url").to_pylist(), batch.column("ord").to_pylist()):
                text, error = None, None
                try:
                    text = fetch(get, u).body.decode("utf-8", "replace")
                except Exception as e:  # one part's failure is a row, not the job's end
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pydict({"url": [u], "ord": pa.array([i], pa.int32()), "value": pa.array([text], pa.string()), "error": pa.array([error], pa.string())})

    return todo.repartition(min(tasks, max(1, len(urls)))).mapInArrow(run, "url string, ord int, value string, error string")


def failures(parts: DataFrame) -> tuple[int, int]:
    """(failed, fetched) parts."""
    r = parts.selectExpr("count(error) AS f", "count(*) AS n").first()
    return r.f, r.n


def pages(page: Callable[[int], list], size: int, most: int = 10_000) -> Iterable[list]:
    """Pages by offset until a short one; one beyond ``most`` is an error, as the server ignores the offset."""
    for n in range(most):
        rows = page(n * size)
        if rows:
            yield rows
        if len(rows) < size:
            return
    raise TooLarge(f"more than {most} pages")


def daily_windows(now, days: int):
    """(first, last) day texts of the window before today that a daily report is asked for."""
    from datetime import timedelta

    return [((now - timedelta(days=d)).strftime("%d%m%Y"),) * 2 for d in range(days, 0, -1)]


def chunked(values: list, size: int) -> list[list]:
    return [values[i : i + size] for i in range(0, len(values), size)]


def download(get: Get, url: str, open_output: Callable[[str], object], path: str, md5: str | None = None) -> str:
    """Stream a large file to ``path``; its MD5, which must be ``md5`` if that is known (a sidecar's first word)."""
    _, _, chunks = get(url, {})
    h = hashlib.md5()
    with open_output(path) as f:
        for c in chunks:
            h.update(c)
            f.write(c)
    if md5 and md5.split()[0].lower() != h.hexdigest():
        raise ValueError("the file differs from its checksum")
    return h.hexdigest()


def catalog_or_snapshot(resolve: Callable[[], list], snapshot: list) -> tuple[list, bool]:
    """A catalogue's feeds, or the snapshot's where it can't be read or is empty; whether it is the snapshot."""
    try:
        found = resolve()
    except Exception:
        found = []
    return (found, False) if found else (snapshot, True)


@dataclass
class Cached:
    """A side table that is read again after so many seconds, and kept past that while reading fails."""

    read: Callable[[], DataFrame]
    keep_s: float = 6 * 3600
    table: DataFrame | None = None
    at: float = float("-inf")

    def get(self, now: float) -> DataFrame:
        if now - self.at >= self.keep_s:
            try:
                self.table, self.at = self.read(), now
            except Exception:
                if self.table is None:
                    raise
        return self.table
