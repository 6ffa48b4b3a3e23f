"""Token ids in binary shards, each document compressed by itself with one shared zstandard dictionary.

Shard layout, little-endian: magic ``WLT1``, width of an id in bytes (1 byte),
SHA-256 of the dictionary (32 bytes); one zstandard frame per document; the
index, 25 bytes a document: null flag (1), doc_id (8), offset of the frame (8),
number of ids (8); then offset of the index (8), documents (8), magic ``WLTX``.
A short document is read with one seek: index entry, frame, dictionary by hash.

Cases: null text is empty and has the end id alone; null doc_ids come first,
doc_ids may repeat (ties in order of the text's hash); further columns are not
read; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm.bpe import rows, split_pieces, trim
from wayloom.llm.common import open_input, open_output, shuffle_partitions, workspace

MAGIC, TAIL = b"WLT1", b"WLTX"
ENTRY = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u8")])
#: Characters of text in one range of doc_ids, and bytes after which a task starts its next shard.
RANGE_CHARS, SHARD_BYTES = 256 << 20, 256 << 20
#: Pieces and words a worker remembers, over all its tasks; longer ones than CACHE_CHARS are not kept.
CACHE_ENTRIES = 800_000
CACHE_CHARS = 64


class LibraryEncoder:
    """The tokenizers library, with the ids of each piece between blanks remembered.

    The pre-tokenizer's words never merge with each other, so a printable ASCII
    piece is the concatenation of its words. Words not seen before are encoded
    many at a time, parted by blanks: each one's ids end with its only token that
    carries the end-of-word suffix. Other pieces are parted by a special token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.mark, self.mark_id = next(iter(sorted(added.items(), key=lambda x: -x[1])), (None, None))
        size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u4" if size > 65536 else "<u2")
        spec = json.loads(self.library.to_str())
        suffix, steps = spec["model"].get("end_of_word_suffix"), (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.words = regex.compile(pattern) if suffix and (pattern := (steps[0].get("pattern") or {}).get("Regex")) else None
        self.ends = np.zeros(1 + max(self.library.get_vocab(with_added_tokens=True).values(), default=size), bool)
        if suffix:
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _encode_words(self, words: list[str], fresh: dict[str, bytes]) -> None:
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            ids = self._ids(" ".join(part))
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                cuts, data = [0, *(ends * self.dtype.itemsize).tolist()], ids.tobytes()
                fresh.update((w, data[a:b]) for w, a, b in zip(part, cuts, cuts[1:]))
            else:
                self._encode_marked(part, fresh)

    def _encode_marked(self, pieces: list[str], fresh: dict[str, bytes]) -> None:
        own = pieces if self.mark is None else [p for p in pieces if "<|" in p or self.mark in p]
        fresh.update((p, self._ids(p).tobytes()) for p in own)
        rest = [p for p in pieces if p not in fresh] if own else pieces
        for at in range(0, len(rest), 512):
            part = rest[at : at + 512]
            ids = self._ids(f" {self.mark} ".join(part))
            ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            data, w, at_id = ids.tobytes(), self.dtype.itemsize, 0
            for p, end in zip(part, ends, strict=True):
                fresh[p] = data[w * at_id : w * end]
                at_id = end + 1

    def _learn(self, pieces: dict[str, None]) -> dict[str, bytes]:
        """Ids of pieces not remembered, which are remembered from now on."""
        get, fresh = self.known.get, {}
        of: dict[str, list[str]] = {}
        marked = []
        for p in pieces:
            if self.words is not None and p.isascii() and p.isprintable() and "<|" not in p:
                of[p] = self.words.findall(p.lower())
            else:
                marked.append(p)
        if new := [w for w in {w: None for words in of.values() for w in words} if get(w) is None]:
            self._encode_words(new, fresh)
        if marked:
            self._encode_marked(marked, fresh)
        for p, words in of.items():
            if p not in fresh:
                fresh[p] = b"".join([fresh[w] if w in fresh else self.known[w] for w in words])
        self.known.update((p, x) for p, x in fresh.items() if len(p) <= CACHE_CHARS)
        return fresh

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_ENTRIES:
            trim(self.known)
        get = self.known.get
        split = [(pieces, list(map(get, pieces))) for pieces in map(split_pieces, texts)]
        new = {p: None for pieces, found in split if None in found for p, x in zip(pieces, found) if x is None}
        fresh = self._learn(new) if new else {}
        return [b"".join([fresh[p] if x is None else x for p, x in zip(pieces, found)] if None in found else found) for pieces, found in split]


@lru_cache(maxsize=2)
def load_library(path: str) -> LibraryEncoder:
    """One encoder for all tasks of a worker."""
    return LibraryEncoder(path)


def train_dictionary(docs: DataFrame, n: int, tokenizer_path: str, eos_id: int, sample_docs: int = 2000, size: int = 65536, most_bytes: int = 8_000_000) -> bytes:
    """A zstandard dictionary from the id arrays, of ``n`` documents, of about ``sample_docs`` documents, at most ``most_bytes`` of them.

    Documented bound: only the dictionary is learned from the sample; every document is written.
    """
    share = min(1.0, sample_docs / max(n, 1))
    picked = docs.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) <= int(share * (1 << 30)))

    def run(batches):
        enc = load_library(tokenizer_path)
        end = np.asarray([eos_id], enc.dtype).tobytes()
        for (texts,) in rows(batches, ("t",)):
            yield pa.RecordBatch.from_pydict({"ids": pa.array([x + end for x in enc.encode([t or "" for t in texts])], pa.binary())})

    samples, total = [], 0
    for r in picked.mapInArrow(run, "ids binary").limit(2 * sample_docs).toLocalIterator():
        total += len(r.ids)
        if total > most_bytes:
            break
        samples.append(bytes(r.ids))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the samples themselves are the dictionary
        return b"".join(samples)[-size:]


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, eos_id: int, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> list[dict]:
    """Encode every whole text, write shards in ascending doc_id order; return the shards' manifest.

    Ranges of doc_ids hold about RANGE_CHARS characters, so their number follows
    the input; a task starts another shard after SHARD_BYTES, which bounds the
    index it holds. Shards are written under names of their own, so a retried
    task never touches another's file; the manifest lists the shards of the tasks
    that counted. It has one small row per shard, which bounds what the driver gets.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    n, chars = src.agg(F.count("*"), F.sum(F.length("t").cast("long"))).first()
    data = train_dictionary(src, n, tokenizer_path, eos_id)
    digest = hashlib.sha256(data).digest()
    with open_output(f"{folder}/dictionary") as f:
        f.write(data)

    def run(batches):
        from pyspark import TaskContext

        enc = load_library(tokenizer_path)
        end = np.asarray([eos_id], enc.dtype).tobytes()
        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(data) if data else None)
        out, index, at, total, path, part_no = None, [], 0, 0, "", 0

        def finish():
            whole = np.concatenate(index)
            out.write(whole.tobytes() + struct.pack("<QQ", at, len(whole)) + TAIL)
            out.close()
            return pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int64()), "part": pa.array([part_no], pa.int64()), "path": [path], "docs": pa.array([len(whole)], pa.int64()), "tokens": pa.array([total], pa.int64())})

        for ids, texts in rows(batches, ("k", "t")):
            if out is None:
                path = f"{folder}/shard-{TaskContext.get().partitionId():06d}-{part_no:04d}-{uuid.uuid4().hex}"
                out = open_output(path)
                out.write(head := MAGIC + bytes([enc.dtype.itemsize]) + digest)
                at = len(head)
            part = np.zeros(len(ids), ENTRY)
            frames = []
            for j, (k, x) in enumerate(zip(ids, enc.encode([t or "" for t in texts]))):
                frames.append(frame := pack.compress(x + end))
                n = len(x) // enc.dtype.itemsize + 1
                part[j] = (k is None, k or 0, at, n)
                at += len(frame)
                total += n
            out.write(b"".join(frames))
            index.append(part)
            if at >= SHARD_BYTES:
                yield finish()
                out, index, total, part_no = None, [], 0, part_no + 1
        if out is not None:
            yield finish()

    ranges = max(shuffle_partitions(spark), -(-int(chars or 0) // RANGE_CHARS))
    ordered = src.repartitionByRange(ranges, "k", F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"))
    found = ordered.mapInArrow(run, "shard long, part long, path string, docs long, tokens long").collect()
    start, manifest = 0, []
    for r in sorted(found, key=lambda r: (r.shard, r.part)):
        manifest.append(r.asDict() | {"start": start})
        start += r.tokens
    return manifest


def read_shard(path: str, dictionary: bytes):
    """(doc_id, ids as a numpy array) of each document of a shard, in order."""
    with open_input(path) as f:
        size = f.size()
        f.seek(size - 20)
        tail = f.read(20)
        at, n = struct.unpack("<QQ", tail[:16])
        if tail[16:] != TAIL:
            raise ValueError(f"{path} is cut off")
        f.seek(at)
        index = np.frombuffer(f.read(n * ENTRY.itemsize), ENTRY)
        f.seek(0)
        head = f.read(37)
        if head[:4] != MAGIC or head[5:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        dtype = np.dtype(f"<u{head[4]}")
        open_frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        ends = [*index["offset"][1:].tolist(), at]
        for e, end in zip(index, ends):
            data = f.read(end - int(e["offset"]))
            ids = np.frombuffer(open_frame.decompress(data, max_output_size=int(e["n"]) * dtype.itemsize), dtype)
            yield None if e["null"] else int(e["doc_id"]), ids


def read_document(path: str, dictionary: bytes, doc_id: int) -> np.ndarray | None:
    """Ids of one document (of several with this doc_id, the first): a binary search in the shard's index, then one frame."""
    with open_input(path) as f:
        f.seek(0)
        head = f.read(37)
        if head[:4] != MAGIC or head[5:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        f.seek(f.size() - 20)
        at, n = struct.unpack("<QQ", f.read(16))

        def entry(i: int):
            f.seek(at + i * ENTRY.itemsize)
            return np.frombuffer(f.read(ENTRY.itemsize), ENTRY)[0]

        lo, hi = 0, n
        while lo < hi:  # nulls come first, doc_ids ascend
            mid = (lo + hi) // 2
            e = entry(mid)
            lo, hi = (mid + 1, hi) if e["null"] or e["doc_id"] < doc_id else (lo, mid)
        if lo == n or (e := entry(lo))["doc_id"] != doc_id:
            return None
        end = int(entry(lo + 1)["offset"]) if lo + 1 < n else at
        dtype = np.dtype(f"<u{head[4]}")
        f.seek(int(e["offset"]))
        data = f.read(end - int(e["offset"]))
        pack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        return np.frombuffer(pack.decompress(data, max_output_size=int(e["n"]) * dtype.itemsize), dtype)


def read_tokens(spark: SparkSession, folder: str, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """One row per document from the shards: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if not manifest:
        return spark.createDataFrame([], schema)
    with open_input(f"{folder}/dictionary") as f:
        dictionary = f.read()

    def run(batches):
        for paths, starts in rows(batches, ("path", "start")):
            for path, start in zip(paths, starts):
                cols: list[list] = [[], [], [], [], []]

                def batch(cols=cols):
                    out = {"doc_id": pa.array(cols[0], pa.int64()), "start": pa.array(cols[1], pa.int64()), "n_tokens": pa.array(cols[2], pa.int64()), "ids_crc32": pa.array(cols[3], pa.int64())}
                    return pa.RecordBatch.from_pydict(out | ({"ids": pa.array(cols[4], pa.list_(pa.int64()))} if with_ids else {}))

                for doc_id, ids in read_shard(path, dictionary):
                    cols[0].append(doc_id)
                    cols[1].append(start)
                    cols[2].append(len(ids))
                    cols[3].append(zlib.crc32(ids.astype("<u4").tobytes()))
                    if with_ids:
                        cols[4].append(ids.astype(np.int64))
                    start += len(ids)
                    if len(cols[0]) >= 2000:
                        yield batch()
                        for c in cols:
                            c.clear()
                yield batch()

    shards = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long")
    return shards.repartition(len(manifest)).mapInArrow(run, schema)


def token_store(docs: DataFrame, tokenizer_path: str, eos_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Write the documents' ids to a new folder of the workspace and read them back."""
    folder = workspace(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, folder, write_tokens(docs, folder, tokenizer_path, eos_id, id_col, text_col), with_ids)
