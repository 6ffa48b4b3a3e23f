"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every n words in a row of a test item are a seed. One scan of the corpus finds
seeds in whole texts and gives, for each (document, item), the stretch of words
around them. Local alignment of the stretch with the item (match 2, mismatch
-1, gap -1, over twice the item's length) is the score: 1 for a whole copy,
above ``threshold`` for edited ones, which every alignment around a shared seed
reaches whole. No seed is too frequent to count, as rarity would lose passages
that many documents share. A stretch is left out only where it shares too few words with the item
(repeats counted) for any alignment to reach the threshold.

Items go to the tasks in blocks of bounded size; more items mean more scans,
not larger blocks.

Cases: null texts hold nothing; very long ones are read whole; items of fewer
than n words are no items, items of equal words are each found; of
several stretches of one document and item the best counts, as for rows that
repeat; null doc_ids stay in the result; further columns are not read; empty
tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.bpe import rows
from wayloom.llm.common import give_back

WORD = re.compile(r"\w+")
#: Words of items in one block.
BLOCK_WORDS = 400_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def smith_waterman(a: tuple[str, ...], b: tuple[str, ...], match: int = 2, miss: int = 1, gap: int = 1) -> int:
    """Best local alignment score of two word sequences; a row at a time, gaps along a row by a running maximum."""
    if not a or not b:
        return 0
    code = {w: i for i, w in enumerate(dict.fromkeys(a))}
    x, y = np.array([code[w] for w in a]), np.array([code.get(w, -1) for w in b])
    gain = np.where(np.arange(len(code))[:, None] == y[None, :], match, -miss)
    slope = gap * np.arange(len(b))
    above, best = np.zeros(len(b) + 1, int), 0
    for c in x:
        t = np.maximum(np.maximum(above[:-1] + gain[c], above[1:] - gap), 0)
        row = np.maximum.accumulate(t + slope) - slope
        above[1:] = row
        best = max(best, int(row.max()))
    return best


def seed_index(items: list[tuple[int, tuple[str, ...]]], n: int) -> tuple[dict, list[list[tuple[int, int]]]]:
    """Seed words -> seed number; for each number the (item position in the list, word position) pairs."""
    number: dict[tuple[str, ...], int] = {}
    where: list[list[tuple[int, int]]] = []
    for i, (_, ws) in enumerate(items):
        for j in range(len(ws) - n + 1):
            s = number.setdefault(ws[j : j + n], len(number))
            if s == len(where):
                where.append([])
            where[s].append((i, j))
    return number, where


def stretches(ws: list[str], items, number: dict, where: list, n: int, threshold: float):
    """(item position, start, end, seeds) of the stretches of a text that hold seeds.

    An alignment that scores ``threshold`` has at most 2 * (1 - threshold) words
    beside its matches for each word of the item, so that margin around where a
    seed puts the item holds the whole of it.
    """
    found: dict[int, list[tuple[int, int, int]]] = {}
    for at, gram in enumerate(zip(*(ws[i:] for i in range(n)))):
        s = number.get(gram)
        if s is not None:
            for i, j in where[s]:
                found.setdefault(i, []).append((at, j, s))
    for i, hits in found.items():
        size = len(items[i][1])
        margin = math.ceil(2 * (1 - threshold) * size)
        spans: list[list] = []
        for lo, s in sorted((at - j - margin, s) for at, j, s in hits):
            hi = lo + size + 2 * margin
            if spans and lo <= spans[-1][1] and hi - spans[-1][0] <= 12 * size:
                spans[-1][1] = max(hi, spans[-1][1])
                spans[-1][2].add(s)
            else:
                spans.append([lo, hi, {s}])
        for lo, hi, seeds in spans:
            yield i, max(0, lo), min(len(ws), hi), seeds


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, n_seeds, start_word of every document and item that align above the threshold."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("i is not null and t is not null").distinct()
    total = items.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_WORDS))
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else items
        held = [(r.i, ws) for r in part.collect() if len(ws := tuple(words_of(r.t))) >= n]
        found = scan_block(docs, held, n, threshold, id_col, text_col)
        out = found if out is None else out.union(found)
    best = F.max(F.struct("score", "n_seeds", (-F.col("start_word")).alias("s"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", "b.n_seeds", (-F.col("b.s")).alias("start_word"))


def reachable(held: Counter, words: list[str]) -> int:
    """Words of the stretch that an alignment with the item (its words counted) can match at most."""
    there = Counter(words)
    return sum(min(c, there[w]) for w, c in held.items() if w in there)


def scan_block(docs: DataFrame, items: list, n: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((items, *seed_index(items, n)))

    def scan(batches):
        items, number, where = shared.value
        held = lru_cache(maxsize=20_000)(lambda i: Counter(items[i][1]))
        score = lru_cache(maxsize=20_000)(lambda i, w: smith_waterman(items[i][1], tuple(w.split(" "))) / (2 * len(items[i][1])))
        for ids, texts in rows(batches, ("k", "t")):
            out: list[list] = [[], [], [], [], []]
            for k, t in zip(ids, texts):
                ws = words_of(t)
                for i, lo, hi, seeds in stretches(ws, items, number, where, n, threshold):
                    part = ws[lo:hi]
                    if reachable(held(i), part) / len(items[i][1]) >= threshold and (v := score(i, " ".join(part))) >= threshold:
                        for c, x in zip(out, (k, items[i][0], v, len(seeds), lo)):
                            c.append(x)
            if out[0]:
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(out[0], pa.int64()), "item_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64()), "n_seeds": pa.array(out[3], pa.int32()), "start_word": pa.array(out[4], pa.int32())})

    src = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    return src.mapInArrow(give_back(scan), "doc_id long, item_id long, score double, n_seeds int, start_word int")
