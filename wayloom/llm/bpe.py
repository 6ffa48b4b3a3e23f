"""BPE encoding and decoding by forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged across,
so it marks a certain cut. A word is cut at all such pairs, the fragments are
encoded independently (and remembered), and the results are concatenated.
White space is the outermost certain cut: the vocabulary's pre-tokenizer drops it.

Handled tokenizer files: those of the ``tokenizers`` library with the
normalizer NFC + white space + lower case, a Split pre-tokenizer that keeps its
matches followed by ByteLevel, a BPE model with or without an end-of-word
suffix, and no decoder (decode joins tokens with one blank).

Null text counts as empty: no tokens, decoded text empty. Row order, repeated
rows and further columns don't matter. Null ids are returned as null.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from functools import lru_cache
from itertools import islice
from sys import byteorder

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wayloom.llm.common import give_back

#: Bytes of pieces and of fragments that a worker remembers (of about ENTRY_BYTES each besides text and ids), over all its tasks.
PIECE_BYTES, FRAGMENT_BYTES, ENTRY_BYTES = 44_000_000, 22_000_000, 200
#: Longer pieces are not remembered.
CACHE_CHARS = 64


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte, by the public byte-level rule: printable Latin-1 stays, the rest goes to 256 and up."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in keep}
    for n, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + n)
    return [names[b] for b in range(256)]


def trim(cache: dict) -> None:
    """Keep the older half: frequent entries come early in a corpus."""
    for key in list(islice(reversed(cache), len(cache) - len(cache) // 2)):
        del cache[key]


def split_pieces(text: str) -> list[str]:
    """Blanks and line ends are certain cuts. Latin-1 text is lower-cased first, which the normalizer would do anyway."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.replace("\n", " ").split(" ")
    return (text if "<|" in text else text.lower()).replace("\n", " ").split(" ")


class ForcedBoundaryBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        same = {t: t for t in self.vocab}  # one string object per token
        merges = [tuple(same.get(x, x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.rank = {m: i for i, m in reversed(list(enumerate(merges)))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.named = [self.name.get(i, "").encode() for i in range(1 + max(self.name, default=0))]
        parts = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(parts[0]["pattern"]["Regex"])
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.alphabet = byte_alphabet()
        self.inner, self.final = self._pairs()
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}
        self.pieces: dict[str, bytes] = {"": b""}
        self.room = {"pieces": PIECE_BYTES, "fragments": FRAGMENT_BYTES}

    def _pairs(self) -> tuple[set[str], set[str]]:
        """Pairs inside tokens; those that end a word are kept apart, as their last symbol carries the suffix."""
        inner, final = set(), set()
        n = len(self.suffix)
        for token in self.vocab:
            ends = bool(n) and token.endswith(self.suffix) and len(token) > n
            body = token[:-n] if ends else token
            last = len(body) - 2
            for i in range(last + 1):
                (final if ends and i == last else inner).add(body[i : i + 2])
        return inner, final

    def _merge(self, symbols: list[str]) -> list[int]:
        """Lowest rank first, leftmost among equals, over a linked list with a heap."""
        n = len(symbols)
        rank = self.rank
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i] = a + b
            alive[j] = False
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            h = left[i]
            if h >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return [self.vocab[s] for s, a in zip(symbols, alive) if a and s in self.vocab]

    def _room(self, name: str, cache: dict, size: int, most: int) -> None:
        """Account for a new entry of so many bytes; a full cache loses its newer half, and half its bytes are free again."""
        self.room[name] -= ENTRY_BYTES + size
        if self.room[name] < 0:
            trim(cache)
            self.room[name] = most // 2

    def fragment(self, text: str, ends: bool) -> tuple[int, ...]:
        got = self.fragments.get((text, ends))
        if got is None:
            symbols = list(text)
            if ends:
                symbols[-1] += self.suffix
            got = tuple(self._merge(symbols))
            if len(text) <= CACHE_CHARS:
                self._room("fragments", self.fragments, len(text) + 8 * len(got), FRAGMENT_BYTES)
                self.fragments[text, ends] = got
        return got

    def cuts(self, word: str) -> list[int]:
        """Positions in the byte-level word before which a boundary is certain."""
        last = len(word) - 2
        inner, final = self.inner, self.final if self.suffix else self.inner
        return [i + 1 for i in range(last + 1) if word[i : i + 2] not in (final if i == last else inner)]

    def word(self, word: str) -> list[int]:
        """Ids of one byte-level word: fragments between certain cuts, concatenated."""
        known, out, at, last = self.fragments, [], 0, len(word) - 2
        inner, final = self.inner, self.final if self.suffix else self.inner
        for i in range(last + 1):
            if word[i : i + 2] not in (final if i == last else inner):
                part = word[at : i + 1]
                out += known.get((part, False)) or self.fragment(part, False)
                at = i + 1
        out += known.get((part := word[at:], True)) or self.fragment(part, True)
        return out

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a text without blanks or line ends."""
        if piece.isascii():
            if piece.isalpha():
                return self.word(piece.lower())
            if "<|" not in piece and piece.isprintable():  # printable ASCII stands for its own bytes
                found = self.words.findall(piece.lower())
                return self.word(found[0]) if len(found) == 1 else [i for w in found for i in self.word(w)]
        out, at = [], 0
        found = [*self.specials.finditer(piece)] if self.specials and "<" in piece else []
        for m in [*found, None]:
            part = piece[at : m.start() if m else len(piece)]
            if part:
                part = unicodedata.normalize("NFC", part)
                part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
                for w in self.words.findall(part):
                    out += self.word("".join(map(self.alphabet.__getitem__, w.encode("utf-8"))))
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return out

    def piece(self, piece: str) -> bytes:
        """Ids as 32-bit integers of this machine."""
        got = array("I", self.encode_piece(piece)).tobytes()
        if len(piece) <= CACHE_CHARS:
            self._room("pieces", self.pieces, len(piece) + len(got), PIECE_BYTES)
            self.pieces[piece] = got
        return got

    def encode_decode(self, text: str) -> tuple[bytes, bytes]:
        """Ids of a whole text as little-endian 32-bit integers, and the decoded text in UTF-8."""
        known = self.pieces
        ids = b"".join([known[p] if p in known else self.piece(p) for p in split_pieces(text)])
        whole = np.frombuffer(ids, "u4")
        return ids if byteorder == "little" else whole.astype("<u4").tobytes(), b" ".join(map(self.named.__getitem__, whole.tolist()))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_decode(text)[0], "<u4").tolist()

    def decode(self, ids) -> str:
        return " ".join(self.name[i] for i in ids if i in self.name)


@lru_cache(maxsize=4)
def load(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def rows(batches, columns: tuple[str, ...], step: int = 256):
    """Lists of values of ``columns``, ``step`` rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield tuple(part.column(c).to_pylist() for c in columns)


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` also ids and decoded.

    Narrow: no shuffle, memory bounded by one batch of rows and the worker's cache of fixed size.
    """

    def run(batches):
        bpe = load(tokenizer_path)
        for ids, texts in rows(batches, ("k", "t")):
            both = [bpe.encode_decode(t or "") for t in texts]
            out = {"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array([len(a) // 4 for a, _ in both], pa.int64()), "ids_sha256": [hashlib.sha256(a).hexdigest() for a, _ in both], "decoded_sha256": [hashlib.sha256(b).hexdigest() for _, b in both]}
            if with_ids:
                out["ids"] = pa.array([np.frombuffer(a, "<u4").astype(np.int32) for a, _ in both], pa.list_(pa.int32()))
                out["decoded"] = [b.decode() for _, b in both]
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.selectExpr(f"cast(`{id_col}` as long) k", f"`{text_col}` t").mapInArrow(give_back(run), schema)
