"""N-gram Jaccard join with PartEnum signatures.

A document's feature set is its distinct word n-grams. Documents with equal
sets form a class. Sets are banded by size, so that sets similar enough are in
the same or neighbouring bands; in a band, similarity bounds the number k of
features in which two sets differ. PartEnum cuts the feature domain into more
than k / 2 parts by a hash and each part into three: in some part two similar
sets differ in one feature at most, so on two of its three sub-parts they
agree. Every pair of sub-parts of every part is a signature (the hash of what
the set holds there), and similar sets share one. Signatures of few features say little; a set leaves out
those with fewer than it can demand: as many parts agree as similarity asks
for, so of its parts ranked by their weakest signature it needs only those from
that rank on.

Sets that share signatures are joined into candidate groups; members of large
groups are joined anew by a finer enumeration. Within a group all sets are compared exactly (incidence matrix product, in blocks), and the
links give the components. Nothing is capped: large groups are cut into blocks,
all blocks first meet the same pivots, and what is not in the group's main
component then meets all blocks.

Classes are named by a 64-bit hash of the set, features by 64-bit hashes.

Cases: null and empty texts have an empty set and are linked with nothing;
texts of fewer than n words have their whole word sequence as one feature;
repeated rows and equal texts are one class; a null doc_id never names a
component (a component of null ids alone has a null id); further columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.bpe import rows, trim
from wayloom.llm.common import Forest, connected_components, give_back, materialize, maybe_broadcast, remove, shuffle_partitions, workspace

U = np.uint64
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
ODD = U(0x9E3779B97F4A7C15)
#: Signatures a task packs together, and those one reducing partition should get.
CHUNK, PER_PARTITION = 400_000, 1_000_000
#: Partitions of a shuffle of packs at most; more parts of signatures than that take two rounds.
WIDE = 4096
#: (sub-parts of a part, d) for all sets and for the members of large groups; share of parts above the least number.
COARSE, FINE, SLACK = (3, 1), (6, 3), 0.3
#: Sets and features in one block of a group.
BLOCK_SETS, BLOCK_FEATURES = 1000, 1_000_000
#: Features that one comparing partition should get; words a worker remembers.
PER_COMPARISON, WORD_CACHE = 4_000_000, 150_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters."""
    x = x ^ (x >> U(30))
    x = x * MIX1
    x = x ^ (x >> U(27))
    x = x * MIX2
    return x ^ (x >> U(31))


class Shingler:
    def __init__(self, n: int):
        self.n = n
        self.words: dict[bytes, int] = {}
        self.odd = [mix(np.array([i + 1], U) * ODD)[0] | U(1) for i in range(n)]

    def features(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of a text's n-grams; A-Z lower-cased, words between ASCII blanks."""
        ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not ws:
            return np.empty(0, U)
        if len(ws) < self.n:
            return np.array([xxhash.xxh3_64_intdigest(b"\0".join(ws), seed=len(ws))], U)
        known = self.words
        if new := [w for w in ws if w not in known]:
            if len(known) > WORD_CACHE:
                trim(known)
                new = [w for w in ws if w not in known]
            for w in new:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, ws), U, len(ws))
        m = len(ws) - self.n + 1
        out = np.zeros(m, U)
        for i, c in enumerate(self.odd):
            out += h[i : i + m] * c
        return np.unique(mix(out))


def class_hash(f: np.ndarray) -> int:
    """A signed 64-bit name of a feature set."""
    if not len(f):
        return 0
    return int(mix(np.array([mix(f ^ ODD).sum(dtype=U) + U(len(f))], U)).view(np.int64)[0])


class Bands:
    """Size bands for a similarity of ``percent`` or more; scheme j serves bands j - 1 and j."""

    def __init__(self, percent: int):
        self.percent = percent
        self.upper = [0]

    def of(self, size: int) -> int:
        while self.upper[-1] < size:
            self.upper.append(100 * (self.upper[-1] + 1) // self.percent)
        return int(np.searchsorted(self.upper, size))

    def most(self, j: int) -> int:
        while len(self.upper) <= j:
            self.upper.append(100 * (self.upper[-1] + 1) // self.percent)
        return self.upper[j]

    def differ(self, size: int, j: int) -> int:
        """Features in which a set of this size differs at most from a similar one under scheme j."""
        t = self.percent
        return min(2 * self.most(j) * (100 - t) // (100 + t), size * (100 - t) // t)

    def parts(self, j: int, d: int) -> int:
        least = self.differ(self.most(j) * 2, j) // (d + 1)
        return least + 1 + int(np.ceil(SLACK * least))


def signatures(f: np.ndarray, bands: Bands, scheme: tuple[int, int] = COARSE) -> np.ndarray:
    """The PartEnum signatures of a feature set, in both its bands."""
    out = []
    subs, d = scheme
    choices = np.array([*combinations(range(subs), subs - d)])
    b = bands.of(len(f))
    for j in (b, b + 1):
        if bands.differ(bands.most(j), j) == 0:
            continue  # equal sets alone are similar: the class has them
        n1 = bands.parts(j, d)
        x = mix(f ^ mix(np.array([j], U) * ODD))
        part = ((x >> U(32)) * U(n1)) >> U(32)
        cell = (part * U(subs) + (x & U(0xFFFFFFFF)) * U(subs) // U(1 << 32)).astype(np.int64)
        total, count = np.zeros(n1 * subs, U), np.bincount(cell, minlength=n1 * subs)
        np.add.at(total, cell, mix(x ^ ODD))
        sums = total.reshape(n1, subs)[:, choices].sum(2, dtype=U)
        sizes = count.reshape(n1, subs)[:, choices].sum(2)
        name = mix(sums + sizes.astype(U)) ^ mix((np.arange(sums.size, dtype=U).reshape(sums.shape) + U(j << 32)) * ODD)
        # The most features to ask for: the parts whose smallest signature has fewer must be fewer than those that agree.
        agree = n1 - bands.differ(len(f), j) // (d + 1)
        ask = np.partition(sizes.min(1), agree - 1)[agree - 1]
        out.append(mix(name[sizes >= ask]))
    return np.concatenate(out) if out else np.empty(0, U)


def shared_runs(sig: np.ndarray, member: np.ndarray, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Sort by signature; join members that share one; return one (signature, member) of each."""
    order = np.lexsort((member, sig))
    sig, member = sig[order], member[order]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    head = member[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
    other = member != head
    if other.any():
        pairs = np.unique(np.stack([head[other], member[other]], 1), axis=0)
        for a, b in pairs.tolist():
            forest.join(a, b)
    return sig[first], member[first]


SCHEMA = "kind string, p int, doc_id long, n long, h long, g long, sigs binary, low binary, idx binary, names binary"
FIELDS = {"kind": pa.string(), "p": pa.int32(), "doc_id": pa.int64(), "n": pa.int64(), "h": pa.int64(), "g": pa.int64(), "sigs": pa.binary(), "low": pa.binary(), "idx": pa.binary(), "names": pa.binary()}


def batch_of(**cols) -> pa.RecordBatch:
    size = max(len(v) for v in cols.values())
    return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(size, t) for c, t in FIELDS.items()], names=[*FIELDS])


def scattered(sig: np.ndarray) -> np.ndarray:
    return mix(sig ^ MIX1)


def packs(held: dict[int, np.ndarray], parts: int):
    """Batches for the reducers from the signatures of some classes: packs by partition, and the pairs already found."""
    sig = (np.concatenate([*held.values()]) if held else np.empty(0, U)) >> U(16)
    member = np.repeat(np.fromiter(held, np.int64, len(held)), [len(x) for x in held.values()])
    yield from dealt(sig, member, lambda s: (scattered(s) % U(parts)).astype(np.int64), parts)


def dealt(sig: np.ndarray, member: np.ndarray, part_of, parts: int):
    """Packs by part of signatures (48 bits) and their classes, one class of each signature, and pairs of the classes that share one."""
    forest = Forest()
    sig, member = shared_runs(sig, member, forest)
    to = part_of(sig)
    order = np.argsort(to, kind="stable")
    sig, member, to = sig[order], member[order], to[order]
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else np.zeros(1, int)
    out: list[list] = [[], [], [], [], []]
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        for at in range(lo, hi, 60_000):  # numbers of classes have 16 bits
            s, m = sig[at : min(hi, at + 60_000)], member[at : min(hi, at + 60_000)]
            known, idx = np.unique(m, return_inverse=True)
            for c, v in zip(out, (int(to[lo]), (s >> U(16)).astype("<u4").tobytes(), (s & U(0xFFFF)).astype("<u2").tobytes(), idx.astype("<u2").tobytes(), known.astype("<i8").tobytes())):
                c.append(v)
    if out[0]:
        yield batch_of(kind=["sig"] * len(out[0]), p=out[0], sigs=out[1], low=out[2], idx=out[3], names=out[4])
    a, b = forest.edges()
    if len(a):
        yield batch_of(kind=["edge"], p=[abs(int(a[0])) % parts], sigs=[a.astype("<i8").tobytes()], low=[b.astype("<i8").tobytes()])


def unpacked(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and classes of packs."""
    sig = np.concatenate([(np.frombuffer(s, "<u4").astype(U) << U(16)) | np.frombuffer(w, "<u2").astype(U) for s, w, _, _ in held])
    return sig, np.concatenate([np.frombuffer(names, "<i8")[np.frombuffer(i, "<u2")] for _, _, i, names in held])


def repack(coarse: int, fine: int):
    """The first of two rounds: packs of a coarse part, a bounded number at a time, dealt to its fine parts; other rows as they are."""

    def part_of(sig: np.ndarray) -> np.ndarray:
        h = scattered(sig)
        return (h % U(coarse) + U(coarse) * (h // U(coarse) % U(fine))).astype(np.int64)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            kinds = np.array(batch.column("kind").to_pylist())
            if len(rest := np.flatnonzero(kinds != "sig")):
                yield batch.take(pa.array(rest)).select([*FIELDS])
            for i in np.flatnonzero(kinds == "sig").tolist():
                held.append(tuple(batch.column(c)[i].as_py() for c in ("sigs", "low", "idx", "names")))
                size += len(held[-1][0]) // 4
                if size >= 4 * CHUNK:
                    yield from dealt(*unpacked(held), part_of, coarse * fine)
                    held, size = [], 0
        if held:
            yield from dealt(*unpacked(held), part_of, coarse * fine)

    return run


def reduce_packs(batches):
    """Rows of other kinds as they are; of a partition's packs, pairs that join the classes which share signatures."""
    at, held = None, []

    def finish():
        forest = Forest()
        shared_runs(*unpacked(held), forest)
        a, b = forest.edges()
        return [batch_of(kind=["edge"], p=[0], sigs=[a.astype("<i8").tobytes()], low=[b.astype("<i8").tobytes()])] if len(a) else []

    for batch in batches:
        kinds = np.array(batch.column("kind").to_pylist())
        rest = np.flatnonzero(kinds != "sig")
        if len(rest):
            yield batch.take(pa.array(rest)).select([*FIELDS])
        for i in np.flatnonzero(kinds == "sig").tolist():
            p = batch.column("p")[i].as_py()
            if p != at:
                if held:
                    yield from finish()
                at, held = p, []
            held.append(tuple(batch.column(c)[i].as_py() for c in ("sigs", "low", "idx", "names")))
    if held:
        yield from finish()


def found_by(emitted: DataFrame, parts: int, path: str) -> DataFrame:
    """Reduce packs, dealt to at most WIDE coarse parts; rows of documents and packs of pairs, written below ``path``.

    A reducer holds the packs of one part at a time, about PER_PARTITION
    signatures. Parts beyond WIDE come from a round that cuts each coarse part
    anew, so neither shuffles nor the rows of a pack grow with maps times parts.
    """
    coarse, fine = min(parts, WIDE), -(-parts // WIDE)

    def by_part(df: DataFrame) -> DataFrame:
        return df.repartition(coarse, "p").sortWithinPartitions("p", "kind")

    if fine > 1:
        emitted = by_part(emitted).mapInArrow(give_back(repack(coarse, fine)), SCHEMA)
    found = by_part(emitted).mapInArrow(give_back(reduce_packs), SCHEMA)
    found.select("kind", "doc_id", "n", "h", F.col("sigs").alias("a"), F.col("low").alias("b")).write.partitionBy("kind").parquet(path)
    return emitted.sparkSession.read.schema("doc_id long, n long, h long, a binary, b binary, kind string").parquet(path)


def pairs_of(found: DataFrame) -> DataFrame:
    """(a, b): of the packs of pairs that a task reads, a spanning forest."""

    def run(batches):
        forest = Forest()
        for lefts, rights in rows(batches, ("a", "b"), 16):
            for x, y in zip(lefts, rights):
                for a, b in zip(np.frombuffer(x, "<i8").tolist(), np.frombuffer(y, "<i8").tolist()):
                    forest.join(a, b)
                if len(forest.up) >= CHUNK:
                    a, b = forest.edges()
                    yield pa.RecordBatch.from_pydict({"a": a, "b": b})
                    forest = Forest()
        a, b = forest.edges()
        yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return found.where("kind = 'edge'").select("a", "b").mapInArrow(give_back(run), "a long, b long")


def candidates(docs: DataFrame, n: int, percent: int, path: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, h) of every document, and (a, b) pairs of classes that join candidate groups.

    One pass over the texts and one shuffle. Signatures are packed, 8 bytes each:
    48 bits of the signature and a number into the pack's list of classes. A
    pack keeps one member of a signature, so what a reducer gets of a very
    common signature is bounded by the number of packs, not of documents. Beyond
    WIDE parts there is one more shuffle of packs.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    ratio = 3 * 2 * (100 - percent) / (100 + percent)
    parts = max(shuffle_partitions(spark), int(chars / 6 * ratio / PER_PARTITION) + 1)

    def emit(batches):
        shingler, bands = Shingler(n), Bands(percent)
        held: dict[int, np.ndarray] = {}
        size = 0
        for ids, texts in rows(batches, ("k", "t")):
            sizes, names = [], []
            for t in texts:
                f = shingler.features(t)
                h = class_hash(f)
                sizes.append(len(f))
                names.append(h)
                if len(f) and h not in held:
                    held[h] = signatures(f, bands)
                    size += len(held[h])
            yield batch_of(kind=["doc"] * len(ids), p=[(i * 31 + (k or 0)) % parts for i, k in enumerate(ids)], doc_id=ids, n=sizes, h=names)
            if size >= CHUNK:
                yield from packs(held, min(parts, WIDE))
                held.clear()
                size = 0
        if held:
            yield from packs(held, min(parts, WIDE))

    back = found_by(docs.mapInArrow(give_back(emit), SCHEMA), parts, path)
    return back.where("kind = 'doc'").select("doc_id", "n", "h"), pairs_of(back)


def finer(members: DataFrame, features: int, percent: int, path: str) -> DataFrame:
    """(a, b) pairs that join candidate groups among the members (h, f) of large groups, by the finer enumeration."""
    parts = max(shuffle_partitions(members.sparkSession), int(4 * features / PER_PARTITION) + 1)

    def emit(batches):
        bands = Bands(percent)
        held: dict[int, np.ndarray] = {}
        size = 0
        for hs, fs in rows(batches, ("h", "f")):
            for h, f in zip(hs, fs):
                held[h] = signatures(np.frombuffer(f, "<u8"), bands, FINE)
                size += len(held[h])
                if size >= CHUNK:
                    yield from packs(held, min(parts, WIDE))
                    held.clear()
                    size = 0
        if held:
            yield from packs(held, min(parts, WIDE))

    return pairs_of(found_by(members.select("h", "f").mapInArrow(give_back(emit), SCHEMA), parts, path))


def in_blocks(members: DataFrame) -> DataFrame:
    """(h, g, n) with blocks, the number of blocks of the group, and block."""
    sizes = members.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_FEATURES)).cast("int")
    found = members.join(sizes.select("g", blocks.alias("blocks")), "g")
    return found.withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))


def linked(x: list[np.ndarray], y: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Whether sets are similar: x by x, or x by y. Exact: intersections are products of 0/1 rows over shared features."""
    sets = x if y is None else [*x, *y]
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    feature = np.concatenate(sets) if len(sets) else np.empty(0, U)
    order = np.argsort(feature, kind="stable")
    feature, owner = feature[order], owner[order]
    first = np.ones(len(feature), bool)
    first[1:] = feature[1:] != feature[:-1]
    number = np.cumsum(first) - 1
    shared = np.bincount(number, minlength=1)[number] > 1 if len(number) else np.empty(0, bool)
    owner, number = owner[shared], number[shared]
    if len(number):
        number = np.unique(number, return_inverse=True)[1]
    nx = len(x)
    both = np.zeros((nx, nx if y is None else len(y)), np.float32)
    width = 4096
    cuts = np.searchsorted(number, np.arange(0, (int(number[-1]) + 1 if len(number) else 0) + width, width))
    for c in range(len(cuts) - 1):
        o, k = owner[cuts[c] : cuts[c + 1]], number[cuts[c] : cuts[c + 1]] - c * width
        if not len(o):
            continue
        m = np.zeros((len(sets), min(width, int(k.max()) + 1)), np.float32)
        m[o, k] = 1
        both += m[:nx] @ (m if y is None else m[nx:]).T
    either = size[:nx, None] + (size if y is None else size[nx:])[None, :] - both.astype(np.int64)
    return 100 * both.astype(np.int64) >= percent * either


def components_of(link: np.ndarray) -> np.ndarray:
    """Smallest reachable row number of each row of a square link matrix."""
    label = np.arange(len(link))
    while True:
        new = np.where(link, label[None, :], len(label)).min(1)
        new = np.minimum(new, label)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def compare_groups(members: DataFrame, percent: int, features: int = 0) -> DataFrame:
    """(a, b) that join classes by true links, from rows (gid, side, h, f): side 0 meets side 0 and side 1; side 1 meets side 0 alone.

    A group's rows are in one partition, in order of the group, and have a bounded
    number of features; partitions are as many as ``features``, those of all rows, ask for.
    """

    def run(batches):
        at, hs, fs, sides = None, [], [], []

        def finish():
            own = [i for i, s in enumerate(sides) if s == 0]
            far = [i for i, s in enumerate(sides) if s == 1]
            a, b = [], []
            if own:
                x = [fs[i] for i in own]
                label = components_of(linked(x, None, percent))
                a += [hs[own[i]] for i in range(len(own)) if label[i] != i]
                b += [hs[own[label[i]]] for i in range(len(own)) if label[i] != i]
                if far:
                    link = linked(x, [fs[i] for i in far], percent)
                    for i, j in zip(*np.nonzero(link)) if link.sum() <= 4 * sum(link.shape) else _spanning(link):
                        a.append(hs[own[i]])
                        b.append(hs[far[j]])
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            gid, side, h = (batch.column(c).to_pylist() for c in ("gid", "side", "h"))
            f = batch.column("f")
            for i in range(batch.num_rows):
                if gid[i] != at:
                    if hs:
                        yield finish()
                    at, hs, fs, sides = gid[i], [], [], []
                hs.append(h[i])
                fs.append(np.frombuffer(f[i].as_py(), "<u8"))
                sides.append(side[i])
        if hs:
            yield finish()

    n = max(shuffle_partitions(members.sparkSession), features // PER_COMPARISON + 1)
    return members.repartition(n, "gid").sortWithinPartitions("gid").mapInArrow(give_back(run), "a long, b long")


def _spanning(link: np.ndarray):
    """Pairs that span the components of a bipartite link matrix."""
    forest = Forest()
    n = len(link)
    for i in range(n):
        js = np.flatnonzero(link[i])
        for j in js.tolist():
            if forest.root(i) != forest.root(n + j):
                forest.join(i, n + j)
                yield i, j


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links of ``percent`` or more."""
    spark = docs.sparkSession
    base = workspace(spark, "ngram-join")
    src = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    sets, edges = candidates(src, n, percent, f"{base}/found")
    groups = materialize(connected_components(edges, "candidates", thin=False).select(F.col("node").alias("h"), F.col("component").alias("g")), f"{base}/groups")
    classes = materialize(sets.where("n > 0").groupBy("h").agg(F.min("doc_id").alias("rep"), F.count("*").alias("docs"), F.max("n").alias("n")), f"{base}/classes")

    # Features of the candidates alone, made again from their texts.
    wanted = materialize(in_blocks(classes.join(groups, "h").select("h", "rep", "g", "n")), f"{base}/wanted")
    near = maybe_broadcast(wanted)
    texts = src.join(near, src.k.eqNullSafe(near.rep)).select("t", "h", "g", "blocks", "block", "n")

    def features(batches):
        shingler = Shingler(n)
        for ts, hs, gs, bs, b, ns in rows(batches, ("t", "h", "g", "blocks", "block", "n"), 64):
            got = [(h, g, x, y, m, f.astype("<u8").tobytes()) for t, h, g, x, y, m in zip(ts, hs, gs, bs, b, ns) if class_hash(f := shingler.features(t)) == h]
            if got:
                cols = list(zip(*got))
                yield pa.RecordBatch.from_pydict({"h": pa.array(cols[0], pa.int64()), "g": pa.array(cols[1], pa.int64()), "blocks": pa.array(cols[2], pa.int32()), "block": pa.array(cols[3], pa.int32()), "n": pa.array(cols[4], pa.int64()), "f": pa.array(cols[5], pa.binary())})

    have = materialize(texts.mapInArrow(give_back(features), "h long, g long, blocks int, block int, n long, f binary"), f"{base}/features")
    crowd = have.where("blocks > 1")
    if (many := crowd.agg(F.sum("n")).first()[0]) is not None:
        again = connected_components(finer(crowd, many, percent, f"{base}/finer"), "finer", thin=False).select(F.col("node").alias("h"), F.col("component").alias("g"))
        placed = materialize(in_blocks(crowd.select("h", "n").distinct().join(again, "h")), f"{base}/placed")
        moved = crowd.select("h", "f").join(maybe_broadcast(placed), "h").select("h", "g", "blocks", "block", "n", "f")
        have = materialize(have.where("blocks = 1").union(moved), f"{base}/features-placed")
    name = F.concat_ws("/", "g", "block")
    members = have.select(name.alias("gid"), F.lit(0).alias("side"), "h", "f")
    large = have.where("blocks > 1")
    split = not large.isEmpty()
    if split:
        # The same pivots for all blocks of a group: the smallest class of each of eight residues.
        pivots = large.groupBy("g", "blocks", F.pmod("h", F.lit(8)).alias("r")).agg(F.min(F.struct("h", "f")).alias("x"))
        pivots = pivots.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "x.h", "x.f")
        members = members.union(pivots.select(name.alias("gid"), F.lit(0), "h", "f"))
    features_held = have.agg(F.sum("n")).first()[0] or 0
    links = materialize(compare_groups(members, percent, features_held), f"{base}/links")
    if split:
        links = links.union(materialize(compare_rest(large, links, percent, base), f"{base}/links-rest"))

    comp = connected_components(links, "links")
    named = classes.join(comp.withColumnRenamed("node", "h"), "h", "left").where("docs > 1 or component is not null")
    named = named.withColumn("c", F.coalesce("component", "h"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    ids = materialize(named.join(least, "c").select("h", "component_id"), f"{base}/ids")
    out = sets.join(maybe_broadcast(ids), "h", "left")
    remove(spark, f"{base}/features", f"{base}/features-placed", f"{base}/groups", f"{base}/finer")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def compare_rest(large: DataFrame, links: DataFrame, percent: int, base: str) -> DataFrame:
    """Of groups in several blocks: what isn't in the main component meets all blocks."""
    comp = connected_components(links.join(large.select(F.col("h").alias("a")), "a", "left_semi"), "blocks").withColumnRenamed("node", "h")
    of = large.select("h", "g", "block").join(comp, "h", "left").withColumn("component", F.coalesce("component", "h"))
    counts = of.groupBy("g", "component").agg(F.count("*").alias("m"))
    main = counts.groupBy("g").agg(F.max(F.struct("m", F.col("component").alias("main"))).alias("x")).select("g", "x.main")
    rest = materialize(of.join(main, "g").where("component <> main").select("g", "h", "block"), f"{base}/rest")
    used = rest.select("g", "block").distinct().select("g", F.col("block").alias("i"))
    own = large.join(rest.select("h"), "h", "left_semi")
    pair = F.concat_ws("/", "g", "i", "j")
    left = own.withColumnRenamed("block", "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(pair.alias("gid"), F.lit(0).alias("side"), "h", "f")
    right = large.withColumnRenamed("block", "j").join(used, "g").select(pair.alias("gid"), F.lit(1).alias("side"), "h", "f")
    return compare_groups(left.union(right), percent)
