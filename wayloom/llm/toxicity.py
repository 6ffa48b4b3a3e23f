"""Toxicity by weak supervision.

Voters look at a text and say toxic, clean or nothing: lexicons of insults,
lexicons mined from the training rows (one voter for each group of words;
each half of the rows is judged by words mined from the other half), writing
patterns, and the given label as one more voter that may err. A generative
model, fitted by expectation maximisation, estimates how often each voter speaks
and is right under either class, and how the votes hang together within a class
(a mixture of kinds of rows). The posterior labels train a linear classifier
over words, which scores every text.

Learned from: at most ``sample_rows`` labelled rows (documented bound), of
which ``train_filter`` picks the rows. Scores use the text alone.

Cases: null and empty texts get the score of a text without words; without
training rows of both classes the fixed lexicon alone decides; null labels take
no part; equal texts train once, with the largest of their labels; repeated rows
are scored each; null doc_ids stay, held_out false;
further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.bpe import rows
from wayloom.llm.common import give_back, materialize, workspace

WORD = re.compile(r"[^\W\d_]+")

# Insults in common use, by language.
LEXICONS = {
    "en": "idiot moron stupid dumb loser trash scum worthless pathetic disgusting clown imbecile fool jerk bastard bitch asshole shit fuck damn hate kill ugly freak creep",
    "de": "idiot dumm blöd arschloch scheiße abschaum versager wertlos erbärmlich widerlich müll trottel depp hurensohn drecksau",
    "fr": "idiot stupide crétin imbécile connard salaud merde ordure minable pathétique dégoûtant raté pourri abruti débile",
    "es": "idiota estúpido imbécil basura escoria inútil patético asqueroso mierda cabrón tonto perdedor payaso gilipollas",
}
#: Mined words, groups of them that vote, words a text needs to be called clean, rounds of EM and of the classifier.
MINED, GROUPS, MIN_WORDS, EM_ROUNDS, FIT_ROUNDS = 3000, 12, 5, 80, 400
#: Kinds of rows within a class: what makes the voters' votes hang together.
KINDS = 6
#: A word is mined when it is in so many training rows, so far from chance, and mostly in toxic ones.
MIN_COUNT, MIN_Z, MIN_SHARE = 3, 3.0, 0.5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def pattern_votes(text: str, n: int) -> list[int]:
    """Votes of the writing patterns: shouting, strings of marks, very short text."""
    letters = sum(map(str.isalpha, text)) or 1
    shout = sum(map(str.isupper, text)) / letters
    return [1 if shout > 0.6 and n > 5 else 0, 1 if text.count("!") > 0.2 * n + 2 else 0, -1 if n < MIN_WORDS else 0]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    accuracies: dict[str, tuple[float, float]]
    correlations: list[tuple[str, str, float]]

    def score(self, words) -> float:
        got = self.weights
        s = self.bias + sum([got[w] for w in got.keys() & set(words)])
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, s))))


def label_model(votes: np.ndarray, trusted: int, trust: float = 0.9, weight: float = 0.05, rounds: int = EM_ROUNDS, kinds: int = KINDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1, say of every voter under both classes, correlations) from votes of -1, 0, 1 (rows by voters).

    A row of a class is of one of several kinds (a language, say, or one without a
    known word). Given its kind the voters are independent, so within a class they
    are as correlated as the kinds make them: a voter that repeats another, or falls
    silent with it, counts once. ``trusted`` is the voter that names the classes
    (the given label) and depends on the class alone: posteriors start from it, and
    its say has a prior of ``trust`` worth ``weight`` of the rows; beyond that it is
    estimated, and may be outvoted, like any other.
    """
    n, m = votes.shape
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    rest = [j for j in range(m) if j != trusted]
    flat, label = hot[:, rest].reshape(n, -1), hot[:, trusted]
    post = np.where(votes[:, trusted] > 0, trust, 1 - trust)
    first = (flat @ np.random.default_rng(0).normal(size=(flat.shape[1], kinds))).argmax(1)  # equal votes start as one kind
    share = np.stack([1 - post, post])[:, :, None] * (0.8 * np.eye(kinds)[first] + 0.2 / kinds)
    sure = weight * n * np.array([[trust, 0, 1 - trust], [1 - trust, 0, trust]])
    for _ in range(rounds):
        size = share.sum(1)
        kind = (size + 1) / (size.sum(1, keepdims=True) + kinds)
        say = (np.einsum("cnk,nf->ckf", share, flat) + 0.3).reshape(2, kinds, len(rest), 3)
        say /= say.sum(3, keepdims=True)
        own = share.sum(2) @ label + sure + 0.5
        own /= own.sum(1, keepdims=True)
        prior = np.clip(post.mean(), 1e-4, 1 - 1e-4)
        odds = np.log(kind)[:, None, :] + np.einsum("nf,ckf->cnk", flat, np.log(say).reshape(2, kinds, -1)) + (np.log(own) @ label.T)[:, :, None]
        odds += np.log([1 - prior, prior])[:, None, None]
        share = np.exp(odds - odds.max((0, 2))[None, :, None])
        share /= share.sum((0, 2))[None, :, None]
        before, post = post, share[1].sum(1)
        if np.abs(post - before).max() < 1e-5:
            break
    every = np.zeros((2, m, 3))
    every[:, rest], every[:, trusted] = np.einsum("ck,ckjv->cjv", kind, say), own
    values = np.array([-1.0, 0.0, 1.0])
    off = votes - (1 - post)[:, None] * (every[0] @ values) - post[:, None] * (every[1] @ values)
    sd = off.std(0) + 1e-9
    return post, every, (off.T @ off) / n / np.outer(sd, sd)


def fit_linear(indptr: np.ndarray, cols: np.ndarray, target: np.ndarray, width: int, l2: float = 0.02, rounds: int = FIT_ROUNDS) -> tuple[np.ndarray, float]:
    """Logistic regression on presence features and soft labels, by Adam over whole passes."""
    n = len(target)
    row = np.repeat(np.arange(n), np.diff(indptr))
    w, b = np.zeros(width), math.log((target.mean() + 1e-4) / (1 - target.mean() + 1e-4))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, w[cols], n)
        e = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - target
        g = np.append(np.bincount(cols, e[row], width) + l2 * w, e.sum()) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fixed_model() -> Model:
    return Model({w: 4.0 for x in LEXICONS.values() for w in x.split()}, -2.0, {}, [])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most about ``sample_rows`` labelled rows that aren't held out."""
    spark = docs.sparkSession
    usable = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("k is not null and y is not null").where(~held_out(F.col("k")))
    n = usable.count()
    if n == 0:
        return fixed_model()
    picked = usable.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(min(1.0, sample_rows / n) * (1 << 30)) + 1).groupBy("k").agg(F.max("y").alias("y")).limit(2 * sample_rows)
    texts = docs.select(F.col(id_col).alias("k"), F.coalesce(text_col, F.lit("")).alias("t")).join(F.broadcast(picked), "k").groupBy("t").agg(F.max("y").alias("y"))
    texts = materialize(texts.select("t", "y", F.pmod(F.xxhash64("t"), F.lit(2)).cast("int").alias("half")), workspace(spark, "toxic-train"))

    def counts(batches):
        seen = [Counter() for _ in range(4)]  # by half and label
        for ts, ys, hs in rows(batches, ("t", "y", "half")):
            for t, y, h in zip(ts, ys, hs):
                seen[2 * h + int(y > 0)].update(set(words_of(t)))
        words = list({w for x in seen for w in x})
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"w": part} | {f"c{i}": pa.array([x[w] for w in part], pa.int64()) for i, x in enumerate(seen)})

    size = {(r.half, r.y): r.n for r in texts.groupBy("half", (F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    if not all(sum(size.get((h, y), 0) for h in (0, 1)) for y in (0, 1)):
        return fixed_model()
    total = texts.mapInArrow(give_back(counts), "w string, c0 long, c1 long, c2 long, c3 long").groupBy("w").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(4)))
    total = materialize(total.where("c0 + c1 + c2 + c3 >= 2"), workspace(spark, "toxic-words"))

    def mine(halves: tuple[int, ...], limit: int) -> dict[str, float]:
        k0, k1 = (sum(F.col(f"c{2 * h + y}") for h in halves) for y in (0, 1))
        n0, n1 = (max(1, sum(size.get((h, y), 0) for h in halves)) for y in (0, 1))
        lor = F.log((k1 + 0.5) / (n1 - k1 + 0.5)) - F.log((k0 + 0.5) / (n0 - k0 + 0.5))
        found = total.where((k0 + k1 >= MIN_COUNT) & (k1 >= MIN_SHARE * (k0 + k1))).select("w", (lor / F.sqrt(1 / (k1 + 0.5) + 1 / (k0 + 0.5))).alias("z"))
        return {r.w: r.z for r in found.where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "w").limit(limit).collect()}

    mined, by_half = mine((0, 1), MINED), [mine((1,), MINED), mine((0,), MINED)]
    lexicons = {k: set(x.split()) for k, x in LEXICONS.items()}
    vocab = sorted({*mined, *by_half[0], *by_half[1], *(w for x in lexicons.values() for w in x)})
    index = {w: i for i, w in enumerate(vocab)}

    def features(batches):
        for ts, ys, hs in rows(batches, ("t", "y", "half")):
            found, votes = [], []
            for t in ts:
                ws = words_of(t)
                found.append(sorted(index[w] for w in index.keys() & set(ws)))
                votes.append(pattern_votes(t, len(ws)))
            yield pa.RecordBatch.from_pydict({"y": pa.array([int(y > 0) for y in ys], pa.int32()), "half": pa.array(hs, pa.int32()), "f": pa.array(found, pa.list_(pa.int32())), "v": pa.array(votes, pa.list_(pa.int32()))})

    got = texts.mapInArrow(give_back(features), "y int, half int, f array<int>, v array<int>").collect()
    # Voters: a lexicon of a language; mined words dealt into groups by strength; patterns; the label.
    groups = [{index[w]: i % GROUPS for i, w in enumerate(sorted(x, key=lambda w, x=x: -x[w]))} for x in by_half]
    in_lexicon = {index[w]: [j for j, k in enumerate(lexicons) if w in lexicons[k]] for w in {w for x in lexicons.values() for w in x}}
    names = [*(f"lexicon {k}" for k in lexicons), *(f"mined {i}" for i in range(GROUPS)), "no mined word", "shouting", "marks", "short", "label"]
    votes = np.zeros((len(got), len(names)), int)
    for r, row in zip(votes, got):
        group = groups[row.half]
        for f in row.f:
            for j in in_lexicon.get(f, ()):
                r[j] = 1
            if f in group:
                r[len(lexicons) + group[f]] = 1
        k = len(lexicons) + GROUPS
        r[k] = 0 if r[:k].any() else -1
        r[k + 1 : k + 4] = row.v
        r[-1] = 1 if row.y else -1
    post, say, corr = label_model(votes, len(names) - 1)
    kept = {index[w] for w in {*mined, *(w for x in lexicons.values() for w in x)}}
    used = [[f for f in row.f if f in kept] for row in got]
    cols = np.array([f for x in used for f in x], int)
    indptr = np.cumsum([0, *map(len, used)])
    w, b = fit_linear(indptr, cols, post, len(vocab))
    pairs = [(names[i], names[j], float(corr[i, j])) for i in range(len(names)) for j in range(i) if abs(corr[i, j]) > 0.2]
    return Model({x: float(w[i]) for x, i in index.items() if abs(w[i]) > 1e-3}, b, {x: (float(say[0, j, 0]), float(say[1, j, 2])) for j, x in enumerate(names)}, pairs)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Narrow: one pass over the texts."""

    def run(batches):
        for ids, ts in rows(batches, ("k", "t")):
            s = [model.score(words_of(t or "")) for t in ts]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "score": pa.array(s, pa.float64())})

    out = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(give_back(run), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, all their columns. Narrow; null texts count as empty, repeated rows are judged each."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.filter(pa.array([model.score(words_of(t or "")) < 0.5 for t in part.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(give_back(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    return score_documents(docs, train(docs, labels, sample_rows))
