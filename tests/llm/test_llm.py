"""The training-data operators against brute force, exact round trips, held-out accuracy, and their edge cases."""

import hashlib
import io
import os
import random
import re
import zlib

import numpy as np
import pytest

from wayloom.llm import bpe, chat, common, decontaminate, ngram_join, pii, token_store, topk, toxicity, url_filter, warc

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def tok():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def docs(spark, rows, extra="n_shingles long, score double"):
    """Documents with columns whose names clash with results."""
    return spark.createDataFrame([(*r, 1, 0.5) for r in rows], f"doc_id long, text string, {extra}")


EDGES = [(1, "a b c d e f"), (2, None), (3, ""), (4, "x"), (4, "x"), (None, "a b c d e f"), (5, "é" * 30000 + " word"), (6, "  \n\t ")]


# 1 ---------------------------------------------------------------------------


def test_topk(spark):
    random.seed(1)
    rows = [(i, [random.gauss(0, 1) for _ in range(24)]) for i in range(300)] + [(300, None), (301, [float("nan")] * 24), (302, [1.0] * 3), (303, [None] * 24), (7, [0.25] * 24)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    topk.ROWS_PER_PACK = 50
    got = sorted(map(tuple, topk.top_inner_products(df, "k % 50 = 0", 5).collect()))
    ok = [(i, np.floor(256 * np.array(v))) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    want = []
    for i, q in ok:
        if i % 50 == 0:
            s = sorted((-int(q @ x), j) for j, x in ok if j != i and len(x) == len(q))[:5]
            want += [(i, r + 1, j, -v) for r, (v, j) in enumerate(s)]
    assert got == sorted(want)
    assert topk.top_inner_products(df.limit(0), "k % 50 = 0", 5).count() == 0


@pytest.mark.parametrize("block, lane", [(16_384, 1024), (3, 20)])
def test_topk_grid_and_huge_components(spark, monkeypatch, block, lane):
    """Small cells of the grid, and components whose products doubles can't hold; scores are set to 64 bits."""
    for name, v in {"QUERIES_PER_BLOCK": block, "ROWS_PER_LANE": lane, "ROWS_PER_PACK": 16, "QUERIES_AT_ONCE": 2}.items():
        monkeypatch.setattr(topk, name, v)
    random.seed(11)
    big = [2.0**45, -(2.0**60), 1e300, 2.0**17]
    rows = [(i, [random.choice(big) if random.random() < 0.02 else random.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(200 + i, [0.5] * 8) for i in range(5)]
    got = sorted(map(tuple, topk.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "k % 20 = 0", 3).collect()))
    whole = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows]
    want = []
    for i, q in whole:
        if i % 20 == 0:
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, x)))), j) for j, x in whole if j != i)[:3]
            want += [(i, r + 1, j, -v) for r, (v, j) in enumerate(s)]
    assert got == sorted(want)


def test_topk_bounds_hold():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 30)), rng.normal(size=(50, 30))
    for n in topk.LEVELS:
        assert (topk.statistics(x, n) @ topk.statistics(y, n).T + 1e-9 >= x @ y.T).all()


# 2 ---------------------------------------------------------------------------


@pytest.mark.parametrize("version", [1, 2])
def test_arc_to_warc(version):
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    legacy = warc.write_arc([("http://a.b/c", "text/html", body), ("dns:a.b", "text/dns", b"x"), ("ftp://f/g", "image/png", b"\n\n")], version, "19970102030405")
    out = [*warc.convert_arc(io.BytesIO(legacy))]
    assert [r.headers["WARC-Type"] for r in out] == ["warcinfo", "response", "response", "resource"]
    assert out[1].payload == b"hello" and out[1].headers["WARC-Date"] == "1997-01-02T03:04:05Z" and out[3].block == b"\n\n"
    back = [*warc.load_warc(io.BytesIO(b"".join(map(warc.dump_warc, out))), 7)]
    assert [(r.block, r.headers["WARC-Payload-Digest"]) for r in back] == [(r.block, r.headers["WARC-Payload-Digest"]) for r in out]
    with pytest.raises(ValueError):
        [*warc.convert_arc(io.BytesIO(legacy[:-3]))]


def test_archives(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/ c", "same"), (3, None, None), (4, "x", ""), (None, "u", "one"), (2**62, "http://d", "é"), (-5, "http://e", "é")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record_type string")
    got = {r.page_id: r for r in warc.archive_pages(df).collect()}
    assert (got[1].record_type, got[1].refers_to, got[2].record_type) == ("revisit", 2, "response")
    assert (got[3].record_type, got[3].refers_to, got[3].payload_bytes) == ("revisit", 4, 0)
    assert got[-5].refers_to == 2**62 and got[None].record_type == "response"
    assert got[1].payload_digest == warc.sha1_base32(b"same") and got[1].payload_bytes == 4
    assert warc.archive_pages(df.limit(0)).count() == 0
    urls = [(1, "ftp://f.org/x"), (2, "HTTPS://a.org/"), (3, "no scheme"), (4, "filedesc://x"), (5, "dns:a"), (6, None), (7, " ")]
    long = "é" * 300_000
    kept = {r.page_id: r for r in warc.archive_pages(spark.createDataFrame([(i, u, f"{long}{i}") for i, u in urls], "page_id long, url string, html string")).collect()}
    assert [kept[i].target_uri for i in range(1, 8)] == ["ftp://f.org/x", "HTTPS://a.org/", "no%20scheme", "filedesc://x", "dns:a", "urn:wayloom:page:6", "urn:wayloom:page:7"]
    assert {(r.record_type, r.payload_bytes) for r in kept.values()} == {("response", 600_001)}
    for k in (None, 0, -1, 2**63 - 1, -(2**63)):
        assert warc.id_key(warc.key_id(k)) == k


# 3 ---------------------------------------------------------------------------


def test_url_filter(spark):
    random.seed(2)
    hosts = ["a.org", "b.a.org", "xa.org", "A.ORG", "org", "com", "q.com", "", "a.org:80", "com,x", "org,a", "a..org", ".org", "a.org0", "b.a.org,c", "\U0010ffff.a.org", "a.org\U0010ffff"]
    paths = ["", "/", "/x", "/x/y", "/z?q=/x", "#/x"]
    rows = [(i, f"http://{random.choice(hosts)}{random.choice(paths)}") for i in range(800)] + [(5000 + i, "http://hot.a.org/x/y") for i in range(500)] + [(900, None), (901, "no scheme"), (902, "://")]
    rules = [("block", "a.org", "/x"), ("allow", "org", "/"), ("block", "b.a.org", "/"), ("allow", "a.org", "/x/y"), ("block", "com", "/z"), ("block", "", "/")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, url_filter.rules_frame(spark, rules)).collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        host = path = ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            host, path = m[1].lower(), m[2]
        fit = [r for r in rules if r[1] and (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fit, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
        assert got[i] == (host, path, best and best[1] + best[2], best[0] if best else "allow"), u
    assert url_filter.filter_urls(df.limit(0), url_filter.rules_frame(spark, rules)).count() == 0
    twice = url_filter.filter_urls(df.union(df), url_filter.rules_frame(spark, [*rules, ("allow", "a.org", "/x")])).collect()
    assert len(twice) == 2 * len(rows) and {r.verdict for r in twice if r.rule == "a.org/x"} == {"allow"}


# 4, 7 ------------------------------------------------------------------------


def test_token_store(spark, tok):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tok)
    rows = [*EDGES, *[(100 + i, f"Some words number {i} here!") for i in range(50)], (99, "x <|endoftext|> y")]
    got = sorted(token_store.token_store(docs(spark, rows), tok, 2, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    start = 0
    by = {}
    for k, t in rows:
        by.setdefault(k, []).append([*lib.encode(t or "", add_special_tokens=False).ids, 2])
    for r in got:
        ids = next(x for x in by[r.doc_id] if x == r.ids)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.token_store(docs(spark, rows).limit(0), tok, 2).count() == 0


def test_token_store_short_access(spark, tok):
    folder = common.workspace(spark, "tokens")
    df = docs(spark, [(i, f"text {i}") for i in range(20)])
    manifest = token_store.write_tokens(df, folder, tok, 2)
    with common.open_input(f"{folder}/dictionary") as f:
        d = f.read()
    hits = [x for m in manifest if (x := token_store.read_document(m["path"], d, 7)) is not None]
    assert len(hits) == 1 and hits[0].tolist() == [*bpe.load(tok).encode("text 7"), 2]
    assert token_store.read_document(manifest[0]["path"], d, 99) is None
    with pytest.raises(ValueError):
        next(token_store.read_shard(manifest[0]["path"], d + b"x"))
    with pytest.raises(ValueError):
        token_store.read_document(manifest[0]["path"], d + b"x", 7)


def test_token_store_rolls_shards(spark, tok, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_BYTES", 100)
    rows = [(i // 2, f"some text of document {i}") for i in range(2000)] + [(None, "x")]
    df = docs(spark, rows).coalesce(1)
    folder = common.workspace(spark, "tokens")
    manifest = token_store.write_tokens(df, folder, tok, 2)
    assert len(manifest) > 4 and sum(m["docs"] for m in manifest) == len(rows)
    got = sorted(token_store.read_tokens(spark, folder, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted(i // 2 for i in range(2000))]
    assert [r.start for r in got[1:]] == np.cumsum([r.n_tokens for r in got])[:-1].tolist()


def test_library_encoder_remembers_rightly(tok, monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tok)
    monkeypatch.setattr(token_store, "CACHE_ENTRIES", 40)
    enc, pick = token_store.LibraryEncoder(tok), random.Random(3)
    parts = ["word", "Don't", "''t", "b.", "c,", "İ", "Σς", "é", "12a3", "<|endoftext|>", "<|EndOfText|>", "<|", "</w>", "\t", "\x1f", "\x85", "中", "\U0001f600", "z" * 100, " ", "\n"]
    for _ in range(40):
        texts = ["".join(pick.choice(parts) + pick.choice([" ", "", str(pick.randrange(50))]) for _ in range(30)) for _ in range(10)]
        assert enc.encode(texts) == [np.asarray(lib.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert all(len(p) <= token_store.CACHE_CHARS for p in enc.known)


def test_bpe_is_the_library(tok):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(tok), bpe.load(tok)
    random.seed(3)
    letters = "aAbzZ 's'llé́ΣσςİıßǅА中😀\t\r\x0b\x1c\x85\xa0 ٣²½_-!?\n\x00﻿한"
    for _ in range(4000):
        t = "".join(random.choice(letters) if random.random() < 0.9 else random.choice(["<|endoftext|>", "<|startoftext|>", "the ", "I'm ", "Hello"]) for _ in range(random.randint(0, 30)))
        want = lib.encode(t, add_special_tokens=False).ids
        ids, text = own.encode_decode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(t)
        assert text.decode() == lib.decode(want, skip_special_tokens=False)


def test_certain_cuts(tok):
    own = bpe.load(tok)
    for w in ("xqzjkvw", "internationalization", "qqqq"):
        whole = own._merge([*w[:-1], w[-1] + own.suffix])
        assert own.word(w) == whole
    assert any(own.cuts(a + b) for a in "qxzj" for b in "qxzj\x80Ā")


def test_bpe_rows(spark, tok):
    got = bpe.bpe_round_trip(docs(spark, EDGES), tok).collect()
    assert len(got) == len(EDGES)
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id in (2, 3, 6)} == {(0, empty, empty)}


# 5 ---------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    random.seed(4)
    good, bad = [f"w{i}" for i in range(200)], ["idiot", "grobaz", "moron", "trash"]
    words = [re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], w) for w in good]
    rows, labels = [], []
    for i in range(1500):
        y = int(random.random() < 0.2)
        t = [random.choice(words) for _ in range(40)]
        if y:
            t[3:3] = random.sample(bad, 2)
        rows.append((i, " ".join(t)))
        labels.append((i, 1, y if random.random() > 0.02 else 1 - y))
    d = docs(spark, [*rows, (None, "idiot"), (5000, None), (5001, ""), (5002, "idiot trash moron " * 7000)])
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5003, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(d, lab).collect()
    truth = {i: int(any(w in bad for w in t.split())) for i, t in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert {r.doc_id: r.predicted for r in got if r.doc_id in (5000, 5001, 5002)} == {5000: 0, 5001: 0, 5002: 1}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert toxicity.toxicity(d, lab.limit(0)).count() == len(got) and toxicity.toxicity(d.limit(0), lab).count() == 0


def test_shouting_is_judged_by_the_whole_text():
    calm, loud = "word " * 5000, "WORD " * 5000
    assert toxicity.pattern_votes(calm + loud * 2, 15000)[0] == 1 and toxicity.pattern_votes(loud + calm * 2, 15000)[0] == 0


def test_label_model_finds_the_good_voter():
    rng = np.random.default_rng(5)
    y = rng.random(3000) < 0.3
    vote = lambda acc: np.where(rng.random(3000) < acc, np.where(y, 1, -1), np.where(y, -1, 1))
    a = vote(0.7)
    votes = np.stack([vote(0.95), vote(0.6), a, a, vote(0.95)], 1)
    post, say, corr = toxicity.label_model(votes, 4)
    assert ((post > 0.5) == y).mean() > 0.95 and say[1, 0, 2] > say[1, 1, 2] and corr[2, 3] > 0.9


def test_label_model_estimates_accuracies():
    """Of voters, the given label too; one that others repeat doesn't outvote better ones, and labels don't settle the posterior."""
    rng = np.random.default_rng(6)
    y = rng.random(8000) < 0.3
    vote = lambda acc: np.where(rng.random(8000) < acc, np.where(y, 1, -1), np.where(y, -1, 1))
    bad = vote(0.6)
    votes = np.stack([vote(0.9), vote(0.85), bad, bad, bad, bad, bad, vote(0.8)], 1)
    post, say, _ = toxicity.label_model(votes, 7)
    for j, acc in ((0, 0.9), (1, 0.85), (7, 0.8)):
        assert abs(say[0, j, 0] - acc) < 0.06 and abs(say[1, j, 2] - acc) < 0.08, (j, say[:, j])
    assert ((post > 0.5) == y).mean() > max(0.9, ((votes[:, 7] > 0) == y).mean() + 0.05)
    assert ((post > 0.5) != (votes[:, 7] > 0)).mean() > 0.1


# 6 ---------------------------------------------------------------------------


def test_leaks(spark):
    random.seed(6)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(random.choice(vocab) for _ in range(30))) for i in range(8)] + [(90, None), (91, "v1 v2")]
    rows, want = [], set()
    for i in range(300):
        t = [random.choice(vocab) for _ in range(80)]
        if i % 10 == 0:
            k = i // 10 % 8
            w = items[k][1].split()
            for _ in range(4):
                w[random.randrange(len(w))] = "edited"
            t[20:20] = w if i % 20 else [x.upper() + "," for x in items[k][1].split()]
            want.add((i, k))
        rows.append((i, " ".join(t)))
    d = docs(spark, [*rows, *EDGES[1:3], (None, items[0][1])])
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = decontaminate.find_leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id is not None} == want and any(r.doc_id is None for r in got)
    assert decontaminate.find_leaks(d, b.limit(0)).count() == 0 and decontaminate.find_leaks(d.limit(0), b).count() == 0


def test_leaks_with_frequent_seeds(spark):
    """Copies that more than 50 documents share, and have one seed only."""
    items = [(1, "alpha beta gamma"), (2, "a b c d"), (3, "h0 h1 h2 h3 h4 h5 h6 h7 h8 h9 h10 h11 h12 h13 h14"), (4, "p q r s t u v w")]
    edited = "h0 h1 h2 X h3 h4 X h5 h6 X h7 h8 X h9 X h10"
    texts = [f"u{{0}} alpha beta gamma w{{0}} u{{0}} a b c x{{0}} {'z{0} ' * 12}{edited} {'y{0} ' * 12}p q r w{{0}}".format(i) for i in range(60)]
    got = decontaminate.find_leaks(docs(spark, list(enumerate(texts))), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.score, r.n_seeds) for r in got} == {(i, k): v for i in range(60) for k, v in ((1, (1.0, 1)), (2, (0.75, 1)), (3, (17 / 30, 1)))}


def test_leaks_as_brute_force(spark):
    """Every document against every item, edited copies included; the pairs without a seed in common are left out."""
    random.seed(16)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, [random.choice(vocab) for _ in range(random.choice([3, 5, 12, 25]))]) for i in range(12)]
    items += [(100 + i, items[3][1]) for i in range(10)]
    rows = []
    for i in range(120):
        t = [random.choice(vocab) for _ in range(random.choice([0, 10, 80, 400]))]
        for _ in range(random.randint(0, 3)):
            w = list(random.choice(items)[1])
            for _ in range(random.randint(0, 8)):
                p = random.randrange(len(w))
                w[p : p + 1] = random.choice([["x", w[p]], [], ["x"], [w[p], "x", "x"]]) if len(w) > 2 else w[p : p + 1]
            at = random.randint(0, len(t))
            t[at:at] = w
        rows.append((i, " ".join(t)))
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(docs(spark, [*rows, *rows[:7]]), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    grams = lambda w: {*zip(w, w[1:], w[2:])}
    want = {}
    for i, t in rows:
        ws = t.split()
        for k, w in items:
            if grams(ws) & grams(w) and (v := decontaminate.smith_waterman(tuple(w), tuple(ws)) / (2 * len(w))) >= 0.5:
                want[i, k] = v
    assert got == want and sum(v < 1 for v in want.values()) > 20
    assert sum(k >= 100 for _, k in want) == 10 * sum(k == 3 for _, k in want) > 0


def test_smith_waterman():
    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        return max(map(max, h))

    random.seed(7)
    for _ in range(200):
        a, b = (tuple(random.choice("abc") for _ in range(random.randint(1, 12))) for _ in range(2))
        assert decontaminate.smith_waterman(a, b) == plain(a, b)


# 8 ---------------------------------------------------------------------------


def test_chat(spark):
    rows = [
        (1, 0, "user", "First line\nSecond  line"),
        (1, 1, "user", "Another topic"),
        (1, 2, "assistant", "> first LINE\n> second line\nMy answer"),
        (1, 3, "user", "> > First line\n> My answer\nThanks"),
        (1, 4, "user", "> nobody said this\nHm"),
        (2, 0, None, None),
        (2, 1, "user", "> First line\nother conversation"),
        (None, 5, "user", "> x"),
        (3, None, "user", "no turn"),
        (1, 600, "user", "> another topic\nlate"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position int")
    got = {(r.conv_id, r.turn): r for r in chat.format_conversations(df).collect()}
    assert len(got) == len(rows)
    assert [got[1, t].reply_to for t in (0, 1, 2, 3, 4, 600)] == [None, None, 0, 2, None, 1]
    assert [got[1, t].thread for t in (0, 2, 3, 600)] == [0, 0, 0, 1]
    assert [t for _, t in sorted((r.position, k[1]) for k, r in got.items() if k[0] == 1)] == [0, 2, 3, 1, 600, 4]
    assert got[1, 2].text == "My answer" and got[1, 3].quote_depth == 2 and got[2, 1].reply_to is None
    assert got[1, 2].formatted == "<|assistant|>\nMy answer\n<|end|>\n"
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_passages(spark):
    """Re-wrapped quotations: between answers, of one paragraph of several, and of all of them without the blank line."""
    two = "one two three\nfour five\n\nsix seven\neight nine ten"
    rows = [
        (1, 0, two),
        (1, 1, "> one two\n> three four five\nMy answer\n> six\n> seven eight nine ten\nMore"),
        (2, 0, two),
        (2, 1, "> six seven eight\n> nine ten\nYes"),
        (3, 0, two),
        (3, 1, "> one two three four\n> five six\n> seven eight\n> nine ten\nAll of it"),
        (4, 0, "x y\n> quoted\nz w\nv"),
        (4, 1, "> z\n> w v\nAfter the quotation"),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in chat.format_conversations(df).collect()}
    assert [got[c, 1].reply_to for c in (1, 2, 3, 4)] == [0, 0, 0, 0]
    assert [got[c, 1].n_linked for c in (1, 2, 3, 4)] == [3, 1, 1, 1]


def brute_chat(rows):
    """(reply_to, n_linked, thread) of each (conv, turn), and the positions of all rows, by plain loops."""

    def units(text, quoted):
        lines = []
        for line in re.split(r"\r?\n", text):
            marks = re.match(r"(?:[ \t]*>)*", line)[0]
            lines.append((marks.count(">"), re.sub(r"\s+", " ", line[len(marks) :]).strip(" ").lower()))
        out, runs, last = [], [], None
        for level, norm in lines:
            if not norm:
                last = None
                continue
            if last != level:
                runs.append((level, []))
            runs[-1][1].append(norm)
            last = level
        runs = [r for r in runs if (r[0] > 0) == quoted]
        out += [(level, x) for level, xs in runs for x in xs] + [(level, " ".join(xs)) for level, xs in runs if len(xs) > 1]
        wide = []
        for level, xs in runs:
            if wide and wide[-1][0] == level:
                wide[-1][1].append(xs)
            else:
                wide.append((level, [xs]))
        return out + [(level, " ".join(x for xs in xss for x in xs)) for level, xss in wide if len(xss) > 1]

    known = {(c, t, x or "") for c, t, _, x in rows if c is not None and t is not None}
    links = {}
    for c, t in {(c, t) for c, t, _ in known}:
        per = {}
        for x in [x for d, u, x in known if (d, u) == (c, t)]:
            for level, norm in units(x, True):
                src = [u for d, u, y in known if d == c and u < t and any(norm == z for _, z in units(y, False))]
                if src:
                    n, size = per.get((level, max(src)), (0, 0))
                    per[level, max(src)] = (n + 1, size + len(norm))
        if per:
            links[c, t] = (max((-level, size, src) for (level, src), (_, size) in per.items())[2], sum(n for n, _ in per.values()))

    def root(c, t):
        return root(c, links[c, t][0]) if (c, t) in links else t

    return {(c, t): (*links.get((c, t), (None, 0)), root(c, t)) for c, t, _, _ in rows}


def test_chat_as_brute_force(spark):
    random.seed(18)
    words = "one two three four five six seven".split()
    rows = []
    for c in range(12):
        said = []
        for t in range(14):
            lines = []
            for _ in range(random.randint(0, 6)):
                own = " ".join(random.choice(words) for _ in range(random.randint(1, 3)))
                old = random.choice(said).split("\n") if said else ["none"]
                lines += random.choice([[own], [own, own + " x"], [""], [f"> {x}" for x in old], [f">  {random.choice(old).upper()}"], ["> " + " ".join(x for x in old if not x.startswith(">"))], [f"> > {own}"]])
            said.append("\n".join(lines))
            rows.append((c, t * random.choice([1, 200]), random.choice("ab"), random.choice([said[-1], None]) if random.random() < 0.1 else said[-1]))
    rows += [(0, 5, "a", "> one\nother"), (20, 0, "a", "q" * 200_000), (20, 1, "a", "> " + "Q" * 200_000)]
    df = spark.createDataFrame([(*r, 1) for r in [*rows, *rows]], "conv_id long, turn long, role string, text string, position int")  # every row twice
    got = chat.format_conversations(df).collect()
    assert len(got) == 2 * len(rows)
    want = brute_chat(rows)
    assert {(r.conv_id, r.turn): (r.reply_to, r.n_linked, r.thread) for r in got} == want and sum(v[0] is not None for v in want.values()) > 30
    for c in {r[0] for r in rows}:
        own = sorted((r.position, r.thread, r.turn, r.role) for r in got if r.conv_id == c)
        assert [p for p, *_ in own] == [*range(1, len(own) + 1)] and [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_chat_rows_without_a_turn(spark):
    df = spark.createDataFrame([(c, None, "a", f"t{i}") for i in range(50) for c in (1, None)] + [(1, 3, "a", "x")], "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(df).collect()
    for c, n in ((1, 51), (None, 50)):
        assert sorted(r.position for r in got if r.conv_id == c) == [*range(1, n + 1)]
    assert next(r for r in got if r.turn == 3).position == 51


# 9 ---------------------------------------------------------------------------


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[j : j + n]) for j in range(len(w) - n + 1)])
    up = {i: i for i in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            k = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * k >= percent * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed=8):
    random.seed(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [random.choice(vocab) for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(random.randint(0, 5)):
            w[random.randrange(len(w))] = random.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(random.choice(vocab) for _ in range(random.randint(1, 60)))) for i in range(60)]
    return [*rows, (2000, None), (2001, ""), (2002, "a b"), (2003, "A  b")]


@pytest.mark.parametrize("sets, local", [(1000, 1_000_000), (20, 1_000_000), (1000, 0)])
def test_jaccard_components(spark, monkeypatch, sets, local):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", sets)
    monkeypatch.setattr(common, "LOCAL_EDGES", local)
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, rows)).collect()}
    assert got == brute_components(rows, 4, 85)


@pytest.mark.parametrize("wide", [1, 3])
def test_jaccard_in_two_rounds(spark, monkeypatch, wide):
    """More parts of signatures than a shuffle may have partitions."""
    monkeypatch.setattr(ngram_join, "WIDE", wide)
    monkeypatch.setattr(ngram_join, "PER_PARTITION", 300)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 40)
    rows = near_copies(12)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, rows)).collect()}
    assert got == brute_components(rows, 4, 85)


def test_repacked_signatures_meet():
    rng = np.random.default_rng(13)
    names = rng.permutation(4000)[:400]
    held = {int(n): rng.integers(0, 3000, 20).astype(np.uint64) << np.uint64(16) for n in names}
    first = [b for part in (0, 1) for b in ngram_join.packs({n: s for n, s in held.items() if n % 2 == part}, 3)]
    second = [b for p in range(3) for b in ngram_join.repack(3, 5)([b.filter([x == p for x in b.column("p").to_pylist()]) for b in first])]
    forest = common.Forest()
    by_part = {}
    for b in second:
        for r in b.to_pylist():
            if r["kind"] == "edge":
                for x, y in zip(np.frombuffer(r["sigs"], "<i8").tolist(), np.frombuffer(r["low"], "<i8").tolist()):
                    forest.join(x, y)
            else:
                by_part.setdefault(r["p"], []).append((r["sigs"], r["low"], r["idx"], r["names"]))
    for packs in by_part.values():
        ngram_join.shared_runs(*ngram_join.unpacked(packs), forest)
    want = common.Forest()
    owner = {}
    for n, sigs in held.items():
        for x in sigs.tolist():
            want.join(n, owner.setdefault(x, n))
    assert {n: forest.root(n) for n in held} == {n: want.root(n) for n in held} and max(by_part) > 3


def test_jaccard_edge_cases(spark):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, EDGES)).collect()]
    assert len(got) == len(EDGES) and (None, 3, 1) in got and got.count((4, 1, 4)) == 2 and (2, 0, 2) in got
    assert ngram_join.jaccard_components(docs(spark, EDGES).limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("scheme", [ngram_join.COARSE, ngram_join.FINE])
def test_similar_sets_share_a_signature(percent, scheme):
    rng = np.random.default_rng(9)
    bands = ngram_join.Bands(percent)
    for size in (5, 6, 7, 9, 13, 20, 33, 60, 150, 400):
        for _ in range(40):
            base = rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64)
            drop, add = rng.integers(0, max(1, size * (100 - percent) // 100) + 1, 2)
            other = np.unique(np.concatenate([base[drop:], rng.integers(0, 2**63, add, dtype=np.int64).astype(np.uint64)]))
            base = np.unique(base)
            both = len(np.intersect1d(base, other))
            either = len(base) + len(other) - both
            if both < either and 100 * both >= percent * either:
                assert np.intersect1d(ngram_join.signatures(base, bands, scheme), ngram_join.signatures(other, bands, scheme)).size


# 10 --------------------------------------------------------------------------


def brute_pii(t):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), m.end(), 2)] if 14 <= len(d) <= 19 and pii.luhn(d) else []
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        out += [(m.start(), m.end(), 3)] if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15 else []
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_pii_patterns():
    random.seed(10)
    parts = ["@", ".", "1", "23", "400", "+", "-", " ", "(", ")", "a", "B", "_", "é", "4111111111111111", "@a.b", "x@", "%", "+1 (212) 555-0100", "1.2.3.4"]
    for _ in range(8000):
        t = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert pii.base_spans(t) == brute_pii(t), repr(t)
    assert pii.base_spans("1" * 50000 + "." + "a" * 50000 + "@") == []
    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}.1.2.{zeros}255 x") == [(0, 10008, 1)] and pii.base_spans(f"{zeros}.1.2.{zeros}256") == []
    assert pii.mask_texts([f"{zeros}.1.2.3"]) == ["<IP>"]


def test_shape_reads_whole_tokens():
    assert pii.shape("-" * 70 + "12") == "-92" and pii.features("a" * 70 + "@b1")[0] == "s=a@a91"


def test_field_adds_spans():
    f = pii.field()
    right = total = 0
    for toks, tags in pii.labelled():
        right += sum(a == b for a, b in zip(f.viterbi([f.classes(toks)])[0], tags))
        total += len(tags)
    assert right / total > 0.97
    t = "please phone (212) 555-0188 after lunch, order 1002003004005006 left"
    (more,) = pii.added_spans([t], [pii.base_spans(t)])
    assert [t[a:b] for a, b, _ in more] == ["(212) 555-0188"]


def plain_path(f, toks):
    """Best labels and their score by a plain loop over a whole sequence, from the features of each place."""
    score, back = None, []
    for i in range(len(toks)):
        e = f.w[[f.index[x] for x in pii.context(toks, i) if x in f.index]].sum(0)
        if score is None:
            score = f.first + e
        else:
            z = score[:, None] + f.trans
            back.append(z.argmax(0))
            score = z.max(0) + e
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(score.max())


def test_stretches_give_the_path_of_the_whole_text():
    f, pick = pii.field(), random.Random(23)
    assert 0 < f.reach < 40
    lines = [t for t, _ in pii.labelled()]
    texts = []
    for _ in range(400):
        words = []
        for _ in range(pick.randint(0, 6)):
            words += [pick.choice(["word", "Word", "end.", "End,", "a", "phone", "call", "Mail"]) for _ in range(pick.choice([0, 3, 9, 12, 25, 60]))]
            words += pick.choice([pick.choice(lines), [pick.choice(pick.choice(lines))], [str(pick.randrange(10**9))], ["(212)"], ["+49"]])
        texts.append(f.classes(words[: pick.choice([len(words), len(words) // 2])]))
    whole, parts = f.viterbi(texts, whole=True), f.viterbi(texts)
    assert all((a == b).all() for a, b in zip(whole, parts)) and sum(a.any() for a in whole) > 100
    assert sum(hi - lo for t in texts for lo, hi in f.stretches(t)) < 0.9 * sum(map(len, texts))


def test_viterbi_is_the_best_path_over_whole_texts(monkeypatch):
    f, pick = pii.field(), random.Random(20)
    monkeypatch.setattr(pii, "KNOWN_TOKENS", 40)
    monkeypatch.setattr(pii, "BATCH_CHARS", 400)
    lines = [t for t, _ in pii.labelled()]
    texts = ["", "x", "call +1 (212) 555-0188"]
    for _ in range(60):
        texts.append(" ".join(pick.choice(pick.choice(lines)) + pick.choice(["", "", ".", ","]) if pick.random() < 0.7 else pick.choice(["Word", "été,", "ǅungla", "中", "a" * 60, str(pick.randrange(10**6)), "+49", "m@x"]) for _ in range(pick.choice([1, 5, 30, 200]))))
    base = [pii.base_spans(t) for t in texts]
    got = pii.added_spans(texts, base, f)
    for t, b, g, p in zip(texts, base, got, f.viterbi([f.classes(t.split()) for t in texts])):
        want, best = plain_path(f, t.split()) if t else ([], 0.0)
        if p.tolist() != want:  # a tie within rounding
            e = [f.w[[f.index[x] for x in pii.context(t.split(), i) if x in f.index]].sum(0) for i in range(len(want))]
            assert abs(f.first[p[0]] + sum(x[j] for x, j in zip(e, p)) + sum(f.trans[i, j] for i, j in zip(p, p[1:])) - best) < 1e-3
        assert g == pii.spans_of(t, p, b)
    assert sum(map(len, got)) > 10


def test_pii_rows(spark):
    got = pii.find_pii(docs(spark, [*EDGES, (50, "mail a.b@c.de or 10.1.2.3")])).collect()
    assert len(got) == len(EDGES) + 1
    r = next(r for r in got if r.doc_id == 50)
    assert (r.n_email, r.n_ip, r.spans) == (1, 1, "email:5:13,ip:17:25") and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert next(r for r in got if r.doc_id == 2).base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.mask_texts(["mail a.b@c.de or 10.1.2.3", None, ""]) == ["mail <EMAIL> or <IP>", None, ""]


# pipeline --------------------------------------------------------------------


@needs_data
def test_pipeline(spark, tok):
    import corpus_pipeline as p

    got = {r.doc_id: r for r in p.run(spark, DATA).collect()}
    src = common.read_table(spark, DATA, "documents")
    model = toxicity.train(src, common.read_table(spark, DATA, "labels"))
    kept = [(r.doc_id, r.text) for r in src.collect() if model.score(toxicity.words_of(r.text or "")) < 0.5]
    comps = brute_components(kept, 5, 80)
    kept = [(i, t) for i, t in kept if comps[i][1] == i]
    items = [tuple(decontaminate.words_of(r.text)) for r in common.read_table(spark, DATA, "benchmark").collect()]
    whole = {i for i, t in kept if any(" ".join(x) in " ".join(decontaminate.words_of(t)) for x in items)}
    assert not whole & got.keys()
    assert got.keys() <= {i for i, _ in kept} and len(got) >= 0.9 * len(kept) - len(whole)
    own = bpe.load(tok)
    for i, t in kept:
        if i in got:
            ids, text = own.encode_decode(pii.mask_texts([t])[0] or "")
            assert (got[i].ids_sha256, got[i].decoded_sha256) == (hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest())


ODD = [(1, "same words in this text here", "z"), (1, "same words in this text here", "z"), (2, None, "z"), (None, "mail a@b.cd", "z"), (3, "", "z"), (4, "ж" * 50_000 + " word" * 20_000, "z"), (None, None, None)]


def test_stages_take_odd_rows(spark, tok):
    """Nulls, empty and very long texts, repeated rows, further columns with clashing names, empty tables, in every stage."""
    import corpus_pipeline as p

    d = spark.createDataFrame([(*r, 7, 0.5, "k") for r in ODD], "doc_id long, text string, component_id string, n_chars int, score double, word string")
    sizes = {"toxicity": 7, "n-gram Jaccard join": 6, "benchmark decontamination": 7, "PII": 7, "BPE encoding and decoding": 7}
    for name, stage in p.STAGES:
        got = stage(spark, d, DATA)
        assert got.count() == sizes[name], name
        assert stage(spark, d.limit(0), DATA).count() == 0, name
        assert (got.columns == d.columns) == (stage is not p.encode), name
    masked = {(r.doc_id, r.text and r.text[:20], r.n_chars) for r in p.mask_personal_data(spark, d, DATA).collect()}
    assert (None, "mail <EMAIL>", 12) in masked and (2, None, None) in masked and (None, None, None) in masked
    assert p.without(d, spark.createDataFrame([(2,)], "dropped_id long")).columns == d.columns


# SQL -------------------------------------------------------------------------


@needs_data
@pytest.mark.parametrize("name", ["op1_topk", "op2_warc", "op3_url_filter", "op9_ngram_join"])
def test_same_as_sql(spark, name):
    import duckdb

    from wayloom.llm import queries

    assert {*queries.oracle_sql()} == {"op1_topk", "op2_warc", "op3_url_filter", "op9_ngram_join"}
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    res = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in res.description]
    want = sorted(map(str, res.fetchall()))
    got = queries.queries()[name](spark, DATA)
    assert {*names} == {*got.columns} and sorted(str(tuple(r[c] for c in names)) for r in got.collect()) == want
