"""Personal data: fixed patterns, and a linear-chain conditional random field that adds spans.

The field runs over all tokens between blanks of a whole text, one sequence.
Its features are word shapes (runs of letters, digits and marks) of a token and
its neighbours; its weights come from the small labelled table below by maximum
likelihood, once, on the driver. Tokens with the same known features are one
class, and a class has one row of weights as itself and as a neighbour, so a
batch of sequences is three look-ups; Viterbi then decodes the batch in numpy,
position by position, over the sequences that reach it. After training a bound
on all walks through plain words shows how far from any other token a best path
can be inside a span; farther words are outside without being computed, and the
path is that of the whole text (see ``quiet_reach``). Spans the field finds that
touch no pattern's span and pass the kind's check are added; the patterns' spans
stay.

Cases: null text is empty; empty text has no spans, base_sha256 that of the
empty string and empty ``spans``; long runs of digits or letters take linear
time, very long texts about 200 bytes a token besides the text; repeated rows are
each judged; null doc_ids stay; further columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.bpe import rows, trim
from wayloom.llm.common import give_back

#: Characters of texts decoded together; tokens whose class is remembered, and their longest.
BATCH_CHARS, KNOWN_TOKENS, KNOWN_CHARS = 1 << 20, 60_000, 48
#: One of each class of plain tokens: words of letters, also before a full stop or the like. What a path can't take.
PLAIN, BARRED = ("a", "A", "a.", "A."), -1e4

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
MARKED = re.compile(r"[0-9@]|[(\[]at[)\]]")
BLANK = re.compile(r"\s")

# Labelled lines. [kind ...] is a span; everything else is outside.
TABLE = """
write to [email anna.lee@mail.example.com] about the offer
Mail: [email bob_77@post.example.org], please
contact <[email x.y+z@sub.example.net]> or call [phone +44 20 7946 0958] today
her address is [email info@example.co.uk] and his [email jo-ann@example.de].
send it to [email m.mustermann (at) example.de] now
reach us: [email sales @ example.com] any time
the server at [ip 10.0.0.12] is down
from [ip 192.168.4.200] to [ip 172.16.254.1] in 3 hops
ping [ip 8.8.8.8], then wait 20 seconds
host [ip 203.0.113.77:8080] answered 404 twice
pay with [card 4111 1111 1111 1111] before 12/27
card [card 5500-0000-0000-0004] was refused
number [card 378282246310005] on file
his [card 6011111111111117] expired in 2019
call [phone +1 (212) 555-0100] or [phone +49 30 901820]
phone [phone (212) 555-0188] after 5 pm
tel. [phone 212-555-0199], room 14
ring [phone 030 / 901 82 00] in the morning
fax: [phone 0049 30 9018210] office 7
her cell is [phone +33 1 99 00 12 34] or [phone 555-0123]
version 2.4.1 of the tool came out in 2021
the year 1999 and the year 2004
page 12 of 340 has table 7
it cost 1,299.00 and 45.50 with tax
on 2024-05-17 at 14:30 we met
chapter 3.2 shows 17 of 20 cases
room 101 and gate 7b are closed
see section 4.1.2 or item 55
order 1002003004005006 was sent on 03/04/2023
id 9876543210987654 and code 12345678
build 1234567890123456 failed 3 times
token = "04dbebab91ab85687d33eeaaf9ac699e"
about 5000 people and 250 cars
the 2nd and the 3rd of 10 rows
temperature -3.5 to 12.0 degrees
ratio 16:9 or 4:3 on 1080p
about the words that stand alone here
no numbers are in this line at all
follow @someone and @other_one there
The End. And so on, they said!
"""
SPAN = re.compile(r"\[(email|ip|card|phone) ([^\]]*)\]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def at_most_255(digits: str) -> bool:
    d = digits.lstrip("0")
    return len(d) < 4 and int(d or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns, by start, then kind."""
    out = []
    at, p = 0, text.find("@")
    while p >= 0:
        start = p
        while start > at and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, p + 1) if start < p else None
        if m:
            out.append((start, m.end(), 0))
            at = m.end()
        else:
            at = max(at, p + 1) if start < p else at
        p = text.find("@", max(at, p + 1))
    if DIGIT.search(text):
        if "." in text:
            for m in CHAIN.finditer(text):
                parts = [*re.finditer("[0-9]+", m[0])] if m[0].count(".") > 2 else []
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    if all(at_most_255(x[0]) for x in four):
                        out.append((m.start() + four[0].start(), m.start() + four[3].end(), 1))
        for m in CARD.finditer(text):
            if 14 <= len(m[0]) and 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


# --- the field ---------------------------------------------------------------


def shape(token: str) -> str:
    """Letters as A and a, digits as 9 with the length of their run up to 5, other signs as they are; runs of letters and signs cut to one."""
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|(.)\1*", token):
        s = m[0]
        out.append(f"9{min(len(s), 5)}" if s[0] in "0123456789" else ("A" if s[0].isupper() else "a") if s[0].isalpha() else s[0])
    return "".join(out)


def features(token: str) -> tuple[str, ...]:
    d = sum(c in "0123456789" for c in token)
    core = token.strip(".,;:!?\"'<>()[]*#$%&")
    return (f"s={shape(core)}", f"d={min(d, 17)}", f"at={'@' in token}", f"plus={token[:1] == '+'}", f"paren={token[:1] == '('}", f"dots={min(core.count('.'), 4)}", f"dash={min(core.count('-'), 3)}", f"end={token[-1:] in '.,;:!?'}", f"marked={bool(MARKED.search(token))}", f"alnum={core.isalnum()}")


def context(tokens: list[str], i: int) -> list[str]:
    before = tokens[i - 1] if i else ""
    after = tokens[i + 1] if i + 1 < len(tokens) else ""
    return [*features(tokens[i]), *(f"-1 {f}" for f in features(before)[:5]), *(f"+1 {f}" for f in features(after)[:5])]


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\S+", text)]


def labelled() -> list[tuple[list[str], list[int]]]:
    out = []
    for line in TABLE.strip().splitlines():
        spans, text, at = [], "", 0
        for m in SPAN.finditer(line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            at = m.end()
        text += line[at:]
        tags, toks = [], []
        for lo, hi in tokens_of(text):
            toks.append(text[lo:hi])
            kind = next(((a, k) for a, b, k in spans if lo < b and hi > a), None)
            tags.append(LABELS.index("O" if kind is None else f"{'B' if lo <= kind[0] else 'I'}-{kind[1]}"))
        out.append((toks, tags))
    return out


class Field:
    def __init__(self, rounds: int = 150, l2: float = 0.02):
        data = labelled()
        names = sorted({f for toks, _ in data for i in range(len(toks)) for f in context(toks, i)})
        self.index = {f: i for i, f in enumerate(names)}
        n, m = len(LABELS), len(names)
        width = max(len(t) for t, _ in data)
        x = np.zeros((len(data), width, m))
        y = np.zeros((len(data), width), int)
        mask = np.zeros((len(data), width), bool)
        for s, (toks, tags) in enumerate(data):
            for i, tag in enumerate(tags):
                x[s, i, [self.index[f] for f in context(toks, i)]] = 1
                y[s, i], mask[s, i] = tag, True
        w, t = np.zeros((m, n)), np.zeros((n, n))
        # I-k may follow B-k and I-k alone.
        self.barred = np.array([[b[0] == "I" and a[2:] != b[2:] for b in LABELS] for a in LABELS])
        first = np.array([a[0] == "I" for a in LABELS])
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
        hot = np.eye(n)[y] * mask[..., None]
        for step in range(1, rounds + 1):
            trans = np.where(self.barred, -1e4, t)
            e = x @ w
            a = np.zeros((len(data), width, n))
            b = np.zeros((len(data), width, n))
            a[:, 0] = e[:, 0] + np.where(first, -1e4, 0)
            for i in range(1, width):
                z = a[:, i - 1, :, None] + trans
                a[:, i] = np.where(mask[:, i, None], e[:, i] + _lse(z, 1), a[:, i - 1])
            for i in range(width - 2, -1, -1):
                z = trans + (e[:, i + 1] + b[:, i + 1])[:, None, :]
                b[:, i] = np.where(mask[:, i + 1, None], _lse(z, 2), b[:, i + 1])
            total = _lse(a[:, -1], 1)
            node = np.exp(np.clip(a + b - total[:, None, None], -700, 0)) * mask[..., None]
            gw = np.einsum("sif,sin->fn", x, node - hot) + l2 * w
            gt = l2 * t
            for i in range(1, width):
                both = mask[:, i]
                edge = np.exp(np.clip(a[:, i - 1, :, None] + trans + (e[:, i] + b[:, i])[:, None, :] - total[:, None, None], -700, 0))
                gt = gt + edge[both].sum(0) - np.einsum("sa,sb->ab", hot[both, i - 1], hot[both, i])
            for p, g, u, v in ((w, gw, state[0], state[1]), (t, gt, state[2], state[3])):
                u *= 0.9
                u += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= 0.1 * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.w, self.first = w, np.where(first, -1e4, 0.0)
        self.trans = np.where(self.barred, -1e4, t)

        # Tokens with the same known features are one class; its rows: weights as itself, before the next token, after the one before.
        self.number: dict[tuple, int] = {}
        self.rows = np.zeros((3, 0, n), np.float32)
        self.known: dict[str, int] = {}
        self.none = self.classify("")
        self.plain = np.array([self.classify(t) for t in PLAIN])
        self.reach = self.quiet_reach()

    def classify(self, token: str) -> int:
        """The class of a token."""
        own = features(token)
        names = (own, [f"-1 {f}" for f in own[:5]], [f"+1 {f}" for f in own[:5]])
        key = tuple(tuple(self.index[f] for f in part if f in self.index) for part in names)
        c = self.number.get(key)
        if c is None:
            c = self.number[key] = len(self.number)
            if c >= self.rows.shape[1]:
                self.rows = np.concatenate([self.rows, np.zeros((3, max(64, c), len(LABELS)), np.float32)], axis=1)
            for r, ids in zip(self.rows, key):
                r[c] = self.w[list(ids)].sum(0)
        if len(token) <= KNOWN_CHARS:
            if len(self.known) >= KNOWN_TOKENS:
                trim(self.known)
            self.known[token] = c
        return c

    def classes(self, tokens: list[str]) -> np.ndarray:
        """Classes of a sequence. Words of letters alone, also before a full stop or the like, have four classes and aren't looked up."""
        known, out = self.known, []
        low, high, low_end, high_end = self.plain.tolist()
        for t in tokens:
            if t.isalpha():
                out.append(high if t[0].isupper() else low)
            elif t[-1] in ".,;:!?" and t[:-1].isalpha():
                out.append(high_end if t[0].isupper() else low_end)
            else:
                out.append(known[t] if t in known else self.classify(t))
        return np.array(out, np.int32)

    def quiet_reach(self, most: int = 64) -> int | None:
        """Plain tokens on either side of others beyond which a best path is outside of all spans; None if that can't be shown.

        All is relative to staying outside. A step of a path among plain tokens gains
        at most ``high`` (the best of all neighbours that plain tokens can have), and
        at least ``low``. If no walk out of O and back gains anything, none is taken
        among plain tokens alone; and if a path inside spans for n plain tokens gains
        no more than one that leaves at once and comes back in the last two steps,
        then beyond n tokens from any other token a best path is at O.
        """
        c = [self.classify(t) for t in PLAIN]
        e = np.array([self.rows[0][i] + self.rows[1][j] + self.rows[2][k] for i in c for j in c for k in c], float)
        gain = e - e[:, :1]
        step = self.trans - self.trans[0, 0]
        high, low = step + gain.max(0)[None, :], step + gain.min(0)[None, :]
        inside, out = high[1:, 1:], high[1:, 0]
        back = np.array([low[0, b] if LABELS[b][0] == "B" else low[0, b - 1] + low[b - 1, b] for b in range(1, len(LABELS))])
        best = high[0, 1:].copy()  # of walks that have left O
        walk = np.where(np.eye(len(inside)) > 0, 0.0, -np.inf)  # of n steps inside, by ends
        for n in range(1, most):
            if (best + out).max() >= 0:
                return None
            best = (best[:, None] + inside).max(0)
            walk = (walk[:, :, None] + inside[None]).max(1)
            if n > 2 and (walk - step[1:, :1] - np.minimum(back, 0)[None, :]).max() + max(0.0, out.max()) < 0 and best.max() < np.minimum(back, 0).min():
                return n + 2  # the two steps back, and a neighbour's features
        return None

    def stretches(self, c: np.ndarray) -> list[tuple[int, int]]:
        """The parts of a sequence of classes that must be decoded: those in reach of a token that isn't plain, or of an end of the text."""
        if self.reach is None or len(c) < 2:
            return [(0, len(c))] if len(c) else []
        odd = c > self.plain.max()  # plain classes were numbered first
        odd[0] = odd[-1] = True
        odd = np.flatnonzero(odd)
        new = np.flatnonzero(np.diff(odd) > 2 * self.reach + 2)
        first, last = odd[np.concatenate([[0], new + 1])], odd[np.concatenate([new, [len(odd) - 1]])]
        return [(max(0, lo - self.reach - 1), min(len(c), hi + self.reach + 2)) for lo, hi in zip(first.tolist(), last.tolist())]

    def viterbi(self, sequences: list[np.ndarray], whole: bool = False) -> list[np.ndarray]:
        """Best labels of every sequence of classes; outside of ``stretches`` they are O, and stretches begin and end with O there.

        Stretches are decoded together: entries are laid out by position, longer ones first, so a step reads one slice.
        """
        out = [np.zeros(len(s), np.int8) for s in sequences]
        parts = [(i, lo, hi) for i, s in enumerate(sequences) for lo, hi in ([(0, len(s))] if whole and len(s) else self.stretches(s))]
        parts.sort(key=lambda p: p[1] - p[2])
        if not parts:
            return out
        size = np.array([hi - lo for _, lo, hi in parts])
        width, total = int(size[0]), int(size.sum())
        reach = np.searchsorted(-size, -np.arange(width), side="left")  # stretches longer than each position
        at = np.concatenate([[0], np.cumsum(reach)])
        start = np.concatenate([[0], np.cumsum(size)[:-1]])

        def beside(shift: int) -> np.ndarray:
            """The classes before (-1), at (0) or after (1) each token, of its whole text."""
            near = []
            for i, lo, hi in parts:
                s, a, b = sequences[i], lo + shift, hi + shift
                near.append(s[a:b] if 0 <= a and b <= len(s) else np.concatenate([[self.none] * (a < 0), s[max(a, 0) : b], [self.none] * (b > len(s))]))
            return np.concatenate(near).astype(np.int32)

        e = self.rows[0][beside(0)]
        e += self.rows[1][beside(-1)]
        e += self.rows[2][beside(1)]
        inner = np.array([lo > 0 for _, lo, _ in parts]), np.array([hi < len(sequences[i]) for i, _, hi in parts])
        for edge, rows_ in zip(inner, (start, start + size - 1)):
            e[rows_[edge], 1:] = BARRED
        place = at[np.arange(total) - np.repeat(start, size)] + np.repeat(np.arange(len(parts)), size)
        by_place = np.empty_like(e)
        by_place[place] = e
        del e
        back = np.zeros((total, len(LABELS)), np.int8)
        ends, best = np.empty((len(parts), len(LABELS))), np.empty((len(parts), len(LABELS)), np.intp)
        score = by_place[: reach[0]] + self.first
        reach_, at_, into = reach.tolist(), at.tolist(), np.ascontiguousarray(self.trans.T)
        for i in range(1, width):
            n, lo, hi = reach_[i], at_[i], at_[i + 1]
            if n < len(score):
                ends[n : len(score)] = score[n:]
                score = score[:n]
            z = score[:, None, :] + into
            z.argmax(2, out=best[:n])
            back[lo:hi] = best[:n]
            score = z.max(2)
            score += by_place[lo:hi]
        ends[: len(score)] = score
        label = np.empty(total, np.int8)
        now = ends.argmax(1)
        flat, column = back.reshape(-1), np.arange(total) * len(LABELS)
        for i in range(width - 1, -1, -1):
            n, lo, hi = reach_[i], at_[i], at_[i + 1]
            label[lo:hi] = now[:n]
            now[:n] = flat[column[lo:hi] + now[:n]]
        path = label[place]
        for (i, lo, hi), a in zip(parts, start.tolist()):
            out[i][lo:hi] = path[a : a + hi - lo]
        return out


def _lse(z: np.ndarray, axis: int) -> np.ndarray:
    top = z.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(z - top).sum(axis=axis))


@lru_cache(maxsize=1)
def field() -> Field:
    return Field()


def valid(kind: str, s: str) -> bool:
    digits = re.sub("[^0-9]", "", s)
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+ ?(@|\(at\)|\[at\]) ?[\w-]+(\.[\w-]+)+", s))
    if kind == "ip":
        m = re.fullmatch(r"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})(:[0-9]+)?", s)
        return bool(m) and all(int(x) <= 255 for x in m.groups()[:4])
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search("[^0-9 -]", s)
    return 7 <= len(digits) <= 15 and not re.search("[^0-9 ()+./-]", s) and bool(re.search("[ ()/.-]", s))


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], f: Field | None = None) -> list[list[tuple[int, int, int]]]:
    """Spans the field adds to each text; texts are decoded together up to BATCH_CHARS."""
    f = f or field()
    out: list[list[tuple[int, int, int]]] = []
    at = 0
    while at < len(texts):
        end, chars = at + 1, len(texts[at])
        while end < len(texts) and chars + len(texts[end]) <= BATCH_CHARS:
            chars += len(texts[end])
            end += 1
        paths = f.viterbi([f.classes(t.split()) for t in texts[at:end]])
        out += [spans_of(t, p, b) if p.any() else [] for t, p, b in zip(texts[at:end], paths, base[at:end])]
        at = end
    return out


def spans_of(text: str, path: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The labelled spans of a text that pass their kind's check and touch no span of ``base``."""
    toks, out, at, names = tokens_of(text), [], 0, [LABELS[p] for p in path.tolist()]
    while at < len(names):
        tag = names[at]
        if tag[0] != "B":
            at += 1
            continue
        end = at + 1
        while end < len(names) and names[end] == f"I-{tag[2:]}":
            end += 1
        lo, hi = toks[at][0], toks[end - 1][1]
        s = text[lo:hi]
        lead = len(s) - len(s.lstrip("<\"'[,;:*#$%&!?."))
        s = s[lead:].rstrip(">\"'],;:!?.*#$%&")
        lo, hi = lo + lead, lo + lead + len(s)
        at = end
        if s and valid(tag[2:], s) and not any(lo < b and hi > a for a, b, _ in base):
            out.append((lo, hi, KINDS.index(tag[2:])))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def mask_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All columns of ``docs``, each span in the text replaced by its kind, and the length in ``chars_col`` (if there) following the text. Narrow.

    Null texts stay null; repeated rows, null ids and further columns stay as they are; an empty table gives no rows.
    """
    f = field()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = mask_texts(part.column(text_col).to_pylist(), f)
                part = part.set_column(part.schema.get_field_index(text_col), part.schema.field(text_col), pa.array(texts, part.schema.field(text_col).type))
                if chars_col in part.schema.names:
                    i = part.schema.get_field_index(chars_col)
                    part = part.set_column(i, part.schema.field(i), pa.array([None if t is None else len(t) for t in texts]).cast(part.schema.field(i).type))
                yield part

    return docs.mapInArrow(give_back(run), docs.schema)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans, n_added. Narrow."""

    f = field()

    def run(batches):
        for ids, texts in rows(batches, ("k", "t")):
            texts = [t or "" for t in texts]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, f)
            count = [[sum(k == i for *_, k in b) for b in base] for i in range(len(KINDS))]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(ids, pa.int64())}
                | {f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, count)}
                | {"base_sha256": [hashlib.sha256(written(b).encode()).hexdigest() for b in base], "spans": [written([*b, *m]) for b, m in zip(base, more)], "n_added": pa.array(list(map(len, more)), pa.int64())}
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(give_back(run), schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; of spans that overlap, the first, then the longest, names the whole."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def mask_texts(texts: list[str | None], f: Field | None = None) -> list[str | None]:
    own = [t or "" for t in texts]
    base = [base_spans(t) for t in own]
    more = added_spans(own, base, f)
    return [None if t is None else masked(t, [*b, *m]) if b or m else t for t, b, m in zip(texts, base, more)]
