"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans come from the patterns below: leftmost, non-overlapping for each kind; a match that fails its
check is dropped and the search goes on behind it. They always stay.

The field adds spans where the patterns see none, such as phones without a plus sign, disguised e-mail
addresses or two cards in a row. Lines are cut into tokens; candidate segments are runs of at most
``MAX_TOKENS`` tokens and ``MAX_CHARS`` characters with a digit or an @ (or its disguise), looked for within
``_REACH`` characters of one on its line; everything else has label ``none``, one token at a time. A segment is scored as a whole (shape, digit groups, checksum, range of its parts,
neighbours) and by the labels of adjoining segments; the bounded dynamic programme over (end, label)
picks boundaries and kinds jointly. A span is added if it passes its kind's check and touches no base span.
Text without a digit or an @ has no candidates. A line of more than ``PIECE`` tokens is decoded in
pieces that overlap by more than a segment.

Fit: conditional likelihood by AdaGrad on the driver over at most ``MAX_WINDOWS`` lines of the corpus
(lowest hashes; labelled by the patterns) and as many generated ones as ``EXAMPLES`` says, which show the
variants and the things that only look alike. The bounds are parameters; all else covers whole texts.

A null text counts as empty. Null ids, repeated rows and extra columns pass through.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16
MAX_CHARS = 80
PIECE = 512
MAX_WINDOWS = 400
EXAMPLES = 500
PER_TEXT = 8
LINE_CHARS = 400
EPOCHS = 5
_BUCKETS = 1 << 13
_SPAN_TYPE = "array<struct<kind:string,start:int,end:int,base:boolean>>"

# fixed values: the base patterns
_MAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")      # a run that fails from its first digit fails from all
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    n = [int(d) for d in reversed(digits)]
    return sum(n[::2]) % 10 == sum(sum(divmod(2 * d, 10)) for d in n[1::2]) * -1 % 10


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _MAIL_LEFT:
            start -= 1
        m = _MAIL_RIGHT.match(text, at) if start < at else None
        if m:
            done = m.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if len(m[0]) >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        at = text.find("+")
        while at >= 0:
            m = _PHONE.match(text, at)
            if m and 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
            at = text.find("+", m.end() if m else at + 1)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- candidate segments -------------------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z0-9]+|\s+|.", re.S)
_TRIGGER = re.compile(r"[0-9@]|[(\[] ?at ?[)\]]", re.I)
_INNER = frozenset(".%+-_@()[]/: ")
_AT = re.compile(r"@|[(\[] ?at ?[)\]]", re.I)
_DOT = re.compile(r"\.|[(\[] ?dot ?[)\]]", re.I)
_REACH = 48


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of lines within ``_REACH`` characters of a digit or an @, cut at token ends."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.start() < out[-1][1]:
            # within the last stretch: a later trigger only moves its end
            out[-1][1] = max(out[-1][1], _line_end(text, m.end()))
        else:
            low = max(text.rfind("\n", max(0, m.start() - _REACH), m.start()) + 1, m.start() - _REACH, out[-1][1] if out else 0)
            while low and m.start() - low < MAX_CHARS and (not out or low > out[-1][1]) and text[low - 1].isalnum() and text[low].isalnum():
                low -= 1                 # not inside a word
            out.append([low, _line_end(text, m.end())])
    return [(a, b) for a, b in out]


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at, at + _REACH)
    return min(len(text), at + _REACH) if end < 0 else end


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _side(c: str) -> str:
    return "^" if not c else "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c


def segments(text: str, toks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Candidate (first token, last token + 1): word or + or ( first, word last, a digit or an @ inside."""
    out = []
    for i, (a, b) in enumerate(toks):
        c = text[a]
        if not (c.isascii() and c.isalnum() or c in "+(") or (i and c.isalnum() and text[a - 1] in "@"):
            continue
        hot = False
        for j in range(i, min(len(toks), i + MAX_TOKENS)):
            x, y = toks[j]
            s = text[x:y]
            word = s[0].isascii() and s[0].isalnum()
            if y - a > MAX_CHARS or not (word or s in _INNER):
                break
            hot = hot or bool(_TRIGGER.search(s)) or (s in ")]" and bool(_AT.search(text[a:y])))
            if hot and word:
                out.append((i, j + 1))
    return out


def features(text: str, a: int, b: int) -> list[int]:
    """Hashed features of the segment text[a:b] with its neighbours."""
    s = text[a:b]
    digits = _digits(s)
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", s))
    groups = "-".join(str(min(len(g), 20)) for g in re.findall(r"[0-9]+", s)[:6])
    letters = any(c.isalpha() for c in s)
    parts = _DOT.split(s)
    mail = _AT.split(s)
    f = [
        "1", f"shape {shape[:24]}", f"digits {len(digits)} {letters}", f"groups {groups}", f"first {s[0] if s[0] in '+(' else _side(s[0])}",
        f"luhn {12 <= len(digits) <= 19 and luhn(digits)} {letters}",
        f"quad {len(parts) == 4 and all(p.isdigit() and _small(p) for p in parts)}",
        f"mail {len(mail)} {len(mail) == 2 and len(_DOT.split(mail[1])) > 1} {' ' in s}",
        f"left {_side(text[a - 1:a])}", f"right {_side(text[b:b + 1])}",
        f"sides {_side(text[max(0, a - 2):a])} {_side(text[b:b + 2])}",
        f"marks {''.join(sorted({c for c in s if not c.isalnum()}))} {letters}",
    ]
    return [zlib.crc32(x.encode()) % _BUCKETS for x in f]


def passes(kind: str, s: str) -> bool:
    """The check that an added span must pass."""
    digits = _digits(s)
    if kind == "email":
        sides = _AT.split(s)
        return len(sides) == 2 and bool(sides[0].strip()) and len(_DOT.split(sides[1])) > 1
    letters = any(c.isalpha() for c in s)
    if kind == "ip":
        parts = [p.strip("[]() ") for p in _DOT.split(s.replace("[.]", "."))]
        return len(parts) == 4 and all(p.isdigit() and _small(p) for p in parts)
    if kind == "card":
        return not letters and 12 <= len(digits) <= 19 and luhn(digits)
    return not letters and 9 <= len(digits) <= 15


# --- the field ----------------------------------------------------------------------------------

@dataclass
class Field:
    """``w``: weights by feature and kind; ``t``: weights by label before and label (0: none)."""
    w: np.ndarray
    t: np.ndarray

    def scores(self, feats: np.ndarray) -> np.ndarray:
        return self.w[feats].sum(axis=1)

    def decode(self, n: int, cand: list[tuple[int, int]], s: np.ndarray) -> list[tuple[int, int, int]]:
        """The best segmentation of n tokens: its segments (candidate's first, last + 1, kind)."""
        ending: dict[int, list[int]] = {}
        for c, (_, j) in enumerate(cand):
            ending.setdefault(j, []).append(c)
        best = np.full((n + 1, len(KINDS) + 1), -np.inf)
        best[0, 0] = 0
        into = np.empty((n + 1, len(KINDS) + 1))
        came = np.empty((n + 1, len(KINDS) + 1), np.int64)
        back: dict[tuple[int, int], int] = {}
        for j in range(n + 1):
            if j:
                best[j, 0] = into[j - 1, 0]
                for c in ending.get(j, ()):
                    v = into[cand[c][0], 1:] + s[c]
                    for k in np.flatnonzero(v > best[j, 1:]):
                        best[j, k + 1], back[j, int(k) + 1] = v[k], c
            step = best[j][:, None] + self.t
            came[j] = step.argmax(axis=0)
            into[j] = step.max(axis=0)
        out, j, k = [], n, int(best[n].argmax())
        while j:
            if k == 0:
                j, k = j - 1, int(came[j - 1, 0])
            else:
                i = cand[back[j, k]][0]
                out.append((i, j, k - 1))
                j, k = i, int(came[i, k])
        return out[::-1]

    def gradient(self, n: int, cand: list[tuple[int, int]], s: np.ndarray, gold: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Observed less expected: candidates x kinds, and label pairs. ``gold``: candidate to kind."""
        m = len(KINDS) + 1
        f, into = np.full((n + 1, m), -np.inf), np.empty((n + 1, m))
        f[0, 0] = 0
        ending: dict[int, list[int]] = {}
        starting: dict[int, list[int]] = {}
        for c, (i, j) in enumerate(cand):
            ending.setdefault(j, []).append(c)
            starting.setdefault(i, []).append(c)
        for j in range(n + 1):
            if j:
                f[j, 0] = into[j - 1, 0]
                if j in ending:
                    cs = ending[j]
                    f[j, 1:] = np.logaddexp.reduce(into[[cand[c][0] for c in cs], 1:] + s[cs], axis=0)
            into[j] = np.logaddexp.reduce(f[j][:, None] + self.t, axis=0)
        z = np.logaddexp.reduce(f[n])
        out = np.zeros((n + 1, m))           # what can follow a segment that ends here with this label
        grad, pair = np.zeros_like(s), np.zeros_like(self.t)
        for i in range(n - 1, -1, -1):
            go = np.full(m, -np.inf)
            go[0] = out[i + 1, 0]
            if i in starting:
                cs = starting[i]
                follow = out[[cand[c][1] for c in cs], 1:] + s[cs]
                grad[cs] -= np.exp(into[i, 1:] + follow - z)
                go[1:] = np.logaddexp.reduce(follow, axis=0)
            step = self.t + go[None, :]
            pair -= np.exp(f[i][:, None] + step - z)
            out[i] = np.logaddexp.reduce(step, axis=1)
        at, before, ends = 0, 0, {cand[c][0]: (cand[c][1], k) for c, k in gold.items()}
        while at < n:
            nxt, k = ends.get(at, (at + 1, -1))
            pair[before, k + 1] += 1
            at, before = nxt, k + 1
        for c, k in gold.items():
            grad[c, k] += 1
        return grad, pair

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """The spans that the field finds beside the base spans."""
        out = []
        for low, high in windows(text):
            part = text[low:high]
            toks = tokens(part)
            at, free = 0, low
            while at < len(toks):
                piece = toks[at:at + PIECE]
                last = at + PIECE >= len(toks)
                limit = len(piece) if last else PIECE - 4 * MAX_TOKENS
                cand = segments(part, piece)
                if cand:
                    s = self.scores(np.array([features(part, piece[i][0], piece[j - 1][1]) for i, j in cand]))
                    for i, j, k in self.decode(len(piece), cand, s):
                        a, b = low + piece[i][0], low + piece[j - 1][1]
                        if i < limit and a >= free and passes(KINDS[k], text[a:b]):
                            out.append((KINDS[k], a, b))
                            free = b
                at += limit
        return [x for x in out if not any(x[1] < b and a < x[2] for _, a, b in _near(base, x))]


def _near(base: list[tuple[str, int, int]], span: tuple[str, int, int]) -> list[tuple[str, int, int]]:
    return [b for b in base if b[1] < span[2] and span[1] < b[2]] if len(base) < 64 else _near_sorted(base, span)


def _near_sorted(base, span):
    from bisect import bisect_left
    # per kind the spans are disjoint and in order, so at most one per kind reaches in from before
    hi = bisect_left(base, span[2], key=lambda b: b[1])
    out, missing = [], set(KINDS)
    for b in reversed(base[:hi]):
        if b[2] > span[1]:
            out.append(b)
        else:
            missing.discard(b[0])
            if not missing:
                break
    return out


def spans(text: str | None, field: Field) -> list[tuple[str, int, int, bool]]:
    """All spans (kind, start, end, base) by start, then kind."""
    text = text or ""
    base = base_spans(text)
    return sorted([(*b, True) for b in base] + [(*x, False) for x in field.added(text, base)],
                  key=lambda s: (s[1], KINDS.index(s[0])))


# --- fit ----------------------------------------------------------------------------------------

def _card(r: random.Random) -> str:
    d = str(r.randint(10 ** 14, 10 ** 15 - 1))
    return next(d + x for x in "0123456789" if luhn(d + x))


def examples(n: int, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated lines with their spans: variants of each kind, and numbers that are none."""
    r = random.Random(seed)

    def word():
        return "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))

    def num(k):
        return "".join(r.choice("0123456789") for _ in range(k))

    def mail():
        a, b, c = f"{word()}.{num(2)}" if r.random() < 0.5 else word(), word() + r.choice(("", num(1))), r.choice(("com", "org", "net", "de"))
        return r.choice((f"{a}@{b}.{c}", f"{a}@{b}.example.{c}", f"{a} [at] {b}.{c}", f"{a} (at) {b} (dot) {c}", f"{a} @ {b}.{c}"))

    def phone():
        a, b, c = num(3), num(3), num(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"+49 {num(2)} {num(7)}", f"+{num(2)}-{num(3)}-{num(6)}"))

    def card():
        d = _card(r)
        return r.choice((d, d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}", f"{d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}"))

    def ip():
        q = [str(r.randint(0, 255)) for _ in range(4)]
        return r.choice((".".join(q), ".".join(q), "[.]".join(q)))

    def other():
        bad = _card(r)
        bad = bad[:-1] + str((int(bad[-1]) + r.randint(1, 9)) % 10)
        return r.choice((f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}",
                         f"version {r.randint(1, 9)}.{r.randint(0, 9)}", f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{r.randint(1, 99)},{num(3)},{num(3)}",
                         f"{r.randint(1900, 2020)}-{r.randint(1900, 2020)}", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"password={num(4)}{word()[:3]}{num(6)}",
                         f"#{num(8)}", f"{r.randint(1, 12)}:{num(2)}:{num(2)}", num(r.randint(1, 11)), bad, f"{num(3)}.{num(3)}.{num(3)}", f"{r.randint(300, 999)}.{num(3)}.{num(2)}.{num(3)}",
                         f"{word().upper()}{num(5)}{word().upper()}", f'token = "{num(12)}{word()[:2]}{num(9)}"', " ".join(num(r.randint(1, 3)) for _ in range(5))))

    make = {"email": mail, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        line, found = word(), []
        for _ in range(r.randint(1, 3)):
            line += r.choice((" ", ", ", ". ", ": "))
            kind = r.choice((*KINDS, "none", "none", "none"))
            for _ in range(2 if kind == "card" and r.random() < 0.3 else 1):
                s = other() if kind == "none" else make[kind]()
                if found and line.endswith(found[-1][3]):
                    line += " "
                if kind != "none":
                    found.append((kind, len(line), len(line) + len(s), s))
                line += s
            line += " " + word()
        out.append((line + r.choice((".", "", ", ")), [f[:3] for f in found]))
    return out


def train(lines: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = EPOCHS, rate: float = 0.25, l2: float = 1e-4) -> Field:
    """Conditional likelihood by AdaGrad, in a fixed shuffled order. A labelled span that is no candidate is left out."""
    data = []
    for text, found in lines:
        toks = tokens(text)
        cand = segments(text, toks)
        if not cand:
            continue
        at = {(toks[i][0], toks[j - 1][1]): c for c, (i, j) in enumerate(cand)}
        gold, end = {}, 0
        for kind, a, b in found:
            if (a, b) in at and a >= end:
                gold[at[a, b]] = KINDS.index(kind)
                end = b
        data.append((len(toks), cand, np.array([features(text, toks[i][0], toks[j - 1][1]) for i, j in cand]), gold))
    f = Field(np.zeros((_BUCKETS, len(KINDS))), np.zeros((len(KINDS) + 1, len(KINDS) + 1)))
    gw, gt = np.full_like(f.w, 1e-2), np.full_like(f.t, 1.0)
    order = random.Random(5)
    for _ in range(epochs):
        order.shuffle(data)
        for n, cand, feats, gold in data:
            grad, pair = f.gradient(n, cand, f.scores(feats), gold)
            step = np.zeros((_BUCKETS, len(KINDS)))
            np.add.at(step, feats.ravel(), np.repeat(grad, feats.shape[1], axis=0))
            rows = np.unique(feats)
            g = step[rows] - l2 * f.w[rows]
            gw[rows] += g * g
            f.w[rows] += rate * g / np.sqrt(gw[rows])
            gt += pair * pair
            f.t += rate * pair / np.sqrt(gt)
    return f


def fit(docs: DataFrame, text_col: str = "text", max_windows: int = MAX_WINDOWS, n_examples: int = EXAMPLES,
        per_text: int = PER_TEXT, line_chars: int = LINE_CHARS) -> Field:
    """Train on a bounded sample: at most ``max_windows`` stretches of the corpus around digits and @, the first ``per_text``
    of a text, each cut at ``line_chars`` characters; and ``n_examples`` generated lines. Only the fit is bounded: every
    stretch of every text is scanned afterwards."""
    count = docs.count()
    h = F.pmod(F.xxhash64(F.col(text_col), F.lit(3)), F.lit(1 << 30))
    share = min(1.0, 20 * max_windows / max(count, 1))      # enough texts to choose from, whatever the corpus
    src = docs.select(F.col(text_col).alias("text"), h.alias("h")).where(F.col("text").isNotNull() & (F.col("h") < int(share * (1 << 30))))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        lines, hs, ns = [], [], []
        for t, x in zip(b.column("text").to_pylist(), b.column("h").to_pylist()):
            for n, (a, e) in enumerate(windows(t)[:per_text]):
                lines.append(t[a:min(e, a + line_chars)])
                hs.append(x)
                ns.append(n)
        return pa.record_batch([pa.array(lines, pa.string()), pa.array(hs, pa.int64()), pa.array(ns, pa.int32())], names=["line", "h", "n"])

    rows = map_batches(src, cut, "line string, h long, n int").dropDuplicates(["line"]).orderBy("n", "h", "line").limit(max_windows).collect()
    return train([(r["line"], base_spans(r["line"])) for r in rows] + examples(n_examples))


# --- over tables --------------------------------------------------------------------------------

def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) per row; ``spans``: array of (kind, start, end, base), code points."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [[dict(zip(("kind", "start", "end", "base"), s)) for s in spans(t, field)] for t in b.column("text").to_pylist()]
        return pa.record_batch([b.column("id"), pa.array(got, kind)], names=["id", "spans"])

    return map_batches(src, run, f"id {src.schema['id'].dataType.simpleString()}, spans {_SPAN_TYPE}")


def blanked(text: str, found: list[tuple[str, int, int, bool]]) -> str:
    """``text`` with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b, _ in found:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of its texts replaced; the other columns as they are."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        i = b.schema.get_field_index(text_col)
        texts = [None if t is None else blanked(t, spans(t, field)) for t in b.column(i).to_pylist()]
        return b.set_column(i, text_col, pa.array(texts, b.schema.field(i).type))

    return map_batches(docs, run, docs.schema)
