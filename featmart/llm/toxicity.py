"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are runs of letters, lower-cased and hashed to ``BUCKETS`` buckets. Fit: at most ``CAP`` labelled
documents per label (lowest id hashes; of equal texts with one label one) are the training sample, the only
bounded part. A token's score is the log-odds of its rates in toxic and clean documents under a Dirichlet
prior that follows its rate in all documents of the corpus, taken towards zero by ``Z`` standard errors.
Rates count a token once a document. A steady ``drift``, the share of toxic documents' tokens that score
above zero, is taken off every token, so that scores are negative on the whole.

Scan: the maximal scoring segments of a document (Ruzzo and Tompa: disjoint, none can be extended or cut
to gain) are found in one pass over its tokens. Calibration: on clean text the best of n tokens' segments
follows an extreme-value law, P(S >= s) = 1 - exp(-K n exp(-lambda s)); lambda solves
E exp(lambda score) = 1 over clean tokens, K is its maximum-likelihood value on the clean sample. A segment's
evidence is -ln(K n exp(-lambda S)); a document's, the largest over r of that of its r best segments together
(Karlin and Altschul's sum law). A logistic curve through the sample's evidence, by label, makes it the
score. What is calibrated is scored with the counts of the other half of the sample. ``passages`` lists the
segments expected by chance at most ``E_VALUE`` times in such a document, in code points.

Odd rows: null, empty and letterless texts have no evidence and the score that goes with none. Null ids and labels
teach nothing; a document with several labels has the largest. Without a label of either kind every score is the
share of toxic labels (0 without labels). An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featmart.llm.common import map_batches, materialise, small_batches

BUCKETS = 1 << 18
CAP = 20_000
PRIOR = 0.1          # the prior's weight beside a label's own counts
Z = 2.58
MIN_DRIFT = 0.005
E_VALUE = 0.05
MOST = 20.0          # evidence beyond which the curve is flat
HELD_OUT = 5
MAX_TASKS = 16_384   # of a count, each of which hands on up to BUCKETS sums; beyond it a task reads several splits
_REMEMBER = 200_000
_TOKEN = re.compile(r"[^\W\d_]+")
_known: dict[str, int] = {}


def bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token.lower().encode("utf-8", "surrogatepass")) % BUCKETS


def buckets(tokens: list[str]) -> np.ndarray:
    """The tokens' buckets; those of tokens seen lately are remembered."""
    if len(_known) > _REMEMBER:
        _known.clear()
    for t in set(tokens).difference(_known):
        _known[t] = bucket(t)
    return np.fromiter(map(_known.__getitem__, tokens), np.int64, len(tokens))


def log_odds(toxic: np.ndarray, clean: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Per bucket the log-odds of its rates under the Dirichlet prior, ``Z`` standard errors nearer to zero."""
    prior = PRIOR * np.maximum(corpus, np.maximum(toxic + clean, 1)) / max(corpus.sum(), 1)
    nt, nc = max(toxic.sum(), 1), max(clean.sum(), 1)
    at, ac = toxic + prior * nt, clean + prior * nc
    odds = np.log(at / np.maximum(nt * (1 + PRIOR) - at, 1e-9)) - np.log(ac / np.maximum(nc * (1 + PRIOR) - ac, 1e-9))
    error = np.sqrt(1 / at + 1 / ac)
    return np.where(toxic + clean > 0, np.sign(odds) * np.maximum(0, np.abs(odds) - Z * error), 0.0)


def decay(score: np.ndarray, rate: np.ndarray) -> float:
    """lambda > 0 with sum rate * exp(lambda * score) = 1; needs a negative mean and a positive score."""
    lo, hi = 0.0, 1.0
    while rate @ np.exp(np.minimum(hi * score, 700)) < 1 and hi < 1e3:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if rate @ np.exp(np.minimum(mid * score, 700)) < 1 else (lo, mid)
    return hi


@dataclass
class Scores:
    """Scores per bucket and the law of their best segments on clean text (``log_k`` None: not fitted yet)."""
    table: np.ndarray
    rate: float                 # lambda
    log_k: float = 0.0

    @classmethod
    def learn(cls, toxic: np.ndarray, clean: np.ndarray, corpus: np.ndarray) -> Scores:
        raw = log_odds(toxic, clean, corpus)
        drift = max(float(toxic[raw > 0].sum() / max(toxic.sum(), 1)), MIN_DRIFT)
        table = raw - drift
        prior = PRIOR * corpus / max(corpus.sum(), 1)
        p = (clean + prior * max(clean.sum(), 1)) / (max(clean.sum(), 1) * (1 + PRIOR))
        p = p / max(p.sum(), 1e-12)
        usable = (raw > 0).any() and p @ table < 0
        return cls(table.astype(np.float32), decay(table, p) if usable else 0.0)


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) of a sequence, in one pass over its positive scores."""
    total = np.concatenate(([0.0], np.cumsum(score, dtype=np.float64)))
    found: list[list] = []                 # start, end, sum before, sum up to the end, the last one before with a smaller sum before
    for i in np.flatnonzero(score > 0).tolist():
        start, before, upto = i, float(total[i]), float(total[i + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= upto:
                found.append([start, i + 1, before, upto, j])
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


def evidence(x: list[float]) -> float:
    """The largest -ln P over the r best segments together, from the segments' own evidence."""
    best, total = x[0], 0.0
    for r, one in enumerate(x, 1):
        if one <= 0:
            break
        total += one
        if r > 1:
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
    return best


def scan(text: str | None, s: Scores) -> tuple[float, int, list[tuple[int, int, float]]]:
    """Score of the best segment, number of tokens, all maximal segments, of a text."""
    tokens = _TOKEN.findall(text or "")
    found = segments(s.table[buckets(tokens)]) if tokens and s.rate > 0 else []
    return max((f[2] for f in found), default=0.0), len(tokens), found


def judge(text: str | None, s: Scores, e_value: float = E_VALUE) -> tuple[float, list[dict]]:
    """Evidence of a text and its significant passages."""
    _, n, found = scan(text, s)
    base = s.log_k + math.log(max(n, 1))
    x = sorted((s.rate * f[2] - base for f in found), reverse=True) or [-base]
    out = []
    chosen = [f for f in found if s.rate * f[2] - base >= -math.log(e_value)]
    if chosen:
        at = [m.span() for m in _TOKEN.finditer(text)]
        out = [{"start": at[a][0], "end": at[b - 1][1], "score": v, "expected": math.exp(base - s.rate * v)} for a, b, v in chosen]
    return evidence(x), out


@dataclass
class Model:
    scores: Scores
    at: float                   # the logistic curve over evidence
    slope: float

    def score(self, x: float) -> float:
        return 1 / (1 + math.exp(-(self.at + self.slope * min(max(x, 0.0), MOST))))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text (null: empty) leaves 0 modulo 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str, cap: int) -> DataFrame:
    """(toxic, half, text): per label at most ``cap`` documents outside the held-out fifth, no text twice."""
    known = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull() & ~held_out(label_id)).groupBy(
        F.col(label_id).alias("of")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    known = materialise(known, "labels")
    picked = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("of"), "of").limit(cap)
        picked = part if picked is None else picked.unionByName(part)
    half = (F.crc32(F.col("of").cast("string")) % HELD_OUT > 2).cast("int")
    picked = materialise(picked.select("of", "toxic", half.alias("half")), "picked")
    mine = docs.select(F.col(id_col).alias("of"), F.col(text_col).alias("text")).join(F.broadcast(picked), "of")      # at most 2 * cap rows
    return mine.where("text is not null").dropDuplicates(["toxic", "text"]).select("toxic", "half", "text")


def document_counts(rows: DataFrame, parts: int = 1) -> DataFrame:
    """(bucket, n array): documents that hold a bucket, by the rows' ``part`` (0 up); one sum per task and bucket."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((BUCKETS, parts), np.int64)
        for b in batches:
            for part, text in zip(b.column("part").to_pylist(), b.column("text").to_pylist()):
                if text:
                    n[np.unique(buckets(list(set(_TOKEN.findall(text))))), part] += 1
        at = np.flatnonzero(n.any(axis=1))
        for lo in range(0, len(at), 1 << 16):
            some = at[lo:lo + (1 << 16)]
            yield pa.record_batch([pa.array(some.astype(np.int32)), *(pa.array(n[some, p]) for p in range(parts))],
                                  names=["bucket", *(f"n{p}" for p in range(parts))])

    made = rows.select("part", "text").coalesce(MAX_TASKS).mapInArrow(run, "bucket int, " + ", ".join(f"n{p} long" for p in range(parts)))
    return made.groupBy("bucket").agg(*(F.sum(f"n{p}").alias(f"n{p}") for p in range(parts)))


def _columns(counts: DataFrame, parts: int) -> np.ndarray:
    """The counts on the driver: at most BUCKETS rows of a few numbers."""
    out = np.zeros((parts, BUCKETS))
    got = counts.toArrow()
    for p in range(parts):
        out[p, got.column("bucket").to_numpy()] = got.column(f"n{p}").to_numpy()
    return out


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps on counted values, with a light penalty on the slope."""
    w = np.zeros(2)
    a = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        grad = a.T @ (n * (y - p)) - [0, 0.05 * w[1]]
        hess = (a * (n * p * (1 - p))[:, None]).T @ a + np.diag([1e-6, 0.05])
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
        label_col: str = "toxic", cap: int = CAP) -> Model:
    """Learn from the labelled documents outside the held-out fifth and the token rates of all documents."""
    sample = materialise(training_sample(docs, labels, id_col, text_col, label_id, label_col, cap), "toxic-sample")
    sizes = {(r.toxic, r.half): r.n for r in sample.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect()}     # four rows
    toxic, clean = (sum(sizes.get((y, h), 0) for h in (0, 1)) for y in (1, 0))
    if not toxic or not clean:
        share = toxic / (toxic + clean) if toxic + clean else 0.0
        return Model(Scores(np.zeros(BUCKETS, np.float32), 0.0), math.log((share + 1e-12) / (1 - share + 1e-12)), 0.0)
    corpus = _columns(document_counts(docs.select(F.lit(0).alias("part"), F.col(text_col).alias("text"))), 1)[0]
    by = _columns(document_counts(sample.select((F.col("toxic") * 2 + F.col("half")).alias("part"), "text"), 4), 4)
    final = Scores.learn(by[2] + by[3], by[0] + by[1], corpus)
    # half 0 is scored with what half 1 teaches, and the other way round
    halves = [Scores.learn(by[2 + h], by[h], corpus) for h in (1, 0)]

    def best(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [scan(t, halves[h])[:2] for h, t in zip(b.column("half").to_pylist(), b.column("text").to_pylist())]
        return pa.record_batch([b.column("half"), pa.array([max(n, 1) * math.exp(-halves[h].rate * s) for h, (s, n) in zip(b.column("half").to_pylist(), got)], pa.float64())],
                               names=["half", "t"])

    law = map_batches(sample.where("toxic = 0").select("half", "text"), best, "half int, t double").groupBy("half").agg(
        F.sum("t").alias("t"), F.count(F.lit(1)).alias("n")).collect()           # two rows
    per_half = {r.half: math.log(r.n / max(r.t, 1e-300)) for r in law}
    for h in (0, 1):
        halves[h].log_k = per_half.get(h, next(iter(per_half.values())))
    final.log_k = sum(per_half.values()) / len(per_half)

    def weigh(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [judge(t, halves[h])[0] for h, t in zip(b.column("half").to_pylist(), b.column("text").to_pylist())]
        return pa.record_batch([b.column("toxic"), pa.array(np.round(np.clip(x, 0, MOST), 2), pa.float64())], names=["toxic", "x"])

    seen = map_batches(sample.select("toxic", "half", "text"), weigh, "toxic int, x double").groupBy("toxic", "x").agg(
        F.count(F.lit(1)).alias("n")).toArrow()                        # at most 2 * 100 * MOST rows
    x, y, n = (seen.column(c).to_numpy().astype(float) for c in ("x", "toxic", "n"))
    at, slope = _logistic(x, y, n)
    if slope <= 0:
        at, slope = math.log(toxic / clean), 0.0
    return Model(final, at, slope)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """(``keep`` columns, score, predicted, passages) per row; only the text is read for the score."""
    src = docs.select(*keep, F.col(text_col).alias("text_of_row"))
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [judge(t, model.scores) for t in b.column("text_of_row").to_pylist()]
        p = [model.score(x) for x, _ in got]
        names = [n for n in b.schema.names if n != "text_of_row"]
        return pa.record_batch([b.column(n) for n in names] + [pa.array(p, pa.float64()), pa.array([int(v >= 0.5) for v in p], pa.int32()),
                                                               pa.array([s for _, s in got], passage)], names=[*names, "score", "predicted", "passages"])

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                         T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())])
    schema = T.StructType([*src.drop("text_of_row").schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType()), T.StructField("passages", T.ArrayType(span))])
    return map_batches(src, run, schema)
