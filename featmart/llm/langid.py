"""Language ID by nearest centroid.

Features: the text lower-cased, every run of non-letters as one space, character 2- and 3-grams hashed
to ``DIM`` buckets; weight (1 + ln tf) * idf, the vector scaled to length 1. Long texts are counted in
pieces of ``PIECE`` characters, cut at a space where there is one.

Fit: at most ``cap`` labelled rows per language (lowest id hashes) make the training sample, the only
bounded part. Each language's vectors are clustered by spherical k-means into ``k`` centroids. The
same rows' windows of 8, 16, ... letters give, for each language and each power of two of the number of different
grams, the cosine that almost all of the language's texts of that size reach; ``MARGIN`` times it is the language's
rejection floor at that size.

Predict: language of the centroid with the highest cosine (ties: first in language order); ``score`` is
that cosine, cut to 0..1; ``rejected`` if it lies below that language's floor for the text's size. A text that is
null or has no letter is ``und``, score 0, rejected. If no row is labelled, every text is ``und``.
Null ids and repeated rows are predicted like others. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featmart.llm.common import map_batches, materialise, small

BITS = 14
DIM = 1 << BITS
PIECE = 1 << 20
CENTROIDS = 3
CAP = 400
MARGIN = 0.55
FLOOR_QUANTILE = 0.01
_STEPS = 12
_LOG = np.concatenate(([0.0], 1 + np.log(np.arange(1, 1 << 16)))).astype(np.float32)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            end = (text.rfind(" ", at, end) + 1) or end
        yield text[at:end]
        at = end


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and counts of a text; empty if it has no letter."""
    counts, any_letter = np.zeros(DIM, np.int64), False
    for piece in _pieces((text or "").lower()):
        cp = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[cp]
        if not letter.any():
            continue
        any_letter = True
        keep = letter.copy()
        keep[1:] |= letter[:-1]           # the first non-letter behind a letter stands for the whole run
        c = np.concatenate(([32], np.where(letter, cp, 32)[keep], [32])).astype(np.uint32)
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
        three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) + c[2:] * np.uint32(0xC2B2AE35)
        for h in (two, three):
            counts += np.bincount(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS), minlength=DIM)
    at = np.flatnonzero(counts) if any_letter else np.empty(0, np.int64)
    return at, counts[at]


def _weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(n < len(_LOG), _LOG[np.minimum(n, len(_LOG) - 1)], 1 + np.log(np.maximum(n, 1))).astype(np.float32) * idf[at]
    return v / np.sqrt(v @ v)


@dataclass
class Model:
    langs: list[str]          # per centroid
    centroids: np.ndarray     # DIM x centroids
    idf: np.ndarray
    floors: np.ndarray        # per centroid, by floor(log2(number of different grams))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        at, n = grams(text)
        if not len(at) or not self.langs:
            return "und", 0.0, True
        cos = _weigh(at, n, self.idf) @ self.centroids[at]
        best = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[best])))
        return self.langs[best], score, bool(score < self.floors[best, len(at).bit_length() - 1])


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text (null: empty) leaves 2 modulo 4."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_sample(rows: DataFrame, id_col: str, text_col: str, lang_col: str, cap: int) -> DataFrame:
    """(lang, h, text): per language at most ``cap`` rows, those with the lowest id hashes."""
    src = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = materialise(rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
                        .groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")), "lang-sizes")
    # a hash threshold first, so that the ranking sees about twice the cap per language
    level = F.col("n") / float(2 * cap + 50)
    near = src.join(small(sizes), "lang").where(F.pmod("h", F.lit(1 << 30)) * level < float(1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    return near.withColumn("r", rank).where(F.col("r") <= cap).select("lang", "h", "text")


def _example_rows(b: pa.RecordBatch) -> pa.RecordBatch:
    """The whole text (level 0) and one window of 2**level letters from its middle."""
    out = {"lang": [], "h": [], "level": [], "at": [], "n": []}
    for lang, h, text in zip(*(b.column(c).to_pylist() for c in ("lang", "h", "text"))):
        mid = len(text) // 2
        for level, part in [(0, text)] + [(j, text[mid - (1 << j) // 2:][: 1 << j]) for j in range(3, 14) if len(text) >= 1 << j]:
            at, n = grams(part)
            if len(at):
                for k, v in zip(out, (lang, h, level, at.astype(np.int32), n.astype(np.int32))):
                    out[k].append(v)
    return pa.record_batch([pa.array(out["lang"], pa.string()), pa.array(out["h"], pa.int64()), pa.array(out["level"], pa.int32()),
                            pa.array(out["at"], pa.list_(pa.int32())), pa.array(out["n"], pa.list_(pa.int32()))], names=list(out))


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started from the row nearest the mean and then the rows farthest from those chosen."""
    centres = [x[int(np.argmax(x @ x.mean(axis=0)))]]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argmin((x @ np.array(centres).T).max(axis=1)))])
    c = np.array(centres)
    for _ in range(_STEPS):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.array([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        k: int = CENTROIDS, cap: int = CAP) -> Model:
    """Learn from the labelled ``rows``. What reaches the driver is the model: a document frequency per
    bucket and ``k`` centroids per language."""
    examples = materialise(map_batches(training_sample(rows, id_col, text_col, lang_col, cap), _example_rows,
                                       "lang string, h long, level int, at array<int>, n array<int>"), "examples")
    whole = examples.where("level = 0")
    n_docs = whole.count()
    df = np.zeros(DIM)
    for r in whole.select(F.explode("at").alias("g")).groupBy("g").count().collect():   # at most DIM rows
        df[r["g"]] = r["count"]
    idf = (np.log((1 + n_docs) / (1 + df)) + 1).astype(np.float32)

    def learn(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["level", "h"], kind="stable")
        full = g[g["level"] == 0]
        x = np.zeros((len(full), DIM), np.float32)
        for i, (at, n) in enumerate(zip(full["at"], full["n"])):
            x[i, at] = _weigh(np.asarray(at), np.asarray(n), idf)
        c = _cluster(x, k)
        reach: dict[int, list[float]] = {}
        for at, n in zip(g["at"], g["n"]):
            reach.setdefault(len(at).bit_length() - 1, []).append(float((_weigh(np.asarray(at), np.asarray(n), idf) @ c[:, at].T).max()))
        floors = [float(np.quantile(reach[b], FLOOR_QUANTILE)) if b in reach else -1.0 for b in range(32)]
        return pd.DataFrame({"lang": [key[0]] * len(c), "c": list(c), "floors": [floors] * len(c)})

    found = sorted(examples.groupBy("lang").applyInPandas(learn, "lang string, c array<float>, floors array<double>").collect(),
                   key=lambda r: r["lang"])
    if not found:
        return Model([], np.zeros((DIM, 0), np.float32), idf, np.zeros((0, 32)))
    floors = np.zeros((len(found), 32))
    for i, r in enumerate(found):
        last = 0.0
        for b, reached in enumerate(r["floors"]):
            last = reached * MARGIN if reached >= 0 else last     # a size that no example has: as the next smaller
            floors[i, b] = last
    return Model([r["lang"] for r in found], np.array([r["c"] for r in found], np.float32).T.copy(), idf, floors)


def accepted(rows: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text the model does not reject."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
        return b.filter(pa.array([not model.predict(t)[2] for t in texts], pa.bool_()))
    return map_batches(rows, run, rows.schema)


def predict(rows: DataFrame, model: Model, text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """(``keep`` columns, lang_pred, score, rejected) per row; only the text is read for the prediction."""
    src = rows.select(*keep, F.col(text_col).alias("text_of_row"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [model.predict(t) for t in b.column("text_of_row").to_pylist()]
        names = [n for n in b.schema.names if n != "text_of_row"]
        lang, score, rejected = zip(*got)
        return pa.record_batch([b.column(n) for n in names] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                                                pa.array(rejected, pa.bool_())],
                               names=[*names, "lang_pred", "score", "rejected"])

    schema = src.drop("text_of_row").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return map_batches(src, run, schema)
