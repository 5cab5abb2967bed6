"""SimHash near-dedup by pigeonring filtering.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, ``k``-word shingles (repeats included,
space-joined; a shorter text is one shingle), XXH64 with seed 42 over UTF-8; a bit is 1 if more than
half of the hashes have it. A text without words (null, empty, white space only) has fingerprint 0
and links like any other.

Links: two fingerprints link if they differ in at most ``t`` bits. The 64 bits are cut into a ring of
``m = t + 1`` segments. By the pigeonring principle, linked fingerprints have a start segment from
which every chain of ``l`` consecutive segments differs in at most ``floor(l * t / m) = l - 1`` bits.
A chain of one segment is therefore equal, and the second segment of the chain differs in at most
one bit, so one of its halves is equal: both go into the join key. The joined candidates are pruned
by the chains of 2, 3, ... m - 1 segments, and only then by the full Hamming distance. Fingerprints
are made distinct first, so copies never meet in pairs.

Buckets: a key with more than ``bucket`` distinct fingerprints is not paired. Its fingerprints go the
exact other way: each is written to all words of a Hamming ball around it (radius ``t // 2``, and the
rest of ``t``), and is linked to one fingerprint at each word that two balls share. Two fingerprints
share such a word exactly if they differ in at most ``t`` bits, so no component is lost or joined
wrongly, and rows grow with the fingerprints rather than their pairs.

Ties and odd rows: repeated rows and repeated ids are members like any other; a null id is a member
that never names a component (a component of null ids only has a null id). Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.llm.common import components, map_batches, materialise

SHINGLE_WORDS = 3
MAX_BITS = 2
#: Distinct fingerprints that one join key may hold before its members take the other exact way.
BUCKET = 2_000
_CHUNK = 1 << 16


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one text, as an unsigned number."""
    words = text.encode().lower().split() if text else []   # bytes: A-Z and \x20, \x09-\x0D only
    if not words:
        return 0
    k = min(k, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    ends = ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, _CHUNK):
        part = np.array([digest(line[a:b], 42) for a, b in zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK])], "<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
                 keep: tuple = ()) -> DataFrame:
    """(id, fp long) per row; ``keep``: further expressions (aliased) carried along."""
    src = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text_of_row"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, k) for t in b.column("text_of_row").to_pylist()], np.uint64).view(np.int64)
        names = [n for n in b.schema.names if n != "text_of_row"]
        return pa.record_batch([b.column(n) for n in names] + [pa.array(fps)], names=[*names, "fp"])

    schema = src.drop("text_of_row").schema.add("fp", "long")
    return map_batches(src, run, schema)


def _segments(m: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the ring's segments."""
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(parts: list[tuple[int, int]]) -> int:
    return sum(((1 << w) - 1) << lo for lo, w in parts)


def _bits(col, lo: int, w: int):
    return F.shiftrightunsigned(col, lo).bitwiseAND(F.lit(_signed((1 << w) - 1)))


def link_keys(fps: DataFrame, t: int) -> DataFrame:
    """Index rows (fp, slot, key): the equal segment and one half of the next, for every start."""
    ring = _segments(t + 1)
    rows = []
    for i, (lo, w) in enumerate(ring):
        nlo, nw = ring[(i + 1) % len(ring)]
        for half, (hlo, hw) in enumerate(((nlo, nw // 2), (nlo + nw // 2, nw - nw // 2))):
            rows.append(F.struct(F.lit(2 * i + half).alias("slot"), _bits(F.col("fp"), lo, w).alias("seg"),
                                 _bits(F.col("fp"), hlo, hw).alias("half")))
    return fps.select("fp", F.explode(F.array(*rows)).alias("k")).select("fp", "k.slot", "k.seg", "k.half")


def _chain_ok(x, t: int):
    """Every chain from the start segment within its budget (length 2 to m - 1), by slot."""
    ring = _segments(t + 1)
    ok = F.lit(True)
    for length in range(2, t + 1):
        masks = [_mask([ring[(i + j) % (t + 1)] for j in range(length)]) for i in range(t + 1)]
        arr = F.array(*[F.lit(_signed(v)) for v in masks for _ in range(2)])
        ok = ok & (F.bit_count(x.bitwiseAND(F.element_at(arr, F.col("slot") + 1))) <= length - 1)
    return ok


def _ball(fps: DataFrame, r: int) -> DataFrame:
    masks = [_signed(sum(1 << b for b in c)) for n in range(r + 1) for c in combinations(range(64), n)]
    return fps.select("fp", F.explode(F.array(*[F.lit(v) for v in masks])).alias("x")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("x")).alias("word"))


def fingerprint_links(fps: DataFrame, t: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fps`` (fp): all links outside full buckets,
    and for the members of full buckets enough links to keep every component (see the module)."""
    if t == 0:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    key = ["slot", "seg", "half"]
    keys = link_keys(fps, t)
    full = materialise(keys.groupBy(*key).count().where(F.col("count") > bucket).select(*key), "full")
    full_any = not full.isEmpty()
    use = keys.join(full, key, "left_anti") if full_any else keys
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = (use.withColumnRenamed("fp", "a").join(use.withColumnRenamed("fp", "b"), key)
             .where(F.col("a") < F.col("b")).where(_chain_ok(x, t)).where(F.bit_count(x) <= t).select("a", "b").distinct())
    if not full_any:
        return pairs
    hot = materialise(keys.join(full, key, "left_semi").select("fp").distinct(), "hot")
    hub = _ball(hot, t // 2).groupBy("word").agg(F.min("fp").alias("a"))
    stars = _ball(hot, t - t // 2).join(hub, "word").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionAll(stars)


def fingerprint_groups(prints: DataFrame, t: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(fp, group) for each distinct fingerprint of ``prints``: linked ones share a group."""
    fps = materialise(prints.select("fp").distinct(), "fps")
    comp = components(fingerprint_links(fps, t, bucket))
    return fps.join(comp, fps["fp"] == comp["node"], "left").select("fp", F.coalesce("root", "fp").alias("group"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
                  t: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """One row (id, fp, component) per input row; ``component``: the smallest id reachable by links.

    The members of a group are reduced to one minimum per fingerprint before they meet, so a group
    that holds a third of all rows costs no more than its distinct fingerprints.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, k), "prints")
    groups = materialise(fingerprint_groups(prints, t, bucket), "groups")
    first = prints.groupBy("fp").agg(F.min("id").alias("first")).join(groups, "fp")
    least = first.groupBy("group").agg(F.min("first").alias("component"))
    names = materialise(groups.join(least, "group").select("fp", "component"), "names")
    return prints.join(names, "fp").select("id", "fp", "component")


def hex64(c):
    """16 lower-case hex digits of a long."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))
