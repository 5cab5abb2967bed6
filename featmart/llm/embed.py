"""Embedding near-dedup by spherical-cap filters.

Filter directions form random product codes: a fixed random rotation cuts a vector's coordinates into
``BLOCKS`` parts, each part has a code of random directions of its own, and every choice of one word per
part is a filter. There are several such codes, each with a rotation of its own. A vector passes, in each
code, all filters beyond the height of its own cap, which is set so that ``PASSED`` of them exceed it. List decoding finds
them without visiting the others: of each part only the best ``PASSED`` words can take part in one of the
best sums, and parts are joined one by one, keeping the best ``PASSED`` sums. The words per part grow with
the root of the number of vectors, so a filter's expected members stay the same, and the codes grow with the
logarithm of the words, so that recall stays level: of random pairs at the threshold itself at least 0.98 share
a filter at every size up to 32,768 words (some 4e9 vectors), and more of nearer ones (tests measure both).

Vectors are joined on shared filters in two steps. The first shuffles narrow rows: a sketch of ``SKETCH`` sign bits and
the numbers of the vector's smaller filters. Two members are candidates if their sketches differ in no more bits than
pairs at the threshold do (4 standard deviations above), and share no smaller filter; members without a candidate end
there. The second gives those left their vectors and verifies in double precision. So a vector without near ones is
never shuffled, and one in a dense group about once for each smallest filter that its pairs share.

Equal vectors are one class, so copies never meet in pairs. A filter's members are dealt over a triangle
of block pairs if there are more than ``BUCKET``, so a filter that holds a third of all rows is many
bounded tasks, each a matrix product. Its n members are then copied n / ``BUCKET`` times as narrow rows: the n^2 / 2 pairs
of one cap must all be looked at for the number of links. A task returns, for each of its vectors, how many
it links there and the smallest vector that its links reach there, not the pairs.

The search is approximate; no pair below the threshold is linked.

Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing. Vectors of
different lengths do not link. Rows with equal vectors count each other, whatever their ids. A null id
is a row like any other, but names no component. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featmart.llm.common import components, map_batches, materialise, small_batches

THRESHOLD = 0.9
BLOCKS = 2
PASSED = 8
MEMBERS = 32       # expected members of a filter
BUCKET = 1_000     # members beyond which a filter is dealt over block pairs
SKETCH = 128
SEED = 7


def code_words(n: int, blocks: int = BLOCKS, passed: int = PASSED) -> int:
    """Words per part, a power of two, for ``n`` vectors."""
    return 1 << max(4, int(np.ceil(np.log2(max(n, 1) * passed / MEMBERS) / blocks)))


def code_count(words: int) -> int:
    """Codes for so many words per part."""
    return max(2, int(np.ceil(0.75 * (np.log2(words) - 5))))


@cache
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, 0, dim, SKETCH]).standard_normal((dim, SKETCH))


def sketches(unit: np.ndarray) -> np.ndarray:
    """Two words of sign bits per row."""
    return np.packbits(unit @ _planes(unit.shape[1]) > 0, axis=1).view(np.uint64)


def sketch_limit(threshold: float) -> int:
    """Differing bits that pairs at the threshold hardly ever exceed."""
    p = np.arccos(np.clip(threshold, -1, 1)) / np.pi
    return int(np.ceil(SKETCH * p + 4 * np.sqrt(SKETCH * p * (1 - p))))


@cache
def code(dim: int, blocks: int, words: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rotation, and for each part its code words, of a length that makes each filter a unit vector."""
    rng = np.random.default_rng([SEED, seed, dim])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    out = []
    for p in np.array_split(np.arange(dim), min(blocks, dim)):
        c = rng.standard_normal((words, len(p)))
        out.append(c / np.linalg.norm(c, axis=1, keepdims=True) * np.sqrt(len(p) / dim))
    return turn, out


def _best(a: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest entries of each row."""
    return np.argpartition(-a, k - 1, axis=1)[:, :k] if k < a.shape[1] else np.broadcast_to(np.arange(a.shape[1]), a.shape)


def decode(unit: np.ndarray, words: int, blocks: int = BLOCKS, passed: int = PASSED, codes: int | None = None) -> np.ndarray:
    """For each row the sorted numbers of the filters that it passes."""
    out = []
    for seed in range(code_count(words) if codes is None else codes):
        turn, parts = code(unit.shape[1], blocks, words, seed)
        turned, end = unit @ turn, 0
        number, total = np.full((len(unit), 1), seed, np.int64), np.zeros((len(unit), 1))
        for c in parts:
            dots = turned[:, end:end + c.shape[1]] @ c.T
            end += c.shape[1]
            word = _best(dots, passed)
            sums = (total[:, :, None] + np.take_along_axis(dots, word, 1)[:, None, :]).reshape(len(unit), -1)
            numbers = (number[:, :, None] * words + word[:, None, :]).reshape(len(unit), -1)
            top = _best(sums, passed)
            number, total = np.take_along_axis(numbers, top, 1), np.take_along_axis(sums, top, 1)
        out.append(number)
    return np.sort(np.concatenate(out, axis=1), axis=1)


def classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, v) as they are, v null where it can link with nothing; and classes (cls, v, size) of equal vectors."""
    v = F.col(vector_col)
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(~bad, F.transform(v, lambda x: x + F.lit(0).cast("float"))).alias("v"))
    same = rows.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("size"))
    return rows, materialise(same.select(F.monotonically_increasing_id().alias("cls"), "v", "size"), "classes")


def _scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in double precision and their lengths, scaled so that squares of tiny or huge numbers stay finite."""
    x = v.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x, np.linalg.norm(x, axis=1)


def _unit(b: pa.RecordBatch, rows: np.ndarray, dim: int) -> np.ndarray:
    x, n = _scaled(b.column("v").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim))
    return x / n[:, None]


def _kind(words: int, blocks: int, codes: int):
    """Four bytes for a filter's number if they are enough."""
    return (np.int32, "int") if codes * words ** blocks < 1 << 31 else (np.int64, "long")


def filter_rows(cls: DataFrame, words: int, blocks: int, passed: int, codes: int) -> DataFrame:
    """(dim, filter, cls, a, b, smaller): a row for each filter that a class passes, with the class's sketch and the filters of
    smaller number that it passes."""
    kind, name = _kind(words, blocks, codes)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        dims, out = np.asarray(b.column("dim")), []
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            unit = _unit(b, rows, int(dim))
            f, sketch = decode(unit, words, blocks, passed, codes), sketches(unit).view(np.int64)
            k = f.shape[1]
            # of the i-th filter the i before it, for all rows: a ragged array
            before = np.tile(np.arange(k), len(rows))
            ends = np.append(0, np.cumsum(before)).astype(np.int32)
            lists = np.repeat(f, k, axis=0)[np.arange(k)[None, :] < before[:, None]]
            n = np.arange(len(rows)).repeat(k)
            out.append(pa.record_batch([pa.array(np.full(len(n), dim, np.int32)), pa.array(f.ravel()), b.column("cls").take(pa.array(rows[n])), pa.array(sketch[n, 0]),
                                        pa.array(sketch[n, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(lists.astype(kind)))],
                                       names=["dim", "filter", "cls", "a", "b", "smaller"]))
        return pa.concat_batches(out)

    return map_batches(cls.select("cls", "v", F.size("v").alias("dim")), run, f"dim int, filter long, cls long, a long, b long, smaller array<{name}>")


class _Members:
    """Classes of one (filter, block pair): numbers, row counts, sides, vectors, smaller filters."""

    def __init__(self, cls, size, side, x, filters):
        self.cls, self.size, self.side, self.x, self.filters = cls, size, side, x, filters

    def links(self, number: int, left: int, right: int, threshold: float) -> list[np.ndarray]:
        """Columns cls, n, root of what is linked here and at no smaller filter."""
        a = np.flatnonzero(self.side == left)
        b = a if left == right else np.flatnonzero(self.side == right)
        if not len(a) or not len(b):
            return []
        x, n = _scaled(self.x)
        near = (x[a] @ x[b].T) / (n[a][:, None] * n[b][None, :]) >= threshold
        if left == right:
            near |= near.T        # the product need not be symmetric to the last bit
            np.fill_diagonal(near, False)
        i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(i):
            return []
        near = near[np.ix_(i, j)] & ~self._earlier(a[i], b[j], number)
        at_row, at_col = _roots(near, self.cls[a[i]], self.cls[b[j]])
        out = self._sums(near, a[i], b[j], at_row)
        return out if left == right else [np.concatenate(c) for c in zip(out, self._sums(near.T, b[j], a[i], at_col))]

    def _earlier(self, p: np.ndarray, q: np.ndarray, number: int) -> np.ndarray:
        """Which pairs share a filter below ``number``."""
        return _share([[f for f in self.filters[k] if f < number] for k in p], [[f for f in self.filters[k] if f < number] for k in q])

    def _sums(self, near: np.ndarray, rows: np.ndarray, cols: np.ndarray, roots: np.ndarray) -> list[np.ndarray]:
        some = near.any(axis=1)
        return [self.cls[rows][some], (near @ self.size[cols])[some], roots[some]]


def _share(p: list[list[int]], q: list[list[int]]) -> np.ndarray:
    """Which pairs of lists have a number in common."""
    lists = [*p, *q]
    flat = np.array([f for x in lists for f in x], np.int64)
    known, column = np.unique(flat, return_inverse=True)
    has = np.zeros((len(lists), len(known)), np.float32)
    has[np.repeat(np.arange(len(lists)), [len(x) for x in lists]), column] = 1
    return has[:len(p)] @ has[len(p):].T > 0


def survivors(side: np.ndarray, sketch: np.ndarray, smaller: list[list[int]], left: int, right: int, limit: int) -> np.ndarray:
    """Members of one (filter, block pair) with a candidate there: a sketch near their own, and no smaller filter in common."""
    a = np.flatnonzero(side == left)
    b = a if left == right else np.flatnonzero(side == right)
    kept = np.zeros(len(side), bool)
    for lo in range(0, len(a), 256):
        rows = a[lo:lo + 256]
        near = np.bitwise_count(sketch[rows][:, None, :] ^ sketch[b][None, :, :]).sum(axis=2) <= limit
        near &= rows[:, None] != b[None, :]
        i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if len(i):
            near = near[np.ix_(i, j)] & ~_share([smaller[k] for k in rows[i]], [smaller[k] for k in b[j]])
            kept[rows[i][near.any(axis=1)]] = True
            kept[b[j][near.any(axis=0)]] = True
    return np.flatnonzero(kept)


def _roots(near: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column of ``near`` the smallest class that its links reach, itself included.

    If both are the same vectors, a vector's row and column may lie in two components of the matrix, but these
    hold the same classes. Every row and column is visited once.
    """
    at_row, at_col = rows.copy(), cols.copy()
    row_left, col_left = near.any(axis=1), near.any(axis=0)
    for start in np.flatnonzero(row_left):
        if not row_left[start]:
            continue
        row_left[start] = False
        new, in_rows, in_cols = np.array([start]), [], []
        while len(new):
            in_rows.append(new)
            c = np.flatnonzero(near[new].any(axis=0) & col_left)
            col_left[c] = False
            in_cols.append(c)
            new = np.flatnonzero(near[:, c].any(axis=1) & row_left)
            row_left[new] = False
        r, c = np.concatenate(in_rows), np.concatenate(in_cols)
        at_row[r] = at_col[c] = min(rows[r].min(), cols[c].min())
    return at_row, at_col


def _groups(b: pa.RecordBatch, key: list[str], now: tuple | None, held: list[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Whole groups of a sorted stream: those that a batch ends, as (key, parts). The last group stays in ``held``."""
    at = [np.asarray(b.column(c)) for c in key]
    breaks = np.flatnonzero(np.any([c[1:] != c[:-1] for c in at], axis=0)) + 1 if b.num_rows > 1 else []
    for lo, hi in zip([0, *breaks], [*breaks, b.num_rows]):
        k = tuple(int(c[lo]) for c in at)
        if held and k != now:
            yield now, list(held)
            held.clear()
        now = k
        held.append(b.slice(lo, hi - lo))


def _by_group(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    now, held = None, []
    for b in batches:
        if b.num_rows:
            for k, parts in _groups(b, key, now, held):
                yield k, pa.concat_batches(parts)
            now = tuple(int(b.column(c)[b.num_rows - 1].as_py()) for c in key)
    if held:
        yield now, pa.concat_batches(held)


_KEY = ["dim", "filter", "left", "right"]
_SLICE = 1 << 14


def class_links(cls: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, passed: int = PASSED, codes: int | None = None,
                bucket: int = BUCKET) -> DataFrame:
    """(cls, n, root): rows linked to a class at one block pair of a filter, and the smallest class its links reach there."""
    words = code_words(cls.count(), blocks, passed)
    codes = code_count(words) if codes is None else codes
    rows = filter_rows(cls, words, blocks, passed, codes)
    sizes = materialise(filter_counts(cls, words, blocks, passed, codes).where(F.col("n") > bucket).select(
        "dim", "filter", F.ceil(F.col("n") / bucket).cast("int").alias("cuts")), "full")
    cuts = F.coalesce("cuts", F.lit(1))
    placed = rows.join(sizes, ["dim", "filter"], "left").withColumns({"cuts": cuts, "side": F.pmod(F.xxhash64("cls"), cuts).cast("int")})
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.struct(
        F.least("side", o).alias("left"), F.greatest("side", o).alias("right"))))
    dealt = placed.withColumn("p", pair).select("dim", "filter", "p.left", "p.right", "side", "cls", "a", "b", "smaller")
    small_batches(cls.sparkSession)
    limit = sketch_limit(threshold)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, n = [], 0
        for (_, _, left, right), g in _by_group(batches, _KEY):
            if g.num_rows > 1:
                sketch = np.stack((np.asarray(g.column("a")), np.asarray(g.column("b"))), axis=1).view(np.uint64)
                some = survivors(np.asarray(g.column("side")), sketch, g.column("smaller").to_pylist(), left, right, limit)
                if len(some):
                    ready.append(g.take(pa.array(some)).select([*_KEY, "side", "cls", "smaller"]))
                    n += len(some)
            if n > _SLICE:
                yield pa.concat_batches(ready)
                ready, n = [], 0
        if ready:
            yield pa.concat_batches(ready)

    kept = dealt.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(
        pick, T.StructType([*[f for f in dealt.schema.fields if f.name not in ("a", "b")]]))
    kept = materialise(kept, "candidates")
    with_vectors = kept.join(cls.select("cls", "v", "size"), "cls").select(*_KEY, "side", "cls", "size", "v", "smaller")
    with_vectors = with_vectors.repartition(*_KEY).sortWithinPartitions(*_KEY)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[list[np.ndarray]] = []
        for (dim, number, left, right), g in _by_group(batches, _KEY):
            x = g.column("v").flatten().to_numpy(zero_copy_only=False).reshape(g.num_rows, dim)
            m = _Members(*(np.asarray(g.column(c)) for c in ("cls", "size", "side")), x, g.column("smaller").to_pylist())
            ready.append(m.links(number, left, right, threshold))
            if len(ready) > 256:
                yield _links(ready)
                ready = []
        yield _links(ready)

    return with_vectors.mapInArrow(verify, "cls long, n long, root long")


def filter_counts(cls: DataFrame, words: int, blocks: int, passed: int, codes: int) -> DataFrame:
    """(dim, filter, n): how many classes pass each filter."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        dims = np.asarray(b.column("dim"))
        out = []
        for dim in np.unique(dims):
            x = _unit(b, np.flatnonzero(dims == dim), int(dim))
            number, count = np.unique(decode(x, words, blocks, passed, codes), return_counts=True)
            out.append(pa.record_batch([pa.array(np.full(len(number), dim, np.int32)), pa.array(number), pa.array(count)], names=["dim", "filter", "n"]))
        return pa.concat_batches(out)

    part = map_batches(cls.select("v", F.size("v").alias("dim")), run, "dim int, filter long, n long")
    return part.groupBy("dim", "filter").agg(F.sum("n").alias("n"))


def _links(found: list[list[np.ndarray]]) -> pa.RecordBatch:
    found = [f for f in found if f]
    return pa.record_batch([pa.array(np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64), pa.int64())
                            for i in range(3)], names=["cls", "n", "root"])


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                    blocks: int = BLOCKS, passed: int = PASSED, codes: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """One row (id, n_links, component) per input row; ``component``: the smallest id reachable by links."""
    rows, cls = classes(vectors, id_col, vector_col)
    links = materialise(class_links(cls, threshold, blocks, passed, codes, bucket), "links")
    degree = links.groupBy("cls").agg(F.sum("n").alias("n"))
    comp = components(links.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    known = cls.join(degree, "cls", "left").join(comp, F.col("cls") == F.col("node"), "left").select(
        "cls", "v", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    named = materialise(rows.join(known, "v", "left").select("id", "root", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named")
    least = named.where("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    return named.join(least, "root", "left").select(
        "id", "n_links", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component"))
