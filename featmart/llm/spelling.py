"""Spelling variants by finite-state composition.

Words are runs of letters, A-Z lower-cased; those frequent enough are the vocabulary. Two words are near
if one inserted, deleted or replaced code point makes one the other. Near words are the pairs that the
composition acceptor . one-edit transducer . acceptor accepts, where the acceptor is the minimised automaton
of the vocabulary.

The composed machine is enumerated per initial state. Words of lengths m and m - 1 make class m; the m places
an edit may have in the longer word are cut into blocks, and two words whose edit lies in block j share
what is before and behind it: the state that the acceptor reaches over the part before (and, read from the
right, over the part behind) is the partition's initial state. So a partition is a key (m, block, part before,
part behind) with the words' middles. It starts with two blocks; a partition of more than ``MEMBERS`` words, or
with long middles, is cut into the two halves of its block, down to single places where at most one
word per code point can meet. A task builds the minimised acceptor of a partition's middles, and walks the composed
machine: both tapes over one state up to the edit, then two states that read the same. The transducer inserts only
where the next code point differs, so a pair has one path and is met in one partition only. What leaves a
task is, for each word, the number of its near words there and the best of them, not the pairs.

A word's form is its near word of largest count (ties: smallest in code-point order) if that is at least ``RATIO``
times its own; its root is the last of the forms' forms. Counts grow along the forms, so they end.

Odd rows: null texts have no words; a null id is an empty one in the hash; repeated rows count as often as they
occur; an empty table has no words. Very long runs of letters are words like others. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmart.llm.common import ascii_lower, materialise, small_batches

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
DROP_EVERY = 199
MEMBERS = 4_096       # words of a partition beyond which it is cut
LONGEST = 64          # code points of a middle beyond which it is cut
_BREAKS = r"[^A-Za-zÀ-ÿ]+"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
               least_count: int = LEAST_COUNT, drop_every: int | None = DROP_EVERY) -> DataFrame:
    """(word, n). A run in which ``drop_every`` divides h, the CRC-32 of id and run, loses its code point
    h % length (None: no run does)."""
    i = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    run = docs.select(i.alias("i"), F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), _BREAKS)).alias("run"))
    run = run.where(F.char_length("run") >= least_length).select("i", ascii_lower(F.col("run")).alias("run"))
    word = F.col("run")
    if drop_every:
        h = F.crc32(F.concat_ws(":", "i", "run"))
        at = (h % F.char_length("run")).cast("int")
        word = F.when(h % drop_every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(word)
    return run.select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _placed(words: DataFrame, m: Column, blocks: Column, block: Column) -> DataFrame:
    """(word, n, m, blocks, block, size, key, mid, behind) of ``words`` put into a block of a class."""
    t = words.select("word", "n", m.cast("int").alias("m"), blocks.cast("int").alias("blocks"), block.cast("int").alias("block"))
    length = F.char_length("word")
    start = F.floor(F.col("m") * F.col("block") / F.col("blocks")).cast("int")
    end = F.floor(F.col("m") * (F.col("block") + 1) / F.col("blocks")).cast("int")
    t = t.withColumns({"s": start, "size": end - start, "rest": F.col("m") - end}).where("size > 0")
    t = t.withColumn("tail", F.substring("word", length - F.col("rest") + 1, F.col("rest")))
    key = F.md5(F.concat_ws(":", "m", "blocks", "block", F.substring("word", F.lit(1), F.col("s")), "tail"))
    return t.select("word", "n", "m", "blocks", "block", "size", key.alias("key"),
                    F.substring("word", F.col("s") + 1, length - F.col("rest") - F.col("s")).alias("mid"), F.substring("tail", 1, 1).alias("behind"))


def partitions(vocab: DataFrame, members: int = MEMBERS, longest: int = LONGEST) -> DataFrame:
    """The vocabulary's words in all their partitions, none with more than ``members`` words unless its block is
    a single place."""
    length = F.char_length("word")
    classes = vocab.select("word", "n", F.explode(F.array(length, length + 1)).alias("m")).select(
        "*", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    rows, ready = materialise(_placed(classes, F.col("m"), F.lit(2), F.col("j")), "blocks"), None
    while True:
        big = ((F.col("c") > members) & (F.col("size") > 1)) | ((F.col("c") > 1) & (F.col("size") > longest))
        cut = materialise(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("c")).where(big).select("key"), "cut")      # at most rows / members, and long ones
        done = rows.where(F.col("size") <= longest).join(cut, "key", "left_anti")
        ready = done if ready is None else ready.unionByName(done)
        if cut.isEmpty():
            return ready
        halves = rows.join(cut, "key", "left_semi").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
        rows = materialise(_placed(halves, F.col("m"), F.col("blocks") * 2, F.col("block") * 2 + F.col("j")), "blocks")


class State:
    """A state of an acceptor."""
    __slots__ = ("arcs", "final")

    def __init__(self):
        self.arcs: dict[str, State] = {}
        self.final = False


def minimised(words: list[str]) -> State:
    """The initial state of the minimal acyclic acceptor of sorted, distinct ``words``: equal right languages
    are one state."""
    root, known = State(), {}
    path: list[tuple[State, str, State]] = []         # the last word's arcs that may still grow

    def settle(down_to: int) -> None:
        while len(path) > down_to:
            parent, c, child = path.pop()
            sign = (child.final, tuple((a, id(s)) for a, s in child.arcs.items()))       # arcs come in order
            parent.arcs[c] = known.setdefault(sign, child)

    last = ""
    for w in words:
        same = 0
        while same < len(w) and same < len(last) and w[same] == last[same]:
            same += 1
        settle(same)
        at = path[-1][2] if path else root
        for c in w[same:]:
            nxt = State()
            at.arcs[c] = nxt
            path.append((at, c, nxt))
            at = nxt
        at.final = True
        last = w
    settle(0)
    return root


def common(p: State, q: State, length: int, not_first: str | None = None) -> Iterator[str]:
    """The strings of ``length`` that both states accept, not beginning with ``not_first``."""
    todo = [(p, q, "")]
    while todo:
        a, b, x = todo.pop()
        if len(x) == length:
            if a.final and b.final:
                yield x
            continue
        less, more = (a, b) if len(a.arcs) <= len(b.arcs) else (b, a)
        for c in less.arcs:
            if c in more.arcs and (x or c != not_first):
                todo.append((a.arcs[c], b.arcs[c], x + c))


def compose(root: State, size: int, behind: str = "") -> Iterator[tuple[str, str]]:
    """Pairs that acceptor . one edit . acceptor accepts: middles of ``size`` that differ in one code point, and
    one of ``size`` with one of ``size`` - 1 that lacks a code point. ``behind`` is the code point that follows."""
    todo = [(root, "")]
    while todo:
        p, x = todo.pop()
        left = size - len(x) - 1
        if left < 0:
            continue
        arcs = list(p.arcs.items())
        for i, (a, pa_) in enumerate(arcs):
            todo.append((pa_, x + a))
            for b, pb in arcs[i + 1:]:
                for y in common(pa_, pb, left):
                    yield x + a + y, x + b + y
            for y in common(pa_, p, left, a):
                if y or behind != a:
                    yield x + a + y, x + y


def _partition(words: list[str], counts: list[int], mids: list[str], size: int, behind: str, out: list[list]) -> None:
    """Append (word, near words, count of the best, the best) for each word of a partition with a near word."""
    at = {m: i for i, m in enumerate(mids)}
    near, best = [0] * len(mids), [None] * len(mids)
    for u, v in compose(minimised(sorted(at)), size, behind):
        i, j = at[u], at[v]
        for a, b in ((i, j), (j, i)):
            near[a] += 1
            bid = (-counts[b], words[b])
            if best[a] is None or bid < best[a]:
                best[a] = bid
    for i, b in enumerate(best):
        if b:
            for c, v in zip(out, (words[i], near[i], -b[0], b[1])):
                c.append(v)


def near_words(parts: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) per word with a near word, from ``partitions`` rows."""
    small_batches(parts.sparkSession)
    src = parts.select("key", "word", "n", "mid", "behind", "size").repartition("key").sortWithinPartitions("key")

    def batch(out: list[list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())],
                               names=["word", "k", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], 0, "")
        for b in batches:
            out: list[list] = [[], [], [], []]
            for k, word, n, mid, behind, size in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if len(held[0]) > 1:
                        _partition(*held, out)
                    key, held = k, ([], [], [], size, behind)
                held[0].append(word)
                held[1].append(n)
                held[2].append(mid)
            yield batch(out)
        out = [[], [], [], []]
        if len(held[0]) > 1:
            _partition(*held, out)
        yield batch(out)

    found = src.mapInArrow(run, "word string, k long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): the last of the forms' forms, by pointer jumping. A round doubles
    the steps; there are few, as counts grow by the ratio with each."""
    known = forms.select(F.col("word").alias("form"), F.lit(True).alias("goes_on"))
    ptr = materialise(forms.join(known, "form", "left").select("word", F.col("form").alias("root"), F.col("goes_on").isNull().alias("done")), "pointers")
    while not ptr.where("not done").isEmpty():
        onward = ptr.select(F.col("word").alias("root"), F.col("root").alias("far"), F.col("done").alias("far_done"))
        moved = ptr.where("not done").join(onward, "root").select("word", F.col("far").alias("root"), F.col("far_done").alias("done"))
        ptr = materialise(ptr.where("done").unionByName(moved), "pointers")
    return ptr.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
             ratio: int = RATIO, drop_every: int | None = DROP_EVERY, members: int = MEMBERS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of the vocabulary."""
    vocab = materialise(vocabulary(docs, id_col, text_col, least_length, least_count, drop_every), "vocabulary")
    best = near_words(partitions(vocab, members))
    good = F.col("best_n") >= ratio * F.col("n")
    named = materialise(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "named")
    end = roots(named.where("form is not null").select("word", "form"))
    return named.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
