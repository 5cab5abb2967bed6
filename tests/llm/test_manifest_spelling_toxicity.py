"""Merkle manifest, spelling variants and toxicity against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from featmart.llm import merkle, spelling, toxicity
from featmart.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# --- Merkle manifest ----------------------------------------------------------------------------

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute_leaf(row, change=False):
    v = [row["doc_id"], row["source"], row["lang"], row["n_chars"], lower(row["text"]) if change and row["text"] is not None else row["text"]]
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v))


def climb_of(level, i, fanout):
    """Siblings on the way from node ``i`` up, and the top; the fold of ``mine`` is redone with them."""
    path = []
    while len(level) > 1:
        run = level[i // fanout * fanout:i // fanout * fanout + fanout]
        path.append((run, i % fanout))
        level = [sha("".join(level[k:k + fanout])) for k in range(0, len(level), fanout)]
        i //= fanout
    return path, level[0]


def brute_manifest(rows, fanout=16):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops = [climb_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])], 0, fanout)[1] for s in order]
    out = []
    for k, s in enumerate(order):
        group = sorted(by[s], key=lambda x: x[:3])
        for i, (_, _, leaf, r) in enumerate(group):
            low, subroot = climb_of([x[2] for x in group], i, fanout)
            high, root = climb_of(tops, k, fanout)
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            fold = brute_leaf(r, tampered)
            for run, at in low + high:
                fold = sha("".join(run[:at]) + fold + "".join(run[at + 1:]))
            proof = sha("".join("".join(run[:at] + run[at + 1:]) for run, at in low + high))
            out.append((r["doc_id"], leaf, subroot, root, proof, fold, fold == root))
    return Counter(out)


def manifest_rows(df, **k):
    d = merkle.verify(df, **k)
    return Counter(tuple(r) for r in d.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_merkle_query_by_brute_force(spark, docs):
    want = brute_manifest([r.asDict() for r in docs.collect()])
    got = Counter(tuple(r) for r in QUERIES["op11_merkle"](spark, SF).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert got == want
    assert {v[-1] for v in got} == {True, False}


def test_merkle_odd_rows(spark, odd, none):
    assert manifest_rows(odd) == brute_manifest([r.asDict() for r in odd.collect()])
    assert manifest_rows(none) == Counter()
    one = odd.where("doc_id = 3")
    assert manifest_rows(one) == brute_manifest([r.asDict() for r in one.collect()])     # a lone leaf is the root


@pytest.mark.parametrize("fanout", [2, 3])
def test_merkle_deep_trees(spark, monkeypatch, fanout):
    rnd = random.Random(1)
    sources = ["hot"] * 300 + [None] * 20 + [f"s{i}" for i in range(37)] + ["é", "z", "Z", ""]
    rows = [(rnd.choice([i, i, rnd.randrange(50), None]), f"Text {i % 90}", None, s, i % 7) for i, s in enumerate(sources)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_manifest([r.asDict() for r in df.collect()], fanout)
    assert manifest_rows(df, fanout=fanout) == want
    m = merkle.build(merkle.leaves(df), fanout, share=2)          # upper nodes have many copies
    assert m.nodes.groupBy("tree", "level", "pos").count().agg(F.max("count")).first()[0] > 5
    assert merkle.climb(m).select("root").distinct().count() == 1
    assert spark.conf.get("spark.sql.cteRecursionRowLimit", "1000000") == "1000000"


# --- spelling -----------------------------------------------------------------------------------

def near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    long, short = (u, v) if len(u) > len(v) else (v, u)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_words(rows, drop=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % drop == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute_variants(n, ratio=5):
    key = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            key[w[:i] + w[i + 1:]].add(w)
        key[w].add(w)
    near_of = {w: {v for k in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))} for v in key[k] if near(w, v)} for w in n}
    form = {}
    for w in n:
        best = min(near_of[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(near_of[w]), n[form[w]] if form[w] else None) for w in n}


def variant_rows(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_spelling_query_by_brute_force(spark, docs):
    want = brute_variants(brute_words([(r.doc_id, r.text) for r in docs.collect()]))
    assert variant_rows(QUERIES["op12_spelling"](spark, SF)) == want


def test_acceptor_is_minimal():
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6))) for _ in range(40)})
    root = spelling.minimised(words)
    seen, todo, accepted = {id(root): root}, [(root, "")], set()
    while todo:
        s, x = todo.pop()
        seen[id(s)] = s
        if s.final:
            accepted.add(x)
        todo.extend((t, x + c) for c, t in s.arcs.items())
    assert accepted == set(words)
    rights = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
    assert len(seen) == len(rights)           # a state per right language


def test_composition_meets_each_pair_once():
    rnd = random.Random(3)
    for behind in ("", "a", "b"):
        for size in (1, 2, 3, 5):
            words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.choice((size, size - 1)))) for _ in range(60)})
            got = Counter(frozenset(p) for p in spelling.compose(spelling.minimised(words), size, behind))
            want = Counter()
            for u, v in itertools.combinations(words, 2):
                if len(u) < size and len(v) < size or not near(u, v):
                    continue
                if len(u) != len(v):
                    long, short = (u, v) if len(u) > len(v) else (v, u)
                    last = max(i for i in range(size) if long[:i] + long[i + 1:] == short)
                    if last == size - 1 and long[-1] == behind:
                        continue                # may be inserted later: another block's pair
                want[frozenset((u, v))] += 1
            assert got == want


@pytest.mark.parametrize("members", [1, 3, 4096])
def test_spelling_partitions(spark, members):
    rnd = random.Random(4)
    n = {"".join(rnd.choice("abé") for _ in range(rnd.choice((6, 6, 7, 8)))): rnd.randrange(5, 400) for _ in range(500)}
    long = "".join(rnd.choice("xyz") for _ in range(3000))
    n |= {long: 100, long[:1700] + long[1701:]: 20, long[:40] + "q" + long[41:]: 10, long + "q": 7, "q" + long: 9}
    vocab = spark.createDataFrame(list(n.items()), "word string, n long")
    parts = spelling.partitions(vocab, members)
    assert parts.where("size > 1").groupBy("key").count().where(F.col("count") > members).isEmpty()
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(parts).collect()}
    near_of = {w: [v for v in n if near(w, v)] for w in n}
    want = {w: (len(vs), n[b], b) for w, vs in near_of.items() if vs for b in [min(vs, key=lambda v: (-n[v], v))]}
    assert got == want


def test_spelling_odd_rows(spark, odd, none):
    assert variant_rows(spelling.variants(none)) == set()
    want = brute_variants(brute_words([(r.doc_id, r.text) for r in odd.collect()]))
    assert variant_rows(spelling.variants(odd)) == want
    some = odd.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" Wörter wörter WÖRTER Wörtex wörtex"), F.repeat(F.lit(" wörter"), 9)).alias("text"), "source", "h", "w")
    want = brute_variants(brute_words([(r.doc_id, r.text) for r in some.collect()]))
    assert want and any(w[1] for w in want)
    assert variant_rows(spelling.variants(some)) == want


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(30)] + [(f"leaf{i}", "w05") for i in range(50)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w30" for w, _ in chain}


# --- toxicity -----------------------------------------------------------------------------------

def brute_segments(s):
    """Take the best segment (shortest, if equal), then go on left and right of it."""
    best = max(((sum(s[a:b]), -(b - a), a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    v, _, a, b = best
    return [(x, y, z) for x, y, z in brute_segments(s[:a])] + [(a, b, v)] + [(x + b, y + b, z) for x, y, z in brute_segments(s[b:])]


def test_segments_are_all_maximal_ones():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 25, 40):
        for _ in range(15):
            s = rng.normal(-0.2, 1, n)
            got = toxicity.segments(s)
            want = brute_segments(list(s))
            assert [g[:2] for g in got] == [w[:2] for w in want]
            assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_segments_take_linear_time():
    s = np.tile([1.0, -0.5, -0.6], 200_000)
    assert len(toxicity.segments(s)) == 200_000
    assert len(toxicity.segments(np.concatenate((np.arange(1, 200_000) * -1.0, np.ones(200_000))))) == 1


def test_log_odds_and_decay():
    toxic, clean, corpus = (np.zeros(toxicity.BUCKETS) for _ in range(3))
    toxic[:3], clean[:3], corpus[:4] = (40, 50, 1), (0, 500, 10), (60, 900, 30, 10)
    got = toxicity.log_odds(toxic, clean, corpus)
    for b in range(3):
        a = 0.1 * corpus[b] / corpus.sum()
        at, ac = toxic[b] + a * toxic.sum(), clean[b] + a * clean.sum()
        odds = math.log(at / (1.1 * toxic.sum() - at)) - math.log(ac / (1.1 * clean.sum() - ac))
        want = max(0, abs(odds) - toxicity.Z * math.sqrt(1 / at + 1 / ac))
        assert got[b] == pytest.approx(math.copysign(want, odds))
    assert got[0] > 1 and got[3] == 0
    s, p = np.array([-0.1, 2.0, -1.0]), np.array([0.9, 0.01, 0.09])
    lam = toxicity.decay(s, p)
    assert lam > 0 and p @ np.exp(lam * s) == pytest.approx(1)


def test_evidence_of_several_segments():
    assert toxicity.evidence([-2.0]) == -2.0
    assert toxicity.evidence([3.0, -1.0]) == 3.0
    one, two = toxicity.evidence([6.0]), toxicity.evidence([6.0, 6.0])
    # Karlin and Altschul: P = exp(-t) t^(r-1) / (r! (r-1)!), halved for the choice of r = 2
    assert two == pytest.approx(-math.log(math.exp(-12) * 12 / 2 * 2)) and two > one


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    d = QUERIES["op13_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out and toxic is not null")
    n = {(r.toxic, r.predicted): r["count"] for r in d.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.03


def test_toxicity_rows_and_passages(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model, keep=("doc_id", "text")).collect()
    assert len(got) == docs.count()
    for r in got:
        x, passages = toxicity.judge(r.text, model.scores)
        assert r.score == model.score(x) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
        for p in r.passages:
            part = r.text[p.start:p.end]
            tokens = re.findall(r"[^\W\d_]+", part)
            assert part.startswith(tokens[0]) and part.endswith(tokens[-1])
            assert sum(float(model.scores.table[toxicity.bucket(t)]) for t in tokens) == pytest.approx(p.score, abs=1e-4)
            assert p.expected <= toxicity.E_VALUE * 1.0001
    held = {r.doc_id: r.held_out for r in QUERIES["op13_toxicity"](spark, SF).collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 5 == 0) for k, v in held.items())


def test_labels_of_the_held_out_fifth_teach_nothing(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert (a.scores.table == b.scores.table).all() and (a.scores.rate, a.scores.log_k, a.at, a.slope) == (b.scores.rate, b.scores.log_k, b.at, b.slope)


def test_toxicity_odd_rows(spark, odd, none, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(odd, model, keep=("doc_id", "text")).collect()
    assert len(got) == odd.count()
    empty = [r for r in got if not re.search(r"[^\W\d_]", r.text or "")]
    assert len(empty) == 4 and {r.score for r in empty} == {model.score(0.0)} and not any(r.passages for r in empty)
    assert toxicity.score(none, model, keep=("doc_id",)).collect() == []
    odd_labels = spark.createDataFrame([(1, 1, 7), (1, 0, 7), (2, 0, 7), (5, 1, 7), (None, 1, 7), (3, None, 7)], "doc_id long, toxic int, text int")
    m = toxicity.fit(odd, odd_labels)                        # few rows, null and double labels, a clashing column
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, m).collect())
    for lab, want in ((odd_labels.where("false"), 0.0), (odd_labels.where("toxic = 1 and doc_id is not null"), 1.0)):
        m = toxicity.fit(odd, lab)
        assert {round(r.score, 6) for r in toxicity.score(odd, m).collect()} == {want}
    m = toxicity.fit(none, labels)
    assert {r.score for r in toxicity.score(docs.limit(3), m).collect()} == {m.score(0.0)}
