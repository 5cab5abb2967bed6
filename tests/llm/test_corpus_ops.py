"""SimHash, decontamination, mixing, chat, WARC, embeddings and the pipeline against brute force."""

import hashlib
import math
import os
import re
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from featmart.llm import chat, common, decontam, embed, langid, mixing, pii, simhash, stages, warc
from featmart.llm.queries import ORACLES, QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
from check_oracle import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def groups_of(n, linked):
    """Smallest member reachable, for each of n things."""
    low = list(range(n))

    def find(a):
        while low[a] != a:
            a = low[a]
        return a
    for i, j in linked:
        a, b = sorted((find(i), find(j)))
        low[b] = a
    return [find(i) for i in range(n)]


# --- components ---------------------------------------------------------------------------------

def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(100, 300)] + [(500, 500 + i) for i in range(1, 60)] + [tuple(map(int, e)) for e in rng.integers(1000, 1200, (90, 2))] + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    want = groups_of(len(nodes), [(at[a], at[b]) for a, b in edges if a != b])
    assert set(got) == set(nodes)
    pairs = {(got[x], want[at[x]]) for x in nodes}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SimHash ------------------------------------------------------------------------------------

def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs, odd):
    for r in simhash.fingerprints(docs.limit(60), keep=("text",)).collect():
        assert r.fp & (1 << 64) - 1 == brute_fingerprint(r.text) == simhash.fingerprint(r.text)
    got = simhash.fingerprints(odd).collect()
    assert len(got) == odd.count() and sum(r.fp == 0 for r in got) == 4
    assert simhash.fingerprint("ABC é É") != simhash.fingerprint("abc é é")


@pytest.mark.parametrize("t", [1, 2, 3])
@pytest.mark.parametrize("bucket", [2, 5_000])
def test_fingerprint_links(spark, t, bucket):
    rng = np.random.default_rng(t)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(12):
            x = int(s)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = {(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.fingerprint_links(df, t, bucket).collect()}
    true = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= t}
    assert all((a ^ b).bit_count() <= t for a, b in links)
    if bucket > len(fps):
        assert {tuple(sorted(x)) for x in links} == true
    at = {x: i for i, x in enumerate(fps)}
    assert groups_of(len(fps), [(at[a], at[b]) for a, b in links]) == groups_of(len(fps), [(at[a], at[b]) for a, b in true])


def test_simhash_components(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = simhash.simhash_dedup(d).collect()
    ids = sorted(r.id for r in rows)
    fp = {r.id: r.fp & (1 << 64) - 1 for r in rows}
    want = groups_of(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fp[ids[i]] ^ fp[ids[j]]).bit_count() <= 2])
    assert {r.id: r.component for r in rows} == {x: ids[w] for x, w in zip(ids, want)}


def test_simhash_odd_rows(odd, none):
    got = Counter((r.id, r.component) for r in simhash.simhash_dedup(odd).collect())
    assert got[1, 1] >= 2 and got[None, 1] == 1 and got[3, 2] == 1 and got[None, 2] == 1 and sum(got.values()) == odd.count()
    assert simhash.simhash_dedup(none).count() == 0


# --- decontamination ----------------------------------------------------------------------------

def brute_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(text, items, n=10):
    w, hit, found = brute_words(text), set(), set()
    for item, it in items:
        b = brute_words(it)
        for win in ([b[i:i + n] for i in range(len(b) - n + 1)] if len(b) >= n else [b] if b else []):
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
    return len(w), len(hit), sorted(str(x) for x in found)


def test_decontamination_brute_force(spark):
    items = [(1, "alpha beta gamma"), (2, "one two three four five six seven eight nine ten eleven Twelve"), (10, "one two three four five six seven eight nine ten"),
             (3, ""), (4, None), (5, "de"), (2, "x y z x y z x y z x y z x y z"), (6, "ünï-Çode 日本 a_b")]
    texts = ["", None, "alpha beta gamma delta alpha BETA gamma", "zero one two three four five six seven eight nine ten eleven twelve one", "de de de",
             "x y z " * 9, "ünï çode Ünï çode 日本 a b!", "one two three four five six seven eight nine", "alpha, beta... gamma", "beta gamma alpha"]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    d = spark.createDataFrame([*enumerate(texts), (2, texts[2]), (None, texts[8])], "doc_id long, text string").withColumns({"w": F.lit(1), "k1": F.lit(2), "pos": F.lit(3)})
    got = decontam.decontaminate(d, bench).collect()
    want = [(i, *brute_hits(t, items)) for i, t in [*enumerate(texts), (2, texts[2]), (None, texts[8])]]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=key) == sorted(want, key=key)
    assert all(r.n_items == len(r["items"]) for r in got)
    assert decontam.decontaminate(d.where("false"), bench).count() == 0
    assert {r.n_hit for r in decontam.decontaminate(d, bench.where("false")).collect()} == {0}


def brute_near(rows, items, n=10, share=0.8, slop=2):
    """Items of which a window has ``share`` of its words at most ``slop`` from their places, one word of a pair of its rarest in
    place and the other near its; per row."""
    docs = [brute_words(t) for _, t in rows]
    cf = Counter(w for d in docs for w in d)
    wins = {}
    for item, it in items:
        b = brute_words(it)
        for win in ([b[i:i + n] for i in range(len(b) - n + 1)] if len(b) >= n else [b] if b else []):
            entry = wins.setdefault(tuple(win), [set(), False])
            entry[0].add("" if item is None else str(item))
            entry[1] |= len(b) < 2 * n
    out = []
    for w in docs:
        found = set()
        for win, (names, short) in wins.items():
            rare = sorted((i for i, x in enumerate(win) if cf[x]), key=lambda i: (cf[win[i]], i))[:4]
            pairs = [(rare[0], rare[1 if len(rare) > 1 else 0])] if rare else []
            pairs += [(x, y) for k, x in enumerate(rare) for y in rare[k + 1:]] if short else []
            starts = set()
            for x, y in pairs:
                dx, dy = ([p - i for p, v in enumerate(w) if v == win[i]] for i in (x, y))
                starts |= {s for a in dx for b in dy if abs(a - b) <= slop for s in (a, b)}
            for s in starts:
                here = sum(any(0 <= s + i + k < len(w) and w[s + i + k] == x for k in range(-slop, slop + 1)) for i, x in enumerate(win))
                if here >= math.ceil(share * len(win)):
                    found |= names
        out.append(len(found))
    return out


def test_proximity_by_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    item = lambda k: " ".join(rng.choice(words, k))
    items = [(1, item(30)), (2, item(12)), (3, item(10)), (4, item(7)), (5, "w1"), (None, item(15)), (6, "w1 zz"), (7, None)]
    texts = [None, "", "w1", "zz w1"]
    for _, t in items:
        for _ in range(8):
            w = brute_words(t)
            for _ in range(int(rng.integers(0, 6))):            # changed, lost, added words; cut at either end
                i = int(rng.integers(0, len(w) + 1))
                w = [w[:i] + w[i + 1:], w[:i] + ["new"] + w[i:], w[:i] + [str(rng.choice(words))] + w[i + 1:], w[i // 4:], w[:len(w) - i // 4]][int(rng.integers(0, 5))]
            texts.append(item(int(rng.integers(0, 5))) + " " + " ".join(w) + " " + item(int(rng.integers(0, 5))))
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[9])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for share, slop in ((0.8, 2), (0.6, 1)):
        got = {(r.id, r.n_near) for r in decontam.decontaminate(d, bench, share=share, slop=slop).collect()}
        want = brute_near(rows, items, share=share, slop=slop)
        assert got == {(i, n) for (i, _), n in zip(rows, want)}
    hit = {(i, len(brute_hits(t, items)[2])) for i, t in rows}
    assert sum(n for _, n in got) > sum(n for _, n in hit) > 0          # changed copies are near, not exact


def test_a_leak_with_changed_words_is_near(spark):
    bench = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh ii jj")], "item_id long, text string")
    texts = ["x aa bb cc dd ee ff gg hh ii jj", "x aa new bb cc dd ee ff gg hh ii jj", "aa bb XX dd ee YY gg hh ii jj", "cc dd ee ff gg hh ii jj", "aa bb XX dd ee YY gg ZZ ii jj",
             "bb x x x x x x x x x aa", "cc dd"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.n_hit, r.n_near) for r in decontam.decontaminate(d, bench).collect()}
    assert got == {0: (10, 1), 1: (0, 1), 2: (0, 1), 3: (0, 1), 4: (0, 0), 5: (0, 0), 6: (0, 0)}
    # whichever one word is changed; the rarest ones, too
    words = texts[0].split()[1:]
    d = spark.createDataFrame([(i, " ".join([*words[:i], "ZZ", *words[i + 1:]])) for i in range(10)], "doc_id long, text string")
    assert {r.n_near for r in decontam.decontaminate(d, bench).collect()} == {1}


def test_decontamination_of_very_long_texts(spark):
    """A passage deep inside, and long words: the broadcast of the windows is held against its bytes."""
    blob = "q" * 300_000
    items = [(1, f"{blob} one two three four five six seven eight nine"), (2, "a1 b1 c1 d1 e1 f1 g1 h1 i1 j1")]
    texts = ["word " * 120_000 + items[1][1] + " tail" * 50_000, f"see {items[0][1]} there", "word " * 1000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.id: (r.n_words, r.n_hit, r["items"], r.n_near) for r in decontam.decontaminate(d, bench).collect()}
    assert got == {0: (170_010, 10, ["2"], 1), 1: (12, 10, ["1"], 1), 2: (1000, 0, [], 0)}


# --- mixing -------------------------------------------------------------------------------------

def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    fixed, total = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def check_mix(d, shard_words=mixing.SHARD_WORDS):
    rows = mixing.mix(d, shard_words=shard_words).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target.setdefault(r.source, set()).add(r.target)
        assert 0 <= r.taken <= 2 * r.size
    want = brute_targets(dict(sizes))
    for s in sizes:
        (t,) = target[s]
        assert t == pytest.approx(want[s])
        shards = math.ceil(sizes[s] / shard_words)
        assert abs(taken[s] - t) <= mixing.BLOCK * (1 + shards)
    return rows


def test_mix(spark, odd, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_mix(d)
    key = lambda rows: sorted((r.id or 0, r.size, r.source or "", r.taken) for r in rows)
    assert key(check_mix(d, 2_000)) == key(mixing.mix(d.repartition(7), shard_words=2_000).collect())
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in d.collect()}
    assert {r.id: r.size for r in mixing.mix(d).collect()} == sizes
    rows = check_mix(odd)
    assert len(rows) == odd.count() and [r.size for r in rows if r.id == 2] == [0]
    assert mixing.mix(none).count() == 0


def test_sainte_lague_is_by_highest_quotients(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(25):
        w = [float(x) for x in rng.integers(0, 10 ** int(rng.integers(1, 7)), int(rng.integers(1, 12)))]
        house = int(rng.integers(0, 60)) if sum(w) else 0
        rows += [(g, i, x, house) for i, x in enumerate(w)]
        seats = sorted(((-x / (2 * k + 1), i) for i, x in enumerate(w) if x for k in range(house)))[:house]
        want |= {(g, i): sum(j == i for _, j in seats) for i in range(len(w))}
    got = mixing.sainte_lague(spark.createDataFrame(rows, "g int, p int, w double, house long"), "g", "p", "w", "house").collect()
    assert {(r.g, r.p): r.seats for r in got} == want


# --- chat ---------------------------------------------------------------------------------------

def brute_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "")[:64], hashlib.md5((r[3] or "").encode()).hexdigest()))]
        loss = "".join(t for role, t in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    bits = ["<|im_end|>", "<|im_start|>", "<\\|", "<\\\\|", "<", "|", "\\", "\n", "assistant ok", "é😀", "", "<|im_end|>\n<|im_start|>assistant\nok", "<|endoftext|>"]
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 6)), int(rng.integers(0, 9)), str(rng.choice(["user", "assistant", "system", "odd\nrole\\n", "<|im_end|>", "<\\|"])),
             "".join(rng.choice(bits, int(rng.integers(0, 6))))) for _ in range(300)]
    rows += [(None, 0, "assistant", "no id"), (None, 1, None, None), (8, None, "assistant", None), (8, 3, "assistant", "same"), (8, 3, "assistant", "same"),
             (9, 0, "assistant", "lang " * 200_000)]
    rows += [(10, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(5_000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit(1), "h": F.lit(2), "conv": F.lit(3)})
    old = chat.PART
    parts = chat.format_conversations(d)
    try:
        got = {r.conv: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(parts).collect()}
    finally:
        chat.PART = old
    assert got == brute_chat(rows)
    assert parts.where("conv = 10").count() >= 1
    assert chat.read_back(chat.format_conversations(d.where("false"))).count() == 0


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_chat_order_of_ties_does_not_depend_on_partitions(spark, adaptive):
    """One conversation without turn numbers, over many range partitions: texts that differ early, late, and not at all."""
    rows = [(1, None, "user" if i % 3 else "assistant", [f"{i % 500} short", "x" * 80 + str(i % 700), "same"][i % 7 % 3] + " y" * (i % 50)) for i in range(6_000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        (r,) = chat.read_back(chat.format_conversations(d.repartition(5))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute_chat(rows)[1]


def test_scatter():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 255, 500_000).astype(np.uint8)
    length = np.array([0, 3, 70_000, 1, 0, 130_000, 9])
    start = np.array([5, 10, 100, 0, 1, 200_000, 400_000])
    to = np.cumsum(length) - length
    out = np.zeros(length.sum(), np.uint8)
    chat.scatter(out, to, data, start, length)
    assert out.tobytes() == b"".join(data[a:a + n].tobytes() for a, n in zip(start, length))


# --- WARC ---------------------------------------------------------------------------------------

def test_warc_round_trip(spark):
    trap = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big, pages = "é" * 700, []
    for i in range(120):
        body = [f"page {i}", trap * (i % 5), big, None, "", "\r\n\r\n" + trap + "WARC/1.0\r\n", big + trap, f"x{i}" * 900][i % 8]
        pages.append((i, None if i % 17 == 0 else f"http://x/{i}\r\ninjected: 1", body))
    pages += [(None, "u", big), (None, "u", "small"), (119, "again", f"x{119}" * 900)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "digest": F.lit(2), "off": F.lit(3)})
    got = Counter(tuple(r) for r in warc.archive_and_read(d).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want, top = Counter(), {}
    for i, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    for i, _, h in pages:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and top[h or ""] >= 0 and (i is None or i < top[h or ""])
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top[h or ""] if again else None] += 1
    assert got == want
    assert warc.archive_and_read(d.where("false")).count() == 0


def test_warc_chain_over_blocks(spark):
    """Blocks far smaller than the files: the chain runs over many of them, and false records stay out."""
    trap = "WARC/1.0\r\nContent-Length: 11\r\n\r\nhello world\r\n\r\n"
    d = spark.createDataFrame([(i, "u", f"{i} " * (i % 90) + trap * (i % 4)) for i in range(700)], "page_id long, url string, html string").coalesce(1)
    path = common.shared_path(spark, "warc-test")
    warc.write_archives(warc.plan_records(d), path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        pieces = warc._pieces(spark, path)
        assert pieces.select("block").distinct().count() > 20
        cand = common.materialise(warc.candidates(pieces))
        assert cand.count() > 700 == warc.reachable(cand).count()
        read = warc.read_archives(spark, path)
        # the payloads are read with other splits than the chain was
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        rec = read.rows.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert all(r.intact for r in rec) and read.verified == len(rec) == 700
    assert {r.page_id: r.payload for r in rec} == {r.page_id: r.html for r in d.collect()}


def test_warc_reads_survive_a_change_of_parallelism(spark):
    """More or fewer cores at the second read change the splits of the files; no record is lost or doubled."""
    d = spark.range(40_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), F.col("id") % 30_000, F.repeat(F.lit(" x"), 60)).alias("html"))
    path = common.shared_path(spark, "warc-test")
    warc.write_archives(warc.plan_records(d.repartition(2)), path)
    got = []
    try:
        for before, after in ((4, 7), (7, 4), (3, 31)):
            spark.conf.set("spark.sql.files.minPartitionNum", str(before))
            read = warc.read_archives(spark, path)
            spark.conf.set("spark.sql.files.minPartitionNum", str(after))
            got.append((read.verified, read.rows.count(), read.rows.select("page_id").distinct().count(), warc.resolve(read).count()))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == [(40_000,) * 4] * 3


def test_warc_equal_pieces_inside_and_outside_payloads(spark):
    """A verified record whose very bytes also stand in another's payload counts once for each time it is verified."""
    path = common.shared_path(spark, "warc-test")
    one = spark.createDataFrame([(7, "u", "small")], "page_id long, url string, html string")
    warc.write_archives(warc.plan_records(one), path)
    twin = spark.read.option("wholetext", True).text(path).first()[0]
    rows = [(7, "u", "small"), (7, "u", "small"), (8, "u", "x" + twin), (9, "u", twin + twin + warc.MAGIC * 2), (10, "u", warc.MAGIC + "y" * 9000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = common.shared_path(spark, "warc-test")
    warc.write_archives(warc.plan_records(d), path)
    read = warc.read_archives(spark, path)
    assert Counter((r.page_id, r.payload) for r in read.rows.collect()) == Counter((i, h) for i, _, h in rows)
    narrow = warc.resolve(read)
    assert narrow.count() == 5
    with pytest.raises(RuntimeError, match="verified"):
        warc.resolve(warc.Records(read.rows, 6))


def test_warc_skips_what_precedes_the_first_magic(spark):
    path = common.shared_path(spark, "warc-test")
    spark.createDataFrame([("rubbish before",)], "value string").coalesce(1).write.option("lineSep", warc.MAGIC).text(path)
    read = warc.read_archives(spark, path)
    assert read.verified == 0 and read.rows.count() == 0


# --- embeddings ---------------------------------------------------------------------------------

def brute_embeddings(rows, least=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = []
    for x, i in enumerate(ok):
        for j in ok[:x]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                links.append((i, j))
    return links


@pytest.mark.parametrize("bucket", [5, 1_000])
def test_embeddings(spark, bucket):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 32))
    vecs = [b + rng.normal(size=32) * s for b in base for s in (0, 0.05, 0.2, 0.35)]
    vecs = [np.float32(v).tolist() for v in vecs]
    rows = list(enumerate(vecs + [vecs[3]] * 30 + [[2 * x for x in vecs[3]], None, [], [0.0] * 32, [float("nan")] * 32, [None] + vecs[0][1:], [float("inf")] + vecs[0][1:],
                                  vecs[0][:16], vecs[0][:16], [-0.0] + vecs[1][1:], [0.0] + vecs[1][1:], [1.0], [2.0]]))
    rows += [(5, vecs[5]), (None, vecs[6])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cls": F.lit(1), "size": F.lit(1), "id": F.lit(1)})
    links = brute_embeddings(rows)
    degree = Counter(i for e in links for i in e)
    group = groups_of(len(rows), links)
    least = {}
    for i, g in enumerate(group):
        if rows[i][0] is not None:
            least[g] = min(least.get(g, 1 << 60), rows[i][0])
    got = Counter((r.id, r.n_links, r.component) for r in embed.embedding_dedup(d, bucket=bucket).collect())
    assert got == Counter((rows[i][0], degree[i], least.get(group[i])) for i in range(len(rows)))
    assert embed.embedding_dedup(d.where("false")).count() == 0


@pytest.mark.parametrize("sides", [[0, 0, 0, 0], [0, 1, 0, 1], [1, 0, 1, 0]])
def test_links_of_a_chain_stay_connected(sides):
    """1-4-5-2, where no smallest neighbour crosses the link 4-5."""
    at = {1: 0, 4: 20, 5: 40, 2: 60}
    x = np.array([[np.cos(np.radians(d)), np.sin(np.radians(d))] for d in at.values()], np.float32)
    m = embed._Members(np.array([*at]), np.ones(4, np.int64), np.array(sides), x, [[0]] * 4)
    cls, n, root = m.links(0, min(sides), max(sides), 0.9)
    assert dict(zip(cls, n)) == {1: 1, 4: 2, 5: 2, 2: 1}
    known = [1, 2, 4, 5]
    assert groups_of(4, [(known.index(a), known.index(b)) for a, b in zip(cls, root)]) == [0] * 4


def test_links_of_loose_groups_stay_connected():
    rng = np.random.default_rng(0)
    for k in range(60):
        centre = rng.normal(size=16)
        x = np.float32(centre + rng.normal(size=(30, 16)) * 0.36)
        two = k % 2
        m = embed._Members(rng.permutation(30), np.ones(30, np.int64), np.arange(30) % 2 * two, x, [[0]] * 30)
        parts = [m.links(0, 0, two, 0.9)]
        u = np.float64(x) / np.linalg.norm(np.float64(x), axis=1, keepdims=True)
        near = [(i, j) for i in range(30) for j in range(i) if u[i] @ u[j] >= 0.9 and (not two or m.side[i] != m.side[j])]
        want = groups_of(30, [(int(m.cls[i]), int(m.cls[j])) for i, j in near])
        assert groups_of(30, [(int(a), int(b)) for p in parts if p for a, b in zip(p[0], p[2])]) == want


@pytest.mark.parametrize("words", [64, 128, 512, 2_048, 8_192, 32_768])
def test_filter_recall_at_the_threshold(words):
    """Level from a few thousand vectors to some billions."""
    rng = np.random.default_rng(words)
    x, y = rng.normal(size=(2, 1500 if words < 1_000 else 300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.9 * x + np.sqrt(1 - 0.81) * y
    a, b = embed.decode(x, words), embed.decode(z, words)
    far = np.bitwise_count(embed.sketches(x) ^ embed.sketches(z)).sum(axis=1) > embed.sketch_limit(0.9)
    assert np.mean([np.isin(p, q).any() and not f for p, q, f in zip(a, b, far)]) > 0.98


def test_survivors_meet_at_their_smallest_filter_only():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 32))
    x = np.concatenate((base, base + rng.normal(size=(30, 32)) * 0.02))
    sketch = embed.sketches(x / np.linalg.norm(x, axis=1, keepdims=True))
    every = embed.survivors(np.zeros(60, int), sketch, [[]] * 60, 0, 0, embed.sketch_limit(0.9))
    assert len(every) >= 60
    met = [[k] for k in range(30)] * 2                 # each pair shares a smaller filter: nothing is left for this one
    assert len(embed.survivors(np.zeros(60, int), sketch, met, 0, 0, 5)) == 0
    sides = np.array([0] * 30 + [1] * 30)
    assert len(embed.survivors(sides, sketch, [[]] * 60, 0, 1, embed.sketch_limit(0.9))) == 60
    assert len(embed.survivors(sides, sketch, [[]] * 60, 0, 0, 5)) == 0


def test_vectors_without_near_ones_are_not_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 48))
    near = base[:10] + rng.normal(size=(10, 48)) * 0.05
    d = spark.createDataFrame([(i, np.float32(v).tolist()) for i, v in enumerate([*base, *near])], "vec_id long, embedding array<float>")
    written, write = {}, embed.materialise
    monkeypatch.setattr(embed, "materialise", lambda df, name="table": written.setdefault(name, write(df, name)))
    got = {r.id: r.n_links for r in embed.embedding_dedup(d).collect()}
    assert sum(got.values()) == 20
    assert written["candidates"].select("cls").distinct().count() < 100 and written["candidates"].count() < 150


def test_decoding_finds_the_best_filters():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = embed.decode(x, 8, blocks=3, passed=6, codes=1)
    turn, parts = embed.code(12, 3, 8, 0)
    dots = [p @ c.T for p, c in zip(np.split(x @ turn, 3, axis=1), parts)]
    every = (dots[0][:, :, None, None] + dots[1][:, None, :, None] + dots[2][:, None, None, :]).reshape(5, -1)
    assert np.array_equal(got, np.sort(np.argsort(-every, axis=1)[:, :6], axis=1))


# --- pipeline -----------------------------------------------------------------------------------

def test_pipeline_brute_force(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    now, before = docs, docs.collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = common.materialise(stage(spark, now, sf), name)
        rows = now.collect()
        if i < 4:
            assert now.columns == docs.columns
        if name == "language_id":
            model = langid.fit(docs.where(~langid.held_out()))
            assert {r.doc_id for r in rows} == {r.doc_id for r in before if not model.predict(r.text)[2]}
        if name == "simhash_dedup":
            ids = sorted(r.doc_id for r in before)
            fp = {r.doc_id: simhash.fingerprint(r.text) for r in before}
            group = groups_of(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fp[ids[a]] ^ fp[ids[b]]).bit_count() <= 2])
            assert {r.doc_id for r in rows} == {ids[g] for g in group}
        if name == "decontaminate":
            wins = {tuple(w[i:i + 10]) for _, t in bench for w in [brute_words(t)] for i in range(len(w) - 9)}
            clean = set()
            for r in before:
                w = brute_words(r.text)
                if not any(tuple(w[i:i + 10]) in wins for i in range(len(w) - 9)):
                    clean.add(r.doc_id)
            assert all(len(brute_words(t)) >= 10 for _, t in bench) and {r.doc_id for r in rows} == clean
        if name == "pii":
            assert len(rows) == len(before)
            field = pii.fit(spark.createDataFrame(before, docs.schema))
            old = {r.doc_id: r.text for r in before}
            assert all(r.n_chars == len(r.text) and not pii.base_spans(r.text) for r in rows)
            assert {r.doc_id: r.text for r in rows} == {k: pii.blanked(t, pii.spans(t, field)) for k, t in old.items()}
        before = rows if i < 4 else before
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = brute_targets(dict(sizes))
    assert len(rows) == len(before) and all(abs(taken[s] - want[s]) <= 16 for s in sizes)


def brute_part(text, n):
    ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    return text[:ends[n - 1]] if n else ""


def test_mix_is_carried_out(spark, odd, none):
    """Texts come through the mix: whole copies, the part of the last block, and nothing of what is not taken."""
    for d in (odd, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        mixed = common.materialise(stages.mixture(spark, d, SF))
        rows = mixed.collect()
        assert [c.removeprefix("doc_") if c in ("doc_size", "doc_target", "doc_taken") else c for c in mixed.columns[:len(d.columns)]] == d.columns
        assert Counter((r.doc_id, r.text, r.source) for r in rows) == Counter((r.doc_id, r.text, r.source) for r in d.collect())
        want = Counter()
        for r in rows:
            assert (r.copies, r.part) == ((r.taken // r.size, brute_part(r.text, r.taken % r.size)) if r.size else (0, ""))
            want.update([(r.doc_id, r.source, t) for t in [r.text] * r.copies + [r.part] if t and r.taken])
        assert any(r.taken == 0 for r in rows) and any(r.part for r in rows)
        got = stages.lay_out(mixed).collect()
        assert Counter((r.doc_id, r.source, r.text) for r in got) == want and all(r.n_chars == len(r.text) for r in got)
        words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
        assert sum(words(r.text) for r in got) == sum(r.taken for r in rows)
    assert {r.doc_size for r in stages.mixture(spark, odd, SF).collect()} == {7}
    assert stages.lay_out(stages.mixture(spark, none, SF)).count() == 0


def _shuffles_text(spark, run, monkeypatch):
    """Whether any exchange of any job of ``run``, its result's among them, carries a text column."""
    found = []

    def look(df):
        text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        for block in re.findall(r"\n\(\d+\) (?:Exchange|Sort|SortMergeJoin)\b[^\n]*\n(?:[^\n]+\n)*", text):
            if block.split(")")[1].strip().startswith("Exchange") and re.search(r"Input \[\d+\]: .*\b(text|t|w|payload|value)#", block):
                found.append(block)
        return df
    write = common.materialise
    for module in (common, stages, mixing, decontam, simhash, langid):
        monkeypatch.setattr(module, "materialise", lambda df, name="table": write(look(df), name), raising=False)
    look(run())
    return found


@pytest.mark.parametrize("filter_keys", [common.FILTER_KEYS, 0])
def test_stages_do_not_shuffle_texts(spark, monkeypatch, filter_keys):
    """Beyond the number of keys that is broadcast, a filter takes its place; only without it texts move."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {f.__name__: Counter(map(tuple, f(spark, docs, "/root/testdata/sf0.01").collect())) for f in (stages.deduplicate, stages.mixture)}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(common, "FILTER_KEYS", filter_keys)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for f in (stages.deduplicate, stages.mixture):
            got = []
            moved = _shuffles_text(spark, lambda: got.append(f(spark, docs, "/root/testdata/sf0.01")) or got[0], monkeypatch)
            assert bool(moved) == (f is stages.deduplicate and not filter_keys), (f, moved)
            assert Counter(map(tuple, got[0].collect())) == want[f.__name__]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("rows, filter_keys", [(10, 1 << 20), (10, 0), (1 << 20, 0)])
def test_marked_is_exact(spark, monkeypatch, rows, filter_keys):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(common, "FILTER_KEYS", filter_keys)
    monkeypatch.setattr(common, "FILTER_BITS", 2)            # many strays
    every = spark.range(20_000).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"), "id")
    inside = common.materialise(every.where("id % 3 = 0").select("a", "b"))
    others = common.materialise(every.select("a", "b"))
    got = common.marked(every.unionByName(every.where("id < 50")), ["a", "b"], inside, others, "f")
    assert got.columns == ["a", "b", "id", "f"] and got.where("f <> (id % 3 = 0)").isEmpty() and got.count() == 20_050


def test_equal_rows_at_the_cut_are_numbered(spark):
    rows = [(1, "one two three", "s", 7)] * 40 + [(2, "four five", "s", 7)] * 30 + [(3, "x " * 9, "t", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_rk int").repartition(5)
    p = mixing.plan(d)
    assert p.shards.agg(F.max("copies")).first()[0] > 1
    got = mixing.apply(d, p).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "source", "_mix_rk", "size", "source_size", "target", "taken"}
    for s, blocks in (("s", 8), ("t", 8)):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2 * blocks
        assert sum(0 < r.taken % r.size for r in mine) <= 1 and all(r.taken <= 2 * r.size for r in mine)


def test_first_words_of_long_texts(spark):
    t = "\n Wort\u00a0eins \t zwei\r\n" * 50_000
    for n in (0, 1, 3, 99_999, 100_000):
        (r,) = spark.createDataFrame([(t, n)], "t string, n long").select(mixing.first_words(F.col("t"), F.col("n")).alias("p")).collect()
        assert r.p == brute_part(t, n)


def test_pipeline_returns_the_redacted_corpus(spark):
    import corpus_pipeline
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.text and r.taken > 0 and not pii.base_spans(r.text) for r in rows)
    assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(rows[0].asDict())


def test_pipeline_odd_rows(spark, odd, none):
    import corpus_pipeline
    for d in (odd, none):
        now = d
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            now = common.materialise(stage(spark, now, SF), name)
            assert i == 4 or now.columns == d.columns
    kept = common.materialise(corpus_pipeline.STAGES[1][1](spark, odd, SF))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 1), (False, 2), (False, 5), (False, 6)]
