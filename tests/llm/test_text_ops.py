"""PII, language ID, token counts, licenses: brute force, held-out accuracy, exact library counts."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from featmart.llm import langid, licenses, pii, tokens
from featmart.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def literal_spans(t):
    """The base patterns as they are written, by the standard library."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))]
        if 12 <= len(d) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_are_the_patterns(docs):
    for r in docs.collect():
        assert pii.base_spans(r.text) == literal_spans(r.text)
    rng = random.Random(1)
    bits = ["1", "23", "255", "4111111111111111", ".", "@", "a", "b.c", "+", "+1", " ", "-", "(", ")", "x@y.z", "1.2.3.4", "%", "\n", "é", "٣", "000"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(t) == literal_spans(t), t


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.examples(pii.EXAMPLES))


def brute_best(field, n, cand, s):
    """The best score over all segmentations, by plain recursion."""
    def go(at, before):
        if at == n:
            return 0.0
        best = field.t[before, 0] + go(at + 1, 0)
        for c, (i, j) in enumerate(cand):
            if i == at:
                for k in range(len(pii.KINDS)):
                    best = max(best, field.t[before, k + 1] + s[c, k] + go(j, k + 1))
        return best
    return go(0, 0)


def test_decoding_is_the_best_segmentation():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 7))
        cand = sorted({(int(i), int(j)) for i, j in rng.integers(0, n + 1, (6, 2)) if i < j})
        f = pii.Field(np.zeros((1, 4)), rng.normal(size=(5, 5)))
        s = rng.normal(size=(len(cand), 4))
        segs = f.decode(n, cand, s)
        total, at, before = 0.0, 0, 0
        for i, j, k in [*segs, (n, n, None)]:
            while at < i:
                total, at, before = total + f.t[before, 0], at + 1, 0
            if k is not None:
                total, at, before = total + f.t[before, k + 1] + s[cand.index((i, j)), k], j, k + 1
        assert total == pytest.approx(brute_best(f, n, cand, s))


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    cand, n = [(0, 1), (0, 2), (1, 3), (2, 3)], 3
    s, f = rng.normal(size=(4, 4)), pii.Field(np.zeros((1, 4)), rng.normal(size=(5, 5)) * 0.3)
    gold = {1: 2}

    def loglik(s, t):
        def paths(at, before):
            if at == n:
                return [0.0]
            out = [t[before, 0] + x for x in paths(at + 1, 0)]
            return out + [t[before, k + 1] + s[c, k] + x for c, (i, j) in enumerate(cand) if i == at for k in range(4) for x in paths(j, k + 1)]
        return t[0, 3] + s[1, 2] + t[3, 0] - np.logaddexp.reduce(paths(0, 0))

    grad, pair = f.gradient(n, cand, s, gold)
    for at in np.ndindex(4, 4):
        d = np.zeros_like(s)
        d[at] = 1e-5
        assert grad[at] == pytest.approx((loglik(s + d, f.t) - loglik(s - d, f.t)) / 2e-5, abs=1e-5)
    for at in np.ndindex(5, 5):
        d = np.zeros_like(f.t)
        d[at] = 1e-5
        assert pair[at] == pytest.approx((loglik(s, f.t + d) - loglik(s, f.t - d)) / 2e-5, abs=1e-5)


def test_field_adds_variants_and_leaves_lookalikes(field):
    found = [(set(g), {s[:3] for s in pii.spans(line, field)}) for line, g in pii.examples(300, seed=77)]
    right = sum(len(g & h) for g, h in found)
    assert right / sum(len(g) for g, _ in found) > 0.95
    assert sum(len(h - g) for g, h in found) / sum(len(h) for _, h in found) < 0.06
    for clean in ("on 2024-01-15 at 12:30:45 version 2.0", "pages 12, 13 and 1,234,567 in 1999-2004", "", "no number here"):
        assert pii.spans(clean, field) == []
    two = "pay 4111111111111111 4242424242424242 now"
    assert [s[0] for s in pii.spans(two, field)] == ["card", "card"] and pii.base_spans(two) == []
    assert pii.spans(None, field) == []


def test_long_lines(field):
    t = "10.0.0.1 x@y.de " * 3000
    assert len([s for s in pii.spans(t, field) if s[3]]) == 6000
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000) == []


def test_redaction():
    assert pii.blanked("a 1.2.3.4 b", [("ip", 2, 9, True)]) == "a [IP] b"
    assert pii.blanked("0123456789", [("ip", 1, 5, True), ("card", 3, 7, True), ("ip", 8, 9, False)]) == "0[IP]7[IP]9"


def test_pii_query(spark):
    rows = QUERIES["op1_pii"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import hashlib
    assert len(rows) == len(texts)
    for r in rows:
        base = literal_spans(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert {x for x in line.split(",") if x} <= set(r.spans.split(","))


def test_pii_odd_rows(field, odd, none):
    got = pii.find(odd, field).collect()
    assert len(got) == odd.count() and pii.find(none, field).count() == 0
    out = pii.redact(odd, field)
    assert out.columns == odd.columns and out.where("doc_id = 6").first().text.count("[") >= 2
    assert out.where("text is null").count() == 2


# --- language ID --------------------------------------------------------------------------------

def test_language_held_out(spark):
    rows = QUERIES["op2_language"](spark, "/root/testdata/sf0.01").collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(langs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 2


def test_language_is_the_nearest_centroid(spark, docs):
    model = langid.fit(docs)
    again = langid.fit(docs)
    assert np.array_equal(model.centroids, again.centroids) and model.langs == again.langs
    for r in docs.limit(40).collect():
        at, n = langid.grams(r.text)
        v = np.zeros(langid.DIM)
        v[at] = (1 + np.log(n)) * model.idf[at]
        cos = v @ model.centroids / np.linalg.norm(v)
        lang, score, _ = model.predict(r.text)
        assert lang == model.langs[int(np.argmax(cos))] and score == pytest.approx(max(cos), abs=1e-5)


def test_language_odd_rows(odd, none, docs):
    model = langid.fit(docs)
    got = {(r.doc_id, r.text): r for r in langid.predict(odd.select("doc_id", "text"), model, keep=("doc_id", "text")).collect()}
    assert got[3, ""].lang_pred == got[2, None].lang_pred == "und" and got[3, ""].rejected and got[3, ""].score == 0
    assert langid.predict(odd, model, keep=("doc_id",)).count() == odd.count()
    assert langid.predict(none, model, keep=("doc_id",)).count() == 0
    assert langid.fit(none).predict("the text") == ("und", 0.0, True)
    assert len(langid.fit(odd).langs) >= 2
    foreign = model.predict("Привет мир это текст на русском языке и он длинный")
    assert foreign[2] and foreign[1] < 0.1


def test_language_long_text_in_pieces():
    t = "wort eins zwei " * 200
    old = langid.PIECE
    try:
        whole = langid.grams(t)
        langid.PIECE = 300
        parts = langid.grams(t)
    finally:
        langid.PIECE = old
    a, b = np.zeros(langid.DIM), np.zeros(langid.DIM)
    a[whole[0]], b[parts[0]] = whole[1], parts[1]
    assert np.abs(a - b).sum() <= 8 * len(t) / 300


# --- token counts -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def paths():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    p = P.path(tokens.TOKENIZER)
    return p, Tokenizer.from_file(p)


def test_every_prefix_is_exact(paths, docs):
    c, lib = tokens.counter(paths[0]), paths[1]

    def check(t):
        got = c.prefixes(t)
        assert [len(lib.encode(t[:j], add_special_tokens=False).ids) for j in range(1, len(t) + 1)] == got.tolist(), t

    for r in docs.limit(12).collect():
        check(r.text[:300])
    rng = random.Random(5)
    bits = ["a", "the", " ", "  ", "\n", "\t", "'re", "'ll", "'s", "'", "é", "ß", "日本", "😀", "1", "23", "...", "<|endoftext|>", "<|endof", "|>",
            "\x1c", "\x85", "!!", "-", "=====", "\r\n", chr(0x558), chr(0x10940)]
    for _ in range(400):
        check("".join(rng.choice(bits) for _ in range(rng.randint(1, 12))))
    check("a" * 200)
    check(" " * 150 + "x")


def test_token_table(spark, paths, odd, none):
    d = tokens.token_table(odd.unionByName(odd.limit(1).withColumn("text", odd["text"])), paths[0])
    lib = paths[1]
    n = 0
    for r in d.collect():
        n += 1
        counts = tokens.unpack(r.width, r.deltas)
        assert counts[0] == 0 and counts[-1] == r.n_tokens
    assert n == odd.count() + 1
    texts = [r.text or "" for r in odd.collect()]
    got = tokens.token_table(odd, paths[0]).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted((len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert tokens.token_table(none, paths[0]).count() == 0


def test_answers_without_encoding(spark, paths, docs):
    table = tokens.token_table(docs, paths[0])
    texts, lib = {r.doc_id: r.text for r in docs.collect()}, paths[1]
    for r in tokens.answer(table, budget=50, chars=100).limit(60).collect():
        t = texts[r.id]
        assert r.tokens == len(lib.encode(t[:100], add_special_tokens=False).ids)
        assert len(lib.encode(t[:r.cut], add_special_tokens=False).ids) <= 50
        assert r.cut == len(t) or len(lib.encode(t[:r.cut + 1], add_special_tokens=False).ids) > 50


def test_packing():
    for a in ([], [1, 2, 1], [0, 300, 2], [0, 70_000]):
        w, d = tokens.pack(np.array(a, np.int64))
        assert tokens.unpack(w, d).tolist() == [0, *a]


FOREIGN = ["Il gatto dorme sul tavolo mentre la pioggia cade lentamente sulla città antica.", "Questo documento descrive come installare il programma.",
           "De kat slaapt op de tafel terwijl de regen langzaam over de oude stad valt.", "Dit document beschrijft hoe het programma wordt geïnstalleerd.",
           "Katten sover på bordet medan regnet sakta faller över den gamla staden.", "xkq zzv wqp jjk qqx vvz kkq"]


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_foreign_lines_are_rejected_and_documents_kept(spark, sf):
    d = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    model = langid.fit(d.where(~langid.held_out()))
    assert all(model.predict(t)[2] for t in FOREIGN)
    n = d.where("text rlike '[a-z]'").count()
    assert langid.accepted(d, model).count() >= n * 0.9985
    floors = np.array([model.floors[model.langs.index(x)] for x in sorted(set(model.langs))])
    assert (floors.std(axis=0) > 0).any()                  # each language has its own


@pytest.mark.parametrize("out", ["de", "en", "es", "fr"])
def test_a_language_that_was_not_learned_is_rejected(spark, out):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(d.where(~langid.held_out()).where(F.col("lang") != out))
    assert langid.predict(d.where(F.col("lang") == out), model).agg(F.avg(F.col("rejected").cast("int"))).first()[0] > 0.95


def test_equal_cosines_go_to_the_first_language(spark):
    rows = [(i, f"the same words in both {i % 5}", lang, None) for i in range(40) for lang in ("b", "a")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert model.predict("the same words in both 3")[0] == "a"


def test_counts_beyond_sixteen_bits_weigh_by_their_logarithm():
    n = np.array([3, 65_535, 65_536, 10 ** 6])
    w = langid._weigh(np.arange(4), n, np.ones(langid.DIM, np.float32))
    want = 1 + np.log(n)
    assert np.allclose(w, want / np.linalg.norm(want), atol=1e-6)


# --- licenses -----------------------------------------------------------------------------------

LINES = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
         "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "reserved"}


def test_license_lines(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {}
    for r in licenses.scan(d).collect():
        got.setdefault(r.id, []).append((r.start, r.license))
    for r in d.collect():
        want = sorted((m.start(), name) for line, name in LINES.items() for m in re.finditer(re.escape(line), r.text))
        assert sorted(got.get(r.doc_id, [])) == want


@pytest.mark.parametrize("text, name", [
    ("Distributed under the MIT License.", "MIT"), ("Provided under the MIT License.", "MIT"), ("Licensed under the Apache License 2.0", "Apache-2.0"),
    ("SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"), ("BSD-2-Clause", "BSD-2-Clause"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("SPDX-License-Identifier: Zlib", "Zlib"),
    ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
    *[(licenses.TEMPLATES["GPL-3.0"][1].replace("GNU", f"GNU {w}"), n) for w, n in (("Affero", "AGPL-3.0"), ("Lesser", "LGPL-3.0"))],
    *[(f"This work is licensed under a Creative Commons Attribution-{w} 4.0 International License.", n)
      for w, n in (("NoDerivatives", "CC-BY-ND-4.0"), ("NonCommercial-ShareAlike", "CC-BY-NC-SA-4.0"), ("ShareAlike", "CC-BY-SA-4.0"))]])
def test_usual_licenses(text, name):
    assert [m[0] for m in licenses.scan_text("some words before it\n\n" + text + "\n\nand some after it")] == [name]


@pytest.mark.parametrize("text, names", [
    ("MIT License", ["MIT"]), ("See the MIT license for details.", ["MIT"]), ("licensed under GPLv2", ["GPL-2.0"]),
    ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", ["LGPL-2.1"]), ("CC0-1.0", ["CC0-1.0"]), ("0BSD", ["0BSD"]), ("WTFPL", ["WTFPL"]),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]), ("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 AND BSD-3-Clause) or mit", ["GPL-2.0", "BSD-3-Clause", "MIT"]),
    ("SPDX-License-Identifier: GPL-2.0+", ["GPL-2.0"]), ("SPDX-License-Identifier: LicenseRef-own OR ISC.", ["ISC"]), ("SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", ["Apache-2.0"]),
    ("Apache License 2.0", ["Apache-2.0"]), ("BSD 3-Clause", ["BSD-3-Clause"]), ("the GNU Affero General Public License version 3", ["AGPL-3.0"]),
    ("Licensed under the MIT License. Licensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]), ("Creative Commons Zero v1.0 Universal", ["CC0-1.0"])])
def test_names_and_expressions(text, names):
    got = licenses.scan_text("some words before it\n\n" + text + "\n\nand some after it")
    assert [m[0] for m in got] == names
    if "SPDX" in text:
        assert {m[6] for m in got} == {text.split(": ")[1].rstrip(".")}


def test_expression_spans():
    t = "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC\nMIT License follows"
    got = licenses.scan_text(t)
    assert [t[m[1]:m[2]] for m in got] == ["MIT", "Apache-2.0", "ISC", "MIT License"]
    assert [m[6] for m in got] == ["(MIT OR Apache-2.0) AND ISC"] * 3 + [None]


def brute_align(template, words):
    """Least missing + added over all places, no telling word missing or added."""
    telling = licenses._telling(template)
    best = None
    for i in range(len(words) + 1):
        cost = [[None] * (len(words) - i + 1) for _ in range(len(template) + 1)]
        cost[0][0] = 0
        for a in range(len(template) + 1):
            for b in range(len(words) - i + 1):
                if a == b == 0:
                    continue
                options = []
                if a and cost[a - 1][b] is not None and template[a - 1] not in telling:
                    options.append(cost[a - 1][b] + 1)
                if b and cost[a][b - 1] is not None and not licenses._tells(words[i + b - 1]):
                    options.append(cost[a][b - 1] + 1)
                if a and b and template[a - 1] == words[i + b - 1] and cost[a - 1][b - 1] is not None:
                    options.append(cost[a - 1][b - 1])
                cost[a][b] = min(options, default=None)
        ends = [c for c in cost[-1] if c is not None]
        if ends and (best is None or min(ends) < best):
            best = min(ends)
    return best


def test_alignment_has_the_fewest_differences():
    rnd = random.Random(6)
    pool = ["the", "of", "work", "license", "mit", "2", "bsd", "is", "granted"]
    seen = 0
    for _ in range(400):
        t = [rnd.choice(pool) for _ in range(rnd.randint(1, 7))]
        w = [rnd.choice(pool) for _ in range(rnd.randint(0, 4))]
        for x in t:
            w += rnd.choice([[x], [x], [x], [], [rnd.choice(pool), x]])
        w += [rnd.choice(pool) for _ in range(rnd.randint(0, 4))]
        got, want = licenses.align(t, w), brute_align(t, w)
        if got is None:
            assert want is None or want >= len(t)          # nothing of the template there
            continue
        first, last, missing, added = got
        assert missing + added == want and last - first - added == len(t) - missing > 0
        seen += 1
    assert seen > 150


def test_winners_are_ranked_by_what_they_save():
    """A notice that holds a statement's words saves more than the statement, and is confirmed first."""
    notice = licenses.TEMPLATES["Apache-2.0"][1]
    assert [m[0] for m in licenses.scan_text(notice)] == ["Apache-2.0"] and len(licenses.scan_text(notice)) == 1
    (m,) = licenses.scan_text(notice)
    assert m[2] - m[1] > 500 and m[3] > 0.5


def test_every_template_is_found_under_its_name():
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            assert [(m[0], m[4], m[5]) for m in licenses.scan_text(t)] == [(name, 0, 0)], t


def test_license_wording(odd, none):
    mit = licenses.TEMPLATES["MIT"][2]
    (m,) = licenses.scan_text("x y z " * 50 + "\n// " + mit.replace(", ", ",\n// ") + "\nfoo")
    assert m[0] == "MIT" and m[4:6] == (0, 0)
    (m,) = licenses.scan_text(mit.replace("free of charge", "without charge"))
    assert m[0] == "MIT" and m[4] == 2 and m[5] == 1
    assert [x[0] for x in licenses.scan_text("All rights reserved. and then ALL RIGHTS RESERVED")] == ["reserved"] * 2
    for near in ("Licensed under the Apple License, Version 2.0.", "the GNU General Public License, version 1.", "a licence to fish", "", None):
        assert licenses.scan_text(near) == []
    assert len(licenses.scan_text("All rights reserved. " * 900)) == 900
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0
