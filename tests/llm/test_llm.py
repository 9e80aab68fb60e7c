"""The corpus operators against brute force, round trips and held-out accuracy, and their edge cases."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeseek.llm import bpe, language_id, license_scan, line_dedup, near_dedup, packing, quality_rules, registry, secret_scan, url_filter, vector_search
from lodeseek.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]
WS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n=80, lines=4):
    rng = np.random.default_rng(seed)
    words = [WORDS[i] for i in rng.integers(0, len(WORDS), n)]
    return "\n".join(" ".join(words[i::lines]) for i in range(lines))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


EDGES = [None, "", " \n\t ", "a", "a b", "é ü", "x" * 5000, "word " * 3000, "\n\n\n", "a b", "ſK PASSWORD=abc"]


def test_components_of_paths_stars_and_loops(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(60)] + [(7, 7), (None, 3), (500, 499)] + [tuple(map(int, p)) for p in rng.integers(2000, 2060, (30, 2))]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    edges = spark.createDataFrame(pairs, "a long, b long")
    assert dict(connected_components(edges, "a", "b").collect()) == {x: find(x) for x in parent}
    assert connected_components(edges.limit(0), "a", "b").count() == 0


def brute_duplicates(texts, size, percent):
    sets = []
    for t in texts:
        w = WS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= percent * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = [low if x == high else x for x in comp]
    return [(i, len(s), comp[i], comp[i] == i) for i, s in enumerate(sets)]


def edited(text, seed, n):
    rng = np.random.default_rng(seed)
    words = text.split(" ")
    for i in rng.integers(0, len(words), n):
        words[i] = f"e{seed}"
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark):
    base = prose(1, 120)
    texts = EDGES + [base] + [edited(base, s, 1 + s % 4) for s in range(40)] + [prose(s) for s in range(2, 20)] + [base.upper()] * 30 + [prose(5) + " tail"]
    texts += [prose(99, 60) + "\n" + prose(s, 40) for s in range(200, 230)]
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(frame(spark, texts), size=3, percent=85).collect())
    assert got == brute_duplicates(texts, 3, 85)
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_template_with_a_tail_that_fills_much_of_the_sketch(spark):
    template = [f"t{i}" for i in range(102)]
    group = [" ".join(template)] + [" ".join([*template, f"own{i}"]) for i in range(30)]
    (inside,) = near_dedup.shingle_sets(group[:1], 3)

    def tailed(seed):
        return " ".join([*template, *(f"tail{seed}x{i}" for i in range(24))])

    def outside(text):
        (own,) = near_dedup.shingle_sets([text], 3)
        return int((~np.isin(own[: near_dedup.SKETCH], inside)).sum())

    texts = group + [t for t in map(tailed, range(4000)) if 12 <= outside(t) <= 15][:4]
    assert len(texts) == len(group) + 4
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(frame(spark, texts), size=3, percent=80).collect())
    assert got == brute_duplicates(texts, 3, 80) and {r[2] for r in got} == {0}


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, None)], "doc_id long, text string").withColumns({c: F.lit(0) for c in ("n", "v", "id", "comp", "sketch")})
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 1, None, False)]


def test_bpe_equals_library_and_round_trips(spark):
    from tokenizers import Tokenizer

    path = registry.vocabulary_path()
    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    alphabet = list("ab'sTé \n\t东̈😀²1_#$ll've") + ["<|endoftext|>"]
    texts = [t for t in EDGES if t is not None] + ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(600)]
    codec = bpe.ByteBpe(path)
    for text, mine, theirs in zip(texts, codec.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine == theirs.ids and codec.decode(mine) == library.decode(theirs.ids, skip_special_tokens=False) == text
    df = frame(spark, [*texts[:12], None])
    rows = bpe.digest(df, path).select("doc_id", "bpe.*").orderBy("doc_id").collect()
    for r, text in zip(rows, [*texts[:12], ""], strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = df.select("text", bpe.decode(bpe.encode(F.col("text"), path), path).alias("back")).collect()
    assert all((r.text or "") == r.back for r in back)


def test_license_scan(spark):
    notice = "Licenced under the Apache Licence, Version 2.0"
    texts = [*EDGES, f"foo {notice} bar", "CC BY cc-by x ALL rights\nreserved.", "the GNU General Public License and all right reserved", "cc byé"]
    rows = license_scan.scan(frame(spark, texts)).select("doc_id", "license.*").orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    found = rows[len(EDGES)]
    assert found.labels == "apache-2.0" and found.base_labels == "" and found.matches[0].edits == 2 and (found.matches[0].first_word, found.matches[0].last_word) == (1, 8)
    assert rows[len(EDGES) + 2].labels == "gpl,reserved"


def test_license_fuzzy_equals_whole_search():
    import regex

    scanner = license_scan.Scanner({}, {"all rights reserved by the owner": "r"}, 0.1)
    rng = np.random.default_rng(2)
    for _ in range(200):
        text = list("xx all rights reserved by the owner yy")
        for i in rng.integers(3, 34, rng.integers(0, 6)):
            text[i] = str(rng.choice(list("abz")))
        plain = " ".join("".join(text).split())
        assert bool(scanner.fuzzy(plain)) == bool(regex.search("(?:all rights reserved by the owner){e<=3}", plain))


def test_packing_invariants(spark):
    sizes = [0, 1, 5, 511, 512, 513, 4096, 4097, 9000, 30, 30, 30]
    texts = [" ".join(["w"] * n) for n in sizes] + [None]
    df = frame(spark, texts)
    rows = packing.pack(df, with_text=True).collect()
    for i, n in enumerate([*sizes, 0]):
        own = sorted((r.piece, r.begin, r.length, r.text) for r in rows if r.doc_id == i)
        assert sum(p[2] for p in own) == n and "".join(p[3] for p in own) == (texts[i] or "") and [p[1] for p in own] == list(np.cumsum([0, *[p[2] for p in own]])[:-1])
    for b in {r.bin for r in rows}:
        inside = sorted((r.offset, r.length, r.capacity) for r in rows if r.bin == b)
        used = sum(x[1] for x in inside)
        assert {x[2] for x in inside} == {min(c for c in packing.CAPACITIES if c >= used)} and all(a[0] + a[1] <= z[0] for a, z in zip(inside, inside[1:], strict=False))
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_equals_naive_best_fit():
    lengths = [int(x) for x in np.random.default_rng(1).integers(0, 4097, 300)]
    bins, _, capacity = packing.pack_pieces(lengths)
    room, used, want = [], [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(r, b) for b, r in enumerate(room) if r >= lengths[i]]
        if not fits:
            fits = [(packing.opening(lengths[i], packing.CAPACITIES, packing.OVERHEAD, packing.EXPECTED_FILL), len(room))]
            room.append(fits[0][0])
            used.append(0)
        b = min(fits)[1]
        want[i], room[b] = b, room[b] - lengths[i]
        used[b] += lengths[i]
    assert bins == want and capacity == [min(c for c in packing.CAPACITIES if c >= u) for u in used]


def test_url_filter_rules_and_aliases(spark):
    page = '<html><head><link rel="canonical" href="{}"></head></html>'
    rows = [
        (1, "https://a.example.org/es/1", ""), (2, "http://B.example.net/x#f", page.format("https://a.example.org/es/1")), (3, "http://c.net", page.format("http://b.example.net/x")),
        (4, "http://d.com/fr/2", page.format("http://b.example.net/x")), (5, "http://e.net/1", '<meta http-equiv="refresh" content="0; url=http://f.com/de/9">'), (6, "http://f.com/de/9", None),
        (7, None, None), (8, "no scheme", ""), (9, "http://example.org/en/12", ""), (9, "http://example.org/en/12", ""), (10, "http://xexample.org/es/", ""), (11, "http://z.net/a", page.format("/b")), (12, "ftp://q.org?x=/y", ""),
    ]
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2][2:] == (None, "allow") and got[3][2:] == (None, "allow"), "the explicit allow of 4 takes precedence"
    assert got[5][2:] == (None, "block") and got[6][2:] == ("com/de/", "block") and got[4][2:] == ("com/fr/", "allow")
    assert got[7] == got[8] == ("", "", None, "allow") and got[9][2:] == ("example.org/en/1", "block") and got[10][2:] == ("org/", "allow") and got[12] == ("q.org", "", None, "allow")


def test_url_filter_targets_that_are_not_pages(spark):
    page = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.net/1", page.format("https://x.example.org/es/1")), (2, "http://b.net/2", '<meta http-equiv="refresh" content="0; url=http://y.com/de/9">'),
        (3, "http://c.net/3", page.format("http://y.com/de/8")), (4, "http://c.net/3", page.format("http://z.com/fr/1")), (5, "http://d.net/", page.format("http://q.org")), (6, "http://e.net/", None), (7, "http://f.net/", None),
    ]
    moved = spark.createDataFrame([("http://e.net/", "http://u.net/"), ("http://u.net/", "http://v.com/de/"), ("http://f.net/", None), ("http://q.org", "http://y.com/de/1")], "src string, dst string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), redirects=moved).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "block"), 6: (None, "block"), 7: (None, "allow")}


def test_vector_search_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0, None] + [1.0] * 14), (5004, [1.0]), (5005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.search(df, df.where("vec_id % 100 = 0")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    y = x.astype(float)
    for q in range(0, 3000, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = [int(i) for i in np.lexsort((np.arange(len(y)), d))[:10]]
        mine = sorted(by[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(math.isclose(m[2], d[m[1]], rel_tol=1e-9, abs_tol=1e-9) for m in mine)
        hits, total = hits + len({m[1] for m in mine} & set(want)), total + 10
    assert set(by) == set(range(0, 3000, 100)) and hits / total >= 0.9
    assert [m[1] for m in sorted(by[100])] == list(range(101, 111))
    assert vector_search.search(df.limit(0), df.limit(0)).count() == 0


def test_vector_search_of_several_lengths_and_query_ids_of_several_vectors(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(v) for v in rng.normal(size=6 if i % 3 else 4)]) for i in range(90)]
    rows += [(0, [float(v) for v in rng.normal(size=4)]), (0, [float(v) for v in rng.normal(size=6)]), rows[0], (500, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for q in {(i, tuple(x)) for i, x in rows if i % 100 == 0}:
        near = {}
        for i, x in rows:
            if i != q[0] and len(x) == len(q[1]):
                d = float(np.sqrt(((np.array(x) - q[1]) ** 2).sum()))
                near[i] = min(d, near.get(i, d))
        want += [(q[0], r, i, round(d, 9)) for r, (d, i) in enumerate(sorted((d, i) for i, d in near.items())[:10], 1)]
    got = [(*tuple(r)[:3], round(r.score, 9)) for r in vector_search.search(df, df.where("vec_id % 100 = 0")).collect()]
    assert sorted(got) == sorted(want) and len(got) == 30
    assert vector_search.search(df.where("size(embedding) = 4"), df.where("vec_id = 500")).count() == 0


def test_vector_search_of_repeated_rows(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(600, 8))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0")
    plain = sorted(map(tuple, vector_search.search(df, asked, again=600).collect()))
    assert len(plain) == 12 * 10
    near = {r[0]: r[2] for r in plain if r[1] == 1}
    again = spark.createDataFrame(rows * 2 + [rows[i] for i in near.values()] * 30, "vec_id long, embedding array<double>").coalesce(1)
    assert sorted(map(tuple, vector_search.search(again, asked, again=600).collect())) == plain
    own = 5000
    many = spark.createDataFrame(rows + [(own, [float(c) + 1e-4 * j for c in x[0]]) for j in range(1, 400)], "vec_id long, embedding array<double>").coalesce(1)
    got = [r.vec_id for r in sorted(vector_search.search(many, asked.where("vec_id = 0")).collect(), key=lambda r: r["rank"])]
    assert len(got) == 10 and got[0] == own and got[1:] == [r[2] for r in plain if r[0] == 0][:9]


def test_secret_scan_base_and_redaction(spark):
    texts = [*EDGES, 'x token = "abc123def" y', "PASSWORD: short", "AKIA" + "A1" * 8, "k " + "0af3" * 8, "secret=" + "0a" * 20, "pässword password=\n"]
    df = frame(spark, texts)
    net = secret_scan.train(*secret_scan.labelled(df))
    rows = secret_scan.scan(df, net).select("doc_id", "secrets.*").orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        want = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "") if len(m[1]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        assert [tuple(s) for s in r.base] == sorted(want, key=lambda s: (s[1], secret_scan.KINDS.index(s[0]))) and set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    assert rows[len(EDGES)].redacted == "x [SECRET]\" y" and rows[0].redacted is None and rows[len(EDGES) + 4].redacted == "[SECRET]"


def test_secret_network_finds_what_no_base_pattern_names(spark):
    rng = np.random.default_rng(12)

    def drawn(letters, n):
        return "".join(rng.choice(list(letters), n))

    words = ["".join(rng.choice(["ver", "lan", "tion", "keit", "mor", "sel"], 5)) for _ in range(400)]
    hexes = [f"{words[i]} uses {drawn('abcdef0123456789', 32)} in {words[-i]}" for i in range(120)]
    keys = [f"{words[i]} wrote {drawn('abcdef0123456789', 20)}-{drawn('abcdef0123456789', 20)} for {words[-i]}" for i in range(40)]
    plain = [f"{words[i]} and {words[i + 1]} write about {words[i + 2]}" for i in range(150)]
    df = frame(spark, [*hexes, *keys, *plain])
    x, y = secret_scan.labelled(df)
    assert y.sum() == len(hexes) and len(y) == len(hexes) + len(hexes) + len(keys) + len(plain), "one ordinary word of each text, no candidate that is to be scored"
    net = secret_scan.train(x, y)
    held = x[np.arange(len(y)) % 5 == 4][y[np.arange(len(y)) % 5 == 4] == 1]
    assert (net.probability(held) >= net.threshold).mean() >= secret_scan.RECALL
    rows = secret_scan.scan(df, net).select("doc_id", "secrets.*").orderBy("doc_id").collect()
    assert all([s.kind for s in r.spans] == ["hex"] and r.scores[0] > 0.5 for r in rows[: len(hexes)])
    assert sum([s.kind for s in r.spans] == ["network"] for r in rows[len(hexes) : -len(plain)]) >= 0.8 * len(keys)
    assert not any(r.spans for r in rows[-len(plain) :])


def test_secret_threshold_is_that_of_recall():
    rng = np.random.default_rng(13)
    x = rng.integers(2, 90, (400, secret_scan.WIDTH)).astype(np.uint8)
    y = np.arange(400) // 5 % 8 == 0
    net = secret_scan.train(x, y.astype(int))
    held = np.arange(400) % 5 == 4
    assert net.threshold < 0.5 and (net.probability(x[held & y]) >= net.threshold).mean() >= secret_scan.RECALL


def test_secret_network_learns():
    rng = np.random.default_rng(6)
    texts, labels = [], []
    for i in range(600):
        token = "".join(rng.choice(list("abcdef0123456789" if i % 2 else "aeioulmnrstp"), 24))
        texts.append((f"some words here {token} and more", 16, 40))
        labels.append(i % 2)
    x = np.stack([secret_scan.window(*t) for t in texts])
    y = np.array(labels)
    net = secret_scan.train(x[:500], y[:500])
    found = net.probability(x[500:]) >= net.threshold
    assert (found == (y[500:] == 1)).mean() > 0.95
    assert secret_scan.train(x[:500], np.zeros(500, int)).threshold > 1


def test_line_dedup(spark):
    run = "l one\nl two\nl three"
    long = "a single line of more than forty characters in all"
    texts = [f"{run}\nend", f"start\n\n{run}\n{long}", f"{long}\nl one\nl two", None, "", f"{run}\nend", "l one\n\nl two\nl three"]
    rows = line_dedup.dedup(frame(spark, texts).withColumns({"i": F.lit(1), "doc": F.lit(2)})).select("doc_id", "lines.*").orderBy("doc_id").collect()
    assert [r.text for r in rows] == [texts[0], f"start\n\n{long}", "l one\nl two", None, "", "", ""]
    assert [(r.n_lines, r.n_deleted) for r in rows] == [(4, 0), (5, 3), (3, 1), (0, 0), (0, 0), (4, 4), (3, 3)]
    assert line_dedup.dedup(frame(spark, [])).count() == 0


def test_language_id(spark):
    rng = np.random.default_rng(8)
    words = {"en": ["the", "with", "shing", "tion"], "de": ["der", "über", "keit", "schön"]}
    texts = [" ".join(rng.choice(words[l], 30)) for l in ("en", "de") for _ in range(60)]
    rows = [(i, t, "en" if i < 60 else "de") for i, t in enumerate(texts)] + [(200, None, "en"), (201, "123 !", None), (202, "", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held", language_id.held_out("doc_id"))
    model = language_id.train(df.where("not held"))
    got = {r.doc_id: r for r in language_id.identify(df, model).select("doc_id", "lang", "held", "language.score", F.col("language.lang").alias("pred")).collect()}
    held = [r for r in got.values() if r.held and r.doc_id < 200]
    assert held and all(r.pred == r.lang and 0 <= r.score <= 1 for r in held)
    assert [got[i].pred for i in (200, 201, 202)] == ["und"] * 3
    assert language_id.identify(df, language_id.train(df.limit(0))).select("language.lang").distinct().collect()[0][0] == "und"


def test_quality_rules_counts(spark):
    texts = [*EDGES, prose(1), "a b c a b c x\ny", "L\nL\n \nL", "a# b$$ <c>", " ".join(f"u{i % 60}" for i in range(2500))]
    df = frame(spark, texts).withColumns({"words": F.lit(1), "kept": F.lit("x")})
    rows = quality_rules.judge(df).select("doc_id", "quality.*").orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        w = WS.findall(t or "")
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = len({j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)})
        lines = [x for x in (t or "").split("\n") if WS.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeat, len(w) < 50 or 100 * repeat > 50 * len(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(df).columns == df.columns + ["quality"] and quality_rules.judge(df.limit(0)).count() == 0


def test_quality_divergence_rejects_other_alphabets(spark):
    common = "the of and to in that this with is on".split()
    clean = [" ".join(f"{common[(i * 7 + s) % 10]} {w}" for i, w in enumerate(prose(s, 100).replace("w", "word").split())) for s in range(30)]
    rows = {r.doc_id: r for r in quality_rules.judge(frame(spark, [*clean, " ".join(f"{i}$%&" for i in range(300))]), keep=["doc_id"]).select("doc_id", "quality.*").collect()}
    assert all(rows[i].kept for i in range(30)) and not rows[30].kept and not rows[30].base_failed


def test_pipeline_stages(spark):
    secret = "password=abcdef123456"
    line = "this passage has more than forty characters and stands in two texts"
    base = prose(50, 200, 1)
    texts = [base + "\n" + line, edited(base, 9, 2), prose(51, 90, 2) + "\n" + line + "\n" + secret, "too short", None, prose(52, 90, 3)]
    docs = frame(spark, texts).withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"], name
    left = {r.doc_id: r for r in docs.collect()}
    assert set(left) == {0, 2, 5} and line in left[0].text and line not in left[2].text and "[SECRET]" in left[2].text and secret not in left[2].text
    assert all(r.n_chars == len(r.text) for r in left.values())
    packed = corpus_pipeline.STAGES[4][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == set(left) and all("".join(p.text for p in sorted(packed, key=lambda p: p.piece) if p.doc_id == i) == left[i].text for i in left)


def test_pipeline_near_dedup_of_rows_without_an_id_or_with_a_shared_one(spark):
    shared, lone = prose(70, 90), prose(71, 90)
    rows = [(None, lone), (None, shared), (None, shared), (4, shared), (3, shared), (3, shared), (5, prose(72, 90)), (5, prose(73, 90)), (6, prose(74, 90)), (None, prose(74, 90)), (7, ""), (7, ""), (8, None), (None, ""), (None, prose(75, 90)), (None, prose(75, 90))]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    want = [(None, lone), (3, shared), (5, prose(72, 90)), (5, prose(73, 90)), (6, prose(74, 90)), (7, ""), (8, None), (None, ""), (None, prose(75, 90))]
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(want)
