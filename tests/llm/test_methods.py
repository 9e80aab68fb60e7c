"""The corpus operators against brute force where methods are intricate, and all of them on odd tables."""

import math
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeseek.llm import bpe, language_id, license_scan, line_dedup, near_dedup, oracle, packing, quality_rules, registry, secret_scan, url_filter, vector_search
from test_llm import brute_duplicates, frame

SF = "/root/testdata/sf0.1"


def test_near_duplicates_of_large_groups_with_strays(spark):
    rng = np.random.default_rng(0)
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join(base)]
    for _ in range(300):
        words = list(base)
        for i in rng.integers(0, 100, rng.integers(1, 7)):
            words[i] = f"x{rng.integers(0, 30)}"
        texts.append(" ".join(words))
    passage = " ".join(f"p{i}" for i in range(70))
    texts += [passage + " " + " ".join(f"o{j}_{i}" for i in range(int(rng.integers(5, 40)))) for j in range(150)]
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(frame(spark, texts), size=3, percent=85).collect())
    assert got == brute_duplicates(texts, 3, 85)


def test_near_duplicates_with_whole_sets_as_sketches_and_ids_of_several_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, a + " and more"), (4, "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in near_dedup.near_duplicates(df, size=3, percent=85, k=None).select("doc_id", "component_id", "kept").collect())
    assert got == Counter([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, None, False), (4, 4, True)])


def test_meetings_find_what_all_pairs_find():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50)).astype(np.int64) for _ in range(80)]
    comps = rng.integers(0, 40, 80)
    rows = pa.array([{"id": i, "comp": int(comps[i]), "set": s.tolist(), "earlier": [1] if i % 9 == 0 else []} for i, s in enumerate(sets)], pa.struct([("id", pa.int64()), ("comp", pa.int64()), ("set", pa.list_(pa.int64())), ("earlier", pa.list_(pa.int64()))]))
    side = near_dedup._Side(rows, 32)
    table = np.stack([side.table[i] for i in range(80)])
    for i, j in [(0, 1), (5, 9), (7, 70)]:
        union = np.union1d(table[i], table[j])[:32]
        assert math.isclose(near_dedup._estimates(table[[i]], table[[j]])[0], np.isin(union, np.intersect1d(table[i], table[j])).mean())
    found = near_dedup._meeting(side, side, 45, 0.0)

    def joined(pairs):
        root = {int(c): int(c) for c in comps}
        for i, j in pairs:
            x, y = root[int(comps[i])], root[int(comps[j])]
            root = {c: min(x, y) if r in (x, y) else r for c, r in root.items()}
        return root

    every = [(i, j) for i in range(80) for j in range(i) if not (i % 9 == 0 and j % 9 == 0) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 45 * len(np.union1d(sets[i], sets[j]))]
    assert joined(found) == joined(every) and len(found) < 80 and len(every) > len(found)


def brute_line_dedup(rows, min_lines=3, min_chars=40):
    texts = sorted(rows)
    lines = [[(p, x) for p, x in enumerate(t.split("\n")) if x.strip(" \t\n\v\f\r")] for _, t in texts]
    at = [(t, i) for t in range(len(texts)) for i in range(len(lines[t]))]
    gone = defaultdict(set)
    for n in (1, min_lines):
        first = {}
        for t, i in at:
            window = tuple(x for _, x in lines[t][i : i + n])
            if len(window) < n or n == 1 and len(window[0]) < min_chars:
                continue
            t0, i0 = first.setdefault(window, (t, i))
            gone[t] |= {j for j in range(i, i + n) if (t, i) != (t0, i0) and not (t == t0 and i0 <= j < i0 + n)}
    out = {}
    for t, (i, text) in enumerate(texts):
        dead = {lines[t][j][0] for j in gone[t]}
        out[i] = (len(lines[t]), len(dead), "\n".join(x for p, x in enumerate(text.split("\n")) if p not in dead))
    return out


def brute_runs(texts, least=3):
    """doc, begin, lines, from_doc, from_begin of the maximal runs, by comparing each place with all before it."""
    lines = [[x for x in t.split("\n") if x.strip(" \t\n\v\f\r")] for t in texts]
    at = [(t, i) for t in range(len(texts)) for i in range(len(lines[t]))]
    out, last, reach = set(), None, 0
    for k, (t, i) in enumerate(at):
        best = (0, 0, None)
        for t0, i0 in at[:k]:
            n = 0
            while i + n < len(lines[t]) and i0 + n < len(lines[t0]) and lines[t][i + n] == lines[t0][i0 + n]:
                n += 1
            if n >= least and (n // least).bit_length() > best[0]:
                best = ((n // least).bit_length(), n, (t0, i0))
        reach = reach if i else 0
        source = best[2]
        follows = i > 0 and last is not None and source == (last[0], last[1] + 1)
        if source is not None and not follows and i + best[1] > reach:
            out.add((t, i, best[1], *source))
            reach = i + best[1]
        last = source
    return out


def test_line_dedup_of_overlapping_periodic_and_long_runs(spark):
    rng = np.random.default_rng(7)
    long = [f"line number {i} of a long run" for i in range(150)]
    texts = ["x\nx\nx\nx\nend", "\n".join(["a", "b"] * 9), "a\nb\na\nb\n\na", "\n".join(long), "\n".join(["q", *long[20:], "r"]), "x\n" * 12, "\n".join([*long[:75], "cut", *long[75:]])]
    texts += ["\n".join(rng.choice(["a", "b", "c", "a line that is longer than forty characters by far"], rng.integers(1, 30))) for _ in range(60)]
    df = frame(spark, texts)
    want = brute_line_dedup(list(enumerate(texts)))
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.dedup(df).select("doc_id", "lines.n_lines", "lines.n_deleted", "lines.text").collect()}
    assert got == want and got[0] == (5, 1, "x\nx\nx\nend")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    rows = con.execute(f"SELECT doc_id, n_lines, n_deleted, text, runs FROM ({oracle.LINE_DEDUP})").fetchall()
    assert {r[0]: tuple(r[1:4]) for r in rows} == want
    runs = {tuple(r) for r in line_dedup.repeated_runs(df).collect()}
    assert {r for r in runs if r[0] in (4, 6)} == {(4, 1, 130, 3, 20), (6, 0, 75, 3, 0), (6, 76, 75, 3, 75)}
    assert runs == brute_runs(texts)
    assert {r[0]: r[4] for r in rows if r[4]} == {d: ",".join(":".join(map(str, r[1:])) for r in sorted(runs) if r[0] == d) for d in {r[0] for r in runs}}


def test_line_dedup_needs_all_its_doublings(spark):
    long = [f"line {i}" for i in range(50)]
    df = frame(spark, ["\n".join(long), "\n".join(["q", *long[7:], "r"])])
    single, levels = line_dedup._levels(df, "doc_id", "text", 3, 12)
    short = {tuple(r)[2:4] for r in line_dedup._maximal(single, levels).collect()}
    assert short != {(1, 43)} == {tuple(r)[1:3] for r in line_dedup.repeated_runs(df).collect()}


@pytest.mark.parametrize("least", [1, 2, 4])
def test_line_dedup_of_other_lengths(spark, least):
    rng = np.random.default_rng(least)
    texts = ["\n".join(rng.choice(["a", "b", "c"], rng.integers(1, 25))) for _ in range(15)]
    df = frame(spark, texts)
    assert {tuple(r) for r in line_dedup.repeated_runs(df, min_lines=least).collect()} == brute_runs(texts, least)
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.dedup(df, min_lines=least, min_chars=1 if least == 1 else 40).select("doc_id", "lines.n_lines", "lines.n_deleted", "lines.text").collect()}
    assert got == brute_line_dedup(list(enumerate(texts)), least, 1 if least == 1 else 40)


def test_line_dedup_beside_columns_named_like_its_own(spark):
    rows = [(1, "a\nb\nc", "x", "y"), (2, "a\nb\nc\nd", "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __line_key string, ___LINE_gone string")
    assert [tuple(r) for r in line_dedup.dedup(df).drop("lines").orderBy("doc_id").collect()] == rows


def test_url_filter_equals_sql_on_made_up_pages(spark):
    rng = np.random.default_rng(4)
    hosts = [f"h{i}.net" for i in range(60)] + ["u.com", "v.com", "y.example.org", "y.example.org:443"] * 9
    pick = lambda x: x[rng.integers(len(x))]

    def url():
        return pick(["http", "https"]) + "://" + pick(hosts) + pick(["", "/", "/es/1", "/es/", "/en/1", "/fr/2", "/de/x/", "/de/x", "/q/r.html"]) + pick(["", "?a=1&b=2", "#f"])

    def tag():
        t = pick([*(url() for _ in range(20)), "p.html", "../x", "?a=1&amp;b=2", "/de/x", "//b.net/", "./es/1", "mailto:x@y", "#z", "../../../de/x/", "", "a?u=http://u.com/de/x"])
        return pick([f'<link rel="canonical" href="{t}">', f"<LINK href='{t}' rel='nofollow canonical'>", f'<meta property="og:url" content="{t}">', f'<meta http-equiv="Refresh" content="3; URL={t}">', f'<base href="{t}">', f"<link rel=stylesheet href={t}>", f"<link rel=canonical href={t or 'x'}>"])

    rows = [(i, pick([url(), url(), url(), None, "nothing"]), pick([None, "", "<p>" + tag(), tag() + tag()])) for i in range(900)]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    want = sorted(tuple(map(str, r)) for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({oracle.URL_FILTER})").fetchall())
    got = sorted(tuple(map(str, r)) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == want and any(r[3] == "None" and r[4] == "block" for r in got)


def test_url_filter_spreads_over_chains_hubs_and_address_forms(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [(i, f"http://c{i}.net/", link.format(f"http://c{i + 1}.net/")) for i in range(30)] + [(30, "http://c30.net/", link.format("http://u.com/de/x"))]
    rows += [(100 + i, f"http://s{i}.net/p", link.format("http://hub.net/a")) for i in range(40)] + [(200, "http://hub.net/a", link.format("http://x.com/fr/1")), (201, "http://s3.net/p", link.format("http://u.com/de/y"))]
    rows += [(300, "https://z.com:443/de#top", ""), (301, "http://z.com/de/", ""), (302, "http://w.net/a/b/c", '<base href="http://u.com/de/"><link rel=canonical href="../de/./q">')]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(31)} == {"block"} and {got[i] for i in range(100, 202) if i in got} == {"allow"} and got[300] == "block" and got[302] == "block"


def test_license_search_finds_edited_notices_among_neighbours():
    scanner = license_scan.Scanner(license_scan.PHRASES, dict(list(license_scan.NOTICES.items())[:9] + [("all rights reserved", "reserved")]), 0.1)
    rng, notices = np.random.default_rng(3), [n[0] for n in scanner.notices]

    def whole(plain):
        out = []
        for i, (_, _, _, first, best) in enumerate(scanner.notices):
            at = 0
            while m := first(plain, at):
                m = best(plain, m.start(), m.end()) or m
                out.append((m.start(), m.end(), i, sum(m.fuzzy_counts)))
                at = m.end()
        return sorted(out)

    seen = 0
    for _ in range(40):
        parts = []
        for _ in range(3):
            x = list(notices[rng.integers(len(notices))])
            for _ in range(rng.integers(0, 6)):
                i = rng.integers(len(x))
                x[i : i + rng.integers(0, 2)] = str(rng.choice(["a", "z", " ", ""]))
            parts += ["".join(x), " ".join(rng.choice(["under", "the", "license", "public", "foo"], 3))]
        plain = " ".join(" ".join(parts).split())
        found = scanner.fuzzy(plain)
        assert found == whole(plain)
        seen += len(found)
    assert seen > 60
    assert [(a, b, e) for a, b, _, e in scanner.fuzzy("all right reserved x all rights reserved y")] == [(0, 18, 1), (21, 40, 0)]
    row = scanner.scan("All rights reserved. Released under the MIT licence; " * 4000)
    assert row[1] == 4000 and row[3] == 8 * 3999 and len(row[7]) == 12000


def test_packing_of_hot_ids_and_joint_policy(spark):
    df = spark.createDataFrame([(None if i % 2 else 1, " ".join(["w"] * (i % 700))) for i in range(3000)], "doc_id long, text string")
    rows = packing.pack(df, rows_per_shard=500).collect()
    shards = Counter(r.bin.split("-")[0] for r in rows)
    assert len(rows) == 3000 and len(shards) == 6 and max(shards.values()) < 650
    assert packing.pack(df.limit(200), with_text=True, chars_per_shard=2000).select(F.split("bin", "-")[0]).distinct().count() > 3
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = [int(x) for x in rng.integers(0, 4097, rng.integers(1, 200)) // rng.integers(1, 9)]
        joint = packing.pack_jointly(lengths)
        costs = [packing.total_cost(packing.pack_pieces(lengths, packing.CAPACITIES, packing.OVERHEAD, f)[2], packing.OVERHEAD) for f in packing.FILLS]
        assert packing.total_cost(joint[2], packing.OVERHEAD) <= min(costs)
        used = Counter()
        for b, n in zip(joint[0], lengths, strict=True):
            used[b] += n
        assert all(joint[2][b] >= n for b, n in used.items())


@pytest.mark.skipif(not Path(SF).is_dir(), reason="needs the test tables")
def test_vector_search_recall_on_the_table_in_several_blocks(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    rows = vectors.orderBy("vec_id").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = defaultdict(dict)
    for r in vector_search.search(vectors, vectors.where("vec_id % 100 = 0"), block_rows=500, again=20).collect():
        got[r.query_id][r["rank"]] = r.vec_id
    hits = 0
    for q in got:
        far = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        far[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, far))[:10]].tolist()) & set(got[q].values()))
    assert len(got) == (ids % 100 == 0).sum() and hits / (10 * len(got)) >= 0.9


def test_language_id_equals_counting_by_hand(spark):
    rng = np.random.default_rng(9)
    words = {"en": ["the", "with", "shing", "tion"], "de": ["der", "über", "keit", "schön"], "fr": ["été", "dans", "tion", "les"]}
    rows = [(i, " ".join(rng.choice(words[l], rng.integers(1, 12))), l) for i, l in enumerate(["en", "de", "fr"] * 30)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    grams = lambda t: [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)]
    counts, docs = defaultdict(Counter), Counter()
    for _, t, l in rows:
        counts[l].update(grams(t.lower()))
        docs[l] += 1
    asked = [*(t for _, t, _ in rows), "Über", "t", "zzz", "x" * 30000]
    names, scores = language_id.predict(asked, model)
    for t, name, score in zip(asked, names, scores, strict=True):
        logs = {l: math.log(docs[l] / 90) + sum(math.log((counts[l][g] + language_id.ALPHA) / (counts[l].total() + language_id.ALPHA * language_id.BUCKETS)) for g in grams(t.lower())) for l in sorted(words)}
        best = max(logs, key=logs.get)
        assert name == best and math.isclose(score, 1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel_tol=1e-6)


def test_language_id_ties_and_too_many_languages(spark):
    rows = spark.createDataFrame([(1, "abc", "x"), (2, "abc", "a"), (3, "abc", None), (4, None, "q")], "doc_id long, text string, lang string")
    model = language_id.train(rows)
    assert model.languages == ("a", "x") and language_id.predict(["abc", "", "123", None], model)[0] == ["a", "und", "und", "und"]
    assert language_id.predict(["abc"], language_id.train(rows.limit(0)))[0] == ["und"]
    with pytest.raises(ValueError, match="2 languages"):
        language_id.train(rows, most_languages=1)


def test_bpe_of_many_tries_and_a_full_memory(monkeypatch):
    """Results don't depend on how words are dealt to tries or on what is remembered."""
    rng = np.random.default_rng(4)
    texts = [" ".join("".join(rng.choice(list("abcdeéł1-"), rng.integers(1, 12))) for _ in range(60)) for _ in range(20)] + ["q" * 5000, "<|endoftext|>a<|endoftext|>"]
    codec = bpe.ByteBpe(registry.vocabulary_path())
    wanted = codec.encode(texts)
    monkeypatch.setattr(bpe, "TRIE_BYTES", 16)
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 100)
    again = bpe.ByteBpe(registry.vocabulary_path())
    assert [again.encode([t])[0] for t in texts] == wanted and again.held < 10_000
    assert again.decode(wanted[0]) == texts[0]


def test_odd_tables_pass_all_operators(spark):
    odd = ["a.b", "doc", "v", "x y", "comp", "window", "text_", "n", "id"]
    texts = [None, "", "word " * 40000, "one\ntwo\nthree\n" * 3000, "password=abc123XYZ all rights reserved", "word " * 40000]
    rows = [(i if i else None, t, None if i == 1 else "en", "s", 1) for i, t in enumerate(texts)]
    full = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in odd})
    net = secret_scan.train(*secret_scan.labelled(full))
    model = language_id.train(full)
    for df in (full, full.limit(0)):
        n = df.count()
        for f in (
            lambda d: bpe.digest(d, registry.vocabulary_path()), license_scan.scan, lambda d: secret_scan.scan(d, net), line_dedup.dedup, lambda d: language_id.identify(d, model), quality_rules.judge,
        ):
            out = f(df)
            assert out.columns[:-1] == df.columns and len(out.collect()) == n
        assert near_dedup.near_duplicates(df).count() == n
        assert packing.pack(df, with_text=True).select(F.count_distinct("doc_id")).first()[0] == max(0, n - 1)
        for name, stage in corpus_pipeline.STAGES[:4]:
            assert stage(spark, df, "").columns == df.columns, name
    pages = spark.createDataFrame([(1, None, None), (2, "http://u.com/de/1", "<" * 50000)], "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("a.b", "host", "node", "own")})
    assert url_filter.judge(pages).count() == 2 and url_filter.judge(pages.limit(0)).count() == 0


def drawn(rng, letters, n):
    return "".join(rng.choice(list(letters), n))


def texts_with_secrets(n_secrets, n_plain):
    rng = np.random.default_rng(21)
    words = ["".join(rng.choice(["ver", "lan", "tion", "keit", "mor", "sel"], 5)) for _ in range(400)]
    about = rng.integers(0, 400, (n_secrets + n_plain, 2))
    return [f"{words[a]} uses {drawn(rng, 'abcdef0123456789', 32) if i < n_secrets else i} in {words[b]}" for i, (a, b) in enumerate(about)]


KEYS = [f"it wrote {drawn(np.random.default_rng(i), 'abcdef0123456789', 20)}-{drawn(np.random.default_rng(i + 100), 'abcdef0123456789', 20)} once" for i in range(20)]


def test_secrets_are_learnt_from_every_finding(spark):
    n = 2100
    df = frame(spark, texts_with_secrets(n, n))
    x, y = secret_scan.labelled(df)
    assert y.sum() == n and (1 - y).sum() == 2 * n, "no finding is left out"
    net = secret_scan.learn(df, shard_rows=100_000)
    rows = sorted(secret_scan.findings(df).collect(), key=lambda r: (r.h, bytes(r.window), r.label))
    rows = [r for r in rows if r.h % 5 != 4]
    training = secret_scan.Training(np.random.default_rng(secret_scan.SEED))
    for epoch in range(secret_scan.EPOCHS):
        training.epoch(secret_scan._windows([r.window for r in rows]), np.array([r.label for r in rows]), np.random.default_rng([secret_scan.SEED, epoch, 0]))
    assert np.allclose(net.kernel, training.network().kernel, rtol=0, atol=1e-9) and net.threshold <= 1
    several, again = secret_scan.learn(df, shard_rows=1000), secret_scan.learn(df.repartition(3), shard_rows=1000)
    assert np.array_equal(several.kernel, again.kernel) and several.threshold == again.threshold and not np.allclose(several.kernel, net.kernel)
    for learnt in (net, several):
        assert all(spans for _, spans, _ in secret_scan.found(KEYS, learnt)) and (learnt.probability(x[y == 0]) < learnt.threshold).mean() > 0.95


def test_secrets_rarer_than_shards_are_learnt_in_each(spark):
    df = frame(spark, texts_with_secrets(30, 3000))
    net = secret_scan.learn(df, shard_rows=60)
    assert net.threshold <= 1 and sum(bool(spans) for _, spans, _ in secret_scan.found(KEYS, net)) >= 15
    assert secret_scan.learn(frame(spark, texts_with_secrets(0, 50))).threshold > 1 and secret_scan.learn(df.limit(0)).threshold > 1


def test_pipeline_learns_secrets_from_every_finding(spark, monkeypatch):
    docs = frame(spark, texts_with_secrets(2100, 2100))
    nets, scan, learn = [], secret_scan.scan, secret_scan.learn
    monkeypatch.setattr(secret_scan, "learn", lambda df: learn(df, shard_rows=2000))
    monkeypatch.setattr(secret_scan, "scan", lambda df, net, **more: nets.append(net) or scan(df, net, **more))
    left = corpus_pipeline.secrets(spark, docs, "")
    assert np.array_equal(nets[0].kernel, secret_scan.learn(docs).kernel) and nets[0].threshold <= 1
    assert left.where("text like '%[SECRET]%'").count() >= 2100 and left.count() == 4200


def test_bpe_automaton_lists_the_tokens_that_end_at_each_place():
    import gc

    codec = bpe.ByteBpe(registry.vocabulary_path())
    rng = np.random.default_rng(31)
    tokens = [t for t in codec.ids if t]
    for _ in range(40):
        word, state = b"".join(tokens[i] for i in rng.integers(0, len(tokens), 4)), 0
        for end, byte in enumerate(word, 1):
            state = codec.move(state, byte)
            assert list(codec.ending[state]) == [(n, codec.ids[word[end - n : end]]) for n in range(end, 0, -1) if word[end - n : end] in codec.ids]
    held, codec.moves = codec.look_up([["word", " words"]]), {}
    assert gc.isenabled() and codec.look_up([["word", " words"]]) == held
    for text in ["sword swords", "é" * 30, "0" * 50, " \n\t  x", "日本語 テスト"]:
        codec.words.clear()
        assert codec.encode([text])[0] == [i for w in codec.cut(text) for i in codec.merged(w.encode())]


def test_pipeline_stages_beside_columns_named_like_their_own(spark):
    text = "one\ntwo\nthree\nfour\nfive six seven eight nine ten"
    rows = [(1, text, "x", "p", "q", "s"), (2, text, None, "p", "q", "s"), (3, "z", "y", "p", "q", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __key string, __near_node string, __LINES string, __secrets string")
    first_and_last = [rows[0], rows[2]]
    for stage in (corpus_pipeline.lines, corpus_pipeline.near_duplicates):
        assert [tuple(r) for r in stage(spark, df, "").orderBy("doc_id").collect()] == first_and_last
    assert [tuple(r) for r in corpus_pipeline.secrets(spark, df, "").orderBy("doc_id").collect()] == rows
