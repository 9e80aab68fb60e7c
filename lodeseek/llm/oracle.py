"""DuckDB SQL of the corpus queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from . import quality_rules as q
from . import url_filter as u

LINE_DEDUP = """
    WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
    entries AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM docs),
    texts AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS t FROM docs),
    lines AS (SELECT doc_id, text, t, line, pos, row_number() OVER (PARTITION BY t ORDER BY pos) AS i FROM entries JOIN texts USING (doc_id, text) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
    pairs AS (SELECT x.t, x.i, y.t AS t0, y.i AS i0, x.i - row_number() OVER (PARTITION BY x.t, y.t, x.i - y.i ORDER BY x.i) AS island FROM lines x JOIN lines y ON x.line = y.line AND (y.t < x.t OR y.t = x.t AND y.i < x.i)),
    copies AS (SELECT *, count(*) OVER run AS n, min(i0) OVER run AS begin0, max(i) OVER run - i + 1 AS ahead FROM pairs WINDOW run AS (PARTITION BY t, t0, i - i0, island)),
    tops AS (SELECT t, i, ahead, t0, i0 FROM copies WHERE ahead >= 3 QUALIFY row_number() OVER (PARTITION BY t, i ORDER BY floor(log2(ahead / 3)) DESC, t0, i0) = 1),
    starts AS (SELECT * FROM tops WINDOW before AS (PARTITION BY t ORDER BY i) QUALIFY coalesce(lag(i) OVER before <> i - 1 OR lag(t0) OVER before <> t0 OR lag(i0) OVER before <> i0 - 1, true)),
    maximal AS (SELECT * FROM starts QUALIFY i + ahead > coalesce(max(i + ahead) OVER (PARTITION BY t ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)),
    runs AS (SELECT x.doc_id, x.text, string_agg(concat_ws(':', i - 1, ahead, y.doc_id, i0 - 1), ',' ORDER BY i) AS runs FROM maximal m JOIN texts x ON m.t = x.t JOIN texts y ON m.t0 = y.t GROUP BY 1, 2),
    copied AS (SELECT DISTINCT t, i FROM copies WHERE n >= 3 AND (t <> t0 OR i >= begin0 + 3)),
    gone AS (SELECT l.doc_id, l.text, l.pos, length(line) >= 40 AND row_number() OVER (PARTITION BY line ORDER BY l.t, l.pos) > 1 OR c.t IS NOT NULL AS del FROM lines l LEFT JOIN copied c USING (t, i)),
    back AS (SELECT e.doc_id, e.text, count(*) FILTER (WHERE g.pos IS NOT NULL) AS n_lines, count(*) FILTER (WHERE g.del) AS n_deleted, string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (WHERE NOT coalesce(g.del, false)) AS kept
             FROM entries e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.text = g.text AND e.pos = g.pos GROUP BY 1, 2)
    SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, coalesce(r.runs, '') AS runs
    FROM documents d LEFT JOIN back b ON d.doc_id = b.doc_id AND d.text = b.text LEFT JOIN runs r ON d.doc_id = r.doc_id AND d.text = r.text
"""

_WORDS = ", ".join(f"('{w}', {i}), ('{w.capitalize()}', {i})" for i, w in enumerate(dict.fromkeys(q.COMMON_WORDS)))
_CLASSES = ", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g')) AS n_{k}" for k, p in q.CLASSES.items())


def _distance(name: str, doc: str, ref: str) -> str:
    """Of histograms in long form: doc(rid, bin, n), ref(lang, bin, n). Bins that a row lacks add the reference's share, as if once."""
    return f"""{name}_d AS (SELECT rid, bin, n, n / sum(n) OVER (PARTITION BY rid) AS p, sum(n) OVER (PARTITION BY rid) AS total FROM {doc}),
    {name}_r AS (SELECT lang, bin, n / sum(n) OVER (PARTITION BY lang) AS q FROM {ref}),
    {name} AS (SELECT rid, total, sqrt(greatest(0, (sum(p * log2(2 * p / (p + coalesce(q, 0))) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) + 1 - coalesce(sum(q), 0)) / 2)) AS dist
      FROM {name}_d JOIN base USING (rid) LEFT JOIN {name}_r USING (lang, bin) GROUP BY 1, 2)"""


QUALITY_RULES = f"""
    WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
    w AS (SELECT rid, lang, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM base),
    c AS (SELECT rid, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(t) AS len, len(lines) - len(list_distinct(lines)) AS n_dup_lines, {_CLASSES} FROM w),
    win AS (SELECT rid, unnest(list_transform(range(1, len(words) - 1), lambda i: [words[i], words[i + 1], words[i + 2]])) AS win, unnest(range(1, len(words) - 1)) AS i FROM w),
    dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM win) WHERE n > 1),
    rep AS (SELECT rid, count(*) AS n_repeat_words FROM (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) AS i FROM dup) GROUP BY 1),
    vocabulary(word, bin) AS (VALUES {_WORDS}),
    common AS (SELECT rid, bin, count(*)::DOUBLE AS n FROM (SELECT rid, unnest(words) AS word FROM w) JOIN vocabulary USING (word) GROUP BY 1, 2),
    chars AS (SELECT rid, unnest([0, 1, 2, 3, 4, 5]) AS bin, unnest([n_capital, n_digit, n_stop, n_symbol, len - word_chars, word_chars - n_capital - n_digit - n_stop - n_symbol])::DOUBLE AS n FROM c),
    char_doc AS (SELECT * FROM chars WHERE n > 0),
    char_ref AS (SELECT lang, bin, sum(n) AS n FROM chars JOIN base USING (rid) GROUP BY 1, 2),
    word_ref AS (SELECT lang, bin, sum(n) AS n FROM common JOIN base USING (rid) GROUP BY 1, 2),
    known AS (SELECT lang, count(*) >= {q.MIN_REFERENCE_DOCS} AS enough FROM base GROUP BY 1),
    {_distance('cd', 'char_doc', 'char_ref')},
    {_distance('wd', 'common', 'word_ref')},
    f AS (SELECT doc_id, n_words, word_chars, n_symbol AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, enough AND len >= {q.MIN_CHARS} AND coalesce(cd.dist, 0) > {q.MAX_CHAR_DISTANCE} OR enough AND coalesce(wd.total, 0) >= {q.MIN_COMMON} AND coalesce(wd.dist, 0) > {q.MAX_WORD_DISTANCE} AS far
      FROM c JOIN base USING (rid, lang) JOIN known USING (lang) LEFT JOIN rep USING (rid) LEFT JOIN cd USING (rid) LEFT JOIN wd USING (rid))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT far AS kept FROM f
"""


def _host(x: str) -> str:
    return f"CASE WHEN contains({x}, '://') THEN translate(regexp_extract({x}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"


def _path(x: str) -> str:
    return f"CASE WHEN contains({x}, '://') THEN regexp_extract({x}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END"


def _address(x: str) -> str:
    return f"CASE WHEN contains({x}, '://') THEN regexp_replace({_host(x)}, ':(80|443)?$', '') || regexp_replace({_path(x)}, '/+$', '') || regexp_extract({x}, '(?s)^[^?#]*(\\?[^#]*)', 1) END"


def _attribute(tag: str, name: str) -> str:
    found = " || ".join(f"""regexp_extract({tag}, '(?is)\\b{name}\\s*=\\s*(?:"\\s*([^"]*)|''\\s*([^'']*)|([^\\s"''>]+))', {i})""" for i in (1, 2, 3))
    return f"rtrim(regexp_replace({found}, '(?i)&(amp|#38|#x26);', '&', 'g'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _resolved(x: str, base: str) -> str:
    scheme = f"regexp_extract({base}, '(?s)^(.*?)://', 1)"
    site, plain, rest = f"({scheme} || '://' || {_host(base)})", f"regexp_extract({x}, '(?s)^[^?#]*')", f"regexp_extract({x}, '(?s)^[^?#]*(.*)$', 1)"
    whole = f"CASE WHEN starts_with({plain}, '/') THEN {plain} ELSE regexp_extract({_path(base)}, '(?s)^(.*/)', 1) || {plain} END"
    parts = f"list_transform(string_split(regexp_replace({whole}, '^/', ''), '/'), lambda p: [p])"
    up = f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), {parts}), lambda kept, p: CASE WHEN p = ['..'] THEN kept[1:greatest(len(kept) - 1, 0)] WHEN p = ['.'] THEN kept ELSE list_concat(kept, p) END)"
    return f"""CASE WHEN regexp_matches({x}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {x} WHEN NOT contains({base}, '://') THEN NULL WHEN starts_with({x}, '//') THEN {scheme} || ':' || {x}
      WHEN regexp_matches({x}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN {plain} = '' THEN {site} || {_path(base)} || {rest} ELSE {site} || '/' || array_to_string({up}, '/') || {rest} END"""


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in u.RULES)
URL_FILTER = f"""
    WITH RECURSIVE r(rid, page_id, url, html) AS (SELECT row_number() OVER (), page_id, url, html FROM pages),
    b AS (SELECT rid, page_id, url, coalesce({_host('url')}, '') AS host, coalesce({_path('url')}, '') AS path, {_address('url')} AS node FROM r),
    rules(verdict, h, p) AS (VALUES {_RULES}),
    fit AS (SELECT rid, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict FROM b JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1),
    tags AS (SELECT rid, url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta|base)\\b[^>]*>')) AS tag, generate_subscripts(regexp_extract_all(html, '(?is)<(?:link|meta|base)\\b[^>]*>'), 1) AS n FROM r),
    bases AS (SELECT rid, min_by({_attribute('tag', 'href')}, n) AS href FROM tags WHERE regexp_matches(tag, '(?i)^<base') AND {_attribute('tag', 'href')} <> '' GROUP BY 1),
    targets AS (SELECT rid, url, {_attribute('tag', 'href')} AS target FROM tags WHERE regexp_matches(tag, '(?i)^<link') AND regexp_matches({_attribute('tag', 'rel')}, '(?i)(^|\\s)canonical(\\s|$)')
      UNION ALL SELECT rid, url, {_attribute('tag', 'content')} FROM tags WHERE regexp_matches(tag, '(?i)^<meta') AND regexp_matches({_attribute('tag', 'property')}, '(?i)^og:url$')
      UNION ALL SELECT rid, url, regexp_extract({_attribute('tag', 'content')}, '(?i)\\burl\\s*=\\s*["'']?\\s*([^"''\\s]+)', 1) FROM tags WHERE regexp_matches(tag, '(?i)^<meta') AND regexp_matches({_attribute('tag', 'http-equiv')}, '(?i)^refresh$')),
    named AS (SELECT t.url, target, coalesce({_resolved('href', 't.url')}, t.url) AS base FROM targets t LEFT JOIN bases USING (rid) WHERE target <> ''),
    whole AS (SELECT url, {_resolved('target', 'base')} AS target FROM named),
    e AS (SELECT {_address('url')} AS a, {_address('target')} AS z, url, target FROM whole),
    ends AS (SELECT a AS node, {_host('url')} AS host, {_path('url')} AS path FROM e WHERE a <> z UNION ALL SELECT z, {_host('target')}, {_path('target')} FROM e WHERE a <> z UNION ALL SELECT node, host, path FROM b),
    marks AS (SELECT node, host, path, max_by(verdict, length(h || p)) AS verdict FROM ends JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) WHERE node IS NOT NULL GROUP BY 1, 2, 3),
    both_ways AS (SELECT a, z FROM e WHERE a <> z UNION SELECT z, a FROM e WHERE a <> z),
    reach(a, z) AS (SELECT DISTINCT node, node FROM ends WHERE node IS NOT NULL UNION SELECT reach.a, x.z FROM reach JOIN both_ways x ON x.a = reach.z),
    given AS (SELECT reach.a AS node, max(CASE marks.verdict WHEN 'allow' THEN 2 ELSE 1 END) AS v FROM reach JOIN marks ON marks.node = reach.z GROUP BY 1)
    SELECT page_id, host, path, rule, coalesce(fit.verdict, CASE WHEN given.v = 1 THEN 'block' END, 'allow') AS verdict FROM b LEFT JOIN fit USING (rid) LEFT JOIN given ON given.node = b.node
"""


_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

HARD_NEGATIVES = f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}),
s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, list_dot_product(a.q, v.q)::BIGINT AS score FROM v AS a JOIN v ON a.vec_id % 100 = 0 AND v.vec_id <> a.vec_id AND len(v.q) = len(a.q)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
r AS (SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM r WHERE rank <= 10"""


def _clustering(k: int = 16, rounds: int = 3) -> str:
    """Assignments and means, round after round; distances from inner products of integers held as doubles, which are exact."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND {_FINITE})",
        f"c0 AS (SELECT n - 1 AS cluster, x AS c FROM (SELECT x, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) AS n FROM v) WHERE n <= {k})",
    ]
    for r in range(rounds + 1):
        away = "list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c)"
        steps.append(f"a{r} AS MATERIALIZED (SELECT row, vec_id, x, b.cluster, b.d::BIGINT AS distance FROM (SELECT row, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': {away}, 'cluster': cluster}}) AS b FROM v, c{r} GROUP BY row))")
        if r < rounds:
            steps.append(f"e{r} AS (SELECT cluster, i, sum(y)::HUGEINT AS s, count(*) AS n FROM (SELECT cluster, unnest(x)::BIGINT AS y, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY cluster, i)")
            moved = f"SELECT cluster, list(((s - (s % n + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM e{r} GROUP BY cluster"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN ({moved}) m USING (cluster))")
    last = f"""SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda y: y::BIGINT), ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"""
    return "WITH " + ",\n".join(steps) + "\n" + last


CLUSTERING = _clustering()
