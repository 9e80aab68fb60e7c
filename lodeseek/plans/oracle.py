"""DuckDB forms of the engine's expressions and stages, written apart from them."""

from __future__ import annotations

from . import fixtures as fx

GEO = [r"\bblisko\s+mnie\b", r"\bblisko\b", r"\bniedaleko\b", r"\bw\s+poblizu\b", r"\bobok\b", r"\bw\s+okolic\w*\b", r"\bnajblizej\b", r"\bnajblizsz\w*", r"\bkolo\s+mnie\b", r"\bw\s+sasiedztwie\b", r"\bw\s+moim\s+rejonie\b", r"\bnear\s*me\b", r"\bnearby\b", r"\bclosest\b", r"\baround\s+me\b"]


def fold(x: str) -> str:
    return f"regexp_replace(strip_accents(translate({x}, 'łŁ', 'lL')), '[\\x{{0300}}-\\x{{036f}}]', '', 'g')"


def normalize(x: str, polish: bool = False) -> str:
    plain = fold(f"coalesce({x}, '')") if polish else f"regexp_replace(strip_accents(coalesce({x}, '')), '[\\x{{0300}}-\\x{{036f}}]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace(lower({plain}), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def trigrams(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE list_distinct(flatten(list_transform(string_split({x}, ' '), lambda w: CASE WHEN length(w) < 3 THEN [w] ELSE list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) END))) END"


def padded_trigrams(x: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(string_split_regex({x}, '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def padded_similarity(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"


def similarity(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}), 1) END"


def haversine(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(12742.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def has_intent(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches(lower({fold(x)}), '{p}')" for p in GEO) + ")"


def without_intent(x: str, by: str = "") -> str:
    out = f"lower({fold(x)})" if not by else x
    for p in GEO:
        out = f"regexp_replace({out}, '{p}', '{by}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def without_stop_words(x: str) -> str:
    from ..functions.locale import POLISH_STOP_PHRASES, POLISH_STOP_TOKENS

    out = without_intent(x, " ")
    for p in sorted(POLISH_STOP_PHRASES, key=len, reverse=True):
        out = f"regexp_replace({out}, '\\b{p}\\b', ' ', 'g')"
    return f"array_to_string(list_filter(string_split(regexp_replace({out}, '\\s+', ' ', 'g'), ' '), lambda t: t <> '' AND NOT list_contains({fx.literal(list(POLISH_STOP_TOKENS))}, t)), ' ')"


def stems(x: str) -> str:
    """Of one word: itself, then what its endings give, if of 3 characters or more."""
    from ..functions.locale import STEM_ENDINGS

    cut = [f"CASE WHEN ends_with({x}, '{a}') AND length({x}) - {len(a) - len(b)} >= 3 THEN left({x}, length({x}) - {len(a)}) || '{b}' END" for a, b in STEM_ENDINGS]
    return f"list_filter([{x}, {', '.join(cut)}], lambda s: s IS NOT NULL)"


def pair_stems(ws: str) -> str:
    """Of two words in a list: the name itself, then all combinations, each once."""
    pairs = f"flatten(list_transform({stems(ws + '[1]')}, lambda h: list_transform({stems(ws + '[2]')}, lambda l: h || ' ' || l)))"
    whole = f"list_prepend({ws}[1] || ' ' || {ws}[2], {pairs})"
    return f"list_filter({whole}, lambda s, i: list_position({whole}, s) = i)"


def locative_word(p: str) -> str:
    from ..functions.locale import LOCATIVE_ENDINGS

    return "CASE " + " ".join(f"WHEN ends_with({p}, '{e}') THEN left({p}, length({p}) - {drop}) || '{add}'" for e, drop, add in LOCATIVE_ENDINGS) + " END"


LAT, LNG = "49.0 + ({0} * 7919) % 5800 / 1000.0", "14.1 + ({0} * 104729) % 10000 / 1000.0"
ENTITIES = f"""ent0 AS (SELECT p_partkey AS id, p_name AS name, {LAT.format('p_partkey')} AS lat, {LNG.format('p_partkey')} AS lng, {normalize('p_name')} AS name_n, {normalize('p_type')} AS categories_n, {normalize('p_brand')} AS location_n FROM part),
ent AS (SELECT id, name, replace(name_n, ' ', '-') AS slug, lat::DOUBLE AS lat, lng::DOUBLE AS lng, name_n, categories_n, location_n, replace(location_n, ' ', '-') AS location_slug FROM ent0)"""

TEXTS = """ft AS (SELECT id, 'name' AS field, name_n AS text FROM ent WHERE name_n <> '' UNION ALL SELECT id, 'categories', categories_n FROM ent WHERE categories_n <> '' UNION ALL SELECT id, 'location', location_n FROM ent WHERE location_n <> ''),
tl AS (SELECT id, field, list_filter(string_split_regex(text, '[ -]'), lambda t: t <> '') AS ts FROM ft),
tok AS (SELECT id, field, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM tl),
dl AS (SELECT e.id, coalesce(sum(len(ts)), 0)::BIGINT AS doc_len FROM ent e LEFT JOIN tl ON tl.id = e.id GROUP BY e.id)"""

ROUTED = f"""{fx.values('q0', 'query_id, query, location_slug, category_slug, lat, lng, lim, off', fx.QUERIES)},
q1 AS (SELECT query_id, query, location_slug, category_slug, lat::DOUBLE AS lat, lng::DOUBLE AS lng, lim, off, trim(coalesce(query, '')) = '' AS blank, trim(coalesce(query, '')) <> '' AND {has_intent("coalesce(query, '')")} AS geo_intent FROM q0),
q2 AS (SELECT *, CASE WHEN geo_intent THEN {normalize(without_intent("coalesce(query, '')"), True)} ELSE {normalize('query', True)} END AS normalized FROM q1),
q AS (SELECT *, CASE WHEN blank OR geo_intent AND normalized = '' THEN CASE WHEN location_slug IS NOT NULL THEN 'location' WHEN lat IS NOT NULL AND lng IS NOT NULL THEN 'geo' ELSE 'none' END ELSE 'text' END AS route FROM q2)"""

TERMS = f"""{fx.values('syn', 'alias, canonical, category, ordinal', fx.SYNONYMS)},
qw AS (SELECT query_id, list_filter(string_split(normalized, ' '), lambda t: t <> '') AS words FROM q WHERE route = 'text'),
qa AS (SELECT query_id, words, list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS aliases FROM qw),
qe AS (SELECT query_id, words, unnest(aliases) AS alias, generate_subscripts(aliases, 1) AS place FROM qa),
qc AS (SELECT query_id, canonical, min(place) AS place FROM qe JOIN syn USING (alias) WHERE NOT list_contains(words, canonical) GROUP BY 1, 2),
qx AS (SELECT query_id, list(canonical ORDER BY place, canonical) AS added FROM qc GROUP BY 1),
expanded AS (SELECT qw.query_id, list_concat(words, coalesce(added, []::VARCHAR[])) AS tokens FROM qw LEFT JOIN qx USING (query_id)),
qt AS (SELECT query_id, list_slice(list_filter(list_transform(tokens, lambda t: regexp_replace(t, '[''"(){{}}*:^~!&|<>-]', '', 'g')), lambda t: t <> ''), 1, 6) AS ts FROM expanded),
terms AS (SELECT DISTINCT query_id, unnest(ts) AS term FROM qt)"""

RANKED = """hits AS (SELECT term, id, count(*) AS f FROM (SELECT DISTINCT term FROM terms WHERE NOT contains(term, ' ')) JOIN tok ON starts_with(token, term) GROUP BY 1, 2
  UNION ALL SELECT term, a.id, count(*) FROM (SELECT DISTINCT term FROM terms WHERE contains(term, ' ')) JOIN tok a ON a.token = split_part(term, ' ', 1) JOIN tok b ON b.id = a.id AND b.field = a.field AND b.pos = a.pos + 1 AND starts_with(b.token, split_part(term, ' ', 2)) GROUP BY 1, 2),
corpus AS (SELECT count(*)::DOUBLE AS docs, avg(doc_len) AS mean_len FROM dl),
idf AS (SELECT term, mean_len, ln((docs - n + 0.5) / (n + 0.5)) AS raw FROM (SELECT term, count(*)::DOUBLE AS n FROM hits GROUP BY 1), corpus),
ranked AS (SELECT query_id, id, -sum(CASE WHEN raw > 0 THEN raw ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * doc_len / mean_len))) AS fts_rank FROM terms JOIN hits USING (term) JOIN idf USING (term) JOIN dl USING (id) GROUP BY 1, 2)"""


POSITIVE = """th AS (SELECT term, token, id, count(*) AS f FROM (SELECT DISTINCT term FROM terms WHERE NOT contains(term, ' ')) JOIN tok ON starts_with(token, term) GROUP BY 1, 2, 3
  UNION ALL SELECT term, term, a.id, count(*) FROM (SELECT DISTINCT term FROM terms WHERE contains(term, ' ')) JOIN tok a ON a.token = split_part(term, ' ', 1) JOIN tok b ON b.id = a.id AND b.field = a.field AND b.pos = a.pos + 1 AND starts_with(b.token, split_part(term, ' ', 2)) GROUP BY 1, 2, 3),
ranked AS (SELECT query_id, id, -sum(0.1::DOUBLE * list_sum(list_transform(range(1, least(f, 255) + 1), lambda j: 1::DOUBLE / (j * j))) / 1.64493406685::DOUBLE) / any_value(size) AS fts_rank
  FROM terms JOIN th USING (term) JOIN (SELECT query_id, count(*) AS size FROM terms GROUP BY 1) USING (query_id) GROUP BY 1, 2)"""


def fts(sign: str = "") -> str:
    category = normalize("replace(q.category_slug, '-', ' ')", True)
    return f"""fts AS (SELECT query_id, id, {sign}fts_rank AS fts_rank, pos FROM (SELECT r.query_id, r.id, fts_rank, q.lim, row_number() OVER (PARTITION BY r.query_id ORDER BY round(fts_rank, 9), r.id) AS pos
  FROM ranked r JOIN q USING (query_id) JOIN ent ON ent.id = r.id WHERE (q.location_slug IS NULL OR ent.location_slug = q.location_slug) AND (q.category_slug IS NULL OR contains(categories_n, {category}))) WHERE pos <= 3 * lim),
gq AS (SELECT q.*, coalesce(n, 0) AS fts_rows, coalesce(n, 0) < 5 AND length(normalized) >= 3 AS run_fuzzy FROM q LEFT JOIN (SELECT query_id, count(*) AS n FROM fts GROUP BY 1) USING (query_id) WHERE route = 'text')"""


FUZZY = f"""tri AS (SELECT DISTINCT id, unnest({trigrams('text')}) AS trigram FROM ft),
fq AS (SELECT query_id, lim, location_slug AS q_location, {trigrams('normalized')} AS grams FROM gq WHERE run_fuzzy),
fe AS (SELECT query_id, unnest(grams) AS trigram FROM fq),
fs AS (SELECT query_id, id, count(*) AS shared FROM fe JOIN tri USING (trigram) GROUP BY 1, 2),
fuzzy AS (SELECT query_id, id, fuzzy_score, pos FROM (SELECT fs.query_id, fs.id, shared / len(grams)::DOUBLE AS fuzzy_score, lim, row_number() OVER (PARTITION BY fs.query_id ORDER BY shared / len(grams)::DOUBLE DESC, fs.id) AS pos
  FROM fs JOIN fq USING (query_id) JOIN ent ON ent.id = fs.id WHERE (q_location IS NULL OR location_slug = q_location) AND shared >= CASE WHEN len(grams) <= 3 THEN greatest(1, len(grams) - 1) ELSE greatest(2, ceil(len(grams) * 0.45)) END) WHERE pos <= 2 * lim)"""

MERGED = """merged AS (SELECT query_id, id, fts_rank, NULL::DOUBLE AS fuzzy_score, 0 AS source, pos FROM fts UNION ALL SELECT query_id, id, NULL, fuzzy_score, 1, pos FROM fuzzy z WHERE NOT EXISTS (SELECT 1 FROM fts WHERE fts.query_id = z.query_id AND fts.id = z.id))"""

SCORED = f"""s0 AS (SELECT m.*, q.normalized, q.geo_intent, e.name, e.slug, e.lat, e.lng, e.name_n, e.categories_n, e.location_n, {trigrams('q.normalized')} AS g, {trigrams('e.name_n')} AS gn, {trigrams('e.categories_n')} AS gc, {trigrams('e.location_n')} AS gl, {haversine('q.lat', 'q.lng', 'e.lat', 'e.lng')} AS distance_km FROM merged m JOIN q USING (query_id) JOIN ent e ON e.id = m.id),
scored AS (SELECT *, coalesce(least(1.0, greatest(0.0, -fts_rank / 20.0)), 0.0) * 0.40 + greatest({jaccard('g', 'gn')}, {similarity('normalized', 'name_n')}) * 0.25 + greatest({jaccard('g', 'gc')}, {jaccard('g', 'gl')}) * 0.15 + coalesce(fuzzy_score, 0.0) * 0.30
  + coalesce(greatest(0.0, 1 - distance_km / 30.0), 0.0) * (0.15 + CASE WHEN geo_intent THEN 0.25 ELSE 0.0 END) AS score, floor(distance_km * 1.3 / 4.8 * 60 + 0.5)::INT AS walking_min FROM s0)"""

GATED = f"""gated AS (SELECT * FROM scored WHERE fts_rank IS NOT NULL OR greatest({similarity('normalized', 'name_n')}, {similarity('normalized', 'location_n')}, {similarity('normalized', 'categories_n')}) >= 0.75)"""

PAGES = """placed0 AS (SELECT g.*, q.lim, q.off, CASE WHEN q.location_slug IS NOT NULL OR q.lat IS NULL OR q.lng IS NULL OR distance_km IS NULL OR distance_km <= 15 THEN 'primary' WHEN distance_km <= 30 THEN 'nearby' END AS section FROM gated g JOIN q USING (query_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY round(score, 9) DESC, source, pos, id) AS place FROM placed0 WHERE section IS NOT NULL),
pages AS (SELECT *, CASE WHEN section = 'primary' THEN place - off ELSE place END::INT AS rank FROM placed WHERE CASE WHEN section = 'primary' THEN place > off AND place <= off + lim ELSE place <= 5 END)"""

SCANS = f"""ls AS (SELECT q.query_id, q.lim, q.lat AS q_lat, q.lng AS q_lng, e.id, e.lat, e.lng, row_number() OVER (PARTITION BY q.query_id ORDER BY e.id) AS n FROM q JOIN ent e ON e.location_slug = q.location_slug WHERE route = 'location' AND (q.category_slug IS NULL OR contains(categories_n, {normalize("replace(q.category_slug, '-', ' ')", True)}))),
lscan AS (SELECT query_id, id, {haversine('q_lat', 'q_lng', 'lat', 'lng')} AS distance_km, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN q_lat IS NOT NULL AND q_lng IS NOT NULL THEN round({haversine('q_lat', 'q_lng', 'lat', 'lng')}, 9) END, id) AS pos FROM ls WHERE n <= lim),
gs AS (SELECT q.query_id, q.lim, e.id, {haversine('q.lat', 'q.lng', 'e.lat', 'e.lng')} AS distance_km FROM q JOIN ent e ON e.lat BETWEEN q.lat - 15 / 111.32 AND q.lat + 15 / 111.32 AND e.lng BETWEEN q.lng - 15 / (111.32 * cos(radians(q.lat))) AND q.lng + 15 / (111.32 * cos(radians(q.lat))) WHERE route = 'geo'),
gscan AS (SELECT query_id, id, distance_km, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance_km, 9), id) AS pos FROM gs) WHERE pos <= lim),
scans AS (SELECT * FROM lscan UNION ALL SELECT * FROM gscan)"""


def chain(select: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + select


UP_TO_FTS = (ENTITIES, TEXTS, ROUTED, TERMS, RANKED, fts())
UP_TO_GATED = (*UP_TO_FTS, FUZZY, MERGED, SCORED, GATED)
EVERYTHING = (*UP_TO_GATED, PAGES, SCANS)
