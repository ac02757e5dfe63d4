"""What each query computes, as DuckDB SQL over the driver's tables."""

from __future__ import annotations

from waymark.schema import NEARBY_RANKS, STRONG_KEYS

LON = "(22.5 + (({0} * 7919) % 38000) / 10000.0::DOUBLE)"
LAT = "(48.6 + (({0} * 104729) % 21000) / 10000.0::DOUBLE)"
RANKS = "[" + ", ".join(f"'{r}'" for r in NEARBY_RANKS) + "]"
LATIN, CYRILLIC = "abvgdeziklmnoprstufy", "абвгдезіклмнопрстуфй"


def fold(x: str) -> str:
    return f"strip_accents(replace(lower({x}), 'ß', 'ss'))"


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+')"


def clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def uk(x: str) -> str:
    return f"translate(lower({x}), '{LATIN}', '{CYRILLIC}')"


def spelled(x: str, naive: bool) -> str:
    """A romanised Cyrillic expression."""
    # The romanisation tables.
    x = f"lower({x})"
    several = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch"}
    if naive:
        for a, b in ({"ж": "zh", "ч": "ch", "ш": "sh", "щ": "sch", "є": "ye", "ю": "yu", "я": "ya"}).items():
            x = f"replace({x}, '{a}', '{b}')"
        return f"translate({x}, 'абвгґдезиіклмнопрстуфхцїйыэёь''’ʼъ', 'abvggdeziiklmnoprstufhciyyee')"
    x = f"replace({x}, 'зг', 'zgh')"
    # RE2 has no lookbehind: the sign before is captured and put back.
    for letter, first, later in (("є", "ye", "ie"), ("ї", "yi", "i"), ("й", "y", "i"), ("ю", "yu", "iu"), ("я", "ya", "ia")):
        x = rf"regexp_replace({x}, '(^|[^\p{{L}}]){letter}', '\1' || chr(1) || '{letter}', 'g')"
    for letter, first, later in (("є", "ye", "ie"), ("ї", "yi", "i"), ("й", "y", "i"), ("ю", "yu", "iu"), ("я", "ya", "ia")):
        x = f"replace(replace({x}, chr(1) || '{letter}', '{first}'), '{letter}', '{later}')"
    for a, b in several.items():
        x = f"replace({x}, '{a}', '{b}')"
    return f"translate({x}, 'абвгґдезиіклмнопрстуфыэёь''’ʼъ', 'abvhgdezyiklmnoprstufyee')"


def kmu(x: str) -> str:
    return spelled(x, False)


def typed(x: str) -> str:
    return spelled(x, True)


OBJECTS = f"""
SELECT c_custkey AS id, c_name AS name, ['n', 'w', 'a'][(c_custkey % 3)::INT + 1] AS osm_type,
  c_custkey % 3 = 0 AS building, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) END AS shop, c_custkey % 5 = 0 AS cafe,
  CASE WHEN c_custkey % 7 = 0 THEN (4 + c_custkey % 5)::VARCHAR END AS level,
  CASE WHEN c_custkey % 11 = 0 THEN {RANKS}[(c_custkey % 10)::INT + 1] END AS place, c_custkey % 13 = 0 AS highway
FROM customer"""

POINTS = f"SELECT c_custkey AS place_id, c_name AS name, {LON.format('c_custkey')} AS lon, {LAT.format('c_custkey')} AS lat, CASE WHEN c_custkey % 20 = 0 THEN 'addr ' || c_mktsegment ELSE '' END AS addr_street FROM customer"
SETTLEMENTS = f"SELECT s_suppkey AS seq, s_name AS name, {RANKS}[(s_suppkey % 10)::INT + 1] AS rank, {LON.format('s_suppkey')} AS plon, {LAT.format('s_suppkey')} AS plat FROM supplier"
STREETS = f"""
SELECT p_partkey AS seq, p_name || ' ' || p_partkey AS name, ax, ay, ax + ((p_partkey % 11) - 5) / 50.0::DOUBLE AS bx, ay + ((p_partkey % 7) - 3) / 50.0::DOUBLE AS by_
FROM (SELECT *, {LON.format('(p_partkey + 50021)')} AS ax, {LAT.format('(p_partkey + 50021)')} AS ay FROM part)"""
AREAS = """
SELECT n_nationkey::BIGINT AS seq, n_name AS name, '8' AS level, 22.5::DOUBLE + (n_nationkey % 5) * 0.76::DOUBLE AS x0, 48.6::DOUBLE + floor(n_nationkey / 5.0) * 0.42::DOUBLE AS y0,
  22.5::DOUBLE + (n_nationkey % 5) * 0.76::DOUBLE + 0.76::DOUBLE AS x1, 48.6::DOUBLE + floor(n_nationkey / 5.0) * 0.42::DOUBLE + 0.42::DOUBLE AS y1 FROM nation
UNION ALL SELECT r_regionkey::BIGINT, r_name, '4', 22.5::DOUBLE + r_regionkey * 0.76::DOUBLE, 48.6::DOUBLE, 22.5::DOUBLE + r_regionkey * 0.76::DOUBLE + 0.76::DOUBLE, 50.7::DOUBLE FROM region"""

METRES = "sqrt(((plon - lon) * (111320.0::DOUBLE * cos(radians(lat)))) ** 2 + ((plat - lat) * 110574.0::DOUBLE) ** 2)"


def near(radius: float, ranks: str, most: int, points: str = "p") -> str:
    return f"""SELECT * FROM (SELECT place_id, row_number() OVER (PARTITION BY place_id ORDER BY metres, seq)::INT AS pos, name, metres
FROM (SELECT p.place_id, s.seq, s.name, {METRES} AS metres FROM {points} p, s WHERE {ranks}) WHERE metres <= {radius}) WHERE pos <= {most}"""


SETTLED, MAJOR, SUB = "rank IN ('city', 'town', 'village', 'hamlet')", "rank IN ('city', 'town')", "rank NOT IN ('city', 'town', 'village', 'hamlet')"
GEO = f"WITH p AS ({POINTS}), s AS ({SETTLEMENTS})"


def settled(radius: float) -> str:
    return f"""near AS MATERIALIZED ({near(radius, SETTLED, 3)}),
alone AS (SELECT * FROM p WHERE place_id NOT IN (SELECT place_id FROM near)),
major AS ({near(40000, MAJOR, 1, 'alone')})"""


STREET = f"""street AS (SELECT place_id, name, seq, metres FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY metres, seq) AS rn FROM (
SELECT place_id, seq, name, {METRES} AS metres FROM (SELECT *, ax + t * (bx - ax) AS plon, ay + t * (by_ - ay) AS plat FROM (
SELECT p.place_id, p.lon, p.lat, p.addr_street, st.*, greatest(0, least(1, coalesce(((p.lon - ax) * (bx - ax) + (p.lat - ay) * (by_ - ay)) / nullif((bx - ax) ** 2 + (by_ - ay) ** 2, 0), 0))) AS t
FROM p, ({STREETS}) st))) WHERE metres <= 120) WHERE rn = 1)"""
INSIDE = f"inside AS (SELECT place_id, level, arg_min(a.name, seq) AS name FROM p, ({AREAS}) a WHERE lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY ALL)"

PLACES = f"""
SELECT doc_id AS place_id, {clean("split_part(text, '.', 1)")} AS name, {clean("CASE WHEN instr(text, '.') > 0 THEN substr(text, instr(text, '.') + 1) ELSE '' END")} AS context,
  CASE WHEN doc_id % 10 = 0 THEN 'place=' || lang ELSE 'shop=' || source END AS category, {LON.format('doc_id')} AS lon, {LAT.format('doc_id')} AS lat FROM documents"""
TERMS = f"""pl AS MATERIALIZED ({PLACES}),
nw AS MATERIALIZED (SELECT DISTINCT place_id, unnest({words(fold('name'))}) AS word FROM pl),
cw AS MATERIALIZED (SELECT DISTINCT place_id, unnest({words(fold('context'))}) AS word FROM pl),
pairs AS MATERIALIZED (SELECT word, place_id, true AS named FROM nw UNION ALL SELECT word, place_id, false FROM cw ANTI JOIN nw USING (place_id, word))"""
DELTA = "ref - coalesce(lag(ref) OVER (PARTITION BY word ORDER BY ref), 0)"
BYTES = "1 + (d >= 128)::INT + (d >= 16384)::INT + (d >= 2097152)::INT + (d >= 268435456)::INT + (d >= 34359738368)::INT"
VARINT = "".join(f"CASE WHEN d < {1 << 7 * n} THEN printf('" + "%02x" * n + "', " + ", ".join(f"((d >> {7 * k}) & 127) + {128 if k < n - 1 else 0}" for k in range(n)) + ") ELSE " for n in range(1, 6)) + "NULL" + " END" * 5
VOCAB = f"""vocab AS MATERIALIZED (SELECT word, length(word)::BIGINT AS n_chars, count(*)::BIGINT AS places, sum({BYTES})::BIGINT AS blob_bytes
FROM (SELECT word, {DELTA} AS d FROM (SELECT word, place_id * 2 + named::INT AS ref FROM pairs)) GROUP BY word)"""


def asked(lim: int) -> str:
    """Queries, their words, and what the words resolve to without the ratio."""
    return f"""items AS (SELECT item_id, list_sort(list_distinct({words(fold('text'))})) AS w FROM benchmark),
three AS (SELECT item_id, list(w ORDER BY length(w) DESC, w)[1:3] AS w FROM (SELECT item_id, unnest(w) AS w FROM items) GROUP BY item_id),
q AS MATERIALIZED (SELECT item_id AS query_id, concat_ws(' ', CASE WHEN item_id % 2 = 1 THEN substr(w[1], 1, length(w[1]) - 2) || 'x' || right(w[1], 1) ELSE w[1] END, w[2], w[3]) AS text,
  {lim} AS lim, 0.6::DOUBLE AS threshold, CASE WHEN item_id % 3 = 0 THEN 49.5::DOUBLE END AS olat, CASE WHEN item_id % 3 = 0 THEN 24.0::DOUBLE END AS olon FROM three),
qw AS MATERIALIZED (SELECT query_id, len(w) AS k, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS w FROM (SELECT query_id, {words(fold('text'))} AS w FROM q)),
dw AS MATERIALIZED (SELECT DISTINCT w FROM qw),
pre AS MATERIALIZED (SELECT *, sum(places) OVER (PARTITION BY w ORDER BY rn) AS run FROM (SELECT w, word AS candidate, places, blob_bytes, row_number() OVER (PARTITION BY w ORDER BY n_chars, word) AS rn
  FROM dw JOIN vocab ON word >= w AND word < w || chr(65535)) WHERE rn <= 500),
st AS MATERIALIZED (SELECT w, coalesce(max(run), 0) AS tot FROM dw LEFT JOIN pre USING (w) GROUP BY w),
kept AS MATERIALIZED (SELECT * FROM pre WHERE run <= 20000)"""


def ratio(pairs: str, name: str) -> str:
    """Relations that end in ``name`` (a, b, ratio): longest common runs first, then left and right of them."""

    def run(a: str, b: str) -> str:
        return f"""(SELECT max(struct_pack(k := k, i := -i, j := -j)) FROM (SELECT x.i, y.j, (SELECT coalesce(max(z.k), 0) FROM range(1, least(length({a}) - x.i, length({b}) - y.j) + 1) z(k) WHERE substr({a}, x.i + 1, z.k) = substr({b}, y.j + 1, z.k)) AS k
FROM range(0, length({a})) x(i), range(0, length({b})) y(j) WHERE substr({a}, x.i + 1, 1) = substr({b}, y.j + 1, 1)))"""

    return f"""{name}_p AS MATERIALIZED ({pairs}),
{name}_b AS (SELECT a, b, a AS s, b AS t, 0 AS depth FROM {name}_p UNION ALL
  SELECT a, b, unnest([substr(s, 1, -m.i), substr(s, -m.i + m.k + 1)]), unnest([substr(t, 1, -m.j), substr(t, -m.j + m.k + 1)]), depth + 1 FROM (SELECT *, {run('s', 't')} AS m FROM {name}_b WHERE s <> '' AND t <> '') WHERE m.k > 0),
{name}_m AS (SELECT a, b, sum(coalesce({run('s', 't')}.k, 0)) AS m FROM {name}_b WHERE s <> '' AND t <> '' GROUP BY a, b),
{name} AS MATERIALIZED (SELECT p.a, p.b, 2.0::DOUBLE * coalesce(m, 0) / (length(p.a) + length(p.b)) AS ratio FROM {name}_p p LEFT JOIN {name}_m USING (a, b))"""


VARIANTS = f"""WITH v AS (SELECT p_partkey AS place_id, unnest([0, 1, 2, 3]) AS o, unnest(['name', 'alt_name', 'old_name', 'name:uk']) AS source, unnest([p_name, upper(p_name), p_brand, {uk('p_name')}]) AS name FROM part),
v1 AS (SELECT place_id, o * 10 AS o, source, name FROM v QUALIFY row_number() OVER (PARTITION BY place_id, lower(name) ORDER BY o) = 1),
r AS (SELECT place_id, 100 + o AS o, 'translit_kmu' AS source, trim({kmu('name')}) AS name, name AS own FROM v1 WHERE regexp_matches(name, '[Ѐ-ӿ]')
  UNION ALL SELECT place_id, 101 + o, 'translit_naive', trim({typed('name')}), name FROM v1 WHERE regexp_matches(name, '[Ѐ-ӿ]')),
a AS (SELECT place_id, o, source, name FROM v1 UNION ALL SELECT place_id, o, source, name FROM r WHERE name <> '' AND lower(name) <> lower(own)),
d AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY place_id, lower(name) ORDER BY o) = 1)
SELECT place_id, (row_number() OVER (PARTITION BY place_id ORDER BY o) - 1)::INT AS ord, source, name FROM d"""

ORACLE_SQL = {
    "normalise_text": f"SELECT doc_id, {fold('text')} AS folded FROM documents",
    "tokenise_words": f"SELECT doc_id, len(w)::BIGINT AS n_words, len(list_distinct(w))::BIGINT AS n_distinct, array_to_string(w, ' ') AS words FROM (SELECT doc_id, {words(fold('text'))} AS w FROM documents)",
    "clean_whitespace": f"SELECT page_id, {clean('html')} AS cleaned FROM pages",
    "category_pick": f"""SELECT id AS osm_id, category, split_part(category, '=', 1) AS k, substr(category, instr(category, '=') + 1) AS v FROM (
SELECT id, coalesce(CASE WHEN cafe THEN 'amenity=cafe' END, 'shop=' || shop, 'place=' || place, CASE WHEN building THEN 'building=yes' END) AS category FROM ({OBJECTS})) WHERE category IS NOT NULL""",
    "role_split": f"""WITH o AS ({OBJECTS}) SELECT id AS seq, 'admin' AS role, level AS kind FROM o WHERE osm_type = 'a' AND level IN ('8', '7', '6', '4')
UNION ALL SELECT id, 'settlement', place FROM o WHERE osm_type = 'n' AND place IS NOT NULL UNION ALL SELECT id, 'street', name FROM o WHERE osm_type = 'w' AND highway""",
    "bbox_filter": f"SELECT place_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({POINTS}) WHERE lon BETWEEN 23.0 AND 24.5 AND lat BETWEEN 49.0 AND 50.0",
    "padded_sources": f"SELECT seq, name FROM ({STREETS}) WHERE greatest(ax, bx) >= 23.0 - 0.35 AND least(ax, bx) <= 24.5 + 0.35 AND greatest(ay, by_) >= 49.0 - 0.35 AND least(ay, by_) <= 50.0 + 0.35",
    "name_variants_dedup": VARIANTS,
    "name_concat": f"SELECT p_partkey, p_name, names FROM part JOIN (SELECT place_id, string_agg(name, chr(10) ORDER BY ord) AS names FROM ({VARIANTS}) GROUP BY place_id) ON p_partkey = place_id",
    "context_except": f"""WITH {TERMS} SELECT place_id, coalesce((SELECT string_agg(word, ' ' ORDER BY word) FROM pairs x WHERE x.place_id = pl.place_id AND named), '') AS name_terms,
coalesce((SELECT string_agg(word, ' ' ORDER BY word) FROM pairs x WHERE x.place_id = pl.place_id AND NOT named), '') AS context_terms FROM pl""",
    "postings_build": f"WITH {TERMS} SELECT word, ref >> 12 AS range, count(*)::BIGINT AS places, string_agg(ref::VARCHAR, ',' ORDER BY ref) AS postings FROM (SELECT word, place_id * 2 + named::INT AS ref FROM pairs) GROUP BY ALL",
    "postings_codec": f"""WITH {TERMS}, refs AS (SELECT word, place_id * 2 + named::INT AS ref FROM pairs), steps AS (SELECT word, ref, {DELTA} AS d FROM refs)
SELECT word, ref >> 12 AS range, count(*)::BIGINT AS places, min(ref) AS first_ref, string_agg({VARINT}, '' ORDER BY ref) AS data, sum({BYTES})::BIGINT AS n_bytes, string_agg(ref::VARCHAR, ',' ORDER BY ref) AS postings FROM steps GROUP BY ALL""",
    "postings_bytes": f"WITH {TERMS}, {VOCAB} SELECT word, n_chars, places, blob_bytes FROM vocab",
    "postings_roundtrip": f"WITH {TERMS} SELECT word, place_id, named FROM pairs",
    "prefix_resolve": f"WITH {TERMS}, {VOCAB}, {asked(20)} SELECT w AS word, candidate, places, blob_bytes, rn::BIGINT AS rn, run::BIGINT AS run FROM pre",
    "similarity_ratio": f"""WITH RECURSIVE x AS (SELECT DISTINCT unnest({words(fold('p_name'))}) AS a FROM part), y AS (SELECT DISTINCT unnest({words(fold("p_type || ' ' || p_name"))}) AS b FROM part),
{ratio('SELECT a, b FROM x, y WHERE length(a) = length(b)', 'r')} SELECT a AS word, b AS candidate, round(ratio, 6) AS ratio FROM r""",
    "word_similarity": f"""WITH RECURSIVE x AS (SELECT DISTINCT unnest({words(fold('n_name'))}) AS a FROM nation), y AS (SELECT DISTINCT unnest({words(fold("p_type || ' ' || p_name"))}) AS b FROM part),
{ratio('SELECT a, b FROM x, y WHERE a[1] = b[1]', 'r')} SELECT a AS word, b AS candidate, round(CASE WHEN starts_with(b, a) THEN 1.0 WHEN contains(b, a) THEN 0.9 WHEN abs(length(a) - length(b)) > 3 THEN 0.0 ELSE ratio END, 6)::DOUBLE AS score FROM r""",
    "primary_and_address": f"""WITH d AS (SELECT place_id, CASE WHEN context <> '' THEN name || ' (' || context || ')' ELSE name END AS display FROM ({PLACES}))
SELECT place_id, display, split_part(display, ' (', 1) AS name, CASE WHEN instr(display, ' (') > 0 THEN array_to_string(list_filter(list_transform(string_split(substr(display, instr(display, ' (') + 2, length(display) - instr(display, ' (') - 2), ','), lambda x: trim(x)), lambda x: x <> ''), '|') ELSE '' END AS address FROM d""",
    "matched_context": f"SELECT p_partkey, {kmu(uk('p_name'))} AS latin, {uk('p_name')} AS kept FROM part",
    "distance_labels": f"""SELECT place_id, round(m, 3) AS metres, CASE WHEN m < 1000 THEN printf('%d m', round(m)::BIGINT) WHEN m < 10000 THEN printf('%.1f km', m / 1000) ELSE printf('%.0f km', m / 1000) END AS label,
CASE WHEN (place_id % 1001) / 1000.0::DOUBLE >= 0.999 THEN '1.00' ELSE format('{{:.2f}}', (place_id % 1001) / 1000.0::DOUBLE + 1e-9) END AS score
FROM (SELECT *, sqrt((radians(lon - 24.0) * cos(radians((49.5 + lat) / 2))) ** 2 + radians(lat - 49.5) ** 2) * 6371000 AS m FROM ({POINTS}))""",
    "geo_links": f"""SELECT place_id, printf('geo:%.5f,%.5f', lat, lon) AS short, printf('geo:%.6f,%.6f?q=%.6f,%.6f(', lat, lon, lat, lon) || replace(url_encode(name), '+', '%20') || ')' AS labelled,
CASE place_id % 4 WHEN 0 THEN 'GPS' WHEN 1 THEN name WHEN 2 THEN printf('%.4f, %.4f (map)', lat, lon) ELSE '' END AS origin FROM ({POINTS})""",
    "short_address": f"""SELECT p_partkey, CASE WHEN street IS NULL THEN p_name ELSE p_name || ', ' || street END AS address FROM (
SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'вулиця ' || {uk('p_brand')} WHEN p_partkey % 3 = 0 THEN 'площа ' || {uk('p_type')} END AS street FROM part)""",
    "romanise_official": f"SELECT p_partkey, uk, {kmu('uk')} AS latin FROM (SELECT p_partkey, {uk('p_name')} || ' згода м''яч є-ї ющ' || {uk('p_type')} AS uk FROM part)",
    "romanise_typed": f"SELECT p_partkey, {typed('uk')} AS latin FROM (SELECT p_partkey, {uk('p_name')} || ' згода м''яч є-ї ющ' || {uk('p_type')} AS uk FROM part)",
    "cyrillic_test": f"SELECT p_partkey, regexp_matches({uk('p_name')}, '[Ѐ-ӿ]') AS uk, regexp_matches(p_name, '[Ѐ-ӿ]') AS en FROM part",
    "knn_settlements": f"{GEO} SELECT place_id, pos, name, round(metres, 3) AS metres FROM ({near(60000, SETTLED, 3)})",
    "fallback_major": f"{GEO}, {settled(12000)} SELECT place_id, pos, name, round(metres, 3) AS metres FROM (SELECT * FROM near UNION ALL SELECT * FROM major)",
    "nearest_subdivision": f"{GEO} SELECT place_id, pos, name, round(metres, 3) AS metres FROM ({near(1500, SUB, 1)})",
    "nearest_street": f"{GEO}, {STREET} SELECT place_id, name, seq, round(metres, 3) AS metres FROM street",
    "point_in_area": f"{GEO}, {INSIDE} SELECT place_id, level, name FROM inside",
    "context_assembly": f"""{GEO}, {settled(60000)}, {STREET}, {INSIDE}, sub AS ({near(1500, SUB, 1)}),
parts AS (SELECT place_id, 0 AS kind, pos, name FROM near UNION ALL SELECT place_id, 0, pos, name FROM major
UNION ALL SELECT place_id, 1, 1, CASE WHEN addr_street <> '' THEN addr_street ELSE street.name END FROM p LEFT JOIN street USING (place_id)
UNION ALL SELECT place_id, 2, pos, name FROM sub UNION ALL SELECT place_id, 3, list_position(['8', '7', '6', '4'], level), name FROM inside),
firsts AS (SELECT place_id, parts.name, min(kind * 10 + pos) AS o FROM parts JOIN p USING (place_id) WHERE parts.name IS NOT NULL AND parts.name <> p.name GROUP BY ALL),
six AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY o) AS rn FROM firsts)
SELECT p.place_id, coalesce(string_agg(six.name, ', ' ORDER BY o), '') AS context FROM p LEFT JOIN (SELECT * FROM six WHERE rn <= 6) six USING (place_id) GROUP BY p.place_id""",
    "distinct_categories": f"SELECT row_number() OVER (ORDER BY category)::BIGINT AS probe_id, category FROM (SELECT DISTINCT category FROM ({PLACES}))",
    "rescue_tags": f"""WITH pl AS ({PLACES}), c AS (SELECT category, row_number() OVER (ORDER BY category) AS n FROM (SELECT DISTINCT category FROM pl))
SELECT place_id AS node_id, CASE WHEN n % 3 <> 0 THEN category WHEN starts_with(category, 'place=') THEN 'place=locality' ELSE category || ',place=locality' END AS tags, n % 3 = 0 AS rescued FROM pl JOIN c USING (category)""",
    "count_audit": "SELECT count(*)::BIGINT AS written, count(DISTINCT doc_id)::BIGINT AS kept, (count(*) - count(DISTINCT doc_id))::BIGINT AS lost FROM documents",
    "asof_origin": """SELECT q.event_id, q.user_id, f.event_id AS fix_id, f.value FROM (SELECT * FROM events WHERE event_type IN ('search', 'purchase', 'view')) q
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) f ON q.user_id = f.user_id AND q.ts >= f.ts""",
    "origin_reruns": """SELECT c.event_id AS change_id, c.user_id, q.query_id, q.text FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF JOIN (SELECT user_id, ts, max(event_id) AS query_id, arg_max(event_type, event_id) AS text FROM events WHERE event_type <> 'click' GROUP BY ALL) q ON c.user_id = q.user_id AND c.ts >= q.ts""",
    "origin_states": """SELECT user_id, epoch_us(ts) AS micros, event_type AS kind, round(value, 6) AS lat, event_type AS label FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "located_points": f"""SELECT c_custkey AS osm_id, ['n', 'w', 'a'][(c_custkey % 3)::INT + 1] AS osm_type,
round({LON.format('c_custkey')} + [0.0, 0.005, 0.005][(c_custkey % 3)::INT + 1], 6)::DOUBLE AS lon, round({LAT.format('c_custkey')} + [0.0, 0.005, 0.005][(c_custkey % 3)::INT + 1], 6)::DOUBLE AS lat FROM customer""",
    "first_tags": f"""SELECT id AS osm_id, CASE WHEN building THEN 'building' WHEN shop IS NOT NULL THEN 'shop' WHEN cafe THEN 'amenity' WHEN level IS NOT NULL THEN 'boundary' WHEN place IS NOT NULL THEN 'place' WHEN highway THEN 'highway' END AS key,
CASE WHEN building THEN 'yes' WHEN shop IS NOT NULL THEN shop WHEN cafe THEN 'cafe' WHEN level IS NOT NULL THEN 'administrative' WHEN place IS NOT NULL THEN place WHEN highway THEN 'residential' END AS value FROM ({OBJECTS})""",
    "point_in_slanted_area": f"""WITH g AS (SELECT *, 22.5 + (n_nationkey % 5) * 0.76 AS x, 48.6 + (n_nationkey // 5) * 0.42 AS y FROM nation),
u AS (SELECT place_id, n_name, lon - x AS u, lat - y AS v FROM ({POINTS}), g WHERE lon BETWEEN x AND x + 0.76 AND lat BETWEEN y AND y + 0.42)
SELECT place_id, '8' AS level, n_name AS name FROM u WHERE v >= 0 AND v <= 0.4 / 0.38 * u AND v <= 0.4 / 0.38 * (0.76 - u)
AND NOT (v > 0.1 AND v < 0.1 + 0.1 / 0.08 * (u - 0.3) AND v < 0.1 + 0.1 / 0.08 * (0.46 - u))""",
    "debounce_queries": "SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NULL OR n >= ts + INTERVAL 6 HOURS",
    "latest_answers": "SELECT user_id, max(event_id) AS request_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "fix_throttle": "SELECT user_id, epoch(w)::BIGINT AS window_start, event_id AS fix_id, value FROM (SELECT *, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS w FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, w ORDER BY ts DESC, event_id DESC) = 1",
    "ttl_filter": "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAYS",
    "tags_json": r'''SELECT event_id, '{' || string_agg('"' || key || '":"' || (props ->> key) || '"', ',' ORDER BY n) || '}' AS tags, count(*)::BIGINT AS n
FROM (SELECT event_id, props, unnest(json_keys(props)) AS key, generate_subscripts(json_keys(props), 1) AS n FROM events) GROUP BY event_id''',
}

_NAMES = ORACLE_SQL["name_variants_dedup"]
ORACLE_SQL["export_nodes"] = f"""SELECT row_number() OVER (ORDER BY place_id, ord)::BIGINT AS node_id, place_id, v.name || ' (' || CASE WHEN regexp_matches(v.name, '[Ѐ-ӿ]') THEN {uk('p_type')} ELSE {kmu(uk('p_type'))} END || ')' AS name, 'shop' AS key, p_brand AS value
FROM ({_NAMES}) v JOIN part ON p_partkey = place_id"""

# The whole search: the same relations for the plans that stop earlier.
_FUZZY = f"""probe AS (SELECT w, substr(w, 1, greatest(3, length(w) - 2)) AS probe FROM st WHERE tot < 50 AND length(w) >= 6),
open AS MATERIALIZED (SELECT w AS a, word AS b, blob_bytes FROM probe JOIN vocab ON word LIKE '%' || probe || '%' ANTI JOIN kept ON kept.w = probe.w AND candidate = word),
{ratio('SELECT a, b FROM open WHERE abs(length(a) - length(b)) <= 3 AND NOT contains(b, a)', 'fr')},
fz AS MATERIALIZED (SELECT *, 1000 + row_number() OVER (PARTITION BY a ORDER BY b) AS ord FROM (SELECT a, b, blob_bytes, CASE WHEN starts_with(b, a) THEN 1.0 WHEN contains(b, a) THEN 0.9 ELSE coalesce(ratio, 0) END::DOUBLE AS score FROM open LEFT JOIN fr USING (a, b)) WHERE score >= 0.6)"""
_SEARCH = lambda lim: f"""WITH RECURSIVE {TERMS}, {VOCAB}, {asked(lim)}, {_FUZZY}"""
_TALLY = """cand AS (SELECT *, coalesce(sum(blob_bytes) OVER (PARTITION BY w ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
  SELECT w, candidate, 1.0::DOUBLE AS score, candidate = w AS ex, rn AS ord, blob_bytes FROM kept UNION ALL SELECT a, b, score, false, ord, blob_bytes FROM fz)),
refs AS MATERIALIZED (SELECT w, place_id, ord, CASE WHEN named THEN score ELSE score - 0.01 END AS score, ex AND named AS ex
  FROM cand JOIN st USING (w) JOIN pairs ON word = candidate WHERE before <= 20000 AND (tot <= 20000 OR named)),
best AS MATERIALIZED (SELECT w, place_id, arg_min(score, [-score, ord]) AS score, arg_min(ex, [-score, ord]) AS ex, min(ord) AS first FROM refs GROUP BY ALL),
tally AS MATERIALIZED (SELECT query_id, i, place_id, score, ex, first FROM qw JOIN best USING (w)),
seen AS (SELECT query_id, place_id, min(i * 1000000 + first) AS fv FROM tally GROUP BY ALL),
grid AS MATERIALIZED (SELECT s.query_id, s.place_id, fv, k, qw.i, qw.w, coalesce(score, 0.0) AS score, coalesce(ex, false) AS ex FROM seen s JOIN qw USING (query_id) LEFT JOIN tally t ON t.query_id = s.query_id AND t.place_id = s.place_id AND t.i = qw.i),
agg AS MATERIALIZED (SELECT query_id, place_id, fv, k, min(score) AS low, max(score) AS high, sum(score ORDER BY i) AS total, count_if(ex)::INT AS exact_count, list(score ORDER BY i) AS scores FROM grid GROUP BY ALL)"""
_COMPLETE = f"""nr AS (SELECT query_id, count_if(low >= threshold) AS nr FROM q LEFT JOIN agg USING (query_id) GROUP BY query_id),
part_ AS MATERIALIZED (SELECT * FROM (SELECT agg.*, threshold, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, fv, place_id) AS pn FROM agg JOIN q USING (query_id) JOIN nr USING (query_id) WHERE nr < lim AND low < threshold AND high >= threshold) WHERE pn <= 400),
todo AS MATERIALIZED (SELECT g.query_id, g.place_id, g.i, g.w FROM grid g JOIN part_ p USING (query_id, place_id) WHERE g.score < p.threshold),
hay AS MATERIALIZED (SELECT todo.*, word FROM todo JOIN pairs USING (place_id) WHERE word[1] = w[1]),
{ratio('SELECT DISTINCT w AS a, word AS b FROM hay WHERE abs(length(w) - length(word)) <= 3 AND NOT contains(word, w)', 'cr')},
again AS (SELECT query_id, place_id, i, max(CASE WHEN starts_with(word, w) THEN 1.0 WHEN contains(word, w) THEN 0.9 ELSE coalesce(ratio, 0) END::DOUBLE) AS score FROM hay LEFT JOIN cr ON a = w AND b = word GROUP BY ALL),
comp AS MATERIALIZED (SELECT query_id, place_id, p.pn, p.fv, p.k, p.exact_count, list(CASE WHEN g.score >= p.threshold THEN g.score ELSE coalesce(a.score, 0) END ORDER BY g.i) AS scores
  FROM part_ p JOIN grid g USING (query_id, place_id) LEFT JOIN again a USING (query_id, place_id, i) GROUP BY ALL HAVING min(CASE WHEN g.score >= p.threshold THEN g.score ELSE coalesce(a.score, 0) END) >= any_value(p.threshold))"""
_RANK = """allr AS (SELECT query_id, place_id, 0 AS pn, 0 AS stage, fv, k, exact_count, scores FROM agg JOIN q USING (query_id) WHERE low >= threshold
  UNION ALL SELECT query_id, place_id, pn, 1, fv, k, exact_count, scores FROM comp),
pf AS (SELECT * FROM (SELECT *, list_reduce(list_prepend(0.0::DOUBLE, scores), lambda x, y: x + y) / k AS score FROM allr) JOIN q USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, stage, pn, fv, place_id) <= lim * 10),
shown AS (SELECT place_id, CASE WHEN context <> '' THEN name || ' (' || context || ')' ELSE name END AS display, category, lon, lat FROM pl),
hits AS (SELECT *, starts_with(category, 'place=') OR starts_with(category, 'boundary=administrative') AS is_area, split_part(display, ' (', 1) AS name,
  sqrt((radians(lon - olon) * cos(radians((olat + lat) / 2))) ** 2 + radians(lat - olat) ** 2) * 6371000 AS metres FROM pf JOIN shown USING (place_id)),
fin AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact_count DESC, is_area DESC, score DESC, coalesce(metres, 0), name, place_id)::INT AS pos FROM hits) WHERE pos <= lim)"""

ORACLE_SQL |= {
    "fuzzy_resolve": f"{_SEARCH(20)} SELECT a AS word, b AS candidate, round(score, 6) AS score, ord::BIGINT AS ord FROM fz",
    "tally_scores": f"{_SEARCH(20)}, {_TALLY} SELECT query_id, i::INT AS i, place_id, round(score, 6) AS score, ex AS exact FROM tally",
    "classify_hits": f"{_SEARCH(20)}, {_TALLY} SELECT query_id, place_id, CASE WHEN low >= threshold THEN 'ranked' ELSE 'partial' END AS kind, round(low, 6) AS low, round(high, 6) AS high, exact_count FROM agg JOIN q USING (query_id) WHERE high >= threshold",
    "complete_partial": f"{_SEARCH(20)}, {_TALLY}, {_COMPLETE} SELECT query_id, place_id, pn::INT AS pn, round(list_sum(scores) / k, 6) AS score FROM comp",
    "rank_hits": f"{_SEARCH(3)}, {_TALLY}, {_COMPLETE}, {_RANK} SELECT query_id, pos, place_id, round(score, 6) AS score, exact_count, is_area FROM fin",
    "search_topk": f"""{_SEARCH(20)}, {_TALLY}, {_COMPLETE}, {_RANK}, asked AS (SELECT query_id, list(w ORDER BY i) AS ws FROM qw GROUP BY query_id)
SELECT query_id, pos, place_id, round(score, 6) AS score, exact_count, is_area, name,
CASE WHEN instr(display, ' (') > 0 THEN array_to_string(list_filter(list_transform(string_split(substr(display, instr(display, ' (') + 2, length(display) - instr(display, ' (') - 2), ','), lambda x: trim(x)), lambda x: x <> ''), '|') ELSE '' END AS address,
array_to_string(list_transform(list_zip(ws, scores), lambda z: z[1] || ':' || printf('%.3f', z[2])), ',') AS matched, round(metres, 3) AS metres FROM fin JOIN asked USING (query_id)""",
    "primary_related_split": f"""{_SEARCH(30)}, {_TALLY}, {_COMPLETE}, {_RANK}, lead_ AS (SELECT query_id, arg_min(exact_count, pos) > 0 AS lead FROM fin GROUP BY query_id)
SELECT query_id, pos, place_id, part FROM (SELECT query_id, pos, place_id, CASE WHEN NOT lead OR exact_count > 0 THEN 'primary' WHEN row_number() OVER (PARTITION BY query_id, exact_count > 0 ORDER BY pos) <= 30 THEN 'related' END AS part FROM fin JOIN lead_ USING (query_id)) WHERE part IS NOT NULL""",
}
