"""Independent SQL for the corpus queries that SQL can express."""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_SHINGLES = f"""
w AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END AS ss
    FROM w WHERE len(ws) > 0) t, unnest(ss) AS u(s)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id)"""

_LINKS = """
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach(id, far) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.far),
comp AS (SELECT id, min(far) AS component_id FROM reach GROUP BY id)"""



def _inverse_of(name: str, source: str, keys: str) -> str:
    """From means and covariances c_ij to the inverse p_ij and the determinant, by Cholesky factors."""
    x, pairs = range(4), [(i, j) for i in range(4) for j in range(i, 4)]
    low = []
    for i in x:
        for j in range(i + 1):
            rest = f"c{j}{i}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            low.append(f"sqrt({rest}) AS l{i}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    for i in x:
        for j in range(i + 1):
            low.append(f"1 / l{i}{i} AS w{i}{j}" if i == j else "(0" + "".join(f" - l{i}{k} * w{k}{j}" for k in range(j, i)) + f") / l{i}{i} AS w{i}{j}")
    inv = ", ".join(" + ".join(f"w{k}{i} * w{k}{j}" for k in range(j, 4)) + f" AS p{i}{j}" for i, j in pairs)
    return f"""
{name}_l AS MATERIALIZED (SELECT *, {", ".join(low)} FROM {source}),
{name} AS MATERIALIZED (SELECT {keys}, m0, m1, m2, m3, {inv}, power(l00 * l11 * l22 * l33, 2) AS det FROM {name}_l)"""


def _outliers(steps: int = 16) -> str:
    """The whole outlier rule: statistics, pools, three starts, concentration steps while the determinant falls, reweighting, distances."""
    x, pairs = range(4), [(i, j) for i in range(4) for j in range(i, 4)]
    sql = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, lang, source FROM documents),
wd AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls, text FROM d),
tr AS (SELECT rid, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) AS t, unnest(range(1, len(ws) - 1)) AS p FROM wd WHERE len(ws) > 2),
again AS (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nx FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, t) AS c FROM tr) WHERE c > 1),
rp AS (SELECT rid, sum(least(3, coalesce(nx - p, 3)))::BIGINT AS n_repeat_words FROM again GROUP BY rid),
st AS (SELECT d.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d JOIN wd USING (rid) LEFT JOIN rp USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce('=' || lang, '-') AS gl, coalesce('=' || lang, '-') || chr(31) || coalesce('=' || source, '-') AS gf FROM st),
x AS MATERIALIZED (SELECT *, CASE WHEN NOT base_failed THEN ln(word_chars / n_words) END AS x0, CASE WHEN NOT base_failed THEN sqrt((n_symbols + 0.375::DOUBLE) / n_words) END AS x1,
  CASE WHEN NOT base_failed THEN asin(sqrt(least((n_dup_lines + 0.375::DOUBLE) / (greatest(n_lines, 1) + 0.75::DOUBLE), 1.0))) END AS x2, CASE WHEN NOT base_failed THEN asin(sqrt(least((n_repeat_words / 6 + 0.375::DOUBLE) / (n_words / 6 + 0.75::DOUBLE), 1.0))) END AS x3,
  CASE WHEN NOT base_failed THEN 1 / word_chars END AS v0, CASE WHEN NOT base_failed THEN 1 / (4 * n_words) END AS v1, CASE WHEN NOT base_failed THEN 1 / (4 * greatest(n_lines, 1) + 2) END AS v2, CASE WHEN NOT base_failed THEN 1 / (4 * (n_words / 6) + 2) END AS v3 FROM f),
sz AS (SELECT gf, any_value(gl) AS gl, count(*) AS size FROM x WHERE NOT base_failed GROUP BY gf),
pl AS (SELECT gl, sum(size) AS pool FROM sz WHERE size < 10 GROUP BY gl),
nm AS (SELECT gf, CASE WHEN size >= 10 THEN gf WHEN pool >= 10 THEN gl || chr(31) || '*' ELSE '*' END AS g FROM sz LEFT JOIN pl USING (gl)),
r AS MATERIALIZED (SELECT x.*, g FROM x LEFT JOIN nm USING (gf)),
fit AS MATERIALIZED (SELECT * FROM r WHERE NOT base_failed),
rg AS MATERIALIZED (SELECT g, avg(v0) AS r0, avg(v1) AS r1, avg(v2) AS r2, avg(v3) AS r3 FROM fit GROUP BY g),
md AS (SELECT g, k, bin, coalesce(sum(n) OVER (PARTITION BY g, k ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY g, k) AS all_
  FROM (SELECT g, k, bin, count(*) AS n FROM (SELECT g, unnest([0, 1, 2, 3]) AS k, unnest([floor(x0 * 200), floor(x1 * 200), floor(x2 * 200), floor(x3 * 200)]) AS bin FROM fit) GROUP BY ALL)),
qu AS (SELECT g, k, max(CASE WHEN before < all_ * 0.25 THEN bin END) AS b0, max(CASE WHEN before < all_ * 0.5 THEN bin END) AS b1, max(CASE WHEN before < all_ * 0.75 THEN bin END) AS b2 FROM md GROUP BY ALL),
"""
    sql += f"""mid AS MATERIALIZED (SELECT g, {", ".join(f"max(CASE WHEN k = {i} THEN (b1 + 0.5) / 200 END)::DOUBLE AS m{i}, greatest(sqrt(max(r{i})), max(CASE WHEN k = {i} THEN b2 - b0 END) / (200 * 1.349::DOUBLE)) AS d{i}, max(r{i}) AS r{i}" for i in x)} FROM qu JOIN rg USING (g) GROUP BY g),
z AS (SELECT g, {", ".join(f"(x{i} - m{i}) / d{i} AS z{i}" for i in x)} FROM fit JOIN mid USING (g)),
u AS (SELECT g, {", ".join(f"avg(CASE WHEN z0 * z0 + z1 * z1 + z2 * z2 + z3 * z3 > 0 THEN z{i} * z{j} / (z0 * z0 + z1 * z1 + z2 * z2 + z3 * z3) ELSE 0 END) AS u{i}{j}" for i, j in pairs)} FROM z GROUP BY g),
sg AS (SELECT g, m0, m1, m2, m3, {", ".join(f"4 * u{i}{j} * d{i} * d{j} + {f'r{i}' if i == j else '0'} AS c{i}{j}" for i, j in pairs)} FROM mid JOIN u USING (g)),{_inverse_of("sgn", "sg", "g")},
e0 AS MATERIALIZED (
  SELECT g, 1 AS s, m0, m1, m2, m3, {", ".join(f"{f'1 / r{i}' if i == j else '0.0::DOUBLE'} AS p{i}{j}" for i, j in pairs)}, 'inf'::DOUBLE AS det FROM mid
  UNION ALL SELECT g, 2, m0, m1, m2, m3, {", ".join(f"{f'1 / (d{i} * d{i})' if i == j else '0.0'}" for i, j in pairs)}, 'inf'::DOUBLE FROM mid
  UNION ALL SELECT g, 3, m0, m1, m2, m3, {", ".join(f"p{i}{j}" for i, j in pairs)}, 'inf'::DOUBLE FROM sgn)"""
    dist = "greatest(" + " + ".join(f"(x{i} - m{i}) * (x{j} - m{j}) * p{i}{j} * {1 if i == j else 2}" for i, j in pairs) + ", 0)"
    sums = ", ".join([f"sum(x{i} - m{i}) AS s{i}" for i in x] + [f"sum((x{i} - m{i}) * (x{j} - m{j})) AS q{i}{j}" for i, j in pairs] + [f"any_value(m{i}) AS m{i}" for i in x])
    tot = ", ".join([f"sum(s{i}) AS s{i}" for i in x] + [f"sum(q{i}{j}) AS q{i}{j}" for i, j in pairs] + [f"any_value(m{i}) AS o{i}" for i in x])
    cov = lambda factor: ", ".join([f"o{i} + s{i} / n AS m{i}" for i in x] + [f"(q{i}{j} / n - s{i} / n * (s{j} / n)) * {factor}::DOUBLE + {f'r{i}' if i == j else '0'} AS c{i}{j}" for i, j in pairs])
    every = [f"m{i}" for i in x] + [f"p{i}{j}" for i, j in pairs] + ["det"]
    for k in range(steps):
        sql += f""",
b{k} AS (SELECT g, s, floor(ln({dist} + 1e-6) * 64) AS bin, count(*) AS n, {sums} FROM fit JOIN e{k} USING (g) GROUP BY ALL),
k{k} AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY g, s ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY g, s) AS all_ FROM b{k}),
t{k} AS (SELECT g, s, sum(n)::DOUBLE AS n, {tot} FROM k{k} WHERE before < ceil(all_ * 0.75) GROUP BY g, s),
c{k} AS (SELECT g, s, {cov("1.486")} FROM t{k} JOIN rg USING (g)),{_inverse_of(f"v{k}", f"c{k}", "g, s")},
e{k + 1} AS MATERIALIZED (SELECT e.g, e.s, {", ".join(f"CASE WHEN v.det < e.det * (1 - 1e-4::DOUBLE) THEN v.{c} ELSE e.{c} END AS {c}" for c in every)} FROM e{k} e JOIN v{k} v ON v.g = e.g AND v.s = e.s)"""
    sql += f""",
best AS (SELECT * FROM e{steps} QUALIFY row_number() OVER (PARTITION BY g ORDER BY det, s) = 1),
tw AS (SELECT g, count(*)::DOUBLE AS n, {tot.replace("sum(s", "sum(a").replace("sum(q", "sum(b")} FROM (SELECT g, m0, m1, m2, m3, {", ".join([f"x{i} - m{i} AS a{i}" for i in x] + [f"(x{i} - m{i}) * (x{j} - m{j}) AS b{i}{j}" for i, j in pairs])} FROM fit JOIN best USING (g) WHERE {dist} <= 11.143) GROUP BY g),
cw AS (SELECT g, {cov("1.0645")} FROM tw JOIN rg USING (g)),{_inverse_of("ew", "cw", "g")}"""
    return sql + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(CASE WHEN NOT base_failed THEN {dist} END, 6) AS distance2,
coalesce(NOT base_failed AND {dist} <= 23.51, false) AS kept FROM r LEFT JOIN ew USING (g)"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda j:
  substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', substr(hex, j, 1)) - 3, 4)), '') AS b FROM p),
d AS (SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda j: substr(b, 5 * i + j, 1)::INT * (1 << (5 - j))))::INT, 1)), '') AS payload_digest FROM bits),
m AS (SELECT hex, max(page_id) AS best FROM d GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM d JOIN m USING (hex)"""

_PHRASES = rf"""
WITH pc AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pc),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i+k-1], ' '))) AS phrase FROM w, range(1, 4) r(k) WHERE len(ws) >= k) t GROUP BY ALL),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 10),
cut AS (SELECT lang, k, phrase, f AS a, j, array_to_string(ws[1:j], ' ') AS first, array_to_string(ws[j+1:k], ' ') AS rest FROM c, range(1, 3) r(j) WHERE j < k),
s AS (SELECT cut.*, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f * y.f) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.first JOIN f y ON y.lang = cut.lang AND y.phrase = cut.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
sub AS (SELECT lang, phrase, max(f) AS most FROM (SELECT lang, f, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN sub USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""

_RESAMPLE = rf"""
WITH tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
dw AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
du AS MATERIALIZED (SELECT rid, unnest(ws) AS w FROM dw),
bu AS MATERIALIZED (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
words AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM du UNION SELECT w FROM bu)),
bk AS MATERIALIZED (SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM words, tab),
s AS (SELECT b, count(*) AS s FROM du JOIN bk USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bu JOIN bk USING (w) GROUP BY b),
g AS MATERIALIZED (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM du) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bu) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (b)),
x AS (SELECT rid, sum(gain)::BIGINT AS weight FROM du JOIN bk USING (w) JOIN g USING (b) GROUP BY rid),
y AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM dw LEFT JOIN x USING (rid)),
z AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM r"""

ORACLE_SQL: dict[str, str] = {
    "op11_warc_source": _WARC,
    "op12_phrase_mining": _PHRASES,
    "op13_importance_resampling": _RESAMPLE,
    "op1_robust_outliers": _outliers(),
    "op3_minhash_near_dedup": f"""
WITH RECURSIVE {_SHINGLES}, {_LINKS}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp c ON c.id = d.doc_id""",
    "op5_decontamination": f"""
WITH {_SHINGLES},
bw AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
bs AS (
  SELECT DISTINCT item_id, s FROM (
    SELECT item_id, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) AS ss FROM bw WHERE len(ws) >= 5) t, unnest(ss) AS u(s)
  UNION
  SELECT item_id, array_to_string(ws, ' ') FROM bw WHERE len(ws) BETWEEN 1 AND 4),
size AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
short AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i+k-1], ' ')) AS ss
    FROM w, range(1, 5) r(k) WHERE len(ws) >= k AND EXISTS (SELECT 1 FROM bw WHERE len(bw.ws) = k)) t, unnest(ss) AS u(s)),
hits AS (
  SELECT doc_id, item_id, count(*) AS m FROM (SELECT * FROM sh UNION SELECT * FROM short) x JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, size.n::BIGINT AS item_shingles, m::BIGINT AS shared_shingles, m / size.n AS containment
FROM hits JOIN size USING (item_id) WHERE 100 * m >= 75 * size.n""",
    "op2_html_text": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(p|h1)>'), lambda x:
  trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t""",
}
