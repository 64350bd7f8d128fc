"""DuckDB SQL for the queries that SQL can express."""

from turnstile.llm import quality as q
from turnstile.llm import secrets

#: Words, symbols, lines and repeated windows of the base rules; then the estimate, with the text that Spark runs too.
_BASE = r"""
WITH worded AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lined AS (
  SELECT rid, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM worded),
places AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM worded WHERE len(w) >= 3)),
seen AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM places),
covered AS (
  SELECT rid, sum(step) AS r
  FROM (SELECT rid, least(3, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 3)) AS step FROM seen WHERE c > 1)
  GROUP BY rid),
stats AS MATERIALIZED (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM (
    SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
           CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words,
           CAST(len(ls) AS BIGINT) AS n_lines
    FROM worded JOIN lined USING (rid) LEFT JOIN covered USING (rid)))
"""


def _quality() -> str:
    ctes = [
        ("vectors", q.vectors_sql("stats")),
        ("sizes", q.sizes_sql("vectors")),
        ("grouped", q.grouped_sql("vectors", "sizes")),
        ("hist", q.histogram_sql("grouped")),
        ("mid", q.middle_sql("hist")),
        ("away", q.away_sql("hist", "mid")),
        ("mad", q.middle_sql("away")),
        ("scatter0", q.start_sql("mid", "mad")),
    ]
    for k in range(q.STEPS):
        ctes += [(f"factor{k}", q.factor_sql(f"scatter{k}")), (f"scatter{k + 1}", q.step_sql("grouped", f"factor{k}"))]
    ctes += [("last", q.factor_sql(f"scatter{q.STEPS}")), ("params", q.enough_sql("grouped", "last"))]
    far = q.distance_sql(f"(SELECT s.rid, {', '.join(f'{e} AS {n}' for n, e in q.VECTOR.items())}, p.* FROM stats s JOIN sizes z ON z.gl = {q.LANG} AND z.gs0 = {q.SOURCE} JOIN params p ON p.gl = z.gl AND p.gs = z.gs WHERE NOT base_failed)", "rid")
    return (
        _BASE + "".join(f", {name} AS MATERIALIZED ({sql})" for name, sql in ctes)
        + f""", far AS ({far})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2 <= {q.CUTOFF}, true) AS kept
FROM stats LEFT JOIN far USING (rid)"""
    )


QUALITY = _quality()


#: Rules and their propagation along canonical links and refreshes, by a recursive walk over the links.
URLS = r"""
WITH RECURSIVE u AS (
  SELECT row_number() OVER () AS rid, page_id, html,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS rest
  FROM pages),
rules(v, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
own AS (
  SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid),
node AS (SELECT u.rid, host || rest AS n, v FROM u LEFT JOIN own USING (rid) WHERE host != ''),
target AS (
  SELECT rid, replace(unnest([
    regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1),
    regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["'']?\s*[0-9.]*\s*;?\s*url\s*=\s*["'']?([^"''\s>]+)', 1)]), '&amp;', '&') AS t
  FROM u),
edge AS (
  SELECT DISTINCT n AS a, lower(regexp_extract(t, '://([^/?#]*)', 1)) || regexp_extract(t, '://[^/?#]*([^#]*)', 1) AS b
  FROM target JOIN node USING (rid) WHERE regexp_matches(t, '(?i)^https?://')),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
spread AS (SELECT a AS n, min(v) AS s FROM reach JOIN node ON node.n = b WHERE v IS NOT NULL GROUP BY a)
SELECT page_id, host, path, rule, coalesce(own.v, s, 'allow') AS verdict
FROM u LEFT JOIN own USING (rid) LEFT JOIN node USING (rid) LEFT JOIN spread USING (n)
"""

#: Base32 of the SHA-1 by way of its bits.
ARCHIVES = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS d FROM pages),
g AS (SELECT d, max(page_id) AS top FROM p GROUP BY d),
digit AS (
  SELECT d, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(substr(bits, 5 * k + 1, 5)::BIT::INT AS INT), 1), '' ORDER BY k) AS b32
  FROM (SELECT d, unnest(range(0, 32)) AS k, list_aggregate(list_transform(range(1, 21), lambda i: right(CAST(CAST(('0x' || substr(d, 2 * i - 1, 2))::INT AS BIT) AS VARCHAR), 8)), 'string_agg', '') AS bits FROM g)
  GROUP BY d)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p JOIN g USING (d) JOIN digit USING (d)
"""


def _secrets() -> str:
    """Places as running sums over the lengths between and of the matches, like the query, but by unnesting."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT rid, {k} AS number, unnest(string_split_regex(t, {quoted(r.pattern)})) AS gap, unnest(regexp_extract_all(t, {quoted(r.pattern)}, 0)) AS m, "
        f"unnest(regexp_extract_all(t, {quoted(r.pattern)}, {r.group})) AS part, generate_subscripts(string_split_regex(t, {quoted(r.pattern)}), 1) AS i, {r.least} AS least "
        f"FROM d WHERE regexp_matches(t, {quoted(r.pattern)})"
        for k, r in enumerate(secrets.RULES)
    )
    names = ", ".join(quoted(r.kind) for r in secrets.RULES)
    base = len(secrets.BASE)
    counts = ", ".join(f"count(*) FILTER (number = {k}) AS n_{secrets.RULES[k].kind}" for k in range(base))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
placed AS (
  SELECT rid, number, m, part, least, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY rid, number ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM found WINDOW w AS (PARTITION BY rid, number ORDER BY i)),
span AS (
  SELECT rid, number, CAST(s AS BIGINT) AS s, [{names}][number + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT) AS txt
  FROM placed WHERE m IS NOT NULL AND length(part) >= least)
SELECT doc_id, {', '.join(f'coalesce(n_{secrets.RULES[k].kind}, 0) AS n_{secrets.RULES[k].kind}' for k in range(base))}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN (
  SELECT rid, {counts}, string_agg(txt, ',' ORDER BY s, number) FILTER (number < {base}) AS b, string_agg(txt, ',' ORDER BY s, number) AS a
  FROM span GROUP BY rid) g USING (rid)"""


SECRETS = _secrets()


def _edit(state: str, cost: str, mark: str, line: str | None = None) -> str:
    """A path's struct after one more edit; `line` is the repaired row it adds, put behind earlier ones unless there are none."""
    text = f"{state}.o" if line is None else line if state in ("s0", "t0") else f"{state}.o || chr(10) || {line}"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{mark}', 'o': {text}}}"


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _unless(condition: str, option: str) -> str:
    return f"CASE WHEN {condition} THEN NULL ELSE {option} END"


def _repairs() -> str:
    """Least path to each state of the role pattern, row by row; cost, audit and repaired text go along."""
    delete = lambda s: _edit(s, "2", "D")
    keep = lambda s, letter: _unless(f"must OR initial <> '{letter}'", _edit(s, "extra", "K", "role || ':' || text"))
    rerole = lambda s, role: _unless("must", _edit(s, "1 + extra", "R", f"'{role}:' || text"))
    read = {
        "t0": delete("s0"), "t1": _least(delete("s1"), keep("s0", "s")),
        "t2": _least(delete("s2"), *[f(s, x) for s in ("s0", "s1", "s3") for f, x in ((keep, "u"), (rerole, "user"))]),
        "t3": _least(delete("s3"), keep("s2", "a"), rerole("s2", "assistant")),
    }
    user = lambda s: _edit(s, "5", "I", "'user:'")
    pair = lambda s: _edit(s, "10", "II", "'user:' || chr(10) || 'assistant:'")
    inserted = {"s0": "t0", "s1": "t1", "s2": _least("t2", user("t0"), user("t1"), user("t3")), "s3": _least("t3", _edit("t2", "5", "I", "'assistant:'"), pair("t0"), pair("t1"))}
    none = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': ''}"
    start = {"s0": "{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}", "s1": none, "s2": "{'c': CAST(5 AS BIGINT), 'a': 'I', 'o': 'user:'}", "s3": "{'c': CAST(10 AS BIGINT), 'a': 'II', 'o': 'user:' || chr(10) || 'assistant:'}"}
    listed = lambda named: ", ".join(f"{v} AS {k}" for k, v in named.items())
    return rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS crcs
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM (SELECT unnest(range(256)) AS i))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crcs,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS bytes
  FROM conversations, crc_table),
dealt AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt WHERE kind <> 0),
numbered AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending
  FROM damaged),
judged AS (
  SELECT *, CASE WHEN ending = '' THEN 1 WHEN seen > 1 THEN 2 WHEN ending NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM numbered),
ordered AS (SELECT conv_id, i, role, text, initial, fault IN (1, 2) AS must, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS extra FROM judged),
paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n_read, {listed(start)} FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n_read, {listed(inserted)}
  FROM (SELECT r.conv_id, r.i AS n_read, {listed(read)} FROM paths JOIN ordered r ON r.conv_id IS NOT DISTINCT FROM paths.conv_id AND r.i = paths.n_read + 1)),
ends AS (
  SELECT conv_id, {_least("s0", "s3")} AS best FROM paths QUALIFY n_read = max(n_read) OVER (PARTITION BY conv_id)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(best.o) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


CONVERSATIONS = _repairs()

#: Phrases by listing every n-gram; a candidate is dropped if any longer phrase around it is as frequent.
COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents)),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
grams AS (SELECT lang, w, len(w) AS size, unnest(range(1, len(w) + 1)) AS i FROM worded),
f AS MATERIALIZED (
  SELECT lang, phrase, CAST(count(*) AS BIGINT) AS f
  FROM (SELECT lang, list_slice(w, i, i + m - 1) AS phrase FROM grams, range(1, 6) lengths(m) WHERE i + m - 1 <= size)
  GROUP BY lang, phrase),
candidates AS MATERIALIZED (SELECT lang, phrase, f AS a, len(phrase) AS m FROM f WHERE f >= 100 AND len(phrase) >= 2),
inner_ones AS (
  SELECT DISTINCT lang, phrase
  FROM (SELECT c.lang, c.a, list_slice(c.phrase, i, i + k - 1) AS phrase FROM candidates c, range(1, 6) starts(i), range(2, 5) sizes(k) WHERE k < c.m AND i + k - 1 <= c.m) longer
  JOIN candidates s USING (lang, phrase) WHERE 100 * longer.a >= 100 * s.a),
cuts AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, n, k,
         CAST((1000 * CAST(c.a AS HUGEINT) * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN f l ON l.lang = c.lang AND l.phrase = list_slice(c.phrase, 1, k)
  JOIN f r ON r.lang = c.lang AND r.phrase = list_slice(c.phrase, k + 1, m)
  JOIN totals t ON t.lang = c.lang
  ANTI JOIN inner_ones i ON i.lang = c.lang AND i.phrase = c.phrase),
best AS (
  SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, cuts.phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""
