"""SQL of the numbered queries that SQL can express."""

from __future__ import annotations

from .url_reputation import LOWER, TWO_LABEL_SUFFIXES, UPPER

_two = "(" + ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES) + ")"


def _strength(table: str, n: str, k: str) -> str:
    """The prior's strength at one level; see url_reputation.concentration."""
    return f"""SELECT CASE WHEN j < 2 OR n <= j THEN 10.0 WHEN rho >= 1 THEN 10.0 WHEN rho <= 1.0 / 1001 THEN 1000.0 ELSE greatest(1.0, 1 / rho - 1)
        END AS s FROM (SELECT *, CASE WHEN j < 2 OR n <= j THEN 0 WHEN b + (z - 1) * w > 0 THEN (b - w) / (b + (z - 1) * w) ELSE 0 END AS rho FROM (
        SELECT j, n, CASE WHEN j > 1 THEN (kk - n * (k / n) * (k / n)) / (j - 1) END AS b, CASE WHEN n > j THEN (k - kk) / (n - j) END AS w, CASE WHEN
        j > 1 THEN (n - nn / n) / (j - 1) END AS z FROM (
        SELECT count(*) AS j, CAST(sum({n}) AS DOUBLE) AS n, CAST(sum({k}) AS DOUBLE) AS k, sum(CAST({n} AS DOUBLE) * {n}) AS nn, sum(CAST({k} AS
        DOUBLE) * {k} / {n}) AS kk FROM {table} WHERE {n} > 0)))"""


OP1 = f"""WITH rest AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS r FROM
        pages),
    parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
        FROM rest),
    outcomes AS (SELECT doc_id AS page_id, quality = 1 AND coalesce(toxic, 0) = 0 AS good FROM labels),
    known AS (SELECT page_id, count(*) AS n, sum(CAST(good AS BIGINT)) AS k FROM outcomes WHERE page_id IS NOT NULL AND good IS NOT NULL GROUP BY
        page_id),
    counted AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(k), 0) AS k FROM parts LEFT JOIN known USING (page_id) GROUP BY host),
    cut AS (SELECT *, string_split(host, '.') AS l, regexp_matches(host, '^[0-9.]+$') AS ip FROM counted),
    two AS (SELECT *, array_to_string(l[greatest(len(l) - 1, 1):], '.') AS t FROM cut),
    hosts AS (SELECT host, n, k, CASE WHEN ip THEN host WHEN t IN {_two} THEN array_to_string(l[greatest(len(l) - 2, 1):], '.') ELSE t END AS domain,
        CASE WHEN ip THEN '' WHEN t IN {_two} THEN t ELSE l[len(l)] END AS suffix FROM two),
    domains AS (SELECT domain, suffix, sum(n) AS dn, sum(k) AS dk FROM hosts GROUP BY domain, suffix), tops AS (SELECT suffix, sum(dn) AS sn, sum(dk)
        AS sk FROM domains GROUP BY suffix),
    s0 AS ({_strength('tops', 'sn', 'sk')}), s1 AS ({_strength('domains', 'dn', 'dk')}), s2 AS ({_strength('hosts', 'n', 'k')}),
    base AS (SELECT CASE WHEN sum(sn) > 0 THEN CAST(sum(sk) AS DOUBLE) / sum(sn) ELSE 0.5 END AS r FROM tops),
    priors AS (SELECT domain, dn, dk, (sk - dk + s0.s * base.r) / (sn - dn + s0.s) AS r FROM domains JOIN tops USING (suffix), s0, base),
    rates AS (SELECT host, n, (k + s2.s * (dk - k + s1.s * d.r) / (dn - n + s1.s)) / (n + s2.s) AS rate, n + s2.s AS size FROM hosts JOIN priors d
        USING (domain), s1, s2),
    bounds AS (SELECT host, n AS n_labelled, rate - 1.645 * sqrt(rate * (1 - rate) / (size + 1)) AS lower FROM rates),
    judged AS (SELECT page_id, host, path, CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN
        'example.net/en/' WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR suffix(host, '.net')) AND
        starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN lower >=
        0.5 THEN 'allow' ELSE 'block' END AS verdict, n_labelled, round(lower, 6) AS lower FROM judged JOIN bounds USING (host)"""

OP5 = """WITH q AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT query_id, rank, vec_id, score FROM (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) AS rank
    FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5"""

OP6 = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS k
        FROM documents),
    shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(k) < 2 THEN k ELSE list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])
        END) AS s FROM words),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM pairs JOIN sizes m ON m.doc_id = x JOIN sizes n ON n.doc_id = y WHERE 100 * c >= 80 * (m.n + n.n - c)),
    sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach AS (SELECT DISTINCT doc_id AS d, doc_id AS r FROM documents UNION SELECT s.y, reach.r FROM reach JOIN sides s ON s.x = reach.d),
    least AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
    SELECT t.doc_id, coalesce(z.n, 0) AS n_shingles, l.component_id, t.doc_id = l.component_id AS kept FROM documents t JOIN least l ON l.d = t.doc_id
        LEFT JOIN sizes z ON z.doc_id = t.doc_id"""

OP11 = f"""WITH d AS (SELECT row_number() OVER () AS r, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t, coalesce(lang, '') AS lang,
        coalesce(source, '') AS source FROM documents),
    w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
    found AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
    sizes AS (SELECT lang, source, sum(c) AS n FROM found GROUP BY lang, source), known AS (SELECT DISTINCT lang, source FROM d),
    langs AS (SELECT lang, sum(total) AS lang_n, count(*) AS v FROM kept GROUP BY lang),
    cells AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 5) // (coalesce(n, 0) + 5 * v) AS p,
        1 + CAST(1000000000 AS HUGEINT) * (total + 5) // (lang_n + 5 * v) AS q
        FROM known JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN sizes USING (lang, source) LEFT JOIN found USING (lang, source, term)),
    apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM cells a JOIN cells b USING (lang, term) GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM known a JOIN known b ON a.lang = b.lang AND
        a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
    both_parts AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM cells WHERE c > 0 AND p > q),
    ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC,
        item) AS rank FROM both_parts)
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50"""


def op12(k: int, rounds: int) -> str:
    """A round is an assignment and a mean; floor division is by the remainder, as // rounds towards zero."""
    squares = "list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = f"(SELECT vec_id, row, v, number, distance FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY distance, number) AS place FROM (SELECT vec_id, row, v, number, {squares} AS distance FROM kept, c{{}})) WHERE place = 1)"
    parts = ["""kept AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS number, v AS m FROM kept ORDER BY number LIMIT {k})"]
    for r in range(rounds):
        parts.append(f"""a{r} AS MATERIALIZED {near.format(r)}""")
        parts.append(f"""s{r} AS (SELECT number, i, sum(x) AS total, count(*) AS n FROM (SELECT number, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY number, i)""")
        parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.number, coalesce(any_value(moved.m), any_value(c{r}.m)) AS m FROM c{r} LEFT JOIN (SELECT number, list(CAST((total -
            ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{r} GROUP BY number) moved USING (number) GROUP BY c{r}.number)""")
    parts.append(f"last AS MATERIALIZED {near.format(rounds)}")
    parts.append("spread AS (SELECT number, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM last GROUP BY number)")
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(number AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, cluster_inertia, (SELECT CAST(sum(cluster_inertia)
        AS BIGINT) FROM spread) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM last JOIN spread USING (number) JOIN c{rounds} USING (number)"""
