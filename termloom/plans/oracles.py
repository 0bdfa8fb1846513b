"""The queries of the catalogue in SQL, over the given tables: common parts and one statement each."""

from __future__ import annotations

import re

from ..operators.associate import HEAD, TAIL
from ..operators.gate import BINARY, KEEP_WORDS, MISSABLE, NUMERIC, OTHER
from .fixtures import SECTIONS

ROOT = "HP:0000118"
#: The ridge of the gate's fit, as gate.gate_train has it, and how many Newton steps the SQL takes.
RIDGE, STEPS = 1e-6, 12


def hp(n: str) -> str:
    return f"'HP:' || lpad(CAST({n} AS VARCHAR), 7, '0')"


def bounded(words: str) -> str:
    r"""A pattern with Unicode word borders, which DuckDB's \b hasn't."""
    return words.replace(r"\b(", r"(?:^|[^\p{L}\p{N}_])(?:").replace(r")\b", r")(?:$|[^\p{L}\p{N}_])")


def joined(a: int, b: int) -> str:
    """Tokens a to b (from 0, end excluded) of a list k, in one phrase."""
    return f"array_to_string(k[{a + 1}:{b}], ' ')"


def ids(c: str, real: bool = False) -> str:
    """The parts of an identifier, as a list."""
    return f"list_filter(list_transform(string_split({c}, ';'), lambda x: trim(x)), lambda x: x <> ''{' AND x <> $$-1$$' if real else ''})"


def near(mentions: str, max_dist: int | None = None) -> str:
    """(pmc_id, ent_idx, identifier, roster_idx, dist) of the nearest patient of each mention."""
    ranked = f"""SELECT m.pmc_id, m.ent_idx, m.identifier, a.roster_idx, abs(m."offset" - a.anchor) AS dist,
        row_number() OVER (PARTITION BY m.pmc_id, m.ent_idx ORDER BY abs(m."offset" - a.anchor), a.roster_idx) AS r
        FROM {mentions} m LEFT JOIN fx_anchor a ON a.pmc_id = m.pmc_id AND a.anchor IS NOT NULL"""
    who = "coalesce(roster_idx, 0)" if max_dist is None else f"CASE WHEN dist <= {max_dist} THEN roster_idx END"
    return f"SELECT n.pmc_id, n.ent_idx, n.identifier, p.patient_id FROM (SELECT *, {who} AS who FROM ({ranked}) WHERE r = 1) n JOIN fx_patients p ON p.pmc_id = n.pmc_id AND p.roster_idx = n.who"


def roster(assigned: str) -> str:
    return f"SELECT p.pmc_id, p.patient_id, x.identifier FROM fx_patients p LEFT JOIN (SELECT DISTINCT pmc_id, patient_id, identifier FROM ({assigned}) WHERE identifier IS NOT NULL) x ON x.pmc_id = p.pmc_id AND x.patient_id = p.patient_id"


def tokens(association: str) -> str:
    return f"SELECT DISTINCT pmc_id, patient_id, unnest({ids('identifier')}) AS token FROM {association} WHERE identifier IS NOT NULL"


def counts(gold: str, pred: str, keys: str, by: str = "") -> str:
    """tp, fp, fn of two sets of rows."""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {by + ',' if by else ''} coalesce(sum(CASE WHEN s = 3 THEN 1 ELSE 0 END), 0) AS tp, coalesce(sum(CASE WHEN s = 2 THEN 1 ELSE 0
        END), 0) AS fp, coalesce(sum(CASE WHEN s = 1 THEN 1 ELSE 0 END), 0) AS fn
        FROM (SELECT {keys}, sum(g) AS s FROM (SELECT DISTINCT {keys}, 1 AS g FROM ({gold}) UNION ALL SELECT DISTINCT {keys}, 2 AS g FROM ({pred}))
        GROUP BY {keys}) {group}"""


P = "CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END"
R = "CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END"
F1 = "CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END"
PRF = f"round({P}, 6) AS precision, round({R}, 6) AS recall, round({F1}, 6) AS f1"


def units(mentions: str, keys: str) -> str:
    return f"SELECT DISTINCT {keys}, unnest({ids('identifier')}) AS token FROM {mentions} WHERE note IS DISTINCT FROM 'NO'"


def people(gold: str, pred: str, by: str = "") -> str:
    """Scores of each gold patient."""
    b = by + ", " if by else ""
    both = f"SELECT {b} pmc_id, patient_id, token, sum(g) AS s FROM (SELECT DISTINCT {b} pmc_id, patient_id, unnest({ids('identifier')}) AS token, 1 AS g FROM {gold} WHERE identifier IS NOT NULL UNION ALL SELECT DISTINCT {b} pmc_id, patient_id, unnest({ids('identifier')}) AS token, 2 AS g FROM {pred} WHERE identifier IS NOT NULL) GROUP BY {b} pmc_id, patient_id, token"
    on = "".join(f" AND c.{k} = p.{k}" for k in [*([by] if by else []), "patient_id"])
    own = f"p.{by}, " if by else ""
    return f"""SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE {P} END AS p, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE {R} END AS r, CASE WHEN tp +
        fp + fn = 0 THEN 1.0 ELSE {F1} END AS f FROM (
        SELECT {own} p.pmc_id, p.patient_id, coalesce(sum(CASE WHEN s = 3 THEN 1 END), 0) AS tp, coalesce(sum(CASE WHEN s = 2 THEN 1 END), 0) AS fp,
        coalesce(sum(CASE WHEN s = 1 THEN 1 END), 0) AS fn
        FROM (SELECT DISTINCT {b} pmc_id, patient_id FROM {gold}) p LEFT JOIN ({both}) c ON c.pmc_id = p.pmc_id{on} GROUP BY ALL)"""


def collapsed(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def prompt(roster_line: str, mention_line: str, text: str = "") -> str:
    lines = ["$head$", text, "'Individuals:'", "r.lines", "'Phenotype mentions:'", "m.lines", "$tail$"]
    joined = " || chr(10) || ".join(x for x in lines if x).replace("$head$", f"'{HEAD}'").replace("$tail$", f"'{TAIL}'")
    return f"""SELECT r.pmc_id, {joined} AS prompt FROM (SELECT pmc_id, string_agg({roster_line}, chr(10) ORDER BY roster_idx) AS lines FROM fx_roster
        GROUP BY pmc_id) r
        JOIN (SELECT pmc_id, string_agg({mention_line}, chr(10) ORDER BY ent_idx) AS lines FROM fx_prompted GROUP BY pmc_id) m ON m.pmc_id = r.pmc_id
        JOIN fx_texts x ON x.pmc_id = r.pmc_id"""


_state = "".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, " for c in NUMERIC)
_scaled = [f"(coalesce(CAST({c} AS DOUBLE), coalesce(m_{c}, 0.0)) - coalesce(m_{c}, 0.0)) / d_{c}" for c in NUMERIC]
_values = ", ".join([*_scaled, *(f"CAST({c} AS DOUBLE)" for c in BINARY), *(f"CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END" for c in MISSABLE)])

#: Common parts by name; a statement gets those that it names, and what they name.
PARTS = {
    "fx_documents": "SELECT doc_id, 'PMC' || doc_id AS pmc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL",
    "fx_texts": "SELECT pmc_id, replace(text, chr(10), ' ') AS text FROM fx_documents",
    "fx_lines": "SELECT pmc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS seg_idx FROM fx_documents",
    "fx_segments": f"""SELECT pmc_id, seg_idx, coalesce(sum(length(text)) OVER (PARTITION BY pmc_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) + seg_idx AS "offset", text,
        {SECTIONS}[1 + seg_idx % 7] AS section_type FROM fx_lines""",
    "fx_terms": f"""SELECT item_id AS ord, {hp('item_id + 1000')} AS id, {joined(0, 2)} AS name, [{joined(2, 3)}, {joined(3, 6)}, {joined(6, 10)},
        {joined(4, 5)}, {joined(10, 12)}] AS syns,
        item_id % 11 = 10 AS obsolete, CASE WHEN item_id % 11 = 10 THEN {hp('item_id + 999')} END AS replaced_by, {hp('item_id + 900000')} AS alt FROM
        (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM benchmark)""",
    "fx_edges": f"""SELECT {hp('item_id + 1000')} AS child, CASE WHEN item_id = 0 THEN '{ROOT}' ELSE {hp('(item_id - 1) // 2 + 1000')} END AS parent
        FROM benchmark
        UNION SELECT {hp('item_id + 1000')}, {hp('item_id + 998')} FROM benchmark WHERE item_id % 5 = 0 AND item_id > 2""",
    "fx_walk": f"SELECT '{ROOT}' AS id, 0 AS depth UNION SELECT e.child, w.depth + 1 FROM fx_walk w JOIN fx_edges e ON e.parent = w.id",
    "fx_reach": """SELECT DISTINCT unnest([child, parent]) AS ancestor, unnest([child, parent]) AS id, 0 AS depth FROM fx_edges UNION
        SELECT r.ancestor, e.child, r.depth + 1 FROM fx_reach r JOIN fx_edges e ON e.parent = r.id""",
    "fx_depth": "SELECT id, min(depth) AS depth FROM fx_walk GROUP BY id",
    "fx_names": """SELECT id, unnest(list_concat([name], syns)) AS raw, unnest(range(1 + len(syns))) AS pos FROM fx_terms WHERE NOT obsolete AND id
        IN (SELECT id FROM fx_depth)""",
    "fx_phrases": """SELECT phrase, len(string_split(phrase, ' ')) AS n_tokens, string_split(phrase, ' ')[1] AS first_token, min(id) AS hpo_id
        FROM (SELECT id, array_to_string(regexp_extract_all(lower(raw), '[A-Za-z0-9]+'), ' ') AS phrase FROM fx_names) WHERE length(phrase) >= 3 AND
        (contains(phrase, ' ') OR length(phrase) >= 4) GROUP BY phrase""",
    "fx_split": "SELECT pmc_id, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS k FROM fx_texts",
    "fx_runs": "SELECT pmc_id, unnest(k) AS run, unnest(range(len(k))) AS pos FROM fx_split",
    "fx_placed": """SELECT *, coalesce(sum(length(run)) OVER (PARTITION BY pmc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS s FROM fx_runs""",
    "fx_tokens": """SELECT pmc_id, row_number() OVER (PARTITION BY pmc_id ORDER BY pos) - 1 AS tok_idx, lower(run) AS token, s AS "start", s +
        length(run) AS "end" FROM fx_placed WHERE regexp_matches(run, '^[A-Za-z0-9]')""",
    "fx_ahead": """SELECT *, list(token) OVER w AS ahead, list("end") OVER w AS ends FROM fx_tokens WINDOW w AS (PARTITION BY pmc_id ORDER BY tok_idx
        ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)""",
    "fx_candidates": """SELECT t.pmc_id, t.tok_idx, p.n_tokens, p.hpo_id, t."start", t.ends[p.n_tokens] AS "end" FROM fx_ahead t JOIN fx_phrases p ON
        p.first_token = t.token
        WHERE p.n_tokens <= 8 AND len(t.ahead) >= p.n_tokens AND array_to_string(t.ahead[1:p.n_tokens], ' ') = p.phrase""",
    "fx_longest": "SELECT * FROM fx_candidates QUALIFY row_number() OVER (PARTITION BY pmc_id, tok_idx ORDER BY n_tokens DESC) = 1",
    "fx_following": """SELECT a.pmc_id, a.tok_idx, min(b.tok_idx) AS nxt FROM fx_longest a JOIN fx_longest b ON b.pmc_id = a.pmc_id AND b.tok_idx >=
        a.tok_idx + a.n_tokens GROUP BY a.pmc_id, a.tok_idx""",
    "fx_taken": """SELECT pmc_id, min(tok_idx) AS tok_idx FROM fx_longest GROUP BY pmc_id UNION ALL SELECT f.pmc_id, f.nxt FROM fx_taken t JOIN
        fx_following f ON f.pmc_id = t.pmc_id AND f.tok_idx = t.tok_idx""",
    "fx_matches": """SELECT c.pmc_id, c.tok_idx, c.n_tokens, c.hpo_id AS identifier, c."start" AS "offset", c."end" - c."start" AS length,
        substring(x.text, CAST(c."start" + 1 AS BIGINT), CAST(c."end" - c."start" AS BIGINT)) AS text
        FROM fx_longest c JOIN fx_taken t ON t.pmc_id = c.pmc_id AND t.tok_idx = c.tok_idx JOIN fx_texts x ON x.pmc_id = c.pmc_id""",
    "fx_pred": """SELECT pmc_id, row_number() OVER (PARTITION BY pmc_id ORDER BY "offset") - 1 AS ent_idx, identifier, "offset", length, text,
        CAST(NULL AS VARCHAR) AS note FROM fx_matches WHERE "offset" % 5 <> 0""",
    "fx_gold": f"""SELECT pmc_id, row_number() OVER (PARTITION BY pmc_id ORDER BY "offset") - 1 AS ent_idx, CASE WHEN "offset" % 13 = 0 THEN
        identifier || ';' || {hp("CAST(substring(identifier, 4) AS INTEGER) + 1")} ELSE identifier END AS identifier,
        "offset", length, text, CASE WHEN "offset" % 11 = 0 THEN 'NO' END AS note FROM fx_matches WHERE "offset" % 7 <> 0""",
    "fx_patients": """SELECT doc_id, pmc_id, 1 + doc_id % 3 AS n, unnest(range(1 + doc_id % 3)) AS roster_idx, 'P' || (unnest(range(1 + doc_id % 3))
        + 1) AS patient_id FROM fx_documents WHERE doc_id % 10 <> 9""",
    "fx_refs": """SELECT p.pmc_id, p.roster_idx, p.patient_id, s.seg_idx, s."offset", substring(s.text, 1, 20) AS text FROM fx_patients p JOIN
        fx_segments s ON s.pmc_id = p.pmc_id AND s.seg_idx % p.n = p.roster_idx WHERE NOT (p.roster_idx = 2 AND p.doc_id % 4 = 0)""",
    "fx_mentioned": """SELECT pmc_id, 'entity' AS kind, '' AS owner, ent_idx AS idx, "offset", length, text FROM fx_gold
        UNION ALL SELECT pmc_id, 'patient', patient_id, row_number() OVER (PARTITION BY pmc_id, patient_id ORDER BY seg_idx) - 1, "offset",
        length(text), text FROM fx_refs""",
    "fx_anchor": """SELECT DISTINCT p.pmc_id, p.roster_idx, p.patient_id, r."offset" AS anchor FROM fx_patients p LEFT JOIN fx_refs r ON r.pmc_id =
        p.pmc_id AND r.roster_idx = p.roster_idx""",
    "fx_near": near("fx_pred"),
    "fx_assoc_pred": roster("SELECT * FROM fx_near"),
    "fx_assoc_gold": roster(near("fx_gold")),
    "fx_assoc_seen": """SELECT pmc_id, patient_id, identifier FROM fx_assoc_pred UNION ALL SELECT pmc_id, 'P9', 'HP:9999999' FROM fx_patients WHERE
        roster_idx = 0 AND doc_id % 8 = 0""",
    "fx_sizes": "SELECT DISTINCT pmc_id, doc_id, n FROM fx_patients",
    "fx_answered": "SELECT DISTINCT m.pmc_id FROM fx_pred m JOIN fx_sizes z ON z.pmc_id = m.pmc_id WHERE z.doc_id % 20 <> 0 AND (m.ent_idx + 1) % 17 <> 0",
    "fx_given": """SELECT m.pmc_id, m.ent_idx, m.identifier, 'P' || (1 + (m.ent_idx + 1) % z.n) AS patient_id FROM fx_pred m JOIN fx_sizes z ON
        z.pmc_id = m.pmc_id WHERE z.doc_id % 20 <> 0 AND (m.ent_idx + 1) % 17 <> 0 AND (m.ent_idx + 1) % 3 <> 0""",
    "fx_answers": """SELECT z.pmc_id, CASE WHEN z.doc_id % 20 = 0 THEN '' ELSE coalesce(string_agg((m.ent_idx + 1) || ': ' || CASE WHEN (m.ent_idx +
        1) % 3 = 0 THEN 'NONE' ELSE 'P' || (1 + (m.ent_idx + 1) % z.n) END, chr(10) ORDER BY m.ent_idx) FILTER (WHERE (m.ent_idx + 1) % 17 <> 0), '')
        END AS response
        FROM fx_pred m JOIN fx_sizes z ON z.pmc_id = m.pmc_id GROUP BY z.pmc_id, z.doc_id""",
    "fx_assigned": roster("SELECT * FROM fx_given"),
    "fx_unit": """SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]),
        CAST(embedding AS DOUBLE[])))) AS v FROM embeddings""",
    "fx_top1": f"""SELECT q.vec_id AS key, c.vec_id // 2 AS row_idx, {hp('c.vec_id')} AS hpo_id, 'concept ' || c.vec_id AS name, list_dot_product(q.v,
        c.v) AS score FROM fx_unit q JOIN fx_unit c ON q.vec_id % 2 = 1 AND c.vec_id % 2 = 0
        QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) = 1""",
    "fx_free": """SELECT t.*, t.tok_idx - row_number() OVER (PARTITION BY t.pmc_id ORDER BY t.tok_idx) AS island FROM fx_tokens t WHERE NOT EXISTS
        (SELECT 1 FROM fx_covered c WHERE c.pmc_id = t.pmc_id AND c.tok_idx = t.tok_idx)""",
    "fx_covered": "SELECT pmc_id, unnest(range(tok_idx, tok_idx + n_tokens)) AS tok_idx FROM fx_matches",
    "fx_grams": """SELECT g.pmc_id, g.run_id, g."start", g."end" - g."start" AS length, substring(x.text, CAST(g."start" + 1 AS BIGINT), CAST(g."end"
        - g."start" AS BIGINT)) AS text FROM (
        SELECT pmc_id, island + 1 AS run_id, "start", unnest(list("end") OVER (PARTITION BY pmc_id, island ORDER BY tok_idx ROWS BETWEEN CURRENT ROW
        AND 3 FOLLOWING)) AS "end" FROM fx_free) g JOIN fx_texts x ON x.pmc_id = g.pmc_id""",
    "fx_ngrams": "SELECT * FROM fx_grams WHERE length(text) > 2 AND regexp_matches(text, '^[A-Za-z]')",
    "fx_asked": "SELECT *, row_number() OVER (ORDER BY key) - 1 AS doc_ord FROM fx_top1",
    "fx_asked_size": "SELECT count(*) AS size FROM fx_asked",
    "fx_named": """SELECT text, CAST('0x' || substring(md5(text), 1, 8) AS BIGINT) % size AS place FROM (SELECT DISTINCT text FROM fx_ngrams), fx_asked_size""",
    "fx_hits": "SELECT t.text, a.hpo_id, a.name, a.score FROM fx_named t JOIN fx_asked a ON a.doc_ord = t.place",
    "fx_near_grams": """SELECT g.pmc_id, g.run_id, CAST(g."start" AS BIGINT) AS a, CAST(g."start" + g.length AS BIGINT) AS z, g.text, h.hpo_id,
        h.name, h.score,
        row_number() OVER (PARTITION BY g.pmc_id, g.run_id ORDER BY h.score DESC, g."start", g.length DESC) AS place FROM fx_ngrams g JOIN fx_hits h
        ON h.text = g.text WHERE h.score >= 0.3""",
    # each step takes the n-grams that no better one overlaps, and drops what these overlap; cells of 200 characters bring overlaps together
    "fx_greedy": """SELECT pmc_id, run_id, a, z, place, FALSE AS taken FROM fx_near_grams UNION ALL SELECT * FROM (
        WITH still AS (SELECT * FROM fx_greedy WHERE NOT taken),
        spread AS (SELECT *, unnest(range(a // 200, (z - 1) // 200 + 1)) AS cell FROM still),
        beaten AS (SELECT DISTINCT x.pmc_id, x.run_id, x.place FROM spread x JOIN spread y ON y.pmc_id = x.pmc_id AND y.run_id = x.run_id
            AND y.cell = x.cell AND y.place < x.place AND y.a < x.z AND x.a < y.z),
        best AS (SELECT s.* FROM still s ANTI JOIN beaten b ON b.pmc_id = s.pmc_id AND b.run_id = s.run_id AND b.place = s.place),
        winners AS (SELECT *, unnest(range(a // 200, (z - 1) // 200 + 1)) AS cell FROM best),
        gone AS (SELECT DISTINCT x.pmc_id, x.run_id, x.place FROM spread x JOIN winners y ON y.pmc_id = x.pmc_id AND y.run_id = x.run_id
            AND y.cell = x.cell AND y.a < x.z AND x.a < y.z)
        SELECT pmc_id, run_id, a, z, place, TRUE FROM best
        UNION ALL SELECT s.pmc_id, s.run_id, s.a, s.z, s.place, FALSE FROM still s ANTI JOIN gone g ON g.pmc_id = s.pmc_id AND g.run_id = s.run_id AND g.place = s.place)""",
    "fx_selected": """SELECT t.threshold, n.* FROM fx_near_grams n JOIN fx_greedy g ON g.taken AND g.pmc_id = n.pmc_id AND g.run_id = n.run_id AND
        g.place = n.place
        JOIN (SELECT unnest([0.3, 0.4, 0.5]::DOUBLE[]) AS threshold) t ON t.threshold <= n.score""",
    "fx_similar": "SELECT unnest([0.3, 0.4, 0.5]::DOUBLE[]) AS threshold",
    "fx_scanned": """SELECT *, row_number() OVER (PARTITION BY pmc_id ORDER BY threshold, "offset", length) AS ent_idx, CAST(NULL AS VARCHAR) AS note
        FROM (
        SELECT pmc_id, threshold, identifier, "offset", length FROM fx_matches, fx_similar UNION ALL SELECT pmc_id, threshold, hpo_id, a, z - a FROM
        fx_selected)""",
    "fx_scan_routed": f"""SELECT s.threshold, n.pmc_id, n.patient_id, n.identifier FROM ({near('fx_scanned')}) n JOIN fx_scanned s ON s.pmc_id =
        n.pmc_id AND s.ent_idx = n.ent_idx""",
    "fx_scan_gold": "SELECT g.*, threshold FROM fx_gold g, fx_similar",
    "fx_scan_people": "SELECT g.*, threshold FROM fx_assoc_gold g, fx_similar",
    "fx_roster": f"""SELECT p.pmc_id, p.roster_idx, p.patient_id, {collapsed("coalesce(first(r.text ORDER BY length(r.text) DESC, r.seg_idx), '')")}
        AS label,
        coalesce(list({{'t': {collapsed('r.text')}, 'o': r."offset"}} ORDER BY r.seg_idx) FILTER (WHERE r.seg_idx IS NOT NULL), []) AS refs
        FROM fx_patients p LEFT JOIN fx_refs r ON r.pmc_id = p.pmc_id AND r.roster_idx = p.roster_idx GROUP BY p.pmc_id, p.roster_idx, p.patient_id""",
    "fx_prompted": f"""SELECT m.pmc_id, m.ent_idx, m.section, {collapsed('m.text')} AS text, CAST(m."offset" AS BIGINT) AS "offset",
        {collapsed('substring(x.text, CAST(greatest(0, m."offset" - 120) + 1 AS BIGINT), CAST(m."offset" + m.length + 120 - greatest(0, m."offset" - 120) AS BIGINT))')}
        AS c FROM fx_sections m JOIN fx_texts x ON x.pmc_id = m.pmc_id""",
    "fx_sections": """SELECT m.*, coalesce(s.section_type, '?') AS section FROM fx_pred m LEFT JOIN fx_segments s ON s.pmc_id = m.pmc_id AND
        m."offset" >= s."offset" AND m."offset" < s."offset" + length(s.text)""",
    "fx_ctx": """SELECT m.pmc_id, m.ent_idx, lower(substring(x.text, CAST(greatest(0, m."offset" - 120) + 1 AS BIGINT), CAST(m."offset" + m.length +
        120 - greatest(0, m."offset" - 120) AS BIGINT))) AS c, length(x.text) AS size FROM fx_pred m JOIN fx_texts x ON x.pmc_id = m.pmc_id""",
    "fx_union": f"SELECT DISTINCT pmc_id, unnest({ids('identifier')}) AS token FROM fx_assoc_gold WHERE identifier IS NOT NULL",
    "fx_dist": 'SELECT m.pmc_id, m.ent_idx, min(abs(m."offset" - a.anchor)) AS d FROM fx_pred m JOIN fx_anchor a ON a.pmc_id = m.pmc_id WHERE a.anchor IS NOT NULL GROUP BY m.pmc_id, m.ent_idx',
    "fx_samples": f"""SELECT m.pmc_id, m.ent_idx, m.identifier, m."offset", m.length, m.text, m.note, upper(m.section) AS section_type, CASE WHEN
        m."offset" % 4 = 0 THEN m."offset" % 100 / 100.0 END AS retrieved_score,
        CASE WHEN m."offset" % 4 = 0 THEN 0 ELSE 1 END AS is_dict_hit, length(m.text) AS mention_char_len, len(regexp_extract_all(m.text,
        '[A-Za-z0-9]+')) AS mention_word_len, d.depth AS hpo_depth,
        CASE WHEN c.size > 0 THEN CAST(m."offset" AS DOUBLE) / c.size ELSE 0.0 END AS rel_position, CAST(a.d AS DOUBLE) / greatest(1, c.size) AS
        dist_to_nearest_anchor_norm, coalesce(z.n, 0) AS patient_count,
        CASE WHEN regexp_matches(c.c, '{bounded(KEEP_WORDS[0])}') THEN 1 ELSE 0 END AS has_negation_cue, CASE WHEN regexp_matches(c.c,
        '{bounded(KEEP_WORDS[1])}') THEN 1 ELSE 0 END AS has_normal_cue,
        CASE WHEN u.token IS NULL THEN 0 ELSE 1 END AS label FROM fx_sections m JOIN fx_ctx c ON c.pmc_id = m.pmc_id AND c.ent_idx = m.ent_idx LEFT
        JOIN fx_depth d ON d.id = m.identifier
        LEFT JOIN fx_dist a ON a.pmc_id = m.pmc_id AND a.ent_idx = m.ent_idx LEFT JOIN fx_sizes z ON z.pmc_id = m.pmc_id LEFT JOIN fx_union u ON
        u.pmc_id = m.pmc_id AND u.token = m.identifier""",
    "fx_prob": f"SELECT d.* EXCLUDE (v), 1 / (1 + exp(-list_dot_product(v, w))) AS keep_prob FROM fx_design d, fx_w{STEPS}",
    "fx_design": f"""SELECT s.*, list_concat([{_values}], list_transform(names, lambda s: CASE WHEN s = section_type THEN 1.0 ELSE 0.0 END), [1.0])::DOUBLE[]
        AS v FROM fx_samples s, fx_means, fx_spread, fx_gate_sections""",
    "fx_w0": "SELECT list_transform(v, lambda x: 0.0::DOUBLE) AS w FROM fx_design LIMIT 1",
    # a step: the matrix of second derivatives with the gradient beside it, eliminated column by column, and the solution taken off
    **{f"fx_m{t}": f"""SELECT list(line ORDER BY i) AS m FROM (SELECT i, list(x ORDER BY j) AS line FROM (SELECT i, j, CASE WHEN j > len(any_value(w)) THEN
        avg((p - label) * v[i]) + {RIDGE} * any_value(w[i]) ELSE avg(p * (1 - p) * v[i] * coalesce(v[j], 0)) + CASE WHEN i = j THEN {RIDGE} ELSE 0 END END AS x
        FROM (SELECT v, w, label, 1 / (1 + exp(-list_dot_product(v, w))) AS p FROM fx_design, fx_w{t}), (SELECT unnest(range(1, len(w) + 1)) AS i FROM fx_w{t}),
        (SELECT unnest(range(1, len(w) + 2)) AS j FROM fx_w{t}) GROUP BY i, j) GROUP BY i)""" for t in range(STEPS)},
    **{f"fx_e{t}": f"""SELECT 0 AS k, m FROM fx_m{t} UNION ALL SELECT k + 1, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = k + 1 THEN line ELSE
        list_transform(range(1, len(m) + 2), lambda j: m[i][j] - m[i][k + 1] * line[j]) END) FROM (SELECT k, m, list_transform(m[k + 1], lambda x: x / m[k +
        1][k + 1]) AS line FROM fx_e{t} WHERE k < len(m))""" for t in range(STEPS)},
    **{f"fx_w{t + 1}": f"""SELECT list_transform(range(1, len(w) + 1), lambda i: w[i] - m[i][len(w) + 1]) AS w FROM fx_e{t}, fx_w{t} WHERE k = len(w)"""
        for t in range(STEPS)},
    "fx_means": "SELECT " + _state.rstrip(", ") + " FROM fx_samples",
    "fx_spread": "SELECT " + ", ".join(f"CASE WHEN coalesce(stddev_pop(coalesce(CAST({c} AS DOUBLE), m_{c}, 0.0)), 0) = 0 THEN 1.0 ELSE stddev_pop(coalesce(CAST({c} AS DOUBLE), m_{c}, 0.0)) END AS d_{c}" for c in NUMERIC) + " FROM fx_samples, fx_means",
    "fx_gate_sections": f"SELECT list_concat(list_sort(list(DISTINCT section_type)), ['{OTHER}']) AS names FROM fx_samples",
    "fx_delta": f"""SELECT b.pmc_id, b.patient_id, b.tp + b.fn AS n_gold, b.f AS f1_base, m.f AS f1_model, m.f - b.f AS delta FROM
        ({people('fx_assoc_gold', 'fx_assoc_pred')}) b JOIN ({people('fx_assoc_gold', 'fx_assigned')}) m ON m.pmc_id = b.pmc_id AND m.patient_id =
        b.patient_id""",
    "fx_states": f"""SELECT pmc_id, patient_id, token, max(g) AS in_gold, max(b) AS in_base, max(m) AS in_model FROM (SELECT *, 1 AS g, 0 AS b, 0 AS m
        FROM ({tokens('fx_assoc_gold')}) UNION ALL SELECT *, 0, 1, 0 FROM ({tokens('fx_assoc_pred')}) UNION ALL SELECT *, 0, 0, 1 FROM
        ({tokens('fx_assigned')})) GROUP BY pmc_id, patient_id, token""",
    "fx_log": """SELECT 'exp' || user_id AS tag, min(event_id) AS ord, arg_max(strftime(ts, '%Y-%m-%d %H:%M'), event_id) AS ts_local, arg_max(value,
        event_id) FILTER (WHERE event_type IN ('click', 'view') AND value IS NOT NULL) AS local_score,
        arg_max(value, event_id) FILTER (WHERE event_type NOT IN ('click', 'view') AND value IS NOT NULL) AS online_score FROM events GROUP BY user_id""",
    "fx_variants": """SELECT 'A' AS variant, pmc_id, patient_id, identifier FROM fx_assoc_pred UNION ALL SELECT 'B', pmc_id, patient_id, identifier
        FROM fx_assigned UNION ALL SELECT 'intersect', pmc_id, patient_id, token FROM fx_fi UNION ALL SELECT 'union', pmc_id, patient_id, token FROM
        fx_fu""",
    "fx_fi": f"""SELECT p.pmc_id, p.patient_id, x.token FROM (SELECT DISTINCT pmc_id, patient_id FROM fx_assoc_pred) p LEFT JOIN (SELECT * FROM
        ({tokens('fx_assoc_pred')}) INTERSECT SELECT * FROM ({tokens('fx_assigned')})) x ON x.pmc_id = p.pmc_id AND x.patient_id = p.patient_id""",
    "fx_fu": f"""SELECT p.pmc_id, p.patient_id, x.token FROM (SELECT DISTINCT pmc_id, patient_id FROM fx_assoc_pred) p LEFT JOIN (SELECT * FROM
        ({tokens('fx_assoc_pred')}) UNION SELECT * FROM ({tokens('fx_assigned')})) x ON x.pmc_id = p.pmc_id AND x.patient_id = p.patient_id""",
    "fx_goldv": "SELECT g.*, v.variant FROM fx_assoc_gold g, (SELECT unnest(['A', 'B', 'intersect', 'union']) AS variant) v",
    "fx_goldt": "SELECT g.*, t.threshold FROM fx_assoc_gold g, (SELECT unnest([0.0, 0.25, 0.5, 0.75]::DOUBLE[]) AS threshold) t",
    "fx_keptt": """SELECT n.pmc_id, n.patient_id, n.identifier, t.threshold FROM fx_near n JOIN fx_prob k ON k.pmc_id = n.pmc_id AND k.ent_idx =
        n.ent_idx JOIN (SELECT unnest([0.0, 0.25, 0.5, 0.75]::DOUBLE[]) AS threshold) t ON k.keep_prob >= t.threshold""",
    "fx_gated": f"""SELECT p.pmc_id, p.patient_id, x.token AS identifier FROM fx_patients p LEFT JOIN (SELECT t.* FROM ({tokens('fx_assoc_pred')}) t
        WHERE t.pmc_id NOT IN (SELECT pmc_id FROM fx_answered)
        OR EXISTS (SELECT 1 FROM ({tokens('fx_assigned')}) o WHERE o.pmc_id = t.pmc_id AND o.token = t.token)) x ON x.pmc_id = p.pmc_id AND
        x.patient_id = p.patient_id""",
}

MEN = counts(units("fx_gold", 'pmc_id, "offset", length'), units("fx_pred", 'pmc_id, "offset", length'), 'pmc_id, "offset", length, token')
DOC = counts(units("fx_gold", "pmc_id"), units("fx_pred", "pmc_id"), "pmc_id, token")
MICRO = counts(tokens("fx_assoc_gold"), tokens("fx_assoc_seen"), "pmc_id, patient_id, token")
TOTAL = f"SELECT (SELECT {F1} FROM ({MEN})) AS a, (SELECT {F1} FROM ({DOC})) AS b, (SELECT {F1} FROM ({MICRO})) AS c, (SELECT avg(f) FROM ({people('fx_assoc_gold', 'fx_assoc_pred')})) AS d"
SCAN = f"""SELECT *, row_number() OVER (ORDER BY round(raw, 9) DESC, threshold) = 1 AS best FROM (SELECT threshold, round(f1_men, 6) AS f1_men, round(f1_doc, 6)
        AS f1_doc, round(f1_micro, 6) AS f1_micro, round(f1_macro, 6) AS f1_macro,
    round(raw, 6) AS score, n_new, raw FROM (SELECT t.threshold, a.f AS f1_men, b.f AS f1_doc, c.f AS f1_micro, d.f AS f1_macro, (a.f + b.f + c.f +
        d.f) * 0.25 AS raw, (SELECT count(*) FROM fx_selected s WHERE s.threshold = t.threshold) AS n_new FROM fx_similar t
    JOIN (SELECT threshold, {F1} AS f FROM
        ({counts(units('fx_scan_gold', 'threshold, pmc_id, "offset", length'), units('fx_scanned', 'threshold, pmc_id, "offset", length'), 'threshold, pmc_id, "offset", length, token', 'threshold')}))
        a ON a.threshold = t.threshold
    JOIN (SELECT threshold, {F1} AS f FROM
        ({counts(units('fx_scan_gold', 'threshold, pmc_id'), units('fx_scanned', 'threshold, pmc_id'), 'threshold, pmc_id, token', 'threshold')})) b
        ON b.threshold = t.threshold
    JOIN (SELECT threshold, {F1} AS f FROM
        ({counts(*(f"SELECT DISTINCT threshold, pmc_id, patient_id, unnest({ids('identifier')}) AS token FROM {x} WHERE identifier IS NOT NULL" for x in ('fx_scan_people', 'fx_scan_routed')), 'threshold, pmc_id, patient_id, token', 'threshold')}))
        c ON c.threshold = t.threshold
    JOIN (SELECT threshold, avg(f) AS f FROM ({people('fx_scan_people', 'fx_scan_routed', 'threshold')}) GROUP BY threshold) d ON d.threshold =
        t.threshold))"""
SCAN = SCAN.replace("SELECT *, row_number()", "SELECT threshold, f1_men, f1_doc, f1_micro, f1_macro, score, n_new, row_number()", 1)
CTX = """trim(regexp_replace(substring(x.text, CAST(greatest(0, m."offset" - 120) + 1 AS BIGINT), CAST(m."offset" + m.length + 120 - greatest(0,
        m."offset" - 120) AS BIGINT)), '\\s+', ' ', 'g'))"""

STATEMENTS = {
    "read_articles": """SELECT s.pmc_id, s.n AS n_segments, coalesce(g.n, 0) AS n_entities FROM (SELECT pmc_id, count(*) AS n FROM fx_segments GROUP
        BY pmc_id) s LEFT JOIN (SELECT pmc_id, count(*) AS n FROM fx_gold GROUP BY pmc_id) g ON g.pmc_id = s.pmc_id""",
    "read_articles_tolerant": "SELECT pmc_id, unnest(['good', 'bad']) AS state FROM fx_documents",
    "read_ontology": "SELECT id, name, len(list_filter(syns, lambda s: s <> '')) AS n_syns, obsolete, replaced_by, alt AS alt_ids FROM fx_terms",
    "write_predictions": "SELECT pmc_id, patient_id, identifier FROM fx_assoc_pred",
    "write_gate_dataset": f"""SELECT pmc_id, ent_idx, label,
        {', '.join(f'round({c}, 6) AS {c}' if c in ('rel_position', 'dist_to_nearest_anchor_norm') else c for c in NUMERIC[1:] + BINARY)},
        section_type FROM fx_samples""",
    "read_concept_index": f"""SELECT vec_id // 2 AS row_idx, {hp('vec_id')} AS hpo_id, 'concept ' || vec_id AS name, len(embedding) AS dim FROM
        embeddings WHERE vec_id % 2 = 0""",
    "read_answers": "SELECT pmc_id, response FROM fx_answers",
    "ontology_terms": """SELECT id, name, s AS synonym, obsolete, replaced_by FROM (SELECT id, name, unnest(syns) AS s, obsolete, replaced_by FROM
        fx_terms) WHERE s <> ''""",
    "ontology_edges": "SELECT DISTINCT child, parent FROM fx_edges",
    "ontology_descendants": "SELECT id FROM fx_depth",
    "ontology_depth": "SELECT id, depth FROM fx_depth",
    "ontology_alias_map": "SELECT alt AS alias, id FROM fx_terms UNION ALL SELECT id, replaced_by FROM fx_terms WHERE obsolete",
    "phrase_dictionary": "SELECT phrase, n_tokens, first_token, hpo_id FROM fx_phrases",
    "concept_names": """SELECT hpo_id, row_number() OVER (PARTITION BY hpo_id ORDER BY pos) - 1 AS alias_idx, name FROM (SELECT id AS hpo_id, pos,
        raw AS name FROM fx_names WHERE raw <> '' QUALIFY row_number() OVER (PARTITION BY id, lower(raw) ORDER BY pos) = 1)""",
    "rebuild_text": "SELECT pmc_id, text FROM fx_texts",
    "rebuild_text_sorted": "SELECT pmc_id, text FROM fx_texts",
    "tokenize_offsets": 'SELECT pmc_id, tok_idx, token, "start", "end" FROM fx_tokens',
    "section_lookup": """SELECT m.pmc_id, m.ent_idx, coalesce(s.section_type, '?') AS section FROM fx_gold m LEFT JOIN fx_segments s ON s.pmc_id =
        m.pmc_id AND m."offset" >= s."offset" AND m."offset" < s."offset" + length(s.text)""",
    "ontology_reach": """SELECT ancestor, id, min(depth) AS depth, false AS cycle FROM fx_reach GROUP BY ancestor, id""",
    "context_window": f"SELECT m.pmc_id, m.ent_idx, {CTX} AS context FROM fx_gold m JOIN fx_texts x ON x.pmc_id = m.pmc_id",
    "split_ids": f"""SELECT pmc_id, ent_idx, unnest({ids("' ' || identifier || ' ;-1;'")}) AS token FROM fx_gold""",
    "split_ids_real": f"""SELECT pmc_id, ent_idx, unnest({ids("' ' || identifier || ' ;-1;'", True)}) AS token FROM fx_gold""",
    "dictionary_candidates": 'SELECT pmc_id, tok_idx, n_tokens, hpo_id, "start", "end" FROM fx_candidates',
    "dictionary_match": 'SELECT pmc_id, identifier, "offset", length, text FROM fx_matches',
    "free_token_ngrams": 'SELECT pmc_id, run_id, "start", length, text FROM fx_grams',
    "candidate_filter": 'SELECT pmc_id, "start", length, text FROM fx_ngrams',
    "distinct_candidate_texts": "SELECT DISTINCT text FROM fx_ngrams",
    "retrieve_top1": "SELECT key, hpo_id, name, round(score, 4) AS score FROM fx_top1",
    "similarity_profile": """SELECT round(max(score), 6) AS max, round(max(CASE WHEN r = CAST(floor(n * 0.10) AS BIGINT) THEN score END), 6) AS p10,
        round(max(CASE WHEN r = CAST(floor(n * 0.25) AS BIGINT) THEN score END), 6) AS p25,
        round(max(CASE WHEN r = CAST(floor(n * 0.5) AS BIGINT) THEN score END), 6) AS median, round(min(score), 6) AS min FROM (SELECT score,
        row_number() OVER (ORDER BY score DESC) - 1 AS r, count(*) OVER () AS n FROM fx_top1)""",
    "select_retrieved": 'SELECT threshold, pmc_id, a AS "start", z - a AS length, text, hpo_id, round(score, 6) AS score FROM fx_selected',
    "merge_mentions": """SELECT pmc_id, row_number() OVER (PARTITION BY pmc_id ORDER BY source, "offset") - 1 AS ent_idx, * EXCLUDE (pmc_id) FROM (
        SELECT pmc_id, 0 AS source, identifier, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, text, CAST(NULL AS VARCHAR) AS
        retrieved_name, CAST(NULL AS DOUBLE) AS retrieved_score FROM fx_matches
        UNION ALL SELECT pmc_id, 1, hpo_id, a, z - a, text, name, round(score, 4) FROM fx_selected WHERE threshold = 0.5)""",
    "threshold_scan_recognition": SCAN,
    "patient_anchors": "SELECT pmc_id, patient_id, anchor FROM fx_anchor",
    "associate_nearest": "SELECT pmc_id, patient_id, identifier FROM fx_assoc_pred",
    "associate_nearest_maxdist": roster(near("fx_pred", 800)),
    "patient_roster": """SELECT p.pmc_id, p.patient_id, coalesce(first(r.text ORDER BY length(r.text) DESC, r.seg_idx), '') AS label,
        count(r.seg_idx) AS n_refs FROM fx_patients p LEFT JOIN fx_refs r ON r.pmc_id = p.pmc_id AND r.roster_idx = p.roster_idx GROUP BY p.pmc_id,
        p.patient_id""",
    "prompt_window": prompt("""'  ' || patient_id || ' = "' || substring(label, 1, 120) || '"'""", """'  ' || (ent_idx + 1) || '. [' || section ||
        '] "' || text || '" | context: ...' || c || '...'"""),
    "prompt_whole": prompt("""'  ' || patient_id || '  (e.g. "' || substring(label, 1, 80) || '")  refs: ' ||
        array_to_string(list_transform(list_filter(refs[1:6], lambda r: r.t <> ''), lambda r: '"' || r.t || '"@' || r.o), '; ')""",
        """'  ' || (ent_idx + 1) || '. "' || text || '" @char' || "offset" || ' | context: ...' || c || '...'""", "x.text"),
    "parse_answers": "SELECT pmc_id, ent_idx, patient_id FROM fx_given",
    "strip_reasoning": "SELECT pmc_id, response || '</think>' AS answer FROM fx_answers",
    "assoc_assigned": "SELECT pmc_id, patient_id, identifier FROM fx_assigned",
    "gate_intersect_patient": roster("SELECT pmc_id, patient_id, identifier FROM fx_assoc_pred INTERSECT SELECT pmc_id, patient_id, identifier FROM fx_assigned"),
    "gate_filter_route": roster(f"SELECT * FROM ({near('fx_pred', 800)}) n WHERE EXISTS (SELECT 1 FROM fx_given g WHERE g.pmc_id = n.pmc_id AND g.ent_idx = n.ent_idx)"),
    "gate_intersect_article": "SELECT pmc_id, patient_id, identifier FROM fx_gated",
    "associate_with_fallback": f"""SELECT pmc_id, patient_id, identifier, 'intersect' AS how FROM
        ({roster("SELECT pmc_id, patient_id, identifier FROM fx_assoc_pred INTERSECT SELECT pmc_id, patient_id, identifier FROM fx_assigned")}) WHERE
        pmc_id IN (SELECT pmc_id FROM fx_answered)
        UNION ALL SELECT pmc_id, patient_id, identifier, 'nearest' FROM fx_assoc_pred WHERE pmc_id NOT IN (SELECT pmc_id FROM fx_answered)""",
    "decision_stats": """SELECT sum(CASE WHEN parsed > 0 THEN 1 ELSE 0 END) AS answered, sum(CASE WHEN parsed > 0 THEN 0 ELSE 1 END) AS fallback, 0
        AS truncated, sum(CASE WHEN parsed > 0 AND parsed < n THEN 1 ELSE 0 END) AS shortfall,
        sum(CASE WHEN parsed > 0 THEN got ELSE 0 END) AS assigned, sum(CASE WHEN parsed > 0 THEN n - got ELSE 0 END) AS none, round(100.0 * sum(CASE
        WHEN parsed > 0 THEN n - got ELSE 0 END) / sum(CASE WHEN parsed > 0 THEN n ELSE 0 END), 4) AS none_pct
        FROM (SELECT m.pmc_id, count(*) AS n, sum(CASE WHEN z.doc_id % 20 <> 0 AND (m.ent_idx + 1) % 17 <> 0 THEN 1 ELSE 0 END) AS parsed, sum(CASE
        WHEN z.doc_id % 20 <> 0 AND (m.ent_idx + 1) % 17 <> 0 AND (m.ent_idx + 1) % 3 <> 0 THEN 1 ELSE 0 END) AS got FROM fx_pred m JOIN fx_sizes z ON
        z.pmc_id = m.pmc_id GROUP BY m.pmc_id)""",
    "gate_retention": f"""SELECT b AS before, a AS after, round(100.0 * (b - a) / b, 4) AS dropped_pct, joined, not_covered FROM (SELECT (SELECT
        count(*) FROM ({tokens('fx_assoc_pred')})) AS b, (SELECT count(*) FROM ({tokens('fx_gated')})) AS a,
        (SELECT count(DISTINCT pmc_id) FROM fx_patients WHERE pmc_id IN (SELECT pmc_id FROM fx_answered)) AS joined, (SELECT count(DISTINCT pmc_id)
        FROM fx_patients WHERE pmc_id NOT IN (SELECT pmc_id FROM fx_answered)) AS not_covered)""",
    "fuse_intersect": "SELECT pmc_id, patient_id, token FROM fx_fi",
    "fuse_union": "SELECT pmc_id, patient_id, token FROM fx_fu",
    "check_mentions_aligned": """SELECT count(*) AS misaligned FROM (SELECT pmc_id FROM (SELECT DISTINCT pmc_id, "offset", length, identifier FROM
        fx_pred EXCEPT SELECT pmc_id, "offset", length, identifier FROM fx_gold)
        UNION SELECT pmc_id FROM (SELECT DISTINCT pmc_id, "offset", length, identifier FROM fx_gold WHERE pmc_id IN (SELECT pmc_id FROM fx_pred)
        EXCEPT SELECT pmc_id, "offset", length, identifier FROM fx_pred))""",
    "fusion_compare": f"""SELECT a.variant, round({F1}, 6) AS f1_micro, round(b.f, 6) AS f1_macro FROM
        ({counts("SELECT DISTINCT variant, pmc_id, patient_id, unnest(" + ids('identifier') + ") AS token FROM fx_goldv WHERE identifier IS NOT NULL", "SELECT DISTINCT variant, pmc_id, patient_id, unnest(" + ids('identifier') + ") AS token FROM fx_variants WHERE identifier IS NOT NULL", "variant, pmc_id, patient_id, token", "variant")})
        a
        JOIN (SELECT variant, avg(f) AS f FROM ({people('fx_goldv', 'fx_variants', 'variant')}) GROUP BY variant) b ON b.variant = a.variant""",
    "gold_union": "SELECT pmc_id, token FROM fx_union",
    "label_samples": "SELECT pmc_id, ent_idx, label FROM fx_samples",
    "label_balance": """SELECT sum(label) AS positive, count(*) - sum(label) AS negative, round(100.0 * sum(label) / count(*), 4) AS positive_pct
        FROM fx_samples""",
    "gate_features": f"""SELECT pmc_id, ent_idx, section_type,
        {', '.join(f'round({c}, 6) AS {c}' if c in ('retrieved_score', 'rel_position', 'dist_to_nearest_anchor_norm') else c for c in NUMERIC + BINARY)}
        FROM fx_samples""",
    "gate_fit": " UNION ALL ".join(f"SELECT '{c}' AS feature, round(m_{c}, 6) AS mean, round(d_{c}, 6) AS std FROM fx_means, fx_spread" for c in NUMERIC),
    "gate_transform": f"""SELECT pmc_id, ent_idx, unnest(range(len(v))) AS pos, round(unnest(v), 6) AS value FROM (SELECT pmc_id, ent_idx,
        list_concat([{_values}], list_transform(names, lambda s: CASE WHEN s = section_type THEN 1.0 ELSE 0.0 END)) AS v FROM fx_samples, fx_means,
        fx_spread, fx_gate_sections)""",
    "gate_train": """SELECT n, round(share, 6) AS share, round(loss, 4) AS loss, round(-(share * ln(share) + (1 - share) * ln(1 - share)), 4) AS constant_loss
        FROM (SELECT count(*) AS n, avg(label) AS share, avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS loss FROM (SELECT label, least(greatest(keep_prob,
        1e-9), 1 - 1e-9) AS p FROM fx_prob))""",
    "gate_predict": "SELECT pmc_id, ent_idx, label, round(keep_prob, 4) AS keep_prob FROM fx_prob",
    "gate_sweep": f"""SELECT threshold, round(100.0 * (tp + fp) / n, 6) AS retention_pct, {PRF} FROM (SELECT threshold, sum(CASE WHEN keep_prob >=
        threshold AND label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN keep_prob >= threshold AND label = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN
        keep_prob < threshold AND label = 1 THEN 1 ELSE 0 END) AS fn, count(*) AS n FROM fx_prob, (SELECT unnest([0.0, 0.25, 0.5, 0.75]::DOUBLE[]) AS
        threshold) GROUP BY threshold)""",
    "gate_apply": roster("SELECT n.* FROM fx_near n JOIN fx_prob k ON k.pmc_id = n.pmc_id AND k.ent_idx = n.ent_idx WHERE k.keep_prob >= 0.5"),
    "gate_threshold_scan": f"""SELECT threshold, kept, round(f1_micro, 6) AS f1_micro, round(f1_macro, 6) AS f1_macro, round(score, 6) AS score,
        round(f1_macro - first_value(f1_macro) OVER (ORDER BY threshold), 6) AS delta_macro, row_number() OVER (ORDER BY round(score, 9) DESC, threshold) = 1 AS
        best FROM (
        SELECT a.threshold, k.kept, {F1} AS f1_micro, b.f AS f1_macro, 0.25 * ((SELECT {F1} FROM ({MEN})) + (SELECT {F1} FROM ({DOC})) + {F1} + b.f)
        AS score FROM
        ({counts("SELECT DISTINCT threshold, pmc_id, patient_id, unnest(" + ids('identifier') + ") AS token FROM fx_goldt WHERE identifier IS NOT NULL", "SELECT DISTINCT threshold, pmc_id, patient_id, unnest(" + ids('identifier') + ") AS token FROM fx_keptt", "threshold, pmc_id, patient_id, token", "threshold")})
        a
        JOIN (SELECT threshold, avg(f) AS f FROM ({people('fx_goldt', 'fx_keptt', 'threshold')}) GROUP BY threshold) b ON b.threshold = a.threshold
        JOIN (SELECT threshold, sum(CASE WHEN keep_prob >= threshold THEN 1 ELSE 0 END) AS kept FROM fx_prob, (SELECT unnest([0.0, 0.25, 0.5,
        0.75]::DOUBLE[]) AS threshold) GROUP BY threshold) k ON k.threshold = a.threshold)""",
    "prf": f"""SELECT l_suppkey, {PRF} FROM (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN l_returnflag =
        'A' THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS fn FROM lineitem GROUP BY l_suppkey)""",
    "score_mention": f"SELECT tp, fp, fn, {PRF} FROM ({MEN})",
    "score_document": f"SELECT tp, fp, fn, {PRF} FROM ({DOC})",
    "score_micro": f"SELECT tp, fp, fn, {PRF} FROM ({MICRO})",
    "score_macro": f"""SELECT count(*) AS patients, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1 FROM
        ({people('fx_assoc_gold', 'fx_assoc_pred')})""",
    "score_total": f"""SELECT round(a, 6) AS f1_men, round(b, 6) AS f1_doc, round(c, 6) AS f1_micro, round(d, 6) AS f1_macro, round((a + b + c + d) *
        0.25, 6) AS score FROM ({TOTAL})""",
    "check_coverage": """SELECT (SELECT count(*) FROM (SELECT DISTINCT pmc_id FROM fx_gold EXCEPT SELECT pmc_id FROM fx_pred)) AS missing, (SELECT
        count(*) FROM (SELECT DISTINCT pmc_id FROM fx_pred EXCEPT SELECT pmc_id FROM fx_gold)) AS extra""",
    "patient_delta": """SELECT pmc_id, patient_id, n_gold, round(f1_base, 6) AS f1_base, round(f1_model, 6) AS f1_model, round(delta, 6) AS delta,
        CASE WHEN delta > 1e-9 THEN 'better' WHEN delta < -1e-9 THEN 'worse' ELSE 'same' END AS outcome FROM fx_delta""",
    "bucket_delta": """SELECT CASE WHEN n_gold <= 2 THEN '<=2' WHEN n_gold <= 5 THEN '3-5' ELSE '>5' END AS bucket, count(*) AS n,
        round(avg(f1_base), 6) AS f1_base, round(avg(f1_model), 6) AS f1_model, round(avg(delta), 6) AS delta, round(sum(delta) / (SELECT count(*)
        FROM fx_delta), 6) AS contribution FROM fx_delta GROUP BY 1""",
    "miss_extra": """SELECT (SELECT sum(CASE WHEN in_gold = 1 AND in_model = 0 THEN 1 ELSE 0 END) FROM fx_states) AS missed, (SELECT sum(CASE WHEN
        in_gold = 0 AND in_model = 1 THEN 1 ELSE 0 END) FROM fx_states) AS extra,
        (SELECT sum(CASE WHEN f1_base > 1e-9 AND f1_model <= 1e-9 THEN 1 ELSE 0 END) FROM fx_delta) AS zeroed, (SELECT sum(CASE WHEN f1_base <= 1e-9
        AND f1_model > 1e-9 THEN 1 ELSE 0 END) FROM fx_delta) AS rescued""",
    "miss_destination": """SELECT s.pmc_id, s.patient_id, s.token, CASE WHEN EXISTS (SELECT 1 FROM fx_states o WHERE o.pmc_id = s.pmc_id AND o.token
        = s.token AND o.in_model = 1) THEN 'to_other' WHEN s.in_base = 1 THEN 'to_none' ELSE 'to_lost' END AS destination FROM fx_states s WHERE
        s.in_gold = 1 AND s.in_model = 0""",
    "worst_patients": """SELECT w.pmc_id, w.patient_id, round(w.delta, 6) AS delta, """ + ", ".join(f"coalesce(string_agg(s.token, '|' ORDER BY s.token) FILTER (WHERE {c}), '') AS {a}" for a, c in (("gold", "in_gold = 1"), ("base", "in_base = 1"), ("model", "in_model = 1"), ("missed", "in_gold = 1 AND in_model = 0"), ("extra", "in_gold = 0 AND in_model = 1"))) + """
        FROM (SELECT * FROM fx_delta WHERE delta < -1e-9 ORDER BY delta, pmc_id, patient_id LIMIT 10) w LEFT JOIN fx_states s ON s.pmc_id = w.pmc_id
        AND s.patient_id = w.patient_id GROUP BY w.pmc_id, w.patient_id, w.delta""",
    "experiments_upsert": "SELECT tag, ord, ts_local, round(local_score, 6) AS local_score, round(online_score, 6) AS online_score FROM fx_log",
    "record_local": f"""SELECT 'own' AS tag, round(a, 4) AS f1_men, round(b, 4) AS f1_doc, round(c, 4) AS f1_micro, round(d, 4) AS f1_macro, round((a
        + b + c + d) * 0.25, 4) AS score FROM ({TOTAL})""",
    "record_online": """SELECT tag, CASE WHEN tag = 'exp1' THEN 'A' END AS board, round(CASE WHEN tag = 'exp1' THEN 50.0 ELSE online_score END -
        local_score, 6) AS gap FROM fx_log""",
    "experiments_report": """SELECT row_number() OVER w AS pos, tag, ts_local, round(local_score, 6) AS local_score, round(local_score -
        last_value(local_score IGNORE NULLS) OVER (ORDER BY coalesce(ts_local, ''), ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS
        delta_prev, round(online_score, 6) AS online_score, round(online_score - local_score, 6) AS gap FROM fx_log WINDOW w AS (ORDER BY
        coalesce(ts_local, ''), ord)""",
    "split_every_k": """SELECT pmc_id, doc_ord, CASE WHEN doc_ord % 5 = 0 THEN 'dev' ELSE 'train' END AS split FROM (SELECT pmc_id, row_number() OVER
        (ORDER BY doc_id DESC) - 1 AS doc_ord FROM fx_documents)""",
    "blank_answers": "SELECT pmc_id, count(*) AS n_segments, 0 AS n_entities, 0 AS n_associations FROM fx_segments GROUP BY pmc_id",
    "corpus_stats": f"""SELECT (SELECT count(*) FROM fx_documents) AS articles, (SELECT count(*) FROM fx_patients) AS patients, (SELECT count(*) FROM
        fx_gold) AS mentions, (SELECT sum(CASE WHEN note = 'NO' THEN 1 ELSE 0 END) FROM fx_gold) AS negated,
        (SELECT sum(CASE WHEN contains(identifier, ';') THEN 1 ELSE 0 END) FROM fx_gold) AS compound, 0 AS no_id, (SELECT count(DISTINCT t) FROM
        (SELECT unnest({ids('identifier', True)}) AS t FROM fx_gold)) AS unique_ids,
        (SELECT count(*) FROM fx_assoc_gold WHERE identifier IS NOT NULL) AS pairs, (SELECT count(DISTINCT t) FROM (SELECT
        unnest({ids('identifier', True)}) AS t FROM fx_assoc_gold WHERE identifier IS NOT NULL)) AS unique_patient_ids""",
    "section_counts": "SELECT section_type, count(*) AS n FROM fx_segments GROUP BY section_type",
    "check_offsets": """SELECT pmc_id, kind, owner, idx, "offset", text, found FROM (SELECT m.pmc_id, m.kind, m.owner, m.idx, m."offset" + CASE WHEN
        m.idx % 3 = 0 THEN 1 ELSE 0 END AS "offset", m.text,
        substring(x.text, CAST(m."offset" + CASE WHEN m.idx % 3 = 0 THEN 2 ELSE 1 END AS BIGINT), CAST(m.length AS BIGINT)) AS found FROM fx_mentioned
        m JOIN fx_texts x ON x.pmc_id = m.pmc_id) WHERE text <> found""",
    "check_ontology_ids": f"""SELECT t.token, coalesce(a.id, t.token) AS main_id, coalesce(o.obsolete, FALSE) AS obsolete, t.n FROM (SELECT token,
        count(*) AS n FROM (SELECT unnest({ids('identifier', True)}) AS token FROM fx_gold) GROUP BY token) t
        LEFT JOIN (SELECT alt AS alias, id FROM fx_terms UNION ALL SELECT id, replaced_by FROM fx_terms WHERE obsolete) a ON a.alias = t.token LEFT
        JOIN fx_terms o ON o.id = t.token WHERE coalesce(a.id, t.token) NOT IN (SELECT id FROM fx_depth)""",
    "check_submission": """SELECT (SELECT count(*) FROM fx_documents) AS articles, (SELECT count(*) FROM fx_documents) AS expected, 0 AS
        out_of_order, 0 AS missing_fields, (SELECT count(*) FROM fx_pred) AS entities, (SELECT count(*) FROM fx_assoc_pred WHERE identifier IS NOT
        NULL) AS phenotypes""",
}


#: Parts that are used more than once and dear to make.
KEPT = {"fx_samples", "fx_design", *(f"fx_{k}{t}" for k in "mw" for t in range(STEPS + 1)), "fx_matches", "fx_tokens", "fx_top1", "fx_asked", "fx_ngrams", "fx_named", "fx_near_grams", "fx_selected"}


def with_parts(statement: str) -> str:
    """A statement after the common parts that it needs, in order."""
    order: list[str] = []

    def need(sql: str, own: str = "") -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_\w+", sql)):
            if name != own and name not in order:
                need(PARTS[name], name)
                order.append(name)

    need(statement)
    return ("WITH RECURSIVE " + ", ".join(f"{n} AS {'MATERIALIZED ' if n in KEPT else ''}({PARTS[n]})" for n in order) + " " if order else "") + statement


def oracle_sql() -> dict[str, str]:
    return {name: with_parts(s) for name, s in STATEMENTS.items()}
