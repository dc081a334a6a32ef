"""What SQL can say of the dealt operators, for DuckDB over the same tables."""

from __future__ import annotations

from tripspark.llm import curriculum
from tripspark.llm import license_diagonals as lic

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def _due(share: str) -> str:
    """The time at which a share of a source's target is due, by the source's turn among the schedules."""
    cases = []
    for turn, weights in enumerate(curriculum.SCHEDULES):
        pieces = len(weights) - 1
        areas = [(a + b) / 2 for a, b in zip(weights, weights[1:], strict=False)]
        whens = []
        for i in range(pieces):
            low, slope, before = weights[i], weights[i + 1] - weights[i], sum(areas[:i])
            area = f"greatest(0.0::DOUBLE, {share} * {sum(areas)}::DOUBLE - {before}::DOUBLE)"
            root = f"sqrt(greatest(0.0::DOUBLE, {low * low}::DOUBLE + {2 * slope}::DOUBLE * {area}))"
            inside = f"coalesce(2 * {area} / nullif({low}::DOUBLE + {root}, 0), 0)"
            whens.append(f"WHEN {share} * {sum(areas)}::DOUBLE <= {before + areas[i]}::DOUBLE THEN ({i} + least(1.0::DOUBLE, {inside})) / {pieces}")
        cases.append(f"WHEN {turn} THEN CASE {' '.join(whens)} ELSE 1.0::DOUBLE END")
    return f"CASE turn {' '.join(cases)} END"


MIX = rf"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS}) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
),
own AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2 * CAST(sum(size) AS BIGINT) AS most,
         (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS turn,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source
),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE
             - CAST(coalesce(sum(most) OVER up, 0) AS BIGINT))
            / (CAST(sum(weight) OVER () AS BIGINT) - CAST(coalesce(sum(weight) OVER up, 0) AS BIGINT)) AS level
  FROM own
  WINDOW up AS (ORDER BY most / weight::DOUBLE, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
targets AS (
  SELECT source, source_size, turn, least(most::DOUBLE,
         (SELECT max(level) FROM levels WHERE level * weight <= most) * weight) AS target
  FROM levels
),
line AS (
  SELECT s.*, t.source_size, t.target, t.turn,
         CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY digest, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_it
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, words1 + words2 AS taken,
       CASE WHEN words1 > 0 THEN round({_due('before_it / target')}, 6) END AS first_position,
       CASE WHEN words2 > 0 THEN round({_due('(before_it + source_size) / target')}, 6) END AS second_position
FROM (SELECT *, greatest(0, least(size, CAST(round(target) AS BIGINT) - before_it)) AS words1,
             greatest(0, least(size, CAST(round(target) AS BIGINT) - before_it - source_size)) AS words2 FROM line)
"""

QUALITY = rf"""
WITH words AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w,
                      row_number() OVER () AS r FROM documents),
windows AS (
  SELECT r, i, hash3, count(*) OVER (PARTITION BY r, hash3) AS n FROM (
    SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS hash3
    FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words))
),
repeated AS (
  SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest([0, 1, 2]) AS k FROM windows WHERE n > 1) GROUP BY r
),
measured AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM words)
  LEFT JOIN repeated USING (r)
),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, n_symbols > n_words, word_chars > 40 * n_words]) AS failed,
         unnest([1, 2, 3, 4]) AS rule
  FROM measured
),
hosts AS (
  SELECT source, rule, count(*) AS docs, CAST(sum(failed::INT) AS DOUBLE) AS f FROM judged GROUP BY source, rule
),
priors AS (
  SELECT rule, sum(f) / sum(docs) AS mean, sum(f) / sum(docs) * (1 - sum(f) / sum(docs)) AS noise,
         (sum(f * f / docs) - sum(f) * sum(f) / sum(docs)
          - (count(*) - 1) * (sum(f) / sum(docs)) * (1 - sum(f) / sum(docs)))
         / nullif(sum(docs) - sum(docs::DOUBLE * docs) / sum(docs), 0) AS variance
  FROM hosts GROUP BY rule
),
verdicts AS (
  SELECT source, max(CASE WHEN variance > 0
                          THEN (f + greatest(1, noise / variance - 1) * mean) / (docs + greatest(1, noise / variance - 1))
                          ELSE mean END) > 0.5 AS host_failed
  FROM hosts JOIN priors USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
WHERE rule = 1
"""

VECTORS = """
WITH RECURSIVE nodes AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
),
links AS (
  SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y
  ON x.id <> y.id AND list_dot_product(x.v, y.v) >= 0.95 * sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v))
),
reach(id, other) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a
)
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, min(other) AS component_id, id = min(other) AS kept
FROM reach GROUP BY id
"""

DOCUMENTS = r"""
WITH RECURSIVE words AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
links AS (
  SELECT p.a, p.b FROM (
    SELECT x.id AS a, y.id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.id <> y.id
    GROUP BY x.id, y.id) p
  JOIN sizes sa ON sa.id = p.a JOIN sizes sb ON sb.id = p.b
  WHERE 100 * p.n >= 75 * (sa.n + sb.n - p.n)
),
reach(id, other) AS (
  SELECT id, id FROM words
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a
)
SELECT r.id AS doc_id, coalesce(max(s.n), 0) AS n_shingles, min(other) AS component_id, r.id = min(other) AS kept
FROM reach r LEFT JOIN sizes s ON s.id = r.id GROUP BY r.id
"""

# ---- licenses --------------------------------------------------------------------------------------------


def _values(rows) -> str:
    quoted = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in rows)


def _licenses() -> str:
    texts = {name: b" ".join(lic.license_words(text)).decode() for name, (_, text) in lic.TEMPLATES.items()}
    names = _values((name, label, texts[name]) for name, (label, _) in lic.TEMPLATES.items())
    gram = lambda words, at: " || ' ' || ".join(f"{words}[{at} + {k}]" for k in range(lic.GRAM))
    phrases = _values((phrase, label) for phrase, label in lic.PHRASES.items())
    return rf"""
WITH read AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
phrases AS (SELECT string_split(p, ' ') AS pw, label FROM (VALUES {phrases}) v(p, label)),
base AS (
  SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list_distinct(list(label)) AS labels FROM (
    SELECT r, label, i FROM (SELECT r, w, unnest(range(len(w))) AS i FROM read) JOIN phrases ON w[i + 1] = pw[1]
    WHERE list_slice(w, i + 1, i + len(pw)) = pw)
  GROUP BY r
),
templates AS (SELECT name, label, string_split(t, ' ') AS tw FROM (VALUES {names}) v(name, label, t)),
sizes AS (SELECT *, len(tw) - {lic.GRAM - 1} AS n_grams, greatest(1, least({lic.MOST_SHIFT}, len(tw) // 8)) AS shift FROM templates),
windows AS (SELECT name, q, {gram('tw', 'q + 1')} AS g FROM (SELECT name, tw, unnest(range(len(tw) - {lic.GRAM - 1})) AS q FROM templates)),
rolled AS (SELECT r, p, {gram('w', 'p + 1')} AS g FROM (SELECT r, w, unnest(range(len(w) - {lic.GRAM - 1})) AS p FROM read)),
votes AS (SELECT r, name, p - q AS d, q FROM rolled JOIN windows USING (g)),
stepped AS (
  SELECT r, name, d, CASE WHEN d - lag(d) OVER (PARTITION BY r, name ORDER BY d) > shift THEN 1 ELSE 0 END AS new
  FROM (SELECT DISTINCT r, name, d FROM votes) JOIN sizes USING (name)
),
runs AS (SELECT r, name, d, sum(new) OVER (PARTITION BY r, name ORDER BY d) AS run FROM stepped),
proposed AS (
  SELECT r, name, run, any_value(n_grams) AS n_grams FROM votes JOIN runs USING (r, name, d) JOIN sizes USING (name)
  GROUP BY r, name, run HAVING count(DISTINCT q) >= {lic.LEAST_VOTES} * any_value(n_grams)
),
held AS (
  SELECT r, name, run, d, q FROM (
    SELECT r, name, run, d, tw, w, unnest(range(len(tw))) AS q
    FROM proposed JOIN runs USING (r, name, run) JOIN templates USING (name) JOIN read USING (r))
  WHERE q + d >= 0 AND tw[q + 1] = w[q + d + 1]
),
spans AS (
  SELECT r, name, run, count(DISTINCT q) / any_value(len(tw))::DOUBLE AS share, any_value(label) AS label
  FROM held JOIN templates USING (name) GROUP BY r, name, run
),
more AS (SELECT r, list_distinct(list(label)) AS labels, max(share) AS share FROM spans WHERE share >= {lic.LEAST_SHARE} GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(more.share, 0.0::DOUBLE) END AS score
FROM read LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""


LICENSES = _licenses()

FILL_IN_MIDDLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
),
drawn AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
),
parts AS (
  SELECT *, array_to_string(list_slice(u, 1, least(x, y)), '') AS p,
         array_to_string(list_slice(u, least(x, y) + 1, greatest(x, y)), '') AS m,
         array_to_string(list_slice(u, greatest(x, y) + 1, len(u)), '') AS s
  FROM drawn
)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

# ---- manifest --------------------------------------------------------------------------------------------

#: CRC-32 of the decimal doc_id: each byte is added, then shifted out in eight steps (marked -1).
_CRC32 = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
  string_split(l.doc_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END))"""

#: Levels of the SQL below: groups of up to 8^LEVELS rows.
_LEVELS = 9


def _digest_sql(text: str) -> str:
    parts = [f"coalesce(octet_length(encode({x}))::VARCHAR || ':' || {x}, '-')" for x in
             ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(parts)})"


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs with the nodes (g, i, d) of each level, their siblings left and right, and the roots of all groups."""
    found = [f"{name}0 AS MATERIALIZED (SELECT g, i, d, count(*) OVER (PARTITION BY g) AS n FROM {leaves})"]
    for k in range(_LEVELS):
        found.append(
            f"{name}s{k} AS MATERIALIZED (SELECT g, i, coalesce(string_agg(d, '') OVER "
            "(PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, "
            "coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND "
            f"UNBOUNDED FOLLOWING), '') AS b FROM {name}{k} WHERE n > 1)"
        )
        found.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT g, i // 8 AS i, CASE WHEN any_value(n) > 1 THEN "
            "sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d, (any_value(n) + 7) // 8 AS n "
            f"FROM {name}{k} GROUP BY g, i // 8)"
        )
    return ",\n".join(found)


def _merkle() -> str:
    power = [8**k for k in range(_LEVELS)]
    joins = " ".join(f"LEFT JOIN t{'s'}{k} t{k}_ ON t{k}_.g = l.g AND t{k}_.i = l.i // {power[k]}" for k in range(_LEVELS))
    joins += " JOIN tops ON tops.lg = l.g "
    joins += " ".join(f"LEFT JOIN us{k} u{k}_ ON u{k}_.i = tops.i // {power[k]}" for k in range(_LEVELS))
    steps = [f"{x}{k}_" for x in "tu" for k in range(_LEVELS)]
    proof = " || ".join(f"coalesce({s}.a || {s}.b, '')" for s in steps)
    folds, previous = [], "start"
    for at, s in enumerate(steps):
        folds.append(f"f{at} AS (SELECT *, CASE WHEN a{at} IS NULL THEN {previous} ELSE sha256(a{at} || {previous} || b{at}) "
                     f"END AS x{at} FROM {f'f{at - 1}' if at else 'walked'})")  # fmt: skip
        previous = f"x{at}"
    sides = ", ".join(f"{s}.a AS a{at}, {s}.b AS b{at}" for at, s in enumerate(steps))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_digest_sql('text')} AS d, {_digest_sql(lowered)} AS lower_d FROM documents
),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM hashed
),
{_tree_sql('t', 'leaves')},
subroots AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, d, g AS lg FROM t{_LEVELS}),
{_tree_sql('u', '(SELECT g, i, d FROM subroots)')},
tops AS MATERIALIZED (SELECT s.lg, s.i, s.d AS subroot, u.d AS root FROM subroots s, u{_LEVELS} u),
walked AS (
  SELECT l.doc_id, l.d AS leaf, tops.subroot, tops.root, sha256({proof}) AS proof_sha256,
         CASE WHEN {_CRC32} % 3 = 0 THEN l.lower_d ELSE l.d END AS start, {sides}
  FROM leaves l {joins}
),
{', '.join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, {previous} AS folded_root, {previous} = root AS verified FROM f{len(steps) - 1}
"""


MERKLE = _merkle()
