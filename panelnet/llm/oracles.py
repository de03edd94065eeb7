"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

import re

from panelnet.llm import licenses
from panelnet.llm.quality_rules import STOP_WORDS, THRESHOLDS

_stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))
_verdict = " AND ".join(
    [f"100 * {num} >= {low} * {den}" for _, num, den, low, _h in THRESHOLDS if low is not None]
    + [f"100 * {num} <= {high} * {den}" for _, num, den, _l, high in THRESHOLDS if high is not None]
)
_words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_words} AS w FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) AS o(j) GROUP BY r),
c AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x : x IN ({_stop})))::BIGINT AS n_stop,
    length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclaimed,
    len(l)::BIGINT AS n_lines
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x : regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d) d LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND {_verdict} AS kept FROM f
"""

OP10 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i : w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
inter_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM inter_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.b FROM reach r JOIN edge e ON e.a = r.y)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.y)::BIGINT AS component_id, d.doc_id = min(r.y) AS kept
FROM d JOIN reach r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""



def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _steps(c: str, steps) -> str:
    for pattern, new in steps:
        c = f"regexp_replace({c}, {_text(pattern)}, {_text(re.sub(r'[$]([0-9])', chr(92) + chr(92) + '1', new))}, 'g')"
    return c


def _licenses() -> str:
    """Each rule is laid at each place of a sequence; from the first match on, each one names the next that it leaves free."""
    known = ", ".join(f"({_text(s)}, {_text(i)})" for s, i in licenses.KNOWN.items())
    rules = ", ".join(f"([{', '.join(map(_text, rule))}], {_text(name)})" for rule, name in licenses.RULES.items())
    some = " OR ".join(f"contains(lower(coalesce(text, '')), {_text(x)})" for x in licenses.TRIGGERS)
    cut = f"list_filter(list_transform(string_split({_steps('x', licenses.STEPS_ENDS)}, chr(1)), lambda s : {_steps('lower(s)', licenses.STEPS_SENTENCE)}), lambda s : s <> '')"
    return f"""
WITH RECURSIVE k(s, id) AS (VALUES {known}), m AS MATERIALIZED (SELECT map(list(s), list(id)) AS m FROM k), rules(run, name) AS (VALUES {rules}),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, CASE WHEN {some} THEN {_steps("chr(10) || text || chr(10)", licenses.STEPS_TAGS)} END AS t FROM documents),
forms AS (SELECT r, 'j' AS form, {_steps("t", licenses.STEPS_JOINED)} AS x FROM docs WHERE t IS NOT NULL
  UNION ALL SELECT r, 'l', {_steps("t", licenses.STEPS_LINES)} FROM docs WHERE t IS NOT NULL),
seqs AS MATERIALIZED (SELECT r, form, list_transform({cut}, lambda s : coalesce(m[s], '')) AS ids FROM forms, m),
held AS (SELECT r, form, list_filter(ids, lambda i : i <> '') AS ids FROM seqs),
shown AS (SELECT r, CASE WHEN len(l.ids) > len(j.ids) THEN l.ids ELSE j.ids END AS ids FROM (SELECT * FROM held WHERE form = 'j') j JOIN (SELECT * FROM held WHERE form = 'l') l USING (r)),
places AS (SELECT r, form, ids, unnest(range(1, len(ids) + 1)) AS i FROM seqs WHERE len(list_filter(ids, lambda i : i <> '')) > 0),
hits AS (SELECT r, form, i, max(len(run)) AS n, arg_max(name, len(run)) AS name FROM places JOIN rules ON ids[i] = run[1] AND list_slice(ids, i, i + len(run) - 1) = run GROUP BY r, form, i),
after AS (SELECT a.r, a.form, a.i, any_value(a.name) AS name, min(b.i) AS next FROM hits a LEFT JOIN hits b ON b.r = a.r AND b.form = a.form AND b.i >= a.i + a.n GROUP BY a.r, a.form, a.i),
walk AS (SELECT r, form, min(i) AS i FROM hits GROUP BY r, form UNION ALL SELECT w.r, w.form, a.next FROM walk w JOIN after a ON a.r = w.r AND a.form = w.form AND a.i = w.i WHERE a.next IS NOT NULL),
found AS (SELECT r, list_sort(list(DISTINCT name)) AS names FROM walk JOIN after USING (r, form, i) GROUP BY r)
SELECT doc_id, coalesce(array_to_string(s.ids, ','), '') AS sentence_ids, coalesce(len(s.ids), 0)::BIGINT AS n_sentences, coalesce(array_to_string(f.names, ','), '') AS licenses
FROM docs LEFT JOIN shown s USING (r) LEFT JOIN found f USING (r)
"""


ORACLES = {"op3_license_sentences": _licenses(), "op8_quality_rules": OP8, "op10_minhash_near_dedup": OP10}
