"""DuckDB SQL for the queries whose results SQL can express, written apart from the operators."""

from bourse.llm.license_scan import ANCHORS, MET, SHORT, SIZES, TEMPLATES, Templates, step_of
from bourse.llm.quality import BASE, CURRENT, RULES, UNSPACED, mask_of

_WORD = r"[^\x20\x09-\x0D]+"

EXACT = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
WINDOW same AS (PARTITION BY body)
"""

LINES = r"""
WITH split AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
windows AS (
  SELECT doc_id, p AS pos, lines[p + 1] || chr(10) || lines[p + 2] || chr(10) || lines[p + 3] AS win
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS p FROM split WHERE len(lines) >= 3)
),
later AS (
  SELECT doc_id, pos FROM windows WHERE regexp_matches(win, '[^\x20\x09-\x0D]')
  QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, pos) > 1
),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (SELECT unnest(range(0, 3)) AS k)),
numbered AS (SELECT doc_id, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line FROM split),
left_over AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.pos) AS body FROM numbered n ANTI JOIN gone g ON n.doc_id = g.doc_id AND n.pos = g.pos GROUP BY 1
),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT s.doc_id, CASE WHEN r.n IS NULL THEN s.text ELSE coalesce(l.body, '') END AS text, len(s.lines) AS n_lines, coalesce(r.n, 0) AS n_removed
FROM split s LEFT JOIN left_over l USING (doc_id) LEFT JOIN removed r USING (doc_id)
"""

_KNOWN = Templates()
_TEMPLATES = ", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(TEMPLATES))
_LADDER = f"WHEN len(ws) <= {SHORT} THEN len(ws) " + " ".join(f"WHEN {5 * s // 6} >= len(ws) THEN {s}" for s in SIZES)
_ANCHORS = ", ".join(f"'{w}'" for w in ANCHORS)
_CUTS = " UNION ALL ".join(f"SELECT path, {s} AS size, k AS pos, ws[k * {step_of(s)} + 1 : k * {step_of(s)} + {s}] AS ws FROM (SELECT path, ws, unnest(range(0, ceil(greatest(len(ws) - {s}, 0) / {step_of(s)})::BIGINT + 1)) AS k FROM held)" for s in _KNOWN.sizes)
LICENCES = rf"""
WITH templates(id, license, body) AS (VALUES {_TEMPLATES}),
tl AS (SELECT id, license, regexp_extract_all(lower(body), '[a-z0-9]+(?:\.[0-9]+)*') AS ws FROM templates),
ts AS (SELECT id, license, ws, CASE {_LADDER} ELSE {SIZES[-1]} END AS tsize FROM tl),
tw AS (SELECT id, license, tsize, w, count(*) AS n FROM (SELECT id, license, tsize, unnest(ws) AS w FROM ts) GROUP BY ALL),
idf AS (SELECT w, ln((1 + (SELECT count(*) FROM templates)) / (1 + count(*))) + 1 AS idf FROM tw GROUP BY w),
unseen AS (SELECT ln((1 + count(*)) / 2) + 1 AS idf FROM templates),
tv AS (SELECT id, license, tsize, w, (1 + ln(n)) * idf AS x FROM tw JOIN idf USING (w)),
unit AS (SELECT id, license, tsize, w, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS u FROM tv),
files AS (
  SELECT doc_id, text, source || '/' || regexp_replace(left(doc_id::VARCHAR, length(doc_id::VARCHAR) - 1), '(.)', '\1/', 'g') || doc_id::VARCHAR AS path FROM documents
),
texts AS (SELECT path, lower(coalesce(text, '')) AS low, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:\.[0-9]+)*') AS ws FROM files),
held AS (SELECT * FROM texts WHERE list_has_any(ws, [{_ANCHORS}])),
units AS (
  SELECT path, 0 AS size, k AS pos, regexp_extract_all(ls[k + 1], '[a-z0-9]+(?:\.[0-9]+)*') AS ws FROM (SELECT path, ls, unnest(range(0, len(ls))) AS k FROM (SELECT path, string_split(low, chr(10)) AS ls FROM held))
  UNION ALL SELECT path, -1, 0, ws FROM held UNION ALL {_CUTS}
),
anchored AS (SELECT path, size, pos, unnest(ws) AS w FROM units WHERE list_has_any(ws, [{_ANCHORS}])),
lw AS (SELECT path, size, pos, w, count(*) AS n FROM anchored GROUP BY ALL),
lv AS (SELECT path, size, pos, w, (1 + ln(n)) * coalesce(i.idf, u.idf) AS x FROM lw LEFT JOIN idf i USING (w), unseen u),
norm AS (SELECT path, size, pos, sqrt(sum(x * x)) AS norm FROM lv GROUP BY ALL),
scored AS (
  SELECT path, size, pos, id, license, round(sum(x * u) / any_value(norm), 6) AS score FROM lv JOIN unit USING (w) JOIN norm USING (path, size, pos)
  WHERE size <= 0 OR size = tsize GROUP BY ALL HAVING round(sum(x * u) / any_value(norm), 6) >= {_KNOWN.threshold} AND count(*) >= {MET}
),
own AS (SELECT path, license, score FROM scored QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
granted AS (
  SELECT dir, license, score FROM (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, license, score FROM own) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1
),
near AS (
  SELECT f.path, g.dir, g.license, g.score
  FROM (SELECT DISTINCT path, regexp_replace(path, '/?[^/]*$', '') AS home FROM files) f JOIN granted g ON f.home = g.dir OR starts_with(f.home, g.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(g.dir) DESC) = 1
)
SELECT f.doc_id, f.path, coalesce(o.license, n.license) AS license, coalesce(o.score, n.score) AS score, o.license IS NULL AND n.dir IS NOT NULL AS inherited,
       CASE WHEN o.license IS NOT NULL THEN regexp_replace(f.path, '/?[^/]*$', '') ELSE n.dir END AS from_dir
FROM files f LEFT JOIN own o USING (path) LEFT JOIN near n USING (path)
"""

_SOLE = " ".join(f"WHEN {1 << r.bit} THEN '{r.name}'" for r in RULES if r.name in CURRENT.rules)
_UNSPACED = "[" + "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in UNSPACED) + "]"
QUALITY = rf"""
WITH cut AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM cut WHERE len(words) >= 8)
),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 8)) AS k) GROUP BY 1),
measured AS (
  SELECT c.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words,
         len(lines) AS n_lines, len(regexp_extract_all(coalesce(text, ''), '[A-Z]')) AS n_capitals,
         len(regexp_extract_all(coalesce(text, ''), '{_UNSPACED}')) AS n_unspaced
  FROM cut c LEFT JOIN covered v USING (doc_id)
),
judged AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
           + CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_symbols > 10 * n_words THEN 8 ELSE 0 END
           + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END + CASE WHEN 100 * n_capitals > 50 * word_chars THEN 32 ELSE 0 END
           + CASE WHEN word_chars < 2 * n_words OR (word_chars > 12 * n_words AND 2 * n_unspaced <= word_chars) THEN 64 ELSE 0 END)::BIGINT AS failed
  FROM measured
),
sole AS (SELECT *, CASE failed & {mask_of(CURRENT)} {_SOLE} END AS only_rule FROM judged)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {mask_of(BASE)} <> 0 AS base_failed, failed & {mask_of(CURRENT)} = 0 AS kept, failed, only_rule,
       CASE WHEN only_rule IS NOT NULL THEN count(*) OVER (PARTITION BY only_rule) END AS n_only_rule
FROM sole
"""

PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM cut),
said AS (
  SELECT lang, 1 AS k, w[i] AS phrase FROM placed
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM placed WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM placed WHERE i + 2 <= len(w)
),
f AS (SELECT lang, k, phrase, count(*) AS n FROM said GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
inside AS (
  SELECT lang, phrase, max(a) AS most FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY ALL
),
kept AS (SELECT c.* FROM c LEFT JOIN inside i USING (lang, phrase) WHERE i.most IS NULL OR 100 * i.most < 50 * c.a),
cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1 : j], ' ') AS x, array_to_string(w[j + 1 :], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, j, fx.n AS l, fy.n AS r, ((1000000::HUGEINT * a * a) // (fx.n::HUGEINT * fy.n))::BIGINT AS score
  FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y
),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT r.lang, rank, phrase, a, l, r.r, t.n, score FROM ranked r JOIN total t USING (lang) WHERE rank <= 2000
"""


def _rounds(rounds: int) -> str:
    """Tables a0, b1, a1, ... : nearest entries (packed as distance * 64 + entry), and the books that follow from them."""
    sql = ""
    for k in range(rounds + 1):
        sql += f"""
a{k} AS (
  SELECT v.vec_id, v.p, min(list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))::BIGINT * 64 + b.e) AS m
  FROM parts v JOIN b{k} b USING (p) GROUP BY ALL
),"""
        if k < rounds:
            sql += f"""
s{k} AS (
  SELECT p, e, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x
  FROM (SELECT a.p, a.m % 64 AS e, unnest(range(1, len(v.x) + 1)) AS i, unnest(v.x) AS x FROM a{k} a JOIN parts v USING (vec_id, p)) GROUP BY ALL
),
n{k} AS (SELECT p, e, list(x ORDER BY i) AS x FROM s{k} GROUP BY ALL),
b{k + 1} AS (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN n{k} n USING (p, e)),"""
    return sql


VECTORS = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (SELECT vec_id, p, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS x FROM (SELECT *, unnest(range(0, 16)) AS p FROM kept)),
b0 AS (SELECT p, e, x FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),{_rounds(2)}
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS digest FROM b2),
coded AS (SELECT vec_id, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM a2 GROUP BY 1)
SELECT c.vec_id, code, error, sum(error) OVER (PARTITION BY k.label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM coded c JOIN kept k USING (vec_id), book
"""

ORACLES: dict[str, str] = {"op2_line_dedup": LINES, "op3_license_scan": LICENCES, "op7_quality_ledger": QUALITY, "op9_exact_dedup": EXACT, "op11_phrase_collocations": PHRASES, "op13_vector_codes": VECTORS}
