"""SQL of the derived inputs, shared by the reference SQL of many queries."""

from veilscan.functions.rules import ADDRESS, NEGATED, RULES
from veilscan.plans.registry import part
from veilscan.sources.planted import HEAD, N_ATTACK, PHRASE_TYPES, PHRASES

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# The address-to-an-assistant rule looks behind; here it takes the sentence end along and trims it off.
RE2 = {"R-AI-1": lambda p: p.replace(r"(?:^|(?<=[.!?]\s))", r"(?:^|[.!?]\s)")}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def pattern(rule) -> str:
    return "(?im)" + RE2.get(rule.id, lambda p: p)(rule.pattern)


def values(rows) -> str:
    return ", ".join("(" + ", ".join(r) + ")" for r in rows)


part("phrases", "SELECT * FROM (VALUES " + values(
    [(str(i), lit(p), lit(PHRASE_TYPES[i]) if i < N_ATTACK else "NULL") for i, p in enumerate(PHRASES)]) +
    ") t(no, phrase, type)")

part("planted", f"""
SELECT d.doc_id, d.lang, d.n_chars, CAST(d.doc_id % 20 AS INTEGER) AS phrase_no, d.phrase2_no, d.source, d.plant,
  CASE WHEN d.plant IS NULL THEN d.head || d.text WHEN d.slot = 0 THEN d.head || d.text || chr(10) || chr(10) || d.plant
       ELSE d.head || d.plant || chr(10) || chr(10) || d.text END AS text,
  CASE WHEN d.doc_id % 20 < {N_ATTACK} OR coalesce(d.phrase2_no < {N_ATTACK}, FALSE) THEN 1::BIGINT ELSE 0::BIGINT END AS label,
  CASE WHEN d.plant IS NULL THEN NULL WHEN d.slot = 0 THEN length(d.head) + length(d.text) + 2
       ELSE length(d.head) END AS span_start,
  CASE WHEN d.plant IS NULL THEN NULL WHEN d.slot = 0 THEN length(d.head) + length(d.text) + 2
       ELSE length(d.head) END + length(d.plant) AS span_end
FROM (SELECT x.*, CASE WHEN a.phrase IS NOT NULL AND b.phrase IS NOT NULL THEN a.phrase || ' ' || b.phrase
                       ELSE coalesce(a.phrase, b.phrase) END AS plant
      FROM (SELECT doc_id, text, lang, n_chars,
              CASE WHEN doc_id % 3 = 0 THEN CAST((doc_id // 3) % 18 AS INTEGER) END AS phrase2_no,
              CASE WHEN doc_id % 37 = 0 THEN NULL WHEN (doc_id + doc_id // 20) % 4 = 0 THEN 'email'
                   WHEN (doc_id + doc_id // 20) % 4 = 1 THEN 'document'
                   WHEN (doc_id + doc_id // 20) % 4 = 2 THEN 'web' ELSE 'user' END AS source,
              CASE WHEN (doc_id + doc_id // 20) % 4 = 0 AND (doc_id // 4) % 2 = 0 THEN {lit(HEAD)} ELSE '' END AS head,
              (doc_id // 20) % 2 AS slot FROM documents) x
      LEFT JOIN phrases a ON a.no = x.doc_id % 20
      LEFT JOIN phrases b ON b.no = x.phrase2_no) d
""", ["phrases"])

part("rules", "SELECT * FROM (VALUES " + values(
    [(str(i), lit(r.id), lit(r.type), lit(r.strength), str(r.outside_only).upper(), lit(pattern(r)))
     for i, r in enumerate(RULES)]) + ") t(rule_no, rule, type, strength, outside_only, pattern)")

# Matches with positions: marks round every match, then cumulative lengths of the pieces.
part("marked", """
SELECT p.doc_id, p.source, r.rule_no, r.rule, r.type, r.strength, p.text AS full_text,
       string_split(regexp_replace(p.text, r.pattern, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS pieces
FROM planted p JOIN rules r ON regexp_matches(p.text, r.pattern)
WHERE NOT (r.outside_only AND coalesce(p.source, '') = 'user')
""", ["planted", "rules"])

part("hits", f"""
SELECT doc_id, source, rule_no, rule, type, strength, CAST(s AS BIGINT) AS s, CAST(s + length(hit) AS BIGINT) AS e, hit FROM (
  SELECT doc_id, source, rule_no, rule, type, strength, full_text, pos0 + length(m) - length(ltrim(m, lead)) AS s, trim(m, lead) AS hit
  FROM (SELECT *, split_part(piece, chr(2), 1) AS m, {WS} || CASE WHEN rule = 'R-AI-1' THEN '.!?' ELSE '' END AS lead,
          coalesce(sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY doc_id, rule ORDER BY i
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0
        FROM (SELECT * EXCLUDE (pieces), unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM marked))
  WHERE i > 1)
WHERE NOT (type = 'credential_theft' AND regexp_matches(
  substr(full_text, CAST(greatest(s - 20, 0) + 1 AS BIGINT), CAST(least(s, 20) AS BIGINT)), {lit('(?i)' + NEGATED)}))
""", ["marked"])

SENT = r"([.!?]+[\"'')\]]*)(\s)"
HEADER = r"^\n*(?:[ \t\r\f\v]*[A-Za-z][A-Za-z-]{0,30}:[ \t][^\n]*(?:\n+|$))+"
# Sentences: ends are marked first, then marks after list numbers, initials and abbreviations are taken back.
part("unit_pieces", f"""
SELECT doc_id, source, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM (
  SELECT doc_id, source, list_concat([head], string_split(
    regexp_replace(regexp_replace(replace(body, chr(10), chr(10) || chr(1)), '{SENT}', '\\1' || chr(1) || '\\2', 'g'),
      '((?:^|[\\s\\x01])(?:\\d{{1,3}}|[A-Za-z]|e\\.g|i\\.e|etc|Mr|Mrs|Ms|Dr|vs|No)\\.)\\x01', '\\1', 'g'), chr(1))) AS pieces
  FROM (SELECT doc_id, source, head, substr(text, length(head) + 1) AS body FROM (
    SELECT doc_id, source, text, CASE WHEN source = 'email' THEN regexp_extract(text, '{HEADER}') ELSE '' END AS head
    FROM planted)))
""", ["planted"])

part("units", f"""
SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS unit_no, s, s + length(t) AS e, t AS text FROM (
  SELECT doc_id, source, i, CAST(pos0 + length(piece) - length(ltrim(piece, {WS})) AS BIGINT) AS s, trim(piece, {WS}) AS t FROM (
    SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0 FROM unit_pieces))
WHERE t <> ''
""", ["unit_pieces"])

part("eval_items", """
SELECT p.doc_id, p.source, p.text, p.label, p.n_chars, p.span_start, p.span_end,
  CASE WHEN label = 1 THEN CASE WHEN p.doc_id % 7 <= 1 THEN 'mail_labelled' WHEN p.doc_id % 7 = 2 THEN 'mail_groups'
         WHEN p.doc_id % 7 <= 4 THEN 'pair_attack' WHEN p.doc_id % 7 = 5 THEN 'planted_inbox' ELSE 'planted_thread' END
       ELSE CASE p.doc_id % 3 WHEN 0 THEN 'mail_benign' WHEN 1 THEN 'pair_benign' ELSE 'work_benign' END END AS set_name,
  'family-' || (p.doc_id % 12) AS grp, a.type AS type1, CASE WHEN b.type IS DISTINCT FROM a.type THEN b.type END AS type2
FROM planted p LEFT JOIN phrases a ON a.no = p.phrase_no LEFT JOIN phrases b ON b.no = p.phrase2_no
""", ["planted", "phrases"])

part("attacks", "SELECT doc_id, rule, type, s, e FROM hits WHERE strength = 'strong'", ["hits"])

part("results", """
SELECT r.*, CASE WHEN lane <> 'clean' THEN 1 ELSE 0 END AS judge_calls,
  CASE WHEN lane <> 'clean' THEN 1 + doc_id % 2 ELSE 0 END AS sandbox_calls,
  CASE WHEN lane <> 'clean' THEN doc_id % 29 <> 0 END AS judge_ok,
  CASE WHEN lane <> 'clean' THEN doc_id % 31 = 0 END AS judge_took_over,
  lane <> 'clean' AND doc_id % 43 = 0 AS sandbox_error, lane <> 'clean' AND doc_id % 5 = 0 AS sandbox_acted,
  lane <> 'clean' AND doc_id % 3 = 0 AS by_judge, CASE WHEN lane <> 'clean' THEN doc_id % 4 ELSE 0 END AS cleared
FROM (
  SELECT i.*, i.n_chars AS ms, (i.doc_id * 37 % 101) / 100.0::DOUBLE AS score_a, (i.doc_id * 53 % 101) / 100.0::DOUBLE AS score_b,
    CASE WHEN i.doc_id % 53 = 0 THEN 'Timeout' END AS error,
    CASE WHEN i.doc_id % 53 = 0 THEN NULL WHEN coalesce(h.n_strong, 0) > 0 AND i.doc_id % 41 = 0 THEN 'quarantine'
         WHEN coalesce(h.n_strong, 0) > 0 THEN 'sanitise' ELSE 'allow' END AS verdict,
    CASE WHEN h.doc_id IS NULL THEN 'clean' WHEN h.n_strong > 0 AND (i.doc_id * 37 % 101) / 100.0::DOUBLE >= 0.65
         THEN 'clear_attack' ELSE 'unsure' END AS lane, coalesce(h.n_strong, 0) AS n_attacks
  FROM eval_items i LEFT JOIN (
    SELECT doc_id, count(*) FILTER (WHERE strength = 'strong') AS n_strong FROM hits GROUP BY doc_id) h USING (doc_id)) r
""", ["eval_items", "hits"])


# Evidence from the rules alone --------------------------------------------------------------------
part("unit_marks", """
SELECT u.doc_id, u.unit_no, u.s, u.e, u.text, coalesce(bool_or(h.strength = 'strong'), FALSE) AS bad,
  coalesce(bool_or(h.strength = 'weak'), FALSE) AS weak
FROM units u LEFT JOIN hits h ON h.doc_id = u.doc_id AND h.s < u.e AND u.s < h.e GROUP BY ALL
""", ["units", "hits"])

part("spans", """
SELECT doc_id, min(s) AS s, max(e) AS e FROM (
  SELECT *, unit_no - row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) AS island FROM (
    SELECT *, bad OR (weak AND (coalesce(lag(bad) OVER w, FALSE) OR coalesce(lead(bad) OVER w, FALSE))) AS flagged
    FROM unit_marks WINDOW w AS (PARTITION BY doc_id ORDER BY unit_no)) WHERE flagged) GROUP BY doc_id, island
""", ["unit_marks"])

part("span_hits", """
SELECT p.doc_id, p.s, p.e, h.rule_no, h.rule, h.type, h.strength, h.s AS hit_s FROM spans p
JOIN hits h ON h.doc_id = p.doc_id AND h.s < p.e AND p.s < h.e
""", ["spans", "hits"])

part("span_facts", """
SELECT doc_id, s, e, bool_or(strength = 'strong') AS strong_rule,
  coalesce((SELECT string_agg(type, ',' ORDER BY first_at) FROM (SELECT type, min(rule_no * 1000000 + hit_s) AS first_at FROM span_hits y
     WHERE y.doc_id = x.doc_id AND y.s = x.s AND type <> 'indirect_injection' GROUP BY type)), '') AS types,
  string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules
FROM span_hits x GROUP BY doc_id, s, e
""", ["span_hits"])

# Payload sweep: addresses in a cut that also stand elsewhere, widened to their sentence or header line.
part("sweep_spots", """
SELECT c.doc_id, c.types, c.pos, c.pos + length(c.addr) AS pos_end, p.text FROM (
  SELECT doc_id, types, addr, list_sum(list_transform(pieces[1:k], lambda x: length(x)))::BIGINT + (k - 1) * length(addr) AS pos FROM (
    SELECT doc_id, types, addr, pieces, unnest(range(1, len(pieces))) AS k FROM (
      SELECT f.doc_id, f.types, a.addr, string_split(lower(p.text), lower(a.addr)) AS pieces
      FROM span_facts f JOIN planted p USING (doc_id),
        LATERAL (SELECT DISTINCT unnest(regexp_extract_all(substr(p.text, f.s + 1, f.e - f.s),
          '[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+|https?://[^\\s"''<>)]+')) AS addr) a))) c JOIN planted p USING (doc_id)
WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = c.doc_id AND s.s <= c.pos AND c.pos < s.e)
""", ["span_facts", "planted", "spans"])

part("sweeps", """
SELECT doc_id, types, CASE WHEN n = 1 AND multi THEN pos - length(regexp_extract(substr(text, 1, pos), '[^\n]*$')) ELSE least(lo, pos) END AS s,
  CASE WHEN n = 1 AND multi THEN pos_end + length(regexp_extract(substr(text, pos_end + 1), '^[^\n]*')) ELSE greatest(hi, pos_end) END AS e
FROM (SELECT w.doc_id, w.types, w.pos, w.pos_end, w.text, count(*) AS n, min(u.s) AS lo, max(u.e) AS hi,
        contains(substr(any_value(w.text), min(u.s) + 1, max(u.e) - min(u.s)), chr(10)) AS multi
      FROM sweep_spots w JOIN units u ON u.doc_id = w.doc_id AND u.s < w.pos_end AND w.pos < u.e GROUP BY ALL)
""", ["sweep_spots", "units"])

part("cuts", """
SELECT doc_id, s, e, types, 'rules' AS found_by, rules, strong_rule FROM span_facts
UNION ALL SELECT DISTINCT doc_id, s, e, types, 'payload sweep', '', FALSE FROM sweeps
""", ["span_facts", "sweeps"])

part("kept", """
SELECT doc_id, k, prev AS a, s AS b, substr(text, prev + 1, s - prev) AS piece, label FROM (
  SELECT c.doc_id, row_number() OVER w AS k, coalesce(lag(c.e) OVER w, 0) AS prev, c.s, p.text,
    '[removed: ' || coalesce(nullif(replace(replace(c.types, ',', ', '), '_', ' '), ''), 'suspected injection') || ']' AS label
  FROM cuts c JOIN planted p USING (doc_id) WINDOW w AS (PARTITION BY c.doc_id ORDER BY c.s))
UNION ALL
SELECT c.doc_id, count(*) + 1, max(c.e), length(any_value(p.text)), substr(any_value(p.text), max(c.e) + 1), '' FROM cuts c JOIN planted p USING (doc_id) GROUP BY c.doc_id
""", ["cuts", "planted"])
