"""DuckDB twins of the registered queries (tables are pre-registered views).

Written as plain SQL against the driver tables; only the fixed values
(taxonomy, context, merge list, prompt wording) are shared with the Spark side.
"""

from __future__ import annotations

from ..operators import prompts as P
from ..operators.consolidate import SUMMARY_PREFIX
from ..operators.deciders import NO_MATCH_REASON
from ..operators.responses import FAILED_REASON
from ..operators.taxonomy import MIN_BUCKET, STOP_WORDS, Taxonomy
from .catalog import (
    CONTEXT, GROUP_ROWS, MAX_FLAGS, MERGE_AT, MERGES, MODE, PROFILE_OVERLAP, REPLAY_FAILED, SIMILARITY,
)

# Python str.strip() whitespace, RE2 syntax.
WS = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def q(s: str) -> str:
    """SQL string literal; newlines become chr(10) concatenations."""
    parts = s.split("\n")
    lits = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + " || chr(10) || ".join(lits) + ")" if len(lits) > 1 else lits[0]


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


TAX = Taxonomy.starter()
CATS = TAX.categories

TICKETS = f"""
tickets AS (
  SELECT doc_id, 'DOC-' || CAST(doc_id AS VARCHAR) AS ticket_id,
         {strip('text')} AS issue_description,
         {strip("coalesce(source, '')")} AS current_label,
         '' AS resolution_notes, lang, n_chars
  FROM documents
  WHERE text IS NOT NULL AND regexp_matches(text, '[^{WS}]')
)"""


def _lexical_ctes(src: str = "tickets", name: str = "lexical") -> str:
    scores = ",\n    ".join(f"len(list_intersect(_m, {lst(c.keywords)})) * {c.weight} AS _s{i}" for i, c in enumerate(CATS))
    best = "greatest(" + ", ".join(f"_s{i}" for i in range(len(CATS))) + ")"
    ntop = " + ".join(f"(CASE WHEN _s{i} = _best THEN 1 ELSE 0 END)" for i in range(len(CATS)))
    winner = " ".join(f"WHEN _s{i} = _best THEN {q(c.name)}" for i, c in enumerate(CATS))
    why = " ".join(
        f"WHEN _s{i} = _best THEN 'Matched: ' || array_to_string(list_sort(list_intersect(_m, {lst(c.keywords)})), ', ')"
        for i, c in enumerate(CATS)
    )
    hits = ", ".join(f"{{'k': -_s{i}, 'o': {i}, 'c': {q(c.name)}}}" for i, c in enumerate(CATS))
    return f"""
{name}_m AS (
  SELECT *, list_intersect(regexp_split_to_array(lower(concat_ws(' ', issue_description, resolution_notes)), '[^a-z]+'),
                           {lst(TAX.keywords())}) AS _m
  FROM {src}
),
{name}_s AS (SELECT *, {scores} FROM {name}_m),
{name}_b AS (SELECT *, {best} AS _best FROM {name}_s),
{name} AS (
  SELECT * EXCLUDE (_m, _best, {", ".join(f"_s{i}" for i in range(len(CATS)))}),
    CASE WHEN _best = 0 THEN 'Uncategorised' {winner} END AS new_category,
    CASE WHEN _best >= 2 AND ({ntop}) = 1 THEN 'High'
         WHEN _best = 1 AND ({ntop}) = 1 THEN 'Medium' ELSE 'Low' END AS confidence,
    CASE WHEN _best = 0 THEN {q(NO_MATCH_REASON)} {why} END AS reasoning,
    list_transform(list_sort(list_filter([{hits}], lambda x: x.k < 0)), lambda x: x.c) AS tags
  FROM {name}_b
)"""


LEXICAL = _lexical_ctes()
LABELLED = f"""
cnt AS (SELECT new_category, count(*) AS n FROM lexical WHERE new_category IS NOT NULL GROUP BY 1),
labelled AS (
  SELECT l.* REPLACE (CASE WHEN c.n < {MIN_BUCKET} AND l.new_category <> 'Uncategorised'
                           THEN 'Uncategorised' ELSE l.new_category END AS new_category)
  FROM lexical l LEFT JOIN cnt c ON l.new_category = c.new_category
)"""
BATCHED = """
batched AS (
  SELECT *, pos // 10 AS batch_id, CAST(pos % 10 AS INTEGER) AS batch_pos
  FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM tickets)
)"""


def W(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def pct(part: str, whole: str) -> str:
    return f"CAST(round_even(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100.0, 0) AS BIGINT)"


def cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n}) || '...' ELSE {x} END"


def _categorise_requests() -> str:
    head = P.categorise_header(CONTEXT, MODE, TAX.names)
    block = ("'id: ' || ticket_id || chr(10) || '  text: ' || issue_description || chr(10) || '  label: ' || current_label"
             " || CASE WHEN resolution_notes <> '' THEN chr(10) || '  resolution: ' || resolution_notes ELSE '' END")
    return W(TICKETS, BATCHED) + f"""
, req AS (
  SELECT batch_id, count(*) AS n_tickets,
         {q(head)} || string_agg({block}, chr(10) || chr(10) ORDER BY batch_pos) AS prompt
  FROM batched GROUP BY batch_id
)
SELECT batch_id, n_tickets, md5(prompt) AS prompt_md5, length(prompt) AS prompt_chars FROM req"""


def _tag_requests() -> str:
    intro = P.TAG_INTRO + CONTEXT + "\n\nCategories:\n"
    block = "'id: ' || ticket_id || chr(10) || '  text: ' || issue_description"
    return W(TICKETS, LEXICAL, LABELLED, BATCHED) + f"""
, names AS (
  SELECT string_agg('  * ' || new_category, chr(10) ORDER BY first_pos, new_category) AS listed
  FROM (SELECT new_category, min(doc_id) AS first_pos FROM labelled
        WHERE new_category IS NOT NULL AND new_category <> '' AND new_category <> 'Uncategorised' GROUP BY 1)
),
req AS (
  SELECT batch_id, count(*) AS n_tickets,
         {q(intro)} || (SELECT listed FROM names) || {q(P.TAG_CONTRACT)}
           || string_agg({block}, chr(10) || chr(10) ORDER BY batch_pos) AS prompt
  FROM batched GROUP BY batch_id
)
SELECT batch_id, n_tickets, md5(prompt) AS prompt_md5, length(prompt) AS prompt_chars FROM req"""


def _distribution(src_ctes: str, src: str, order: str) -> str:
    return src_ctes + f"""
, c AS (SELECT new_category AS category, count(*) AS n, min({order}) AS first_pos
        FROM {src} WHERE new_category IS NOT NULL GROUP BY 1),
t AS (SELECT sum(n) AS total FROM c)
SELECT CAST(row_number() OVER (ORDER BY n DESC, first_pos) AS INTEGER) AS rank, category, n,
       {pct('n', 'total')} AS pct,
       CAST(n AS VARCHAR) || ' (' || CAST({pct('n', 'total')} AS VARCHAR) || '%)' AS label
FROM c, t"""


EVENTS_B = """
ev AS (SELECT event_type AS new_category, event_id, event_id // 10 AS batch_id FROM events)"""


def _themes() -> str:
    return W(TICKETS, LEXICAL, LABELLED) + """
, themed AS (SELECT doc_id, ticket_id, array_to_string(tags, ' | ') AS multi_tags FROM labelled),
occ AS (
  SELECT doc_id, i AS idx, """ + strip("parts[i]") + """ AS theme
  FROM (SELECT doc_id, string_split_regex(multi_tags, '[|]') AS parts FROM themed WHERE multi_tags IS NOT NULL AND multi_tags <> ''),
       LATERAL generate_series(1, len(parts)) g(i)
),
tc AS (SELECT theme, count(*) AS n, min(doc_id * 1000000 + idx) AS first_key FROM occ GROUP BY theme)"""


def _merges() -> tuple[str, str]:
    steps = ["m0 AS (SELECT ticket_id, new_category FROM labelled)"]
    logs = []
    k = 0
    for no, (src, tgt) in enumerate(MERGES, start=1):
        if not src or not tgt:
            continue
        prev = f"m{k}"
        k += 1
        inlist = ", ".join(q(s) for s in src)
        steps.append(
            f"m{k} AS (SELECT ticket_id, CASE WHEN new_category IN ({inlist}) THEN {q(tgt)} ELSE new_category END AS new_category FROM {prev})"
        )
        label = " + ".join(f"'{s}'" for s in src)
        logs.append(
            f"SELECT {no} AS merge_no, 'Merged: ' || {q(label)} || ' → ' || {q(repr_target(tgt))} || ' (' || CAST(count(*) AS VARCHAR) || ' tickets)' AS log, "
            f"count(*) AS tickets FROM {prev} WHERE new_category IN ({inlist}) HAVING count(*) > 0"
        )
    base = W(TICKETS, LEXICAL, LABELLED) + ", " + ", ".join(steps)
    return base + f"\nSELECT ticket_id, new_category FROM m{k}", base + "\n" + "\nUNION ALL\n".join(logs)


def repr_target(t: str) -> str:
    return f"'{t}'"


def _replies() -> str:
    return W(TICKETS, BATCHED, _lexical_ctes("batched", "blex")) + """
, rep AS (
  SELECT batch_id, count(*) AS n_tickets, arg_min(lang, batch_pos) AS first_lang,
    list({'ticket_id': ticket_id, 'new_category': new_category, 'confidence': confidence, 'reasoning': reasoning} ORDER BY batch_pos) AS full_l,
    list({'ticket_id': ticket_id, 'new_category': new_category, 'reasoning': reasoning} ORDER BY batch_pos) AS noconf_l
  FROM blex GROUP BY batch_id
),
raw AS (
  SELECT batch_id, n_tickets,
    CASE first_lang
      WHEN 'fr' THEN '```json' || chr(10) || CAST(to_json(full_l) AS VARCHAR) || chr(10) || '```'
      WHEN 'de' THEN '```' || chr(10) || CAST(to_json(noconf_l) AS VARCHAR) || chr(10) || '```'
      WHEN 'es' THEN CAST(to_json(list_slice(full_l, 1, len(full_l) - 1)) AS VARCHAR)
      ELSE CAST(to_json(full_l) AS VARCHAR) END AS raw
  FROM rep
),
parsed AS (
  SELECT batch_id, n_tickets, clean,
    coalesce(json_valid(clean) AND json_type(clean) = 'ARRAY' AND json_array_length(clean) = n_tickets
             AND NOT list_contains(json_type(clean, '$[*]'), 'VARCHAR') AND NOT list_contains(list_transform(json_type(clean, '$[*]'), lambda t: t = 'OBJECT'), false), false) AS ok
  FROM (SELECT *, """ + strip("CASE WHEN starts_with(raw, '```') THEN regexp_replace(split_part(raw, '```', 2), '^json', '') ELSE raw END") + """ AS clean FROM raw)
)"""


def _apply_responses() -> str:
    fields = []
    for k, d in (("new_category", "Uncategorised"), ("confidence", "Low"), ("reasoning", "")):
        failed = FAILED_REASON if k == "reasoning" else d
        fields.append(
            f"CASE WHEN NOT p.ok THEN {q(failed)} WHEN json_exists(e, '$.{k}') THEN json_extract_string(e, '$.{k}') ELSE {q(d)} END AS {k}"
        )
    return _replies() + f"""
SELECT ticket_id, {", ".join(fields)}
FROM (SELECT b.ticket_id, p.ok, json_extract(p.clean, '$[' || CAST(b.batch_pos AS VARCHAR) || ']') AS e
      FROM batched b JOIN parsed p ON b.batch_id = p.batch_id) p"""


def _breakdown() -> str:
    stops = ", ".join(q(s) for s in STOP_WORDS)
    return W(TICKETS, LEXICAL, LABELLED) + f"""
, terms AS (
  SELECT new_category AS category, term, count(*) AS df FROM (
    SELECT new_category, unnest(list_distinct(regexp_split_to_array(lower(issue_description), '[^a-z]+'))) AS term
    FROM labelled WHERE new_category IS NOT NULL)
  WHERE length(term) >= 4 AND term NOT IN ({stops})
  GROUP BY 1, 2
),
top AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY df DESC, term) AS rn FROM terms QUALIFY rn <= 3),
summ AS (SELECT category, {q(SUMMARY_PREFIX)} || string_agg(term, ', ' ORDER BY rn) AS summary FROM top GROUP BY 1),
counts AS (SELECT new_category AS category, count(*) AS n FROM labelled GROUP BY 1),
rows_ AS (SELECT count(*) AS r FROM labelled)
SELECT s.category, coalesce(c.n, 0) AS tickets, {pct('coalesce(c.n, 0)', 'r')} AS pct, s.summary
FROM summ s LEFT JOIN counts c ON s.category = c.category, rows_
WHERE s.category <> 'Uncategorised'"""


def _overlap() -> str:
    stops = ", ".join(q(s) for s in STOP_WORDS)
    return W(TICKETS, LEXICAL, LABELLED) + f"""
, terms AS (
  SELECT new_category AS category, term, count(*) AS df FROM (
    SELECT new_category, unnest(list_distinct(regexp_split_to_array(lower(issue_description), '[^a-z]+'))) AS term
    FROM labelled WHERE new_category IS NOT NULL AND new_category <> 'Uncategorised')
  WHERE length(term) >= 4 AND term NOT IN ({stops})
  GROUP BY 1, 2
),
top AS (SELECT category, term FROM terms),
sz AS (SELECT category, count(*) AS s FROM top GROUP BY 1),
pairs AS (SELECT a.category AS ca, b.category AS cb, count(*) AS shared
          FROM top a JOIN top b ON a.term = b.term AND a.category < b.category GROUP BY 1, 2)
SELECT ca AS category_a, cb AS category_b, CAST(shared AS INTEGER) AS shared,
       CAST(sa.s + sb.s - shared AS INTEGER) AS union_size, round(shared / (sa.s + sb.s - shared), 4) AS jaccard
FROM pairs JOIN sz sa ON sa.category = ca JOIN sz sb ON sb.category = cb
WHERE shared >= {PROFILE_OVERLAP} * (sa.s + sb.s - shared) - 1e-12"""


def _sample(n_expr: str = "greatest(13, least(25, CAST(floor(count(*) OVER () * 0.25) AS BIGINT)))") -> str:
    return f"""
sample AS (
  SELECT * FROM (
    SELECT *, md5('42:' || ticket_id) AS sample_key,
           row_number() OVER (ORDER BY md5('42:' || ticket_id), ticket_id) AS _rn,
           {n_expr} AS _n
    FROM tickets) WHERE _rn <= _n
)"""


def _suggest_terms() -> str:
    stops = ", ".join(q(s) for s in STOP_WORDS)
    return W(TICKETS, _sample()) + f"""
, terms AS (
  SELECT term, count(*) AS df FROM (
    SELECT unnest(list_distinct(regexp_split_to_array(lower(concat_ws(' ', issue_description, current_label)), '[^a-z]+'))) AS term
    FROM sample)
  WHERE length(term) >= 4 AND term NOT IN ({stops})
  GROUP BY 1
)
SELECT CAST(row_number() OVER (ORDER BY df DESC, term) AS INTEGER) AS rank, term, df
FROM terms ORDER BY df DESC, term LIMIT 10"""


def _near_duplicates() -> str:
    return f"""
WITH n AS (SELECT DISTINCT concat_ws(' ', p_name, p_type) AS name FROM part),
t AS (SELECT name, unnest(list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> ''))) AS tok FROM n),
sz AS (SELECT name, count(*) AS s FROM t GROUP BY 1),
pairs AS (SELECT a.name AS name_a, b.name AS name_b, count(*) AS shared FROM t a JOIN t b ON a.tok = b.tok AND a.name < b.name GROUP BY 1, 2)
SELECT name_a, name_b, CAST(shared AS INTEGER) AS shared, CAST(sa.s + sb.s - shared AS INTEGER) AS union_size,
       round(shared / (sa.s + sb.s - shared), 4) AS jaccard
FROM pairs JOIN sz sa ON sa.name = name_a JOIN sz sb ON sb.name = name_b
WHERE shared >= {SIMILARITY} * (sa.s + sb.s - shared) - 1e-12"""


def _grouping() -> str:
    return W(TICKETS, LEXICAL, LABELLED) + f"""
, j AS (SELECT l.new_category AS category, 'quality=' || CAST(g.quality AS VARCHAR) AS expected
        FROM labelled l JOIN labels g ON l.doc_id = g.doc_id),
cont AS (SELECT category, expected, count(*) AS k FROM j GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY k DESC, expected) AS rn FROM cont)
SELECT category, sum(k) AS tickets, max(CASE WHEN rn = 1 THEN expected END) AS majority,
       max(CASE WHEN rn = 1 THEN k END) AS majority_n,
       {pct('max(CASE WHEN rn = 1 THEN k END)', 'sum(k)')} AS purity_pct
FROM r GROUP BY category"""


def _run_facts() -> str:
    return W(TICKETS, LEXICAL, LABELLED) + f"""
, per AS (SELECT new_category AS category, count(*) AS n, min(doc_id) AS first_pos,
                 count(*) FILTER (WHERE confidence = 'Low') AS low FROM labelled GROUP BY 1),
named AS (SELECT * FROM per WHERE category IS NOT NULL AND category <> 'Uncategorised'),
dom AS (SELECT category, n FROM named ORDER BY n DESC, first_pos LIMIT 1)
SELECT (SELECT sum(n) FROM per) AS total,
       (SELECT count(*) FROM named) AS categories,
       (SELECT category FROM dom) AS dominant,
       (SELECT n FROM dom) AS dominant_n,
       {pct('(SELECT n FROM dom)', '(SELECT sum(n) FROM per)')} AS dominant_pct,
       coalesce((SELECT sum(n) FROM per WHERE category = 'Uncategorised'), 0) AS uncategorised,
       (SELECT sum(low) FROM per) AS low_confidence,
       0 AS merges"""


def _trend() -> str:
    return """
WITH daily AS (SELECT date_trunc('day', ts) AS d, event_type AS category, count(*) AS n FROM events GROUP BY 1, 2)
SELECT strftime(d, '%Y-%m-%d') AS day, category, n, n - lag(n) OVER (PARTITION BY category ORDER BY d) AS change FROM daily"""


def build() -> dict[str, str]:
    apply_merges, merge_log = _merges()
    lexical_sel = W(TICKETS, LEXICAL) + "\nSELECT ticket_id, new_category, confidence, reasoning FROM lexical"
    parse_sel = _replies() + "\nSELECT batch_id, n_tickets, ok FROM parsed"
    return {
        "normalise_tickets": W(TICKETS) + "\nSELECT ticket_id, issue_description, current_label, resolution_notes, doc_id, lang, n_chars FROM tickets",
        "conversation_tickets": f"""
WITH agg AS (
  SELECT conv_id,
         arg_min(text, CASE WHEN role = 'user' THEN turn END) AS d,
         arg_max(text, CASE WHEN role = 'assistant' THEN turn END) AS r,
         count(*) AS turns
  FROM conversations GROUP BY conv_id
)
SELECT 'CONV-' || CAST(conv_id AS VARCHAR) AS ticket_id, {strip('d')} AS issue_description, '' AS current_label,
       {strip("coalesce(r, '')")} AS resolution_notes, conv_id, turns
FROM agg WHERE d IS NOT NULL AND regexp_matches(d, '[^{WS}]')""",
        "batch_assignment": W(TICKETS, BATCHED) + "\nSELECT ticket_id, pos, batch_id, batch_pos FROM batched",
        "unordered_batches": W(TICKETS) + f"""
, g AS (SELECT ticket_id, ('0x' || substr(md5(ticket_id), 1, 8))::BIGINT % (SELECT greatest(1, (count(*) + {GROUP_ROWS} - 1) // {GROUP_ROWS}) FROM tickets) AS grp FROM tickets),
r AS (SELECT ticket_id, grp, row_number() OVER (PARTITION BY grp ORDER BY ticket_id) - 1 AS rn FROM g)
SELECT ticket_id, grp * 4294967296 + rn // 10 AS batch_id, CAST(rn % 10 AS INTEGER) AS batch_pos FROM r""",
        "categorise_requests": _categorise_requests(),
        "tag_requests": _tag_requests(),
        "lexical_primary": lexical_sel,
        "threshold_labels": W(TICKETS, LEXICAL, LABELLED) + "\nSELECT ticket_id, new_category, confidence, reasoning FROM labelled",
        "category_distribution": _distribution(W(TICKETS, LEXICAL, LABELLED), "labelled", "doc_id"),
        "event_distribution": _distribution(W(EVENTS_B), "ev", "event_id"),
        "low_confidence_view": W(TICKETS, LEXICAL, LABELLED) + f"""
SELECT ticket_id, {cut('issue_description', 80)} AS description, current_label AS old_label,
       new_category AS category, confidence, reasoning
FROM labelled WHERE confidence = 'Low'""",
        "category_samples": W(TICKETS, LEXICAL, LABELLED) + f"""
SELECT category, CAST(rn AS INTEGER) AS rn, ticket_id, {cut('issue_description', 80)} AS description FROM (
  SELECT new_category AS category, ticket_id, issue_description,
         row_number() OVER (PARTITION BY new_category ORDER BY doc_id) AS rn
  FROM labelled WHERE new_category IS NOT NULL) WHERE rn <= 3""",
        "uncategorised_head": W(TICKETS, LEXICAL, LABELLED) + f"""
SELECT ticket_id, {cut('issue_description', 100)} AS description
FROM labelled WHERE new_category = 'Uncategorised' ORDER BY doc_id LIMIT 10""",
        "running_categories": W(EVENTS_B) + """
, f AS (SELECT new_category, min(batch_id) AS fb FROM ev
        WHERE new_category IS NOT NULL AND new_category <> 'Uncategorised' GROUP BY 1),
b AS (SELECT DISTINCT batch_id FROM ev),
inc AS (SELECT fb AS batch_id, count(*) AS k FROM f GROUP BY 1)
SELECT b.batch_id, CAST(coalesce(inc.k, 0) AS BIGINT) AS new_categories,
       CAST(sum(coalesce(inc.k, 0)) OVER (ORDER BY b.batch_id) AS BIGINT) AS categories_so_far
FROM b LEFT JOIN inc ON b.batch_id = inc.batch_id""",
        "taxonomy_first_seen": W(EVENTS_B) + """
, f AS (SELECT new_category AS category, min(event_id) AS first_pos, count(*) AS n FROM ev
        WHERE new_category IS NOT NULL AND new_category <> '' AND new_category <> 'Uncategorised' GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY first_pos, category) - 1 AS INTEGER) AS ordinal, category, first_pos, n FROM f""",
        "multi_tags": W(TICKETS, LEXICAL, LABELLED) + "\nSELECT ticket_id, array_to_string(tags, ' | ') AS multi_tags FROM labelled",
        "theme_counts": _themes() + "\nSELECT theme, n FROM tc",
        "top_themes": _themes() + f"""
, tk AS (SELECT count(*) AS tickets FROM themed)
SELECT CAST(row_number() OVER (ORDER BY n DESC, first_key) AS INTEGER) AS rank, theme, n, {pct('n', 'tickets')} AS pct
FROM tc, tk ORDER BY n DESC, first_key LIMIT 3""",
        "apply_merges": apply_merges,
        "merge_log": merge_log,
        "category_breakdown": _breakdown(),
        "suggest_sample": W(TICKETS, _sample()) + "\nSELECT ticket_id, sample_key FROM sample",
        "suggest_terms": _suggest_terms(),
        "parse_responses": parse_sel,
        "strict_json": parse_sel,
        "apply_responses": _apply_responses(),
        "near_duplicate_categories": _near_duplicates(),
        "category_overlap": _overlap(),
        "merge_decisions": f"""
WITH s AS ({_near_duplicates()})
SELECT * FROM (SELECT 'merge' AS action, name_a, name_b, jaccard FROM s WHERE jaccard >= {MERGE_AT})
UNION ALL
SELECT * FROM (SELECT 'flag' AS action, name_a, name_b, jaccard FROM s WHERE jaccard >= {SIMILARITY} AND jaccard < {MERGE_AT}
               ORDER BY jaccard DESC, name_a, name_b LIMIT {MAX_FLAGS})""",
        "grouping_accuracy": _grouping(),
        "run_facts": _run_facts(),
        "uncategorised_rate": W(TICKETS, LEXICAL, LABELLED) + f"""
SELECT count(*) AS rows, count(*) FILTER (WHERE new_category = 'Uncategorised') AS uncategorised,
       {pct("count(*) FILTER (WHERE new_category = 'Uncategorised')", 'count(*)')} AS rate_pct,
       count(*) FILTER (WHERE new_category = 'Uncategorised') * 100 < count(*) * 15 AS meets_target
FROM labelled""",
        "confidence_mix": W(TICKETS, LEXICAL, LABELLED) + f"""
, per AS (SELECT confidence, count(*) AS n FROM labelled GROUP BY 1), t AS (SELECT count(*) AS total FROM labelled)
SELECT confidence, n, {pct('n', 'total')} AS pct FROM per, t""",
        "trend_by_day": _trend(),
        "run_replay": _run_replay(),
        "run_sparse_key": _run_replay(),
        "parse_name_list": _name_list(),
        "stream_rounds": lexical_sel,
        "stream_category_counts": W(TICKETS, LEXICAL) + """
SELECT new_category AS category, count(*) AS n FROM lexical GROUP BY 1""",
        "stream_event_windows": """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS category, count(*) AS n FROM events GROUP BY 1, 2""",
    }


def _run_replay() -> str:
    return W(TICKETS, BATCHED) + f"""
, said AS (
  SELECT ticket_id, batch_id % 7 = 3 AS failed,
         CASE WHEN batch_id % 7 = 3 THEN 'Uncategorised' WHEN batch_id % 5 = 2 AND batch_pos = 0 THEN NULL
              ELSE 'From ' || current_label END AS c
  FROM batched),
n AS (SELECT c, count(*) AS n FROM said GROUP BY 1)
SELECT ticket_id, CASE WHEN n.n < {MIN_BUCKET} AND said.c <> 'Uncategorised' THEN 'Uncategorised' ELSE said.c END AS new_category,
       CASE WHEN failed THEN 'Low' ELSE 'High' END AS confidence,
       CASE WHEN failed THEN 'Processing error: {REPLAY_FAILED}' ELSE 'r' END AS reasoning
FROM said LEFT JOIN n ON said.c = n.c"""


def _name_list() -> str:
    return W(TICKETS) + """
SELECT ticket_id, CASE WHEN lang IN ('fr', 'es') THEN 0 ELSE 5 END AS n_names,
       CASE WHEN lang IN ('fr', 'es') THEN '' ELSE ticket_id || '|0|true||7' END AS names
FROM tickets"""


def build_all() -> dict[str, str]:
    from .oracle_extra import build as build_extra
    from .oracle_more import build as build_more

    return {**build(), **build_extra(), **build_more()}
