"""DuckDB twins of the second group of registered queries (prompts PRM3/PRM4,
SMP2, RPT8, QLT5, QLT6, FLT3, conversation labels, order priorities, theme
replies)."""

from __future__ import annotations

from ..operators import prompts as P
from .catalog import CONTEXT, MERGES
from .oracle import BATCHED, LABELLED, LEXICAL, TICKETS, WS, W, _distribution, _lexical_ctes, _sample, q, strip

NL = "\n"

CONV_TICKETS = f"""
ctk AS (
  SELECT 'CONV-' || CAST(conv_id AS VARCHAR) AS ticket_id, {strip('d')} AS issue_description, '' AS current_label,
         {strip("coalesce(r, '')")} AS resolution_notes, conv_id, turns
  FROM (SELECT conv_id,
               arg_min(text, CASE WHEN role = 'user' THEN turn END) AS d,
               arg_max(text, CASE WHEN role = 'assistant' THEN turn END) AS r,
               count(*) AS turns
        FROM conversations GROUP BY conv_id)
  WHERE d IS NOT NULL AND regexp_matches(d, '[^{WS}]')
)"""


def review_request() -> str:
    intro = P.REVIEW_INTRO + CONTEXT + NL + NL + "Category counts:" + NL
    line = "'  ' || chr(39) || c.category || chr(39) || ' (' || CAST(c.n AS VARCHAR) || ' tickets), e.g. ' || coalesce(eg.eg, '')"
    return W(TICKETS, LEXICAL, LABELLED) + f"""
, rc AS (SELECT new_category AS category, count(*) AS n, min(doc_id) AS first_pos FROM labelled
          WHERE new_category IS NOT NULL GROUP BY 1),
smp AS (SELECT new_category AS category, issue_description,
               row_number() OVER (PARTITION BY new_category ORDER BY doc_id) AS rn
        FROM labelled WHERE new_category IS NOT NULL QUALIFY rn <= 2),
eg AS (SELECT category, string_agg(substring(issue_description, 1, 80), '; ' ORDER BY rn) AS eg FROM smp GROUP BY 1),
lines AS (SELECT c.category, c.n, c.first_pos, {line} AS line
          FROM rc c LEFT JOIN eg ON c.category = eg.category),
dist AS (SELECT string_agg(line, chr(10) ORDER BY n DESC, first_pos) AS d FROM lines),
unc AS (SELECT string_agg('  - ' || substring(issue_description, 1, 100), chr(10) ORDER BY doc_id) AS u
        FROM (SELECT * FROM labelled WHERE new_category = 'Uncategorised' ORDER BY doc_id LIMIT 10)),
pr AS (SELECT {q(intro)} || d
              || CASE WHEN u IS NOT NULL THEN chr(10) || chr(10) || 'Uncategorised sample:' || chr(10) || u ELSE '' END
              || {q(P.REVIEW_CONTRACT)} AS p
       FROM dist, unc)
SELECT md5(p) AS prompt_md5, length(p) AS prompt_chars FROM pr"""


def suggest_request() -> str:
    head_a, head_b, tail = P.SUGGEST_INTRO + CONTEXT + P.SUGGEST_SIZE[0], P.SUGGEST_SIZE[1], P.SUGGEST_CONTRACT
    return W(TICKETS, _sample()) + f"""
, pr AS (SELECT {q(head_a)} || CAST(max(_n) AS VARCHAR) || {q(head_b)}
                || string_agg('- ' || issue_description || ' [label: ' || current_label || ']', chr(10) ORDER BY sample_key, ticket_id)
                || {q(tail)} AS p FROM sample)
SELECT md5(p) AS prompt_md5, length(p) AS prompt_chars FROM pr"""


CLEAN = strip("CASE WHEN starts_with(raw, '```') THEN regexp_replace(split_part(raw, '```', 2), '^json', '') ELSE raw END")


def tag_replies_apply() -> str:
    return W(TICKETS, BATCHED, _lexical_ctes("batched", "blex")) + f"""
, rep AS (
  SELECT batch_id, count(*) AS n_tickets, arg_min(lang, batch_pos) AS first_lang,
    list({{'ticket_id': ticket_id, 'tags': tags}} ORDER BY batch_pos) AS plain,
    list({{'ticket_id': ticket_id, 'tags': array_to_string(tags, '')}} ORDER BY batch_pos) AS as_str,
    list({{'ticket_id': ticket_id, 'tags': CASE WHEN batch_pos = 0 THEN NULL ELSE tags END}} ORDER BY batch_pos) AS nulled
  FROM blex GROUP BY batch_id
),
raw AS (
  SELECT batch_id, n_tickets,
    CASE first_lang
      WHEN 'fr' THEN '```json' || chr(10) || CAST(to_json(plain) AS VARCHAR) || chr(10) || '```'
      WHEN 'de' THEN CAST(to_json(as_str) AS VARCHAR)
      WHEN 'es' THEN CAST(to_json(nulled) AS VARCHAR)
      ELSE CAST(to_json(plain) AS VARCHAR) END AS raw
  FROM rep
),
parsed AS (SELECT batch_id, n_tickets, {CLEAN} AS clean FROM raw),
elems AS (
  SELECT b.ticket_id, b.batch_id, json_extract(p.clean, '$[' || CAST(b.batch_pos AS VARCHAR) || ']') AS e,
         json_array_length(p.clean) = p.n_tickets AS len_ok
  FROM batched b JOIN parsed p ON b.batch_id = p.batch_id
),
typed AS (SELECT *, json_type(e, '$.tags') AS t FROM elems),
ok AS (SELECT batch_id, bool_and(len_ok AND (t IS NULL OR t IN ('ARRAY', 'VARCHAR'))) AS ok FROM typed GROUP BY 1)
SELECT ticket_id,
  CASE WHEN NOT ok.ok THEN ''
       WHEN t IS NULL THEN ''
       WHEN t = 'VARCHAR' THEN array_to_string(string_split(json_extract_string(e, '$.tags'), ''), ' | ')
       ELSE coalesce(array_to_string(json_extract_string(e, '$.tags[*]'), ' | '), '') END AS multi_tags
FROM typed JOIN ok ON typed.batch_id = ok.batch_id"""


def merge_mapping() -> str:
    """original category → final category, for the categories the merges moved."""
    steps = ["s0 AS (SELECT DISTINCT new_category AS orig, new_category AS cur FROM labelled WHERE new_category IS NOT NULL)"]
    k = 0
    for src, tgt in MERGES:
        if not src or not tgt:
            continue
        inlist = ", ".join(q(x) for x in src)
        steps.append(f"s{k + 1} AS (SELECT orig, CASE WHEN cur IN ({inlist}) THEN {q(tgt)} ELSE cur END AS cur FROM s{k})")
        k += 1
    return W(TICKETS, LEXICAL, LABELLED) + ", " + ", ".join(steps) + f", mapping AS (SELECT orig, cur AS target FROM s{k} WHERE orig <> cur)"


def merge_safety() -> str:
    return merge_mapping() + """
, moved AS (SELECT m.target AS category, 'quality=' || CAST(g.quality AS VARCHAR) AS expected
            FROM labelled l JOIN mapping m ON l.new_category = m.orig JOIN labels g ON l.doc_id = g.doc_id),
cont AS (SELECT category, expected, count(*) AS k FROM moved GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY k DESC, expected) AS rn FROM cont)
SELECT category AS target, sum(k) AS tickets, max(CASE WHEN rn = 1 THEN k END) AS agree,
       max(CASE WHEN rn = 1 THEN k END) * 2 >= sum(k) AS safe
FROM r GROUP BY category"""


def merged_facts() -> str:
    steps = ["m0 AS (SELECT doc_id, confidence, new_category FROM labelled)"]
    k = 0
    for src, tgt in MERGES:
        if not src or not tgt:
            continue
        inlist = ", ".join(q(x) for x in src)
        steps.append(f"m{k + 1} AS (SELECT doc_id, confidence, CASE WHEN new_category IN ({inlist}) THEN {q(tgt)} "
                     f"ELSE new_category END AS new_category FROM m{k})")
        k += 1
    logs = []
    k = 0
    for src, tgt in MERGES:
        if not src or not tgt:
            continue
        inlist = ", ".join(q(x) for x in src)
        logs.append(f"(SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM m{k} WHERE new_category IN ({inlist}))")
        k += 1
    merges = " + ".join(logs) if logs else "0"
    return W(TICKETS, LEXICAL, LABELLED) + ", " + ", ".join(steps) + f"""
, per AS (SELECT new_category AS category, count(*) AS n, min(doc_id) AS first_pos,
                 count(*) FILTER (WHERE confidence = 'Low') AS low FROM m{k} GROUP BY 1),
named AS (SELECT * FROM per WHERE category IS NOT NULL AND category <> 'Uncategorised'),
dom AS (SELECT category, n FROM named ORDER BY n DESC, first_pos LIMIT 1)
SELECT (SELECT sum(n) FROM per) AS total,
       (SELECT count(*) FROM named) AS categories,
       (SELECT category FROM dom) AS dominant,
       (SELECT n FROM dom) AS dominant_n,
       CAST(round_even(CAST((SELECT n FROM dom) AS DOUBLE) / CAST((SELECT sum(n) FROM per) AS DOUBLE) * 100.0, 0) AS BIGINT) AS dominant_pct,
       coalesce((SELECT sum(n) FROM per WHERE category = 'Uncategorised'), 0) AS uncategorised,
       (SELECT sum(low) FROM per) AS low_confidence,
       {merges} AS merges"""


def run_narrative() -> str:
    from .oracle import _run_facts

    facts = _run_facts()
    return f"""
WITH facts AS ({facts})
SELECT printf('%d tickets were sorted into %d categories; the largest is ''%s'' with %d tickets (%d%%). %d tickets stayed Uncategorised.',
              total, categories, coalesce(dominant, 'none'), coalesce(dominant_n, 0), coalesce(dominant_pct, 0), uncategorised) AS narrative
FROM facts"""


def build() -> dict[str, str]:
    return {
        "taxonomy_gaps": """
WITH f AS (SELECT event_type AS category, min(event_id) AS first_pos, count(*) AS n FROM events
           WHERE event_type IS NOT NULL AND event_type <> '' AND event_type <> 'Uncategorised' GROUP BY 1)
SELECT category, first_pos, n FROM f WHERE category NOT IN ('click', 'view')""",
        "run_narrative": run_narrative(),
        "run_primary": W(TICKETS, LEXICAL, LABELLED) + """
SELECT ticket_id, new_category, confidence, reasoning, array_to_string(tags, ' | ') AS multi_tags FROM labelled""",
        "merged_facts": merged_facts(),
        "uncategorised_panel": W(TICKETS, LEXICAL, LABELLED) + """
SELECT count(*) FILTER (WHERE new_category = 'Uncategorised') AS uncategorised,
       count(*) FILTER (WHERE new_category = 'Uncategorised') = 0 AS all_categorised
FROM labelled""",
        "review_request": review_request(),
        "suggest_request": suggest_request(),
        "stratified_sample": W(TICKETS) + """
SELECT ticket_id, current_label, sample_key FROM (
  SELECT ticket_id, current_label, md5('42:' || ticket_id) AS sample_key,
         row_number() OVER (PARTITION BY current_label ORDER BY md5('42:' || ticket_id), ticket_id) AS rn
  FROM tickets) WHERE rn <= 2""",
        "batch_metrics": W(TICKETS, BATCHED, _lexical_ctes("batched", "blex")) + """
, per AS (SELECT batch_id, count(*) AS tickets, count(*) FILTER (WHERE starts_with(reasoning, 'Processing error: ')) AS failed
          FROM blex GROUP BY 1),
f AS (SELECT new_category, min(batch_id) AS fb FROM blex
      WHERE new_category IS NOT NULL AND new_category <> 'Uncategorised' GROUP BY 1),
inc AS (SELECT fb AS batch_id, count(*) AS k FROM f GROUP BY 1)
SELECT per.batch_id, per.tickets, per.failed, CAST(coalesce(inc.k, 0) AS BIGINT) AS new_categories,
       CAST(sum(coalesce(inc.k, 0)) OVER (ORDER BY per.batch_id) AS BIGINT) AS categories_so_far
FROM per LEFT JOIN inc ON per.batch_id = inc.batch_id""",
        "tag_total_check": W(TICKETS, LEXICAL, LABELLED) + """
, th AS (SELECT array_to_string(tags, ' | ') AS m FROM labelled)
SELECT sum(CASE WHEN m = '' THEN 0 ELSE len(string_split_regex(m, '[|]')) END) AS tags, count(*) AS rows,
       sum(CASE WHEN m = '' THEN 0 ELSE len(string_split_regex(m, '[|]')) END) >= count(*) AS tags_exceed_rows
FROM th""",
        "merge_safety": merge_safety(),
        "drill_down": W(TICKETS, LEXICAL, LABELLED) + """
SELECT ticket_id, confidence, reasoning FROM labelled WHERE new_category = 'German Text'""",
        "conversation_labels": W(CONV_TICKETS, _lexical_ctes("ctk", "clex")) + """
SELECT ticket_id, new_category, confidence, reasoning FROM clex""",
        "order_priority_distribution": _distribution(
            W("\nov AS (SELECT o_orderpriority AS new_category, o_orderkey FROM orders)"), "ov", "o_orderkey"),
        "apply_tag_responses": tag_replies_apply(),
    }
