"""DuckDB twins of the queries in ``catalog_more``."""

from __future__ import annotations

from ..operators.consolidate import FLAG_FORMAT, NARRATIVE, SUMMARY_PREFIX, THEME_FORMAT, UNAVAILABLE
from ..operators.responses import FAILED_REASON
from ..operators.taxonomy import MIN_BUCKET, STOP_WORDS
from ..operators.topics import IDF_SCALE, ITERATIONS, NAME_TERMS, TOPICS, VOCABULARY

from .catalog_more import (
    GHOST_EVERY, LABEL_OVERLAP, LABEL_TERMS, REVIEW_FLAG, REVIEW_NAMES, REVIEW_REPLY, RUN_THRESHOLDS, SELF_EVERY,
)
from .oracle import BATCHED, CATS, LABELLED, LEXICAL, TICKETS, WS, W, _distribution, _lexical_ctes, pct, q, strip

STOPS = ", ".join(q(s) for s in STOP_WORDS)

# each category's way through the merge list, step by step
CHAINS = f"""WITH RECURSIVE m AS (
  SELECT (SELECT max(c_custkey) FROM customer) + 1 - c_custkey AS no, 'C' || (c_custkey // 2) AS into_,
         list_filter(['C' || c_custkey, CASE WHEN c_custkey % {SELF_EVERY} = 0 THEN 'C' || (c_custkey // 2) END,
                      CASE WHEN c_custkey % {GHOST_EVERY} = 0 THEN 'Ghost' || c_custkey END], lambda x: x IS NOT NULL) AS src
  FROM customer WHERE c_custkey > 0),
s AS (SELECT no, unnest(src) AS name FROM m),
nxt AS (SELECT m.no, m.into_, min(s.no) AS next FROM m LEFT JOIN s ON s.name = m.into_ AND s.no > m.no GROUP BY 1, 2),
cat AS (SELECT 'C' || o_custkey AS category, count(*) AS n FROM orders GROUP BY 1),
way AS (
  SELECT category, n, first AS no FROM cat JOIN (SELECT name, min(no) AS first FROM s GROUP BY 1) f ON f.name = category
  UNION ALL
  SELECT way.category, way.n, nxt.next FROM way JOIN nxt ON nxt.no = way.no WHERE nxt.next IS NOT NULL),
fin AS (SELECT category, max(no) AS no FROM way GROUP BY 1),
map AS (SELECT fin.category AS old, m.into_ AS final, CAST(fin.no AS INTEGER) AS merge_no FROM fin JOIN m ON m.no = fin.no)
"""


def _replayed() -> str:
    return W(TICKETS, BATCHED) + f"""
, said AS (SELECT ticket_id, pos, CASE WHEN batch_id % 7 = 3 THEN 'Uncategorised' ELSE 'From ' || current_label END AS c FROM batched),
n AS (SELECT c, count(*) AS n FROM said GROUP BY 1),
m0 AS (SELECT ticket_id, CASE WHEN n.n < {MIN_BUCKET} AND said.c <> 'Uncategorised' THEN 'Uncategorised' ELSE said.c END AS c FROM said JOIN n ON n.c = said.c)"""


def _replay_review() -> str:
    sql, k, logs = _replayed(), 0, []
    for m in REVIEW_REPLY["auto_merges"]:
        src, into = m["merge_these"], m["into"]
        if isinstance(src, str) or not into:
            continue
        names = ", ".join(map(q, src))
        line = q("Merged: " + " + ".join(f"'{s}'" for s in src) + f" → '{into}' (")
        logs.append(f"SELECT 'log', '', {line} || count(*) || ' tickets)' FROM m{k} WHERE c IN ({names}) HAVING count(*) > 0")
        sql += f",\nm{k + 1} AS (SELECT ticket_id, CASE WHEN c IN ({names}) THEN {q(into)} ELSE c END AS c FROM m{k})"
        k += 1
    # with every source present: 0 and 1 become Low Sources, 2 keeps none (it is its own source), then Front Sources
    summaries = [("From src5", "five"), ("Front Sources", "zero / one")]
    parts = [f"SELECT 'summary' AS part, {q(c)} AS name, {q(s)} AS value" for c, s in summaries]
    parts += [f"SELECT 'flag', '', {q(f)}" for f in REVIEW_REPLY["merge_flags"]]
    parts += [f"SELECT 'uncategorised', '', {q(f)}" for f in REVIEW_REPLY["uncategorised_analysis"]]
    parts += [f"SELECT 'narrative', '', {q(REVIEW_REPLY['narrative'])}", *logs, f"SELECT 'count', c, CAST(count(*) AS VARCHAR) FROM m{k} GROUP BY c"]
    return sql + "\n" + "\nUNION ALL\n".join(parts)


def _lexical_review() -> str:
    renamed = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in REVIEW_NAMES.items())
    a, b = sorted(REVIEW_NAMES.values())
    flag = q(FLAG_FORMAT).replace("{pct}", str(round(100 / 3)))
    fa, fb = flag.split("{a}")[0] + "'", "'" + flag.split("{b}")[1]
    mid = "'" + flag.split("{a}")[1].split("{b}")[0] + "'"
    theme = q(THEME_FORMAT).split("{term}")
    narrative = NARRATIVE.replace("'", "''")
    pairs = " OR ".join(f"(x.c = {q(p)} AND y.c = {q(r)})" for p, r in _flag_pairs())
    return W(TICKETS, LEXICAL, LABELLED) + f"""
, named AS (SELECT issue_description, CASE new_category {renamed} ELSE new_category END AS c FROM labelled WHERE new_category IS NOT NULL),
before AS (SELECT c, count(*) AS n FROM named GROUP BY 1),
both_ AS (SELECT count(*) = 2 AS ok, sum(n) AS n FROM before WHERE c IN ({q(a)}, {q(b)})),
fin AS (SELECT issue_description, CASE WHEN c = {q(b)} AND (SELECT ok FROM both_) THEN {q(a)} ELSE c END AS c FROM named),
per AS (SELECT c, count(*) AS n FROM fin GROUP BY 1),
terms AS (SELECT c, term, count(*) AS df FROM (
    SELECT c, unnest(list_distinct(regexp_split_to_array(lower(issue_description), '[^a-z]+'))) AS term FROM fin)
  WHERE length(term) >= 4 AND term NOT IN ({STOPS}) GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY df DESC, term) AS rn FROM terms QUALIFY rn <= 3),
best AS (SELECT c, n FROM per WHERE c <> 'Uncategorised' AND c <> '' ORDER BY n DESC, c LIMIT 1),
tot AS (SELECT sum(n) AS total, count(*) FILTER (WHERE c <> 'Uncategorised' AND c <> '') AS cats, coalesce(sum(n) FILTER (WHERE c = 'Uncategorised'), 0) AS unc FROM per)
SELECT 'summary' AS part, c AS name, {q(SUMMARY_PREFIX)} || string_agg(term, ', ' ORDER BY rn) AS value FROM top GROUP BY c
UNION ALL SELECT 'log', '', {q(f"Merged: '{a}' + '{b}' → '{a}' (")} || n || ' tickets)' FROM both_ WHERE ok
UNION ALL SELECT 'flag', '', {fa} || x.c || {mid} || y.c || {fb} FROM before x JOIN before y ON x.c < y.c AND ({pairs})
UNION ALL SELECT 'uncategorised', '', {theme[0]}' || term || '{theme[1]} FROM top WHERE c = 'Uncategorised'
UNION ALL SELECT 'narrative', '', printf('{narrative}', total::BIGINT, cats, coalesce((SELECT c FROM best), 'none'), coalesce((SELECT n FROM best), 0),
    CASE WHEN total > 0 THEN CAST(round_even(100.0 * coalesce((SELECT n FROM best), 0) / total, 0) AS BIGINT) ELSE 0 END, unc::BIGINT) FROM tot"""


def _flag_pairs() -> list[tuple[str, str]]:
    """Pairs of category names whose words are similar enough to be flagged, not merged."""
    names = sorted(REVIEW_NAMES.get(c.name, c.name) for c in CATS)
    words = {n: set(n.lower().split()) for n in names}
    similar = lambda x, y: len(words[x] & words[y]) / len(words[x] | words[y])
    return [(x, y) for x in names for y in names if x < y and REVIEW_FLAG <= similar(x, y) < 0.5]


def _accuracy() -> str:
    def side(name: str, own: str, other: str) -> str:
        return f"""SELECT '{name}' AS side, {own} AS name, first({other} ORDER BY k DESC, {other}) AS majority, sum(k)::BIGINT AS tickets, max(k) AS matched
  FROM cont GROUP BY {own}"""

    def pairs(n: str) -> str:
        return f"({n}::DOUBLE * ({n} - 1)::DOUBLE / 2)"

    return W(TICKETS, LEXICAL, LABELLED) + f"""
, cont AS (SELECT l.new_category AS category, 'q' || g.quality || 't' || g.toxic AS expected, count(*) AS k
           FROM labelled l JOIN labels g ON g.doc_id = l.doc_id WHERE l.new_category IS NOT NULL AND g.quality IS NOT NULL AND g.toxic IS NOT NULL GROUP BY 1, 2),
sides AS ({side('predicted', 'category', 'expected')} UNION ALL {side('expected', 'expected', 'category')}),
t AS (SELECT (SELECT sum({pairs('k')}) FROM cont) AS c, sum({pairs('tickets')}) FILTER (WHERE side = 'predicted') AS a,
             sum({pairs('tickets')}) FILTER (WHERE side = 'expected') AS b, sum(tickets) FILTER (WHERE side = 'predicted') AS n,
             sum(matched) FILTER (WHERE side = 'predicted') AS m FROM sides),
u AS (SELECT *, CASE WHEN n > 1 THEN a * b / {pairs('n')} ELSE 0 END AS chance, (a + b) / 2 AS most FROM t)
SELECT side, name, majority, tickets, matched, {pct('matched', 'tickets')} AS pct, NULL::DOUBLE AS rand_index, NULL::BOOLEAN AS meets_target FROM sides
UNION ALL SELECT 'overall', '', '', n::BIGINT, m::BIGINT, {pct('m', 'n')}, round(CASE WHEN most = chance THEN 1 ELSE (c - chance) / (most - chance) END, 6), m * 100 >= n * 80
FROM u WHERE n > 0"""


def _label_overlap() -> str:
    return W(TICKETS) + f"""
, terms AS (SELECT DISTINCT c, term FROM (
    SELECT current_label AS c, unnest(list_distinct(regexp_split_to_array(lower(issue_description), '[^a-z]+'))) AS term FROM tickets)
  WHERE length(term) >= 4 AND term NOT IN ({STOPS}) AND c <> 'Uncategorised'),
sz AS (SELECT c, count(*) AS s FROM terms GROUP BY 1),
pairs AS (SELECT a.c AS ca, b.c AS cb, count(*) AS shared FROM terms a JOIN terms b ON a.term = b.term AND a.c < b.c GROUP BY 1, 2)
SELECT ca AS label_a, cb AS label_b, CAST(shared AS INTEGER) AS shared, CAST(sa.s + sb.s - shared AS INTEGER) AS union_size,
       round(shared / (sa.s + sb.s - shared), 4) AS jaccard
FROM pairs JOIN sz sa ON sa.c = ca JOIN sz sb ON sb.c = cb WHERE shared >= {LABEL_OVERLAP} * (sa.s + sb.s - shared) - 1e-12"""


def _topics(last: str) -> str:
    """k-means unrolled: centres in integers, nearest by the largest 2 w.c - c.c."""
    sql = W(TICKETS) + f"""
, words AS (SELECT ticket_id, unnest(list_distinct(regexp_split_to_array(lower(issue_description), '[^a-z]+'))) AS term FROM tickets),
df AS (SELECT term, count(*) AS df FROM words WHERE length(term) >= 4 AND term NOT IN ({STOPS}) GROUP BY 1),
voc AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS t,
               CAST(round({IDF_SCALE} * ln((SELECT count(*) FROM tickets)::DOUBLE / df)) AS BIGINT) AS w FROM df QUALIFY t < {VOCABULARY}),
vec AS (SELECT ticket_id, t, w FROM words JOIN voc USING (term)),
c0 AS (SELECT k.t AS k, v.t, CASE WHEN v.t = k.t THEN v.w ELSE 0 END AS c FROM voc k JOIN voc v ON k.t < {TOPICS})"""
    for i in range(ITERATIONS + 1):
        sql += f""",
a{i} AS (SELECT ticket_id, k AS topic FROM (
    SELECT ticket_id, k, sum(2 * w * c) - any_value(cc) AS s FROM vec JOIN c{i} USING (t) JOIN (SELECT k, sum(c * c) AS cc FROM c{i} GROUP BY 1) USING (k) GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY s DESC, k) = 1)"""
        if i < ITERATIONS:
            sql += f""",
n{i} AS (SELECT topic AS k, count(*) AS n FROM a{i} GROUP BY 1),
h{i} AS (SELECT topic AS k, t, count(*) AS h FROM a{i} JOIN vec USING (ticket_id) GROUP BY 1, 2),
c{i + 1} AS (SELECT c{i}.k, c{i}.t, CASE WHEN n IS NULL THEN c ELSE w * coalesce(h, 0) // n END AS c
             FROM c{i} JOIN voc ON voc.t = c{i}.t LEFT JOIN n{i} ON n{i}.k = c{i}.k LEFT JOIN h{i} ON h{i}.k = c{i}.k AND h{i}.t = c{i}.t)"""
    return sql + last.replace("{a}", f"a{ITERATIONS}")


def _strictness() -> str:
    return W(TICKETS, BATCHED, _lexical_ctes("batched", "blex")) + f"""
, x AS (SELECT *, batch_id % 7 AS turn, batch_id % 7 IN (1, 4) OR (batch_id % 7 = 5) AS bad FROM blex)
SELECT ticket_id, CASE WHEN bad THEN 'Uncategorised' ELSE new_category END AS new_category,
       CASE WHEN bad THEN 'Low' WHEN turn = 3 THEN NULL ELSE 'High' END AS confidence,
       CASE WHEN bad THEN {q(FAILED_REASON)} ELSE '' END AS reasoning,
       CASE WHEN bad THEN '' WHEN turn = 2 THEN 'x | y' ELSE 't' END AS multi_tags
FROM x"""


def _run_diff() -> str:
    low, high = RUN_THRESHOLDS

    def folded(k: int) -> str:
        return f"CASE WHEN cnt.n < {k} AND l.new_category <> 'Uncategorised' THEN 'Uncategorised' ELSE l.new_category END"

    return W(TICKETS, LEXICAL, LABELLED) + f"""
, r AS (SELECT l.ticket_id, {folded(low)} AS before, CASE WHEN doc_id % 10 <> 0 THEN {folded(high)} END AS after, doc_id % 10 <> 0 AS there
        FROM lexical l LEFT JOIN cnt ON cnt.new_category = l.new_category)
SELECT ticket_id, before, after, CASE WHEN NOT there THEN 'removed' ELSE 'moved' END AS change FROM r WHERE NOT there OR before IS DISTINCT FROM after"""


def build() -> dict[str, str]:
    failed = UNAVAILABLE.format(error="no recorded response")
    zero = " UNION ALL ".join(f"SELECT {k} AS o, {q(n)} AS category" for k, n in enumerate([*[c.name for c in CATS], "Nobody's Category", "Another Empty One"]))
    return {
        "merge_map": CHAINS + "SELECT old, final, merge_no FROM map",
        "merge_tickets": CHAINS + """SELECT CAST(m.no AS INTEGER) AS merge_no, m.into_ AS "into", sum(n)::BIGINT AS tickets FROM way JOIN m ON m.no = way.no GROUP BY ALL""",
        "merge_rows": CHAINS + "SELECT o_orderkey, coalesce(final, 'C' || o_custkey) AS new_category FROM orders LEFT JOIN map ON old = 'C' || o_custkey",
        "merged_counts": CHAINS + "SELECT coalesce(final, category) AS category, sum(n)::BIGINT AS n FROM cat LEFT JOIN map ON old = category GROUP BY 1",
        "run_own_names": W(TICKETS) + "\nSELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, 'Only ' || ticket_id AS category, 'discovered' AS source FROM tickets",
        "lexical_review": _lexical_review(),
        "replay_review": _replay_review(),
        "replay_review_failed": _replayed() + f"""
SELECT DISTINCT 'summary' AS part, c AS name, '' AS value FROM m0
UNION ALL SELECT 'uncategorised', '', {q(failed)} UNION ALL SELECT 'narrative', '', NULL""",
        "reply_strictness": _strictness(),
        "accuracy_summary": _accuracy(),
        "label_overlap": _label_overlap(),
        "named_tickets": W(TICKETS, LEXICAL, LABELLED) + "\nSELECT ticket_id, new_category FROM labelled WHERE new_category <> 'Uncategorised'",
        "distribution_with_zero": "WITH d AS (" + _distribution(W(TICKETS, LEXICAL, LABELLED), "labelled", "doc_id") + f"""),
z AS (SELECT o, category FROM ({zero}) WHERE category NOT IN (SELECT category FROM d))
SELECT rank, category, n, pct, label FROM d
UNION ALL SELECT CAST((SELECT coalesce(max(rank), 0) FROM d) + row_number() OVER (ORDER BY o) AS INTEGER), category, 0, 0, '0 (0%)' FROM z""",
        "low_to_uncategorised": W(TICKETS, LEXICAL) + f"""
, low AS (SELECT ticket_id, confidence, CASE WHEN confidence = 'Low' AND new_category IS NOT NULL THEN 'Uncategorised' ELSE new_category END AS c FROM lexical),
k AS (SELECT c, count(*) AS n FROM low GROUP BY 1)
SELECT ticket_id, CASE WHEN k.n < {MIN_BUCKET} AND low.c <> 'Uncategorised' THEN 'Uncategorised' ELSE low.c END AS new_category, confidence
FROM low LEFT JOIN k ON k.c = low.c""",
        "suggest_topics": _topics(f""",
held AS (SELECT topic, term, count(*) AS n FROM {{a}} JOIN vec USING (ticket_id) JOIN voc USING (t) GROUP BY 1, 2),
top AS (SELECT topic, term, n, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS rn FROM held QUALIFY rn <= {NAME_TERMS})
SELECT CAST(x.topic AS INTEGER) AS topic, x.tickets, y.terms FROM (SELECT topic, count(*) AS tickets FROM {{a}} GROUP BY 1) x
JOIN (SELECT topic, string_agg(term, ', ' ORDER BY rn) AS terms FROM top GROUP BY 1) y ON x.topic = y.topic"""),
        "ticket_topics": _topics("\nSELECT ticket_id, CAST(topic AS INTEGER) AS topic FROM tickets LEFT JOIN {a} USING (ticket_id)"),
        "label_terms": W(TICKETS) + f"""
, t AS (SELECT label, term, count(*) AS df FROM (
    SELECT current_label AS label, unnest(list_distinct(regexp_split_to_array(lower(issue_description), '[^a-z]+'))) AS term FROM tickets)
  WHERE length(term) >= 4 AND term NOT IN ({STOPS}) GROUP BY 1, 2)
SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY df DESC, term) AS INTEGER) AS rank, term, df FROM t QUALIFY rank <= {LABEL_TERMS}""",
        "json_tickets": f"""
SELECT 'K-' || doc_id AS ticket_id, md5({strip('text')}) AS text_md5, {strip("coalesce(source, '')")} AS current_label,
       CASE WHEN doc_id % 3 = 0 THEN {strip("coalesce('closed ' || lang, '')")} ELSE '' END AS resolution_notes
FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^{WS}]')""",
        "layout_tickets": """
SELECT 'H' || p_partkey AS ticket_id, '"' || p_name || '", ' || p_brand AS issue_description, p_type AS current_label, CAST(p_size AS VARCHAR) AS resolution_notes FROM part""",
        "run_diff": _run_diff(),
        "observed_totals": W(TICKETS, LEXICAL) + """
, t AS (SELECT count(*) AS a, count(*) FILTER (WHERE new_category = 'Uncategorised') AS b, count(*) FILTER (WHERE confidence = 'Low') AS c FROM lexical)
SELECT 'tickets' AS metric, a AS observed, a AS counted FROM t UNION ALL SELECT 'uncategorised', b, b FROM t UNION ALL SELECT 'low_confidence', c, c FROM t""",
        "distinct_sketches": "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS rows, true AS within_bound FROM events GROUP BY 1",
        "stream_category_state": W(TICKETS, LEXICAL) + "\nSELECT new_category AS category, min(doc_id) AS first_doc, count(*) AS n FROM lexical GROUP BY 1",
        "stream_unique_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS category, count(*) AS n FROM events GROUP BY 1, 2",
    }
