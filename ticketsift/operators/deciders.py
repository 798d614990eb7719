"""Deciders: who picks the category of each ticket.

* ``lexical``  – pure Spark expressions (DEC2/DEC3): keyword overlap scores,
  argmax with ordinal tie-break.  One projection, no shuffle, no Python.
* ``replay``   – recorded raw replies joined to the request table on ``batch_id``.
* ``callable`` – a caller-supplied ``str -> str`` model client run inside
  ``mapInPandas`` (DEC1); one client per Arrow batch stream, errors captured
  per request instead of failing the task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens, ustrip
from .normalise import UNCATEGORISED
from .taxonomy import Taxonomy

NO_MATCH_REASON = "No category keyword matched."


def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lexical_text(desc: str = "issue_description", notes: str = "resolution_notes") -> Column:
    return F.concat_ws(" ", F.col(desc), F.col(notes))


def score_columns(df: DataFrame, taxonomy: Taxonomy, text: Column | None = None) -> DataFrame:
    """Add ``_m`` (matched keywords, distinct) and one integer score per category.

    The text is tokenised once and intersected once with the union of all
    keywords; the per-category intersections then run on that tiny array.
    """
    text = lexical_text() if text is None else text
    cats = taxonomy.categories
    df = df.withColumn("_m", F.array_intersect(tokens(text), _arr(taxonomy.keywords())))
    return df.withColumns(
        {f"_s{i}": (F.size(F.array_intersect(F.col("_m"), _arr(c.keywords))) * F.lit(c.weight)) for i, c in enumerate(cats)}
    )


def label_lexical(
    df: DataFrame,
    taxonomy: Taxonomy,
    text: Column | None = None,
    with_tags: bool = False,
    keep_scores: bool = False,
    wide: bool | None = None,
) -> DataFrame:
    """DEC2 (+ DEC3 when ``with_tags``): primary category, confidence, reason.

    * primary   = highest score, tie → lower ordinal; best score 0 → Uncategorised
    * confidence High: best ≥ 2 and a unique leader; Medium: best = 1 and unique; else Low
    * reasoning ``Matched: k1, k2`` (winner's matched keywords, sorted) or the no-match line
    * tags      all categories with score ≥ 1, by score desc then ordinal
    """
    cats = taxonomy.categories
    if wide is None:
        wide = len(cats) > LITERAL_CATEGORY_LIMIT
    if cats and wide:
        return observe_labels(_label_lexical_wide(df, taxonomy, text, with_tags))
    if not cats:
        out = df.withColumns(
            {"new_category": F.lit(UNCATEGORISED), "confidence": F.lit("Low"), "reasoning": F.lit(NO_MATCH_REASON)}
        )
        return out.withColumn("tags", F.array().cast("array<string>")) if with_tags else out
    scored = score_columns(df, taxonomy, text)
    s = [F.col(f"_s{i}") for i in range(len(cats))]
    best = F.greatest(*s) if len(s) > 1 else s[0]
    scored = scored.withColumn("_best", best)
    b = F.col("_best")
    ntop = sum((F.when(si == b, 1).otherwise(0) for si in s), F.lit(0))
    winner = F.when(b == 0, F.lit(UNCATEGORISED))
    why = F.when(b == 0, F.lit(NO_MATCH_REASON))
    for i, c in enumerate(cats):
        winner = winner.when(s[i] == b, F.lit(c.name))
        why = why.when(
            s[i] == b,
            F.concat(F.lit("Matched: "), F.array_join(F.sort_array(F.array_intersect(F.col("_m"), _arr(c.keywords))), ", ")),
        )
    cols = {
        "new_category": winner,
        "confidence": F.when((b >= 2) & (ntop == 1), "High").when((b == 1) & (ntop == 1), "Medium").otherwise("Low"),
        "reasoning": why,
    }
    if with_tags:
        hits = F.array_compact(
            F.array(*[F.when(s[i] > 0, F.struct((-s[i]).alias("k"), F.lit(i).alias("o"), F.lit(c.name).alias("c"))) for i, c in enumerate(cats)])
        )
        cols["tags"] = F.transform(F.sort_array(hits), lambda x: x["c"])
    out = scored.withColumns(cols)
    if not keep_scores:
        out = out.drop("_m", "_best", *[f"_s{i}" for i in range(len(cats))])
    return observe_labels(out)


LITERAL_CATEGORY_LIMIT = 64


def _label_lexical_wide(df: DataFrame, taxonomy: Taxonomy, text: Column | None, with_tags: bool) -> DataFrame:
    """The same decision for a taxonomy of hundreds of categories.

    Per-category ``CASE`` chains grow with the taxonomy and outgrow code
    generation, so here the categories live in three literals (keyword →
    category ordinals map, weights, names) and the scores are one array:
    O(matched keywords × categories) per row, still one projection.
    """
    cats = taxonomy.categories
    k = len(cats)
    owners: dict[str, list[int]] = {}
    for i, c in enumerate(cats):
        for kw in dict.fromkeys(c.keywords):     # a repeated keyword counts once, as in the narrow form
            owners.setdefault(kw, []).append(i)
    kw_map = F.create_map(*[x for kw, os_ in owners.items() for x in (F.lit(kw), F.array(*[F.lit(o) for o in os_]))]) \
        if owners else F.create_map().cast("map<string,array<int>>")
    weights = F.array(*[F.lit(c.weight) for c in cats])
    names = F.array(*[F.lit(c.name) for c in cats])
    text = lexical_text() if text is None else text
    m = F.array_intersect(tokens(text), _arr(list(owners)))
    df = df.withColumn("_m", m)
    hits = F.flatten(F.transform(F.col("_m"), lambda w: F.element_at(kw_map, w)))
    scores = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                         lambda i: F.size(F.filter(hits, lambda h: h == i)) * F.element_at(weights, i + 1))
    df = df.withColumn("_sc", scores).withColumn("_best", F.array_max("_sc"))
    b = F.col("_best")
    win = F.array_position(F.col("_sc"), b) - 1
    ntop = F.size(F.filter(F.col("_sc"), lambda x: x == b))
    won = F.filter(F.col("_m"), lambda w: F.array_contains(F.element_at(kw_map, w), win.cast("int")))
    cols = {
        "new_category": F.when(b == 0, F.lit(UNCATEGORISED)).otherwise(F.element_at(names, win.cast("int") + 1)),
        "confidence": F.when((b >= 2) & (ntop == 1), "High").when((b == 1) & (ntop == 1), "Medium").otherwise("Low"),
        "reasoning": F.when(b == 0, F.lit(NO_MATCH_REASON)).otherwise(
            F.concat(F.lit("Matched: "), F.array_join(F.sort_array(won), ", "))),
    }
    if with_tags:
        ranked = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(
            (-F.element_at(F.col("_sc"), i + 1)).alias("k"), i.alias("o"), F.element_at(names, i + 1).alias("c")))
        cols["tags"] = F.transform(F.sort_array(F.filter(ranked, lambda x: x["k"] < 0)), lambda x: x["c"])
    return df.withColumns(cols).drop("_m", "_sc", "_best")


def observe_labels(df: DataFrame, name: str | None = None) -> DataFrame:
    """Attach label metrics (rows, Uncategorised, Low) to the labelled table.

    Besides the metrics, the CollectMetrics node stops the optimizer from
    pushing later filters on ``new_category`` below the scoring projection,
    which would otherwise inline (and re-run) the tokeniser once per filter
    reference.
    """
    return df.observe(
        name or f"labels_{uuid.uuid4().hex[:12]}",
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("new_category") == UNCATEGORISED).alias("uncategorised"),
        F.count_if(F.col("confidence") == "Low").alias("low"),
    )


# ---------------------------------------------------------------- DEC1 ------

PROMPT_BATCH_KEY, PROMPT_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
RESPONSE_SCHEMA = "batch_id long, raw string, error string"


def call_requests(requests: DataFrame, call_factory: Callable[[], Callable[[str], str]],
                  concurrency: int | None = None) -> DataFrame:
    """DEC1: run a model client over a ``requests(batch_id, prompt)`` table.

    ``call_factory`` builds one client per task (connection reuse); the client
    maps a prompt to the stripped reply text.  An exception becomes the
    ``error`` column of that one request; the task itself never fails, so a
    requests answered in a finished (written) round are never sent again; a task
    that is retried inside a running round repeats its own calls.

    The requests are dealt round-robin over ``concurrency`` tasks (default:
    the cluster's parallelism): prompts are small, so adaptive execution
    would otherwise coalesce them into a few partitions and the calls would
    run nearly one after another.  A hash repartition on ``batch_id`` would be
    dropped as redundant after the grouping that built the requests; the
    round-robin one is kept, balances the calls, and is deterministic under
    retries (Spark sorts the rows before dealing them).
    """
    n = concurrency or requests.sparkSession.sparkContext.defaultParallelism
    requests = requests.repartition(max(1, n))
    # a prompt holds whole texts: an Arrow batch takes a few of them, bounded by bytes
    conf = requests.sparkSession.conf
    if conf.get(PROMPT_BATCH_KEY, None) in (None, "-1") or int(conf.get(PROMPT_BATCH_KEY)) > PROMPT_BATCH_BYTES:
        conf.set(PROMPT_BATCH_KEY, str(PROMPT_BATCH_BYTES))

    def run(batches):
        call = call_factory()
        for pdf in batches:
            raws, errs = [], []
            for p in pdf["prompt"]:
                try:
                    raws.append(str(call(p)).strip())
                    errs.append(None)
                except Exception as e:  # noqa: BLE001 - recorded per request
                    raws.append(None)
                    errs.append(str(e))
            yield pd.DataFrame({"batch_id": pdf["batch_id"].astype("int64"), "raw": raws, "error": errs})

    return requests.select("batch_id", "prompt").mapInPandas(run, RESPONSE_SCHEMA)


def replay_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """``replay`` decider: recorded replies keyed by ``batch_id``.  A request
    without a recorded reply gets an error, as a failed call would."""
    rec = responses.select("batch_id", "raw", F.col("error").alias("_err") if "error" in responses.columns else F.lit(None).cast("string").alias("_err"))
    j = requests.select("batch_id").join(rec, "batch_id", "left")
    return j.select(
        "batch_id",
        ustrip("raw").alias("raw"),
        F.when(F.col("raw").isNull() & F.col("_err").isNull(), F.lit("no recorded response")).otherwise(F.col("_err")).alias("error"),
    )
