"""DEC4 by topics: TF-IDF vectors of all tickets and k-means with fixed starting points.

The vocabulary is the terms that most tickets hold; a ticket's vector has the
integer IDF weight of each vocabulary term it holds (its non-zero places are
written once, a few small integers per ticket).  Centres are integers, so sums and
ties are exact and a run can be repeated in any engine.  An iteration is one
projection (distances to all centres) and one aggregate over (topic, term); only
topics x vocabulary numbers reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import materialize
from .taxonomy import STOP_WORDS

# --- fixed values -----------------------------------------------------------
TOPICS, VOCABULARY, ITERATIONS = 5, 60, 4
IDF_SCALE = 100           # weights are round(100 * ln(tickets / tickets with the term))
NAME_TERMS = 3            # terms that name a topic
# -----------------------------------------------------------------------------


def vocabulary(tickets: DataFrame, size: int = VOCABULARY, min_len: int = 4, text: str = "issue_description") -> tuple[int, list[tuple[str, int]]]:
    """Number of tickets, and the terms that most of them hold with their weights
    (by falling count, ties by term)."""
    terms = F.filter(F.array_distinct(tokens(text)), lambda t: (F.length(t) >= min_len) & ~t.isin(list(STOP_WORDS)))
    counts = tickets.select(F.explode(F.concat(terms, F.array(F.lit(None).cast("string")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    counts = materialize(counts, "topic_terms")  # the null term counts the tickets
    n = next((r["df"] for r in counts.where("term is null").collect()), 0)
    top = counts.where("term is not null").withColumn("w", F.round(F.lit(IDF_SCALE) * F.log(F.lit(n).cast("double") / F.col("df"))).cast("long"))
    return n, [(r["term"], r["w"]) for r in top.orderBy(F.desc("df"), "term").limit(size).collect()]


def vectors(tickets: DataFrame, terms: list[str], id_col: str = "ticket_id", text: str = "issue_description") -> DataFrame:
    """``(id, ts)``: per ticket the places of the vocabulary terms it holds."""
    if not terms:
        return tickets.select(id_col, F.array().cast("array<int>").alias("ts"))
    words = F.array(*[F.lit(t) for t in terms])
    held = F.array_intersect(tokens(text), words)
    return tickets.select(id_col, F.transform(held, lambda t: F.array_position(words, t).cast("int") - 1).alias("ts"))


def nearest(centres: list[list[int]], weights: list[int]) -> Column:
    """Topic of a vector (the smallest of the nearest ones), null without any term:
    the largest ``2 w.c - c.c``."""
    def score(c: list[int]) -> Column:
        dots = F.array(*[F.lit(2 * w * x).cast("long") for w, x in zip(weights, c, strict=True)])
        return F.aggregate("ts", F.lit(0).cast("long"), lambda a, t: a + F.get(dots, t)) - F.lit(sum(x * x for x in c))

    scores = F.array(*[score(c) for c in centres])
    return F.when(F.size("ts") > 0, F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def topics(tickets: DataFrame, k: int = TOPICS, size: int = VOCABULARY, iterations: int = ITERATIONS,
           id_col: str = "ticket_id", text: str = "issue_description") -> tuple[DataFrame, DataFrame]:
    """Tickets with their topic ``(id, topic)``, and the topics themselves
    ``(topic, tickets, terms)`` (``terms``: what most of its tickets hold).

    Topic ``i`` starts at the vector of the i-th vocabulary term alone.  A centre is
    the mean of its tickets' vectors, rounded down; a topic without tickets keeps its
    centre.  Tickets without a vocabulary term have no topic."""
    _, terms = vocabulary(tickets, size, text=text)
    weights = [w for _, w in terms]
    k = min(k, len(terms))
    rows = materialize(vectors(tickets, [t for t, _ in terms], id_col, text), "topic_vectors")
    if not k:
        empty = rows.sparkSession.createDataFrame([], "topic int, tickets long, terms string")
        return rows.select(id_col, F.lit(None).cast("int").alias("topic")), empty
    centres = [[w if t == i else 0 for t, w in enumerate(weights)] for i in range(k)]
    for _ in range(iterations):
        held = rows.select(nearest(centres, weights).alias("topic"), F.explode(F.concat("ts", F.array(F.lit(-1)))).alias("t")).where("topic is not null")
        counts = {(r["topic"], r["t"]): r["n"] for r in held.groupBy("topic", "t").agg(F.count(F.lit(1)).alias("n")).collect()}
        for i in range(k):
            n = counts.get((i, -1))
            if n:
                centres[i] = [w * counts.get((i, t), 0) // n for t, w in enumerate(weights)]
    placed = rows.select(id_col, nearest(centres, weights).alias("topic"), "ts")
    words = F.array(*[F.lit(t) for t, _ in terms])
    per_term = placed.where("topic is not null").select("topic", F.explode(F.concat("ts", F.array(F.lit(-1)))).alias("t"))
    per_term = per_term.groupBy("topic", "t").agg(F.count(F.lit(1)).alias("n"))
    named = per_term.groupBy("topic").agg(
        F.max(F.when(F.col("t") == -1, F.col("n"))).alias("tickets"),
        F.slice(F.sort_array(F.collect_list(F.when(F.col("t") >= 0, F.struct((-F.col("n")).alias("n"), F.get(words, F.col("t")).alias("term"))))), 1, NAME_TERMS).alias("top"))
    named = named.select("topic", "tickets", F.array_join(F.transform("top", lambda x: x["term"]), ", ").alias("terms"))
    return placed.drop("ts"), named
