"""Quality checks (QLT1-QLT6) and near-duplicate category detection (DEC5/QLT4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import pct_half_even
from .normalise import UNCATEGORISED
from ..session import materialize, shuffle_partitions
from .taxonomy import bounded_broadcast


def grouping_purity(labelled: DataFrame, expected: str, col: str = "new_category") -> DataFrame:
    """QLT1: per predicted category, the expected label held by most of its
    tickets (ties: smaller label) and the share it covers.  A name variant
    that groups the right tickets therefore still counts as a match.
    Contingency table first (one row per pair), then a tiny window."""
    return purity_of_counts(labelled.groupBy(F.col(col).alias("category"), F.col(expected).cast("string").alias("expected")).agg(
        F.count(F.lit(1)).alias("k")))


def purity_of_counts(cont: DataFrame) -> DataFrame:
    """QLT1 from a contingency table ``(category, expected, k)``."""
    w = Window.partitionBy("category").orderBy(F.desc("k"), "expected")
    top = cont.withColumn("rn", F.row_number().over(w))
    per = top.groupBy("category").agg(
        F.sum("k").alias("tickets"),
        F.max_by("expected", F.when(F.col("rn") == 1, F.lit(1)).otherwise(F.lit(0))).alias("majority"),
        F.max(F.when(F.col("rn") == 1, F.col("k"))).alias("majority_n"),
    )
    return per.withColumn("purity_pct", pct_half_even("majority_n", "tickets"))


def accuracy_summary(labelled: DataFrame, expected: str, col: str = "new_category", target_pct: int = 80) -> DataFrame:
    """QLT1 whole: agreement of the categories with the expected labels, both ways.

    Rows ``(side, name, majority, tickets, matched, pct, rand_index, meets_target)``:
    side ``predicted`` (a category, the expected label that most of its tickets have),
    ``expected`` (an expected label, the category that most of its tickets are in) and
    one row ``overall`` (matched by the predicted side, and the adjusted Rand index:
    pairs of tickets that both partitions put together, less what chance gives).
    All of it comes from the contingency table, which is written once; tickets
    without category or expected label do not count."""
    cont = labelled.where(F.col(col).isNotNull() & F.col(expected).isNotNull()).groupBy(
        F.col(col).alias("category"), F.col(expected).cast("string").alias("expected")).agg(F.count(F.lit(1)).alias("k"))
    cont = materialize(cont, "contingency")

    def side(name: str, own: str, other: str) -> DataFrame:
        best = F.max_by(F.col(other), F.struct("k", F.col("_rank"))).alias("majority")
        # ties go to the name that sorts first
        ranked = cont.withColumn("_rank", F.row_number().over(Window.partitionBy(own).orderBy(F.desc(other))))
        per = ranked.groupBy(F.col(own).alias("name")).agg(best, F.sum("k").alias("tickets"), F.max("k").alias("matched"))
        return per.select(F.lit(name).alias("side"), "name", "majority", "tickets", "matched")

    sides = materialize(side("predicted", "category", "expected").unionByName(side("expected", "expected", "category")), "agreement")

    def pairs(n: str) -> Column:
        return F.col(n).cast("double") * (F.col(n) - 1).cast("double") / 2

    none = F.lit(0.0)
    cells = cont.select(pairs("k").alias("c"), none.alias("a"), none.alias("b"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"))
    predicted = F.col("side") == "predicted"
    margins = sides.select(none.alias("c"), F.when(predicted, pairs("tickets")).otherwise(0.0).alias("a"), F.when(predicted, 0.0).otherwise(pairs("tickets")).alias("b"),
                           F.when(predicted, F.col("tickets")).otherwise(0).alias("n"), F.when(predicted, F.col("matched")).otherwise(0).alias("m"))
    t = cells.unionByName(margins).agg(*[F.sum(c).alias(c) for c in ("c", "a", "b", "n", "m")])
    chance = F.when(F.col("n") > 1, F.col("a") * F.col("b") / pairs("n")).otherwise(0.0)
    most = (F.col("a") + F.col("b")) / 2
    rand = F.when(most == chance, F.lit(1.0)).otherwise((F.col("c") - chance) / (most - chance))
    overall = t.where(F.col("n") > 0).select(
        F.lit("overall").alias("side"), F.lit("").alias("name"), F.lit("").alias("majority"), F.col("n").alias("tickets"), F.col("m").alias("matched"),
        pct_half_even("m", "n").alias("pct"), F.round(rand, 6).alias("rand_index"), (F.col("m") * 100 >= F.col("n") * target_pct).alias("meets_target"))
    per_name = sides.withColumns({"pct": pct_half_even("matched", "tickets"), "rand_index": F.lit(None).cast("double"), "meets_target": F.lit(None).cast("boolean")})
    return per_name.unionByName(overall)


def uncategorised_rate(counts: DataFrame, target_pct: int = 15) -> DataFrame:
    """QLT2 from a count table ``(category, n)``: share of Uncategorised rows against the <15 % target."""
    own = F.sum(F.when(F.col("category") == UNCATEGORISED, F.col("n")))
    agg = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(own, F.lit(0)).alias("uncategorised"))
    return agg.withColumn("rate_pct", pct_half_even("uncategorised", "rows")).withColumn(
        "meets_target", F.col("uncategorised") * 100 < F.col("rows") * target_pct
    )


def confidence_mix(labelled: DataFrame) -> DataFrame:
    """QLT3: rows per confidence tier with share."""
    per = labelled.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("pct", pct_half_even(F.col("n"), F.sum("n").over(Window.partitionBy())))


def name_tokens(col: str) -> F.Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.col(col)), "[^a-z0-9]+"), lambda t: t != ""))


def similar_names(names: DataFrame, col: str = "name", threshold: float = 0.5) -> DataFrame:
    """QLT4 / DEC5: pairs of names whose token sets have Jaccard ≥ ``threshold``.

    Exact all-pairs similarity join with prefix filtering.  Tokens are
    ordered rarest first.  If J(x, y) ≥ t with |x| ≤ |y|, the two sets share
    at least a = t·|x ∪ y| tokens, so x's first |x| - ⌈2t/(1+t)·|x|⌉ + 1
    tokens ("index prefix") and y's first |y| - ⌈t·|y|⌉ + 1 tokens ("probe
    prefix") must intersect.  Only those prefix tokens are joined (index side
    of the shorter set against probe side of the longer), so a very common
    token, which sorts last, rarely produces candidates; the exact Jaccard is
    then computed on the candidates.  No pair meeting the threshold is lost.
    """
    # the distinct names are read four times below (frequencies, their size
    # check, index and probe sides): written once, the source is scanned once
    sets = materialize(
        names.select(F.col(col).alias("name")).distinct().withColumn("toks", name_tokens("name")).filter(F.size("toks") > 0),
        "name_sets",
    )
    return similar_token_sets(sets, threshold)


def term_profiles(terms: DataFrame, k: int = 20, col: str = "category") -> DataFrame:
    """QLT4 by content: every named category's ``k`` most frequent terms
    (ticket counts, ties by term) as ``(name, toks)``.  The top-k is a
    ``WindowGroupLimit`` before the exchange, so a category with a huge
    vocabulary ships only ``k`` terms per task."""
    w = Window.partitionBy(col).orderBy(F.desc("df"), F.asc("term"))
    top = (
        terms.filter(F.col("term").isNotNull() & F.col(col).isNotNull() & (F.col(col) != UNCATEGORISED))
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= k)
    )
    return top.groupBy(F.col(col).alias("name")).agg(F.array_sort(F.array_distinct(F.collect_list("term"))).alias("toks"))


SALT = "_salt"


def content_overlap(terms: DataFrame, threshold: float, col: str = "category") -> DataFrame:
    """QLT4 by content over whole vocabularies: pairs of named categories whose
    term sets have Jaccard ≥ ``threshold``.

    ``terms`` has one row per (category, term), so the join on the term makes
    at most categories² / 2 rows per term, and a term's rows are never more
    than the categories; sizes and shared counts are plain aggregates."""
    rows = materialize(
        terms.filter(F.col("term").isNotNull() & F.col(col).isNotNull() & (F.col(col) != UNCATEGORISED))
        .select(F.col(col).alias("name"), "term").distinct(),
        "category_terms",
    )
    sizes = rows.groupBy("name").agg(F.count(F.lit(1)).alias("s"))
    a, b = rows.withColumnRenamed("name", "name_a"), rows.withColumnRenamed("name", "name_b")
    pairs = a.join(b, "term").filter(F.col("name_a") < F.col("name_b")).groupBy("name_a", "name_b").agg(
        F.count(F.lit(1)).cast("int").alias("shared"))
    both = pairs.join(sizes.select(F.col("name").alias("name_a"), F.col("s").alias("sa")), "name_a").join(
        sizes.select(F.col("name").alias("name_b"), F.col("s").alias("sb")), "name_b")
    union = (F.col("sa") + F.col("sb") - F.col("shared")).cast("int")
    out = both.select("name_a", "name_b", "shared", union.alias("union_size"), F.round(F.col("shared") / union, 4).alias("jaccard"))
    return out.filter(F.col("shared") >= F.lit(float(threshold)) * F.col("union_size") - F.lit(1e-12))


def similar_token_sets(sets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Exact all-pairs Jaccard ≥ ``threshold`` over ``(name, toks)`` rows (one
    row per name, ``toks`` distinct and non-empty), by prefix filtering (see
    ``similar_names``)."""
    t = float(threshold)
    freq = sets.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("f"))
    freq = bounded_broadcast(freq, None)
    ordered = (
        sets.select("name", "toks", F.explode("toks").alias("tok"))
        .join(freq, "tok")
        .groupBy("name", "toks")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "tok"))), lambda x: x["tok"]).alias("_o"))
    )
    s_ = F.size("toks")
    index_len = (s_ - F.ceil(F.lit(2 * t / (1 + t)) * s_ - F.lit(1e-9)) + 1).cast("int")
    probe_len = (s_ - F.ceil(F.lit(t) * s_ - F.lit(1e-9)) + 1).cast("int")
    index = ordered.select(F.col("name").alias("name_x"), F.col("toks").alias("tx"),
                           F.explode(F.slice("_o", 1, index_len)).alias("tok"))
    probe = ordered.select(F.col("name").alias("name_y"), F.col("toks").alias("ty"),
                           F.explode(F.slice("_o", 1, probe_len)).alias("tok"))
    # a token held by more than 1/parts of the names is a hot join key: its
    # index rows are spread over ``parts`` salts and its probe rows repeated
    # once per salt, so the pairs it must produce are spread over all tasks
    # (the hot list only routes work; the result does not depend on it)
    parts = shuffle_partitions(sets.sparkSession)
    n_sets = sets.count()
    keys = ["tok"]
    if parts > 1:
        # whether a token is hot comes with its frequency, whatever their number
        heat = freq.select("tok", (F.col("f") * parts > n_sets).alias("_hot"))
        index, probe = index.join(heat, "tok"), probe.join(heat, "tok")
        index = index.withColumn(SALT, F.when(F.col("_hot"), F.pmod(F.xxhash64("name_x"), F.lit(parts))).otherwise(F.lit(0))).drop("_hot")
        probe = probe.withColumn(
            SALT, F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
        keys = ["tok", SALT]
    cand = (
        index.join(probe, keys)
        .filter((F.col("name_x") != F.col("name_y")) & (F.size("tx") <= F.size("ty"))
                & (F.size("tx") >= F.lit(t) * F.size("ty") - F.lit(1e-9)))
        .select(
            F.least("name_x", "name_y").alias("name_a"), F.greatest("name_x", "name_y").alias("name_b"),
            F.col("tx").alias("ta"), F.col("ty").alias("tb"),
        )
        .dropDuplicates(["name_a", "name_b"])
    )
    shared = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - shared
    out = cand.select("name_a", "name_b", shared.alias("shared"), union.alias("union_size")).withColumn(
        "jaccard", F.round(F.col("shared") / F.col("union_size"), 4)
    )
    return out.filter(F.col("shared") >= F.lit(t) * F.col("union_size") - F.lit(1e-12))


def merge_decisions(similar: DataFrame, hi: float = 0.8, lo: float = 0.5, max_flags: int = 3) -> DataFrame:
    """DEC5: Jaccard ≥ hi → auto merge (into the name that sorts first);
    lo ≤ J < hi → flag, the top ``max_flags`` by similarity."""
    auto = similar.filter(F.col("jaccard") >= hi).select(
        F.lit("merge").alias("action"), "name_a", "name_b", "jaccard"
    )
    flags = (
        similar.filter((F.col("jaccard") >= lo) & (F.col("jaccard") < hi))
        .orderBy(F.desc("jaccard"), "name_a", "name_b")
        .limit(max_flags)
        .select(F.lit("flag").alias("action"), "name_a", "name_b", "jaccard")
    )
    return auto.unionByName(flags)


def merge_safety(labelled_before: DataFrame, mapping: dict, expected: str, col: str = "new_category") -> DataFrame:
    """QLT5: for every merge target, the share of its tickets whose expected
    label equals the target's majority label (≥ 50 % is considered safe)."""
    if not mapping:
        return labelled_before.sparkSession.createDataFrame([], "target string, tickets long, agree long, safe boolean")
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    moved = labelled_before.withColumn("target", F.element_at(m, F.col(col))).filter(F.col("target").isNotNull())
    pur = grouping_purity(moved.withColumnRenamed(col, "_orig").withColumnRenamed("target", col), expected, col)
    return pur.select(F.col("category").alias("target"), "tickets", F.col("majority_n").alias("agree"),
                      (F.col("majority_n") * 2 >= F.col("tickets")).alias("safe"))

