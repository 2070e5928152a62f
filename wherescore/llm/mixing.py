"""Mixing to target weights by soft membership, in DataFrame operations only.

A classifier learnt from labelled rows gives each document a posterior over domains. Nonnegative document rates are then
fitted by projected gradient steps so that the expected token totals of the domains match their targets.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherescore.llm.common import ROW_KEY, packed, repeated, row_key, whole_text
from wherescore.operators.joins import spread_join
from wherescore.sources.scratch import settle

#: Share of tokens that each domain should get.
TARGETS = {"de": 0.20, "en": 0.45, "es": 0.15, "fr": 0.20}
#: Labelled rows that the classifier is fitted on, at most (in expectation), and words that it knows: a broadcast table.
MAX_TRAINING_ROWS = 10_000
VOCABULARY = 2_000
#: Gap of a domain's tokens, as a share of all, that counts as none; passes without progress after which a target is out of reach.
TOLERANCE = 1e-5
PATIENCE = 10


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def word_weights(labelled: DataFrame, domains: list[str], size: int = VOCABULARY) -> DataFrame:
    """Multinomial naive Bayes: word, and weights w_0 ... (log odds against the mean domain) of the most telling words."""
    exploded = labelled.select("domain", F.explode_outer(words(F.col("text"))).alias("word")).where("word != ''")
    per = [F.count_if(F.col("domain") == d).alias(f"n_{k}") for k, d in enumerate(domains)]
    counts = exploded.groupBy("word").agg(*per, F.count("*").alias("n")).where("n >= 5")
    sums = counts.agg(*[F.sum(f"n_{k}") for k in range(len(domains))]).first()
    logs = [F.log((F.col(f"n_{k}") + 0.5) / float((sums[k] or 0) + 0.5 * size)) for k in range(len(domains))]
    mean = sum(logs, F.lit(0.0)) / len(domains)
    weighted = counts.select("word", "n", *[(x - mean).alias(f"w_{k}") for k, x in enumerate(logs)])
    gain = F.col("n") * F.greatest(*[F.abs(f"w_{k}") for k in range(len(domains))], F.lit(0.0))
    return weighted.orderBy(gain.desc(), "word").limit(size).drop("n")


def training_rows(docs: DataFrame, labels: DataFrame, domains: list[str], max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Text and domain of labelled documents (labels: doc_id, domain), of the ids whose hash is below a share."""
    usable = labels.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    share = min(1.0, max_rows / max(1, usable.count()))
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(sample), "doc_id").select("text", "domain")


def memberships(docs: DataFrame, weights: DataFrame, domains: list[str]) -> DataFrame:
    """Distinct rows with their number of repetitions, tokens and posterior: row keys, doc_id, copies, tokens, p_0 ...

    Tokens are runs of letters. A text without known words, an empty or a null one has equal posteriors.
    """
    # The outer form: else Spark infers a filter on the array's size, for which it splits each text once more.
    split = docs.select(*row_key(), "doc_id", words(whole_text()).alias("_words"))
    first, last = F.get("_words", F.lit(0)), F.get("_words", F.size("_words") - 1)
    empty = F.when(first == "", 1).otherwise(0) + F.when((F.size("_words") > 1) & (last == ""), 1).otherwise(0)  # at the ends only
    size = (F.size("_words") - empty).cast("long").alias("_size")
    tokens = split.select(*ROW_KEY, "doc_id", size, F.posexplode_outer("_words").alias("_at", "word"))
    known = tokens.join(F.broadcast(weights.withColumn("_known", F.lit(True))), "word", "left")
    copies = F.count_if(F.col("_at") == 0)
    sums = known.where("_known or _at = 0").groupBy(*ROW_KEY, "doc_id").agg(  # tokens without weight add nothing
        copies.alias("copies"),
        F.max("_size").alias("tokens"),
        *[(F.coalesce(F.sum(f"w_{k}"), F.lit(0.0)) / copies).alias(f"s_{k}") for k in range(len(domains))],
    )
    scores = [F.col(f"s_{k}") for k in range(len(domains))]
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    total = sum((F.exp(s - top) for s in scores), F.lit(0.0))
    return sums.select(*ROW_KEY, "doc_id", "copies", "tokens", *[(F.exp(s - top) / total).alias(f"p_{k}") for k, s in enumerate(scores)])


def solve(matrix: list[list[float]], vector: list[float]) -> list[float]:
    """Solution of a small symmetric system; directions without mass get 0."""
    n = len(vector)
    rows = [[*r, v] for r, v in zip(matrix, vector, strict=True)]
    scale = max((abs(x) for r in matrix for x in r), default=0.0)
    found = [0.0] * n
    pivots = []
    for c in range(n):
        best = max((r for r in range(n) if r not in pivots), key=lambda r: abs(rows[r][c]))
        if abs(rows[best][c]) <= 1e-12 * scale:
            continue
        pivots.append(best)
        for r in range(n):
            if r != best:
                share = rows[r][c] / rows[best][c]
                rows[r] = [x - share * y for x, y in zip(rows[r], rows[best], strict=True)]
        found[c] = best + 0.5  # the row that holds it, until all are eliminated
    return [rows[int(x)][n] / rows[int(x)][c] if x else 0.0 for c, x in enumerate(found)]


def rates(
    docs: DataFrame,
    labels: DataFrame,
    targets: Mapping[str, float],
    least: float = 0.0,
    grow: bool = False,
    most: float | None = None,
    max_rows: int = MAX_TRAINING_ROWS,
) -> DataFrame:
    """One row per distinct row of ``docs``: row keys, doc_id, copies, tokens, p_0 ... (domains in order of name), rate.

    Minimises the squared gaps between the domains' expected totals (sum of rate x tokens x posterior) and their targets
    over rates from ``least`` to ``most`` (None: without a bound), starting from 1. The targets' sum is the present number of
    tokens, or with ``grow`` the least with which no domain shrinks. A domain without labelled rows cannot be told apart: it
    has no target, and those of the others share the sum. Columns other than doc_id and text are not looked at, repeated
    rows are one with their number in ``copies``. An empty table gives no rows.

    Each pass aggregates one total per domain, then one per pair of domains; the step of a document follows from these and its
    own posterior, so no rates are gathered. Steps are scaled by the pairs' totals over the documents that are free to move, or
    by the totals of the domains where that made the gap larger. Passes end at the tolerance; if PATIENCE of them in a row
    bring no progress, the bounds leave a target out of reach, which a warning tells with the gap that is left.
    """
    domains = sorted(targets)
    weights = word_weights(training_rows(docs, labels, domains, max_rows), domains)
    rows = settle(memberships(docs, settle(weights), domains))
    p = [F.col(f"p_{k}") for k in range(len(domains))]
    tokens = F.col("copies") * F.col("tokens")
    present = [x or 0.0 for x in rows.agg(*[F.sum(tokens * x) for x in p]).first()]
    labelled = {r[0] for r in labels.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).select("domain").distinct().collect()}
    real = [k for k, d in enumerate(domains) if d in labelled and present[k] > 0]
    weight = sum(targets[domains[k]] for k in real)
    shares = {k: targets[domains[k]] / weight if weight else 0.0 for k in real}
    total = max((present[k] / s for k, s in shares.items() if s), default=0.0) if grow else sum(present)
    above = lambda r: F.greatest(F.lit(float(least)), r)
    bounded = above if most is None else lambda r: F.least(F.lit(float(most)), above(r))

    def rate(taken: list[list[float]]) -> Column:
        if not taken:
            return F.lit(1.0)
        steps = F.array(*[F.array(*[F.lit(float(x)) for x in y]) for y in taken])
        step = lambda r, y: bounded(r - sum((F.get(y, F.lit(i)) * p[k] for i, k in enumerate(real)), F.lit(0.0)))
        return F.aggregate(steps, F.lit(1.0), step)

    taken: list[list[float]] = []
    best, without_progress, plain = (math.inf, []), 0, []
    while real:
        current = rate(taken)
        sums = rows.agg(*[F.sum(tokens * p[k] * current) for k in real]).first()
        gaps = [(x or 0.0) - total * shares[k] for k, x in zip(real, sums, strict=True)]
        gap = max(map(abs, gaps)) / max(total, 1.0)
        without_progress = 0 if gap < 0.99 * best[0] else without_progress + 1
        worse = gap > best[0] and bool(plain)
        if gap < best[0]:
            best = (gap, list(taken))
            plain = [x / present[k] for k, x in zip(real, gaps, strict=True)]
        if gap <= TOLERANCE or without_progress >= PATIENCE:
            break
        if worse:  # back to the best rates, and from there by the domains' own totals
            taken = [*best[1], plain]
            plain = []
            continue
        pull = sum((F.lit(x / present[k]) * p[k] for k, x in zip(real, gaps, strict=True)), F.lit(0.0))
        free = (current > least) | (pull < 0)  # not held down at the bound
        free = free if most is None else free & ((current < most) | (pull > 0))
        pairs = [(i, j) for i in range(len(real)) for j in range(i + 1)]
        sums = rows.agg(*[F.sum(F.when(free, tokens * p[real[i]] * p[real[j]])) for i, j in pairs]).first()
        matrix = [[0.0] * len(real) for _ in real]
        for (i, j), x in zip(pairs, sums, strict=True):
            matrix[i][j] = matrix[j][i] = x or 0.0
        taken = [*taken, solve(matrix, gaps)]
    if real and best[0] > TOLERANCE:
        warnings.warn(f"rates leave a gap of {best[0]:.2g} of all tokens to the targets", stacklevel=2)
    return rows.withColumn("rate", rate(best[1]))


def resample(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Each row of ``docs`` as often as its rate says: the whole part, and once more for a matching share of hashes.

    Rows are found again by id and text, so rows that are the same in both share their rate and fate. Columns stay as they
    are, whatever their names; an empty table gives no rows, and rates of 0 drop theirs.
    """
    joined = spread_join(packed(docs), found.select(*ROW_KEY, "rate"), ROW_KEY, "inner")
    chance = F.pmod(F.xxhash64(F.lit("mix"), *ROW_KEY), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor("rate").cast("long") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return repeated(joined.select("_row", times.alias("times")), "times", "nth").select("_row.*")
