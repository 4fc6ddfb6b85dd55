"""Mixing sources to target weights by soft domain membership.

A classifier fitted on a labelled table gives each document a probability for each domain. A document's rate, the
expected number of times it is taken, is then fitted by projected gradient: rates are 0 or more, start at 1, and make the
expected tokens of each domain (sum of probability * tokens * rate) match the targets in least squares. A step needs only
the domains' totals, so a pass is one aggregation, and a document's rate is a fold of its probabilities over the few
steps made.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaya.llm.sampling import first_by_hash
from assaya.shared import cut, stored

SPACE = r"[ \t-\r]+"
#: Bins of each feature of the classifier.
BINS = 8


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")


def lexicon(docs: DataFrame, labelled: DataFrame, words: int, least: int) -> dict[str, list[str]]:
    """For each domain the ``words`` words whose share of its documents most exceeds that of all others', in standard
    errors, of those that ``least`` of its documents have. ``docs``: ``_id``, ``_text``; ``labelled``: ``_id``, ``domain``.
    """
    totals = {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect()}
    if not totals:
        return {}
    parts = docs.join(labelled, "_id").select("domain", F.explode(F.array_distinct(_words(F.col("_text")))).alias("word"))
    counts = parts.groupBy("word", "domain").agg(F.count("*").alias("n"))
    per_word = counts.groupBy("word").agg(*[F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(totals)])
    per_word = cut(per_word.filter(" or ".join(f"n{i} >= {least}" for i in range(len(totals))) or "false"))
    found = {}
    for i, d in enumerate(totals):
        inside, outside = totals[d], max(1, sum(totals.values()) - totals[d])
        others = sum((F.col(f"n{j}") for j in range(len(totals)) if j != i), F.lit(0))
        a, b = F.col(f"n{i}") / inside, others / outside
        pooled = (F.col(f"n{i}") + others) / (inside + outside)
        z = F.try_divide(a - b, F.sqrt(pooled * (1 - pooled) * F.lit(1 / inside + 1 / outside)))
        best = per_word.filter(F.col(f"n{i}") >= least).select("word", z.alias("z")).filter("z > 4").orderBy(F.desc("z"), "word").limit(words)
        found[d] = [r["word"] for r in best.collect()]
    return found


def features(docs: DataFrame, lexicons: dict[str, list[str]]) -> DataFrame:
    """(_id, n_tokens, f0, f1, ...): tokens are words; features are bins 0 to BINS - 1 of shares of symbols, capitals,
    marks and distinct words, and of the numbers of distinct words of each lexicon."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    share = lambda pattern: F.try_divide(F.length(text) - F.length(F.regexp_replace(text, pattern, "")), F.length(text))
    words = _words(F.col("_text"))
    sized = F.transform(
        F.array(words),
        lambda w: F.struct(
            F.size(w).alias("n"),
            F.transform(
                F.array(F.array_distinct(w)),
                lambda d: F.struct(F.size(d).alias("n"), *[F.size(F.array_intersect(d, F.array(*map(F.lit, v)).cast("array<string>"))).alias(f"l{i}") for i, v in enumerate(lexicons.values())]),
            ).alias("d"),
        ),
    )
    rows = docs.select("_id", F.get(sized, F.lit(0)).alias("_w"), share(r"[#*$%&|<>]+").alias("_s"), share(r"\p{Lu}+").alias("_u"), share(r"[!?]+").alias("_m"))
    rows = rows.select("*", F.get("_w.d", F.lit(0)).alias("_d"))
    binned = lambda x: F.least(F.lit(BINS - 1), F.floor(F.coalesce(F.sqrt(x), F.lit(0.0)) * BINS)).cast("int")
    values = [binned(F.col("_s")), binned(F.col("_u")), binned(F.col("_m")), binned(F.try_divide("_d.n", "_w.n"))]
    values += [F.least(F.lit(BINS - 1), F.col(f"_d.l{i}")).cast("int") for i in range(len(lexicons))]
    return rows.select("_id", F.col("_w.n").cast("long").alias("n_tokens"), *[v.alias(f"f{i}") for i, v in enumerate(values)])


def posteriors(rows: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """Adds ``p``, the probabilities of ``domains``, by naive Bayes over the features' bins with add-one smoothing."""
    names = [c for c in rows.columns if c.startswith("f") and c[1:].isdigit()]
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("bin")) for i, c in enumerate(names)])).alias("x")
    counted = rows.join(labelled, "_id").select("domain", bins).groupBy("domain", "x.f", "x.bin").agg(F.count("*").alias("n")).collect()
    table = np.ones((len(domains), len(names), BINS))
    for r in counted:
        table[domains.index(r["domain"]), r["f"], r["bin"]] += r["n"]
    prior = table[:, 0, :].sum(axis=1)
    logs = np.log(table / table.sum(axis=2, keepdims=True))
    scores = []
    for d in range(len(domains)):
        score = F.lit(float(np.log(prior[d] / prior.sum())))
        for i, c in enumerate(names):
            score = score + F.get(F.array(*[F.lit(float(x)) for x in logs[d, i]]), F.col(c))
        scores.append(score)
    most = F.array_max("_scores")
    exps = F.transform("_scores", lambda s: F.exp(s - most))
    rows = rows.select("_id", "n_tokens", F.array(*scores).alias("_scores")).select("_id", "n_tokens", exps.alias("_e"))
    total = F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)
    return rows.select("_id", "n_tokens", F.transform("_e", lambda e: e / total).alias("p"))


def _rate(steps: list[tuple[float, np.ndarray]], n: int, lowest: Column) -> Column:
    """(now, last) after ``steps`` (momentum, change) from the row's ``rate``, of the same form: each goes on by the
    momentum's part of the last move, adds the change's product with the probabilities, and raises what is too low to
    ``lowest``."""
    if not steps:
        return F.col("rate")
    all_steps = F.array(*[F.array(*[F.lit(float(x)) for x in (m, *g)]) for m, g in steps])
    change = lambda g: sum((F.get(g, F.lit(d + 1)) * F.get(F.col("p"), F.lit(d)) for d in range(n)), F.lit(0.0))
    pair = lambda now, last: F.struct(now.alias("now"), last.alias("last"))

    def move(acc: Column, g: Column) -> Column:
        return pair(F.greatest(lowest, acc["now"] + F.get(g, F.lit(0)) * (acc["now"] - acc["last"]) + change(g)), acc["now"])

    return F.aggregate(all_steps, F.col("rate"), move)


def fit_rates(rows: DataFrame, targets: np.ndarray, lowest: Column, tolerance: float = 3e-4, patience: int = 10, gain: float = 0.02) -> tuple[DataFrame, np.ndarray]:
    """The rows (n_tokens, p and more) with ``rate``, and the totals that the rates give.

    Projected gradient with momentum: distances between rates are weighted by tokens, the step is 1 over the largest
    eigenvalue of the domains' Gram matrix. Stops when all totals are within ``tolerance`` of the targets' sum; where the
    bounds keep some from it, at the least squared distance met, once ``patience`` steps together brought it down by less
    than ``gain`` of itself. Rates are written down after every ``patience`` steps, so that a pass folds over few.
    """
    n = len(targets)
    p = [F.get("p", F.lit(d)) for d in range(n)]
    sums = rows.agg(*[F.coalesce(F.sum(p[a] * p[b] * F.col("n_tokens")), F.lit(0.0)).alias(f"g{a}_{b}") for a in range(n) for b in range(a, n)]).first()
    gram = np.array([[sums[f"g{min(a, b)}_{max(a, b)}"] for b in range(n)] for a in range(n)])
    size = max(float(np.linalg.eigvalsh(gram).max()), 1e-12)
    start = F.greatest(F.lit(1.0), lowest)
    held = rows.withColumn("rate", F.struct(start.alias("now"), start.alias("last")))
    steps: list[tuple[float, np.ndarray]] = []
    best, best_at, best_totals, before, pace, met = np.inf, (held, []), None, None, 1.0, []
    while True:
        rated = held.select("p", (_rate(steps, n, lowest)["now"] * F.col("n_tokens")).alias("_rn"))
        r = rated.agg(*[F.coalesce(F.sum(p[d] * F.col("_rn")), F.lit(0.0)).alias(f"t{d}") for d in range(n)]).first()
        totals = np.array([r[f"t{d}"] for d in range(n)])
        off = float(((totals - targets) ** 2).sum())
        if off < best or best_totals is None:
            best, best_at, best_totals = off, (held, list(steps)), totals
        met.append(best)
        stalled = len(met) > patience and best > (1 - gain) * met[-1 - patience]
        if stalled or np.abs(totals - targets).max() <= tolerance * max(targets.sum(), 1.0):
            break
        if len(steps) >= patience:
            held, steps = cut(held.withColumn("rate", _rate(steps, n, lowest))), []
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        momentum, pace = (0.0, 1.0) if before is None else ((pace - 1) / faster, faster)
        ahead = totals if before is None else totals + momentum * (totals - before)
        steps.append((momentum, -(ahead - targets) / size))
        before = totals
    held, steps = best_at
    return held.withColumn("rate", _rate(steps, n, lowest)["now"]), best_totals


def mix(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "domain",
    anchor: str | None = None,
    most_labelled: int = 12_000,
    words: int = 64,
    least: int = 6,
    keep_anchor: bool = False,
    seed: int = 11,
) -> DataFrame:
    """One row per input row: id, n_tokens, p (probabilities of the domains of ``weights``, in their order), rate, copies,
    the rate rounded up or down by a hash of the id so that its expectation is the rate, and ``off``, by how much of all
    target tokens the domain that is furthest from its target misses it, the same for all rows.

    ``labels``: id and ``domain_col``; rows of other domains are left out. The classifier is fitted on at most
    ``most_labelled`` of them, the first in the order of a hash. Targets share out all tokens by the weights, or, with an
    ``anchor``, so many that this domain's expected total stays as it is. With ``keep_anchor`` documents whose most
    probable domain is the anchor have a rate of 1 or more, and the fit is made within these bounds. Without labels of the domains every rate is 1.
    A null or empty text has no tokens, so no bearing on totals, and gets its probabilities' rate like any other. Rows
    that repeat an id are judged each by its own text; of an id's labels the domain first by name counts. A null id has
    copies by the same rule.
    """
    domains = list(weights)
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    marks = labels.filter(F.col(domain_col).isin(domains)).select(F.col(id_col).alias("_id"), F.col(domain_col).alias("domain"))
    marks = marks.filter(F.col("_id").isNotNull()).groupBy("_id").agg(F.min("domain").alias("domain"))
    marks = first_by_hash(marks, F.xxhash64(F.lit(seed), "_id"), most_labelled, "_id")
    marks = stored(marks, "labelled")
    rows = cut(features(docs, lexicon(docs, marks, words, least)))
    placed = cut(posteriors(rows, marks, domains))
    p = [F.get("p", F.lit(d)) for d in range(len(domains))]
    now = placed.agg(*[F.coalesce(F.sum(p[d] * F.col("n_tokens")), F.lit(0.0)).alias(f"t{d}") for d in range(len(domains))]).first()
    totals = np.array([now[f"t{d}"] for d in range(len(domains))])
    share = np.array([weights[d] for d in domains], dtype=float) / sum(weights.values())
    budget = totals.sum() if anchor is None else totals[domains.index(anchor)] / share[domains.index(anchor)]
    keeps = F.lit(keep_anchor) & (p[domains.index(anchor or domains[0])] >= F.array_max("p"))
    lowest = F.when(keeps, 1.0).otherwise(0.0)
    targets = share * budget
    rated, reached = (placed.withColumn("rate", F.lit(1.0)), totals) if marks.isEmpty() else fit_rates(placed, targets, lowest)
    off = float(np.abs(reached - targets).max() / max(targets.sum(), 1.0))
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("_id")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    copies = F.floor(F.col("rate") + chance).cast("long")
    return rated.select(F.col("_id").alias(id_col), "n_tokens", "p", "rate", copies.alias("copies"), F.lit(off).alias("off"))


def label_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``toxic``, ``low`` (quality 0) or ``clean``, from columns ``quality`` and ``toxic``."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select(id_col, domain.alias("domain"))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str = "doc_id", **settings) -> DataFrame:
    """The input's rows and columns, each row as often as its copies say; of rows that repeat an id, as the most of theirs."""
    copies = mix(docs, labels, weights, id_col, **settings).groupBy(F.col(id_col).alias("_copied")).agg(F.max("copies").alias("_copies"))
    rows = docs.select(F.col(id_col).alias("_id"), F.struct("*").alias("_row"))
    joined = rows.join(copies.filter("_copies > 0"), F.col("_id").eqNullSafe(F.col("_copied")))
    return joined.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select("_row.*")
