"""Quality rules whose cutoffs hold their rate of false rejections with a stated confidence.

Signals are measured on whole texts. The labelled rows are halved by a hash of their id: one half proposes cutoffs, the
other certifies them. A cutoff counts as certified in its stratum if, were its true rate of rejecting good rows above
the allowed one, seeing so few rejections would have a probability (an exact binomial tail) under the error level
divided by the number of tests made (Bonferroni). Each signal gets an equal part of the allowed rate, so the rules
together hold it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaya.operators.statistics import quantiles
from assaya.shared import cut, stored

#: Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
SPACE = r"[ \t-\r]+"
WINDOW = 8
#: Signals with cutoffs: a row is rejected if its value is above.
SIGNALS = ("symbol_share", "dup_line_share", "repeat_word_share", "upper_share", "mark_share", "word_length")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the hash of the window at each position."""
    paired = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def positions(s: Column) -> Column:
        same = lambda x, j: x["h"] == F.get(s, j)["h"]
        marked = F.transform(
            s,
            lambda x, i: F.when(
                F.coalesce(same(x, i + 1), F.lit(False)) | F.coalesce(same(x, i - 1), F.lit(False)), x["i"]
            ),
        )
        return F.sort_array(F.array_compact(marked))

    def covered(at: Column) -> Column:
        ends = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(ends, F.lit(0).cast("long"), lambda a, b: a + b)

    return _let(F.array_sort(paired), lambda s: _let(positions(s), covered))


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, ``keep``, the counts of the base rule and the signals, from whole texts. A null text counts as empty.

    Windows are compared by 64-bit hashes of the hashes of their words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("_id"), *keep, text.alias("_text"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    word_hashes = F.transform(F.array_remove(F.split("_text", SPACE), ""), lambda w: F.xxhash64(w))
    docs = docs.select(
        "_id",
        *keep,
        word_hashes.alias("_words"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("_lines"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}+", ""))).alias("_upper"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[!?]+", ""))).alias("_marks"),
    )
    hashes = _let(
        F.col("_words"),
        lambda w: F.when(
            F.size(w) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(w) - WINDOW, F.lit(0))),
                lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    repeated = _let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _repeated(h)).otherwise(F.lit(0).cast("long")),
    )
    docs = docs.select(
        "*", F.size("_words").cast("long").alias("n_words"), F.col("_lines.dup").cast("long").alias("n_dup_lines"), repeated.alias("n_repeat_words")
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return docs.select(
        "_id",
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "_lines.n").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_word_share"),
        share("_upper", "word_chars").alias("upper_share"),
        share("_marks", "word_chars").alias("mark_share"),
        share("word_chars", "n_words").alias("word_length"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X binomial with n trials of rate p: the exact sum, each term from the one before in logarithms."""
    first = F.struct((n * F.log1p(-p)).alias("log"), F.exp(n * F.log1p(-p)).alias("sum"))
    odds = F.log(p) - F.log1p(-p)

    def add(acc: Column, i: Column) -> Column:
        term = acc["log"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("log"), (acc["sum"] + F.exp(term)).alias("sum"))

    # A null needs no test of its own: k is a count.
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, first, add, lambda acc: F.least(acc["sum"], F.lit(1.0)))


def thresholds(labelled: DataFrame, allowed: float, error: float, grid: int) -> DataFrame:
    """One row per stratum and signal with a certified cutoff: (stratum, signal, cutoff, n_good, n_rejected, tail).

    ``labelled``: ``_id``, ``_stratum``, ``_good`` (1 or 0) and the signals. Proposals are the values of the first half
    at ``grid`` evenly spaced ranks above its middle. Of the certified ones that with the largest share of bad rows of
    the first half above it, less the share of good ones, is taken (ties: the largest), if that is above 0.
    """
    part = F.pmod(F.crc32(F.concat(F.lit("half:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))), F.lit(2))
    long = labelled.select(
        "_stratum",
        "_good",
        part.alias("_half"),
        F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("value")) for s in SIGNALS])).alias("_s"),
    ).select("_stratum", "_good", "_half", "_s.*")
    first_half = long.filter("_half = 0").select(F.struct("_stratum", "signal").alias("_of"), "value")
    cuts = quantiles(first_half, "_of", "value", tuple(0.5 + 0.5 * i / grid for i in range(grid)), between=False)
    proposed = cuts.select("_of.*", F.array_distinct(F.array(*[f"q{i}" for i in range(grid)])).alias("_cuts"))
    proposed = stored(proposed, "cutoffs")
    tests = proposed.agg(F.coalesce(F.sum(F.size("_cuts")), F.lit(1))).first()[0]
    over = long.withColumnRenamed("_stratum", "_s2").withColumnRenamed("signal", "_g2")
    over = over.join(proposed, F.col("_stratum").eqNullSafe(F.col("_s2")) & (F.col("signal") == F.col("_g2")))
    passed = F.size(F.filter("_cuts", lambda c: F.col("value") > c)).alias("_passed")
    tallies = over.groupBy("_stratum", "signal", "_cuts", "_half", "_good", passed).agg(F.count("*").alias("_n"))

    def count(half: int, good: int, above: bool) -> Column:
        wanted = (F.col("_half") == half) & (F.col("_good") == good)
        return F.sum(F.when(wanted & (F.col("_passed") > F.col("_at")) if above else wanted, F.col("_n")).otherwise(0))

    counts = (
        tallies.select("*", F.posexplode("_cuts").alias("_at", "cutoff"))
        .groupBy("_stratum", "signal", "cutoff")
        .agg(
            count(1, 1, False).alias("n_good"),
            count(1, 1, True).alias("n_rejected"),
            count(0, 1, False).alias("_good_a"),
            count(0, 1, True).alias("_good_over"),
            count(0, 0, False).alias("_bad_a"),
            count(0, 0, True).alias("_bad_over"),
        )
    )
    rate = F.lit(allowed / len(SIGNALS))
    gain = F.try_divide("_bad_over", "_bad_a") - F.coalesce(F.try_divide("_good_over", "_good_a"), F.lit(0.0))
    counts = counts.filter(F.col("n_rejected") < F.col("n_good") * rate)
    counts = counts.withColumn("tail", binomial_tail(F.col("n_rejected"), F.col("n_good"), rate)).withColumn("_gain", gain)
    best = counts.filter((F.col("tail") <= F.lit(error / tests)) & (F.col("_gain") > 0))
    return (
        best.groupBy("_stratum", "signal")
        .agg(F.max(F.struct("_gain", "cutoff", "n_good", "n_rejected", "tail")).alias("_b"))
        .select("_stratum", "signal", "_b.cutoff", "_b.n_good", "_b.n_rejected", "_b.tail")
    )


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_col: str = "quality",
    allowed: float = 0.06,
    error: float = 0.05,
    grid: int = 24,
) -> DataFrame:
    """One row per input row: id, the counts, the signals, ``base_failed`` and ``kept``.

    ``labels``: id and ``label_col`` (1 good, 0 bad; others are left out; an id with both counts as bad). At most
    ``allowed`` of the good rows of a stratum that pass the base rule are rejected by the cutoffs, with confidence
    1 - ``error`` over all strata. A stratum without a certified cutoff (too few labels, a null stratum without any)
    rejects nothing beyond the base rule. Texts are read once; what follows works on the counts.
    """
    rows = cut(signals(docs.withColumn("_stratum", F.col(stratum_col)), id_col, text_col, ("_stratum",)))
    marks = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_lid")).agg(F.min(label_col).alias("_good"))
    labelled = rows.filter(~base_failed()).join(marks, F.col("_id") == F.col("_lid")).select("_id", "_stratum", "_good", *SIGNALS)
    cutoff = lambda signal: F.max(F.when(F.col("signal") == signal, F.col("cutoff"))).alias(f"_over_{signal}")
    found = thresholds(labelled, allowed, error, grid).withColumnRenamed("_stratum", "_of")
    found = stored(found.groupBy("_of").agg(*[cutoff(signal) for signal in SIGNALS]), "certified")
    rows = rows.join(found, F.col("_stratum").eqNullSafe(F.col("_of")), "left")
    rejected = F.lit(False)
    for signal in SIGNALS:
        rejected = rejected | F.coalesce(F.col(signal) > F.col(f"_over_{signal}"), F.lit(False))
    return rows.select(
        F.col("_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        *SIGNALS,
        base_failed().alias("base_failed"),
        (~base_failed() & ~rejected).alias("kept"),
    )
