"""URL filters from a tree of path templates.

Per host the paths form a tree of segments. Level by level a node's children are generalised to the wildcard of their
shape where they are variable (many, each with few urls), and further branches of one shape are merged where their
labelled shares don't differ more than chance explains. Each url so gets a template; a template is rejected if its
labelled purity, smoothed towards that of all labels, is too low.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaya.shared import cut

#: Fixed values of the contract: (host, path prefix, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://`` or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _longest_first(rules):
    return sorted(rules, key=lambda r: -len(r[0] + r[1]))


def _fits(rule, host: Column, path: Column) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def rule_of(rules, host: Column, path: Column, field: str) -> Column:
    """The longest fitting rule, as text or as its verdict; null if none fits."""
    out = F.lit(None).cast("string")
    for rule in reversed(_longest_first(rules)):
        out = F.when(_fits(rule, host, path), F.lit(rule[0] + rule[1] if field == "rule" else rule[2])).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    """The wildcard that a segment would become; its extension stays."""
    extension = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    kind = (
        F.when(stem.rlike(r"^\d+$"), "<num>")
        .when(stem.rlike(r"^[0-9a-fA-F-]{8,}$"), "<hex>")
        .when(stem.rlike(r"^\d{4}-\d\d(-\d\d)?$"), "<date>")
        .when(stem.rlike(r"\d"), "<mixed>")
        .when(stem.rlike(r"[-_]"), "<slug>")
        .otherwise("<word>")
    )
    return F.concat(kind, extension)


def _common(rows: DataFrame) -> DataFrame:
    """Moves the segments that all rows of a node share from the rest to the template, as no choice is made there. What is
    least and largest in a node share what all of it does."""
    ends = cut(rows.groupBy("host", "template").agg(F.min("_rest").alias("_lo"), F.max("_rest").alias("_hi")))
    differs = F.transform(F.arrays_zip("_lo", "_hi"), lambda x: ~x["_lo"].eqNullSafe(x["_hi"]))
    first = F.array_position(differs, True).cast("int")
    shared = F.when(first > 0, first - 1).otherwise(F.size("_lo"))
    ends = ends.select(F.col("host").alias("_h"), F.col("template").alias("_t"), shared.alias("_shared"))
    joined = rows.join(ends, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")))
    template = F.concat_ws("/", "template", F.slice("_rest", F.lit(1), F.col("_shared")))
    rest = F.slice("_rest", F.col("_shared") + 1, F.size("_rest"))
    return joined.select(*[c for c in rows.columns if c not in ("template", "_rest")], template.alias("template"), rest.alias("_rest"))


def templates(urls: DataFrame, many: int = 16, few: float = 0.05, z_limit: float = 1.96) -> DataFrame:
    """``urls``: ``host``, ``path``, ``n`` urls, ``labelled`` and ``good`` counts, one row per host and path.

    Adds ``template``. At each level a child is variable if its parent has over ``many`` children and it has less than
    ``few`` of the parent's urls, or if it is a number or hexadecimal and has a sibling of its shape. Variable children
    become their shape. Of the rest, children of one shape that are not the only one are merged into their shape if
    their good share is within ``z_limit`` standard errors of the shape's other children and both sides have labels;
    unlabelled ones stay apart. Levels at which a node has one child are passed in one go; each round works on the paths
    that aren't at their end, down to the deepest branch.
    """
    trimmed = F.filter(F.split("path", "/", -1), lambda s: s != "")
    columns = [*urls.columns, "template"]
    rows = cut(urls.select("*", F.lit("").alias("template"), trimmed.alias("_rest")))
    done = []
    while True:
        rows = cut(_common(rows))
        done.append(rows.filter(F.size("_rest") == 0).select(columns))
        rows = rows.filter(F.size("_rest") > 0)
        if rows.isEmpty():
            return reduce(DataFrame.union, done)
        at = rows.withColumn("_seg", F.get("_rest", F.lit(0)))
        children = cut(
            at.groupBy("host", "template", "_seg")
            .agg(F.sum("n").alias("_n"), F.sum("labelled").alias("_l"), F.sum("good").alias("_g"))
            .withColumn("_shape", shape(F.col("_seg")))
        )
        # a row for each shape of a node, with the node's totals: written down, so that a node with very many children can
        # be dealt anew in the join
        kinds = children.groupBy("host", "template", "_shape").agg(
            F.count("*").alias("_like"), F.sum("_n").alias("_kn"), F.sum("_l").alias("_kl"), F.sum("_g").alias("_kg")
        )
        parents = kinds.groupBy("host", "template").agg(F.sum("_like").alias("_kids"), F.sum("_kn").alias("_pn"))
        kinds = cut(kinds.join(parents, ["host", "template"]))
        judged = children.join(kinds, ["host", "template", "_shape"])
        variable = ((F.col("_kids") > many) & (F.col("_n") < few * F.col("_pn"))) | (
            F.col("_shape").rlike("^<(num|hex|date)>") & (F.col("_like") > 1)
        )
        rest_l, rest_g = F.col("_kl") - F.col("_l"), F.col("_kg") - F.col("_g")
        pooled = F.try_divide(F.col("_kg"), F.col("_kl"))
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("_l")) + F.try_divide(F.lit(1.0), rest_l)))
        apart = F.abs(F.try_divide(F.col("_g"), F.col("_l")) - F.try_divide(rest_g, rest_l))
        similar = F.coalesce(apart <= z_limit * spread, F.lit(False))
        token = F.when(variable | similar, F.col("_shape")).otherwise(F.col("_seg"))
        named = cut(judged.select("host", "template", "_seg", token.alias("_token")))
        deeper = F.concat_ws("/", "template", "_token")
        moved = at.join(named, ["host", "template", "_seg"])
        rows = cut(moved.select(*urls.columns, deeper.alias("template"), F.slice("_rest", F.lit(2), F.size("_rest")).alias("_rest")))


def judge(
    pages: DataFrame,
    labelled: DataFrame,
    rules=RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    least_purity: float = 0.5,
    weight: float = 8.0,
    **tree,
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, and what the method found: template, purity, verdict.

    ``labelled``: (url, good) with good 1 or 0; other values are left out, and repeated urls count each time. A
    template's purity is (good + weight * prior) / (labelled + weight), the prior being the share of good labels (1
    without labels), so a template without labels is allowed. A null or malformed url has an empty host and path, and
    is judged as any other. Work after parsing is on distinct (host, path) pairs.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    marks = labelled.filter(F.col("good").isin(0, 1)).select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "good")
    both = rows.select("host", "path", F.lit(1).alias("_n"), F.lit(None).cast("int").alias("_good")).unionByName(
        marks.select("host", "path", F.lit(0).alias("_n"), F.col("good").cast("int").alias("_good"))
    )
    paths = both.groupBy("host", "path").agg(
        F.sum("_n").alias("n"), F.count("_good").alias("labelled"), F.coalesce(F.sum("_good"), F.lit(0)).alias("good")
    )
    tree_rows = templates(paths, **tree)
    total = tree_rows.agg(F.sum("labelled").alias("l"), F.sum("good").alias("g")).first()
    prior = total["g"] / total["l"] if total["l"] else 1.0
    purity = (F.sum("good") + F.lit(weight * prior)) / (F.sum("labelled") + F.lit(weight))
    pure = cut(tree_rows.groupBy("host", "template").agg(purity.alias("purity")))  # so that the join can deal a hot template anew
    per_path = tree_rows.join(pure, ["host", "template"]).select("host", "path", "template", "purity")
    out = rows.join(per_path, ["host", "path"], "left")
    host, path = F.col("host"), F.col("path")
    method = F.when(F.col("purity") < least_purity, "block").otherwise("allow")
    return out.select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        rule_of(rules, host, path, "rule").alias("rule"),
        F.coalesce(rule_of(rules, host, path, "verdict"), method).alias("verdict"),
        "template",
        "purity",
        method.alias("method_verdict"),
    )
