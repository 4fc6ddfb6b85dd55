"""Secret scans by a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams that any match must contain. The postings
(trigram, document) are intersected per document, and only the candidates are verified with the expression. A rule
from which no trigram follows (such as a run of hexadecimal digits) is matched against every text.
"""

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaya.shared import stored


@dataclass(frozen=True)
class Rule:
    """``group``: the capture whose length has to be ``least`` code points or more; else the match is dropped."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: The three base kinds, as their contract states them. A run is taken whole, so that
#: asking for its least length in the expression drops the same matches.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
#: Formats that their issuers publish.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
#: Beyond so many alternatives the literals read so far are turned into a clause.
MOST_STRINGS = 40


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """Clauses that all hold for any text with a match; a clause holds if all trigrams of one of its branches occur.

    Trigrams are in lower case, for texts in lower case. No clause: the pattern needs a full scan.
    """
    clauses: list[list[list[str]]] = []

    def flush(strings: set[str]) -> None:
        branches = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if branches and all(branches):
            clauses.append(sorted(map(sorted, branches)))

    def walk(items, strings: set[str]) -> set[str]:
        for op, arg in items:
            if op is ops.LITERAL:
                more = {chr(arg).lower()}
            elif op is ops.SUBPATTERN:
                strings = walk(arg[3], strings)
                continue
            elif op is ops.BRANCH:
                more = exact_alternatives(arg[1])
            elif op is ops.IN:
                more = {chr(v).lower() for k, v in arg if k is ops.LITERAL}
                more = more if len(more) == len({*arg}) <= 6 else None
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
                low, high, inner = arg
                once = exact_alternatives([inner])
                more = {""} | once if once and (low, high) == (0, 1) else None
                if once and low:  # the first time is certain, what follows isn't
                    strings = grown(strings, once)
            elif op is ops.AT:
                continue
            else:
                more = None
            if more is None:
                flush(strings)
                strings = {""}
            else:
                strings = grown(strings, more)
        return strings

    def grown(strings: set[str], more: set[str]) -> set[str]:
        if len(strings) * len(more) > MOST_STRINGS:
            flush(strings)
            strings = {""}
        return {a + b for a, b in product(strings, more)} if len(more) <= MOST_STRINGS else {""}

    def exact_alternatives(branches) -> set[str] | None:
        """All strings that the branches match, if they are few."""
        found: set[str] = set()
        for items in branches:
            strings = {""}
            for op, arg in items:
                if op is ops.LITERAL:
                    strings = {s + chr(arg).lower() for s in strings}
                elif op is ops.MAX_REPEAT and arg[:2] == (0, 1) and (once := exact_alternatives([arg[2]])):
                    strings = {s + x for s in strings for x in once | {""}}
                elif op is ops.SUBPATTERN and (once := exact_alternatives([arg[3]])):
                    strings = {s + x for s in strings for x in once}
                elif op is ops.BRANCH and (once := exact_alternatives(arg[1])):
                    strings = {s + x for s in strings for x in once}
                else:
                    return None
            found |= strings
        return found

    flush(walk(parser.parse(pattern), {""}))
    return clauses


def postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index over the rules' trigrams: a row (trigram, id) for each trigram that a text contains."""
    lowered = F.lower(text_col)
    found = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("_lower"), t))
    return docs.select(id_col, lowered.alias("_lower")).select(F.explode(found).alias("trigram"), id_col)


def candidates(docs: DataFrame, rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rules): the rules whose trigram query holds. The set gathered for an id is bounded by the rules' trigrams."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for clause in q for branch in clause for t in branch})
    if not trigrams:
        return docs.select(id_col, F.array().cast("array<string>").alias("rules")).limit(0)
    sets = postings(docs, trigrams, id_col, text_col).groupBy(id_col).agg(F.collect_set("trigram").alias("_set"))

    def holds(query) -> Column:
        has = lambda t: F.array_contains("_set", t)
        out = F.lit(True)
        for clause in query:
            any_branch = F.lit(False)
            for branch in clause:
                all_trigrams = F.lit(True)
                for t in branch:
                    all_trigrams = all_trigrams & has(t)
                any_branch = any_branch | all_trigrams
            out = out & any_branch
        return out

    held = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]))
    return sets.select(id_col, held.alias("rules")).filter(F.size("rules") > 0)


def scan(docs: DataFrame, rules=BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``spans``, an array of (start, kind_no, end, kind) in that order; code points, end
    exclusive. Matches of one kind are leftmost and don't overlap.

    A null or empty text has no spans. Rows with one id are judged each by its own text; a null id is an id like any
    other. Columns besides id and text aren't read.
    """
    return _scanned(docs, rules, id_col, text_col).select(F.col("_id").alias(id_col), "spans")


def _scanned(docs: DataFrame, rules, id_col: str, text_col: str) -> DataFrame:
    """(_id, _hash, spans): as ``scan``, with the hash of the text."""
    docs = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = stored(candidates(docs, rules, "_id", "_text"), "secret-candidates")
    docs = docs.join(found.withColumnRenamed("_id", "_cid"), F.col("_id").eqNullSafe(F.col("_cid")), "left")

    def matches(no: int, rule: Rule) -> Column:
        """Every match, kept or not: what lies before it, its length, and if it is long enough."""
        every = lambda g: F.regexp_extract_all("_text", F.lit(rule.pattern), F.lit(g))
        gaps = F.split("_text", rule.pattern, -1)
        zipped = F.arrays_zip(gaps.alias("gap"), every(0).alias("whole"), every(rule.group).alias("part"))
        rows = F.transform(
            zipped,
            lambda x: F.struct(
                F.lit(no).alias("kind_no"),
                F.length(x["gap"]).alias("gap"),
                F.length(x["whole"]).alias("size"),
                (F.length(x["part"]) >= rule.least).alias("kept"),
            ),
        )
        rows = F.filter(rows, lambda x: x["size"].isNotNull())  # the piece after the last match
        asked = F.lit(True) if not trigram_query(rule.pattern) else F.array_contains("rules", rule.kind)
        none = F.array().cast("array<struct<kind_no:int,gap:int,size:int,kept:boolean>>")
        return F.when(asked & F.col("_text").rlike(rule.pattern), rows).otherwise(none)

    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        "_id",
        F.xxhash64("_text").alias("_hash"),
        F.flatten(F.array(*[matches(n, r) for n, r in enumerate(rules)])).alias("_found"),
    )
    rows = stored(rows, "secret-matches")  # the numbers hold from here on, whichever task is run again
    rows = rows.select("_row", "_id", "_hash", F.posexplode_outer("_found").alias("_pos", "_m")).select("_row", "_id", "_hash", "_pos", "_m.*")
    so_far = Window.partitionBy("_row", "kind_no").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
    span = F.struct(
        (F.col("end") - F.col("size")).alias("start"), "kind_no", "end", F.get(kinds, F.col("kind_no")).alias("kind")
    )
    spans = F.array_sort(F.collect_list(F.when(F.col("kept"), span)))
    return rows.groupBy("_row", "_id", "_hash").agg(spans.alias("spans")).select("_id", "_hash", "spans")


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def merged(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parts): spans that overlap are one part, from the first's start to the last end, with the first's kind. Rows
    without spans are left out; equal keys have equal spans and come once."""
    rows = scanned.filter(F.size("spans") > 0).dropDuplicates(keys).select(*keys, F.explode("spans").alias("s")).select(*keys, "s.*")
    in_order = Window.partitionBy(*keys).orderBy("start", "kind_no")
    reached = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_first", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int"))
    rows = rows.withColumn("_part", F.sum("_first").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*keys, "_part").agg(F.min(F.struct("start", "kind_no", "kind")).alias("_s"), F.max("end").alias("end"))
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_s.start", "end", "_s.kind"))).alias("parts"))


def without(text: Column, parts: Column) -> Column:
    """The text with each of the parts, which are in order and apart, replaced by ``[kind]``."""
    before = lambda i: F.coalesce(F.get(parts, i - 1)["end"], F.lit(0))
    kept = F.transform(parts, lambda p, i: F.concat(F.substring(text, before(i) + 1, p["start"] - before(i)), F.lit("["), p["kind"], F.lit("]")))
    end = F.element_at(parts, -1)["end"]
    return F.concat(F.array_join(kept, ""), F.substring(text, end + 1, F.length(text)))


def redact(docs: DataFrame, rules=BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns, with every span that the scan finds in a row's text replaced by its kind in brackets; spans that
    overlap are replaced as one. Other texts, null ones too, stay as they are."""
    found = merged(_scanned(docs, rules, id_col, text_col), ["_id", "_hash"])
    found = stored(found.withColumnsRenamed({"_id": "_found", "_hash": "_found_hash", "parts": "_parts"}), "secret-found")
    same = F.col("_id").eqNullSafe(F.col("_found")) & (F.xxhash64(F.coalesce(F.col("_text"), F.lit(""))) == F.col("_found_hash"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct("*").alias("_row")).join(found, same, "left")
    text = F.when(F.col("_parts").isNotNull(), without(F.col("_text"), F.col("_parts"))).otherwise(F.col("_text"))
    return rows.select(*[(text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def digest(scanned: DataFrame, rules=BASE_RULES + MORE_RULES, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE_RULES]
    return scanned.select(id_col, *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
