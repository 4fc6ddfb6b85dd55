"""MinHash near-duplicates with SuperMinHash signatures, banding, exact verification and union-find grouping.

Documents with one shingle set form a class, a node of the graph; one text of it goes on. Classes that share a band of
their signatures meet in a bucket; of buckets with the same members one is kept. First each bucket's members are compared
with its most copied class; after that only buckets whose members still lie in several components are worked on, in
blocks of members against members. Links are confirmed on full shingle sets. A task holds a block at a time and returns
at most as many links as the block has members, so no group's pairs are ever written out.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaya.operators.graph import components
from assaya.shared import cut

#: Values of a signature; a band is 4 of them. A pair of similarity 0.75 shares a band with probability 1 - 5e-6.
SIZE, BANDS = 128, 32
#: Share of equal signature values under which a pair isn't verified: over 5 standard errors below 0.75.
LIKELY = 0.55
#: Members of a bucket in one side of a block; 1000 shingles count as one more member.
CHUNK = 384
_ELEMENTS = 60_000
_PIECE = 1 << 21
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each bit of a 64-bit value over all (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    up = _powers(_BASE, 1 << 12)
    down = _powers(_INVERSE, 1 << 12)

    @classmethod
    def of(cls, n: int):
        if n > len(cls.up):
            cls.up, cls.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        return cls.up, cls.down


def _word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each word of the bytes: its polynomial, from one running sum over all of them."""
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _Powers.of(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _GOLDEN)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of ``width``-word shingles of the whole text, A-Z in lower case; of a shorter
    text one hash of all its words; none without words."""
    data = _FOLD[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    parts, at = [], 0
    while at < len(data):
        stop = min(len(data), at + _PIECE)
        if stop < len(data) and not _SPACE[data[stop]]:  # a piece ends where a word does
            gap = np.flatnonzero(_SPACE[data[stop : stop + _PIECE]])
            while not len(gap) and stop < len(data):
                stop = min(len(data), stop + _PIECE)
                gap = np.flatnonzero(_SPACE[data[stop : stop + _PIECE]])
            stop += int(gap[0]) if len(gap) else 0
        parts.append(_word_hashes(data[at:stop]))
        at = stop
    words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    if not len(words):
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        out = _mix(out * np.uint64(3) + words[k : k + n] + _GOLDEN)
    return np.unique(out)


def signatures(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """SuperMinHash signatures, one row per set, as 16-bit hashes of the least rank at each position.

    Each element walks through a random permutation of the positions, at step j with a rank in [j, j + 1). Steps are made
    for all elements together; a set stops when every position has a rank, as later ones are larger.
    """
    out = np.full((len(sets), size), np.inf)
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    at = 0
    while at < len(sets):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(lengths[at:]), _ELEMENTS)) + at)
        part = sets[at:stop]
        for lo in range(0, max(1, int(lengths[at:stop].max(initial=0))), _ELEMENTS):
            _walk([s[lo : lo + _ELEMENTS] for s in part], out[at:stop], size)
        at = stop
    return (_mix(out.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def _walk(sets: list[np.ndarray], ranks: np.ndarray, size: int) -> None:
    """Lowers ``ranks`` by the elements of ``sets``."""
    seeds = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.tile(np.arange(size, dtype=np.uint8), (len(seeds), 1))
    flat = ranks.reshape(-1)
    for j in range(size):
        if not len(seeds):
            return
        draw = _mix(seeds + np.uint64((j + 1) * int(_GOLDEN) % (1 << 64)))
        pick = j + ((draw >> np.uint64(32)) * np.uint64(size - j) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(seeds))
        place = order[rows, pick].copy()
        order[rows, pick] = order[:, j]
        rank = j + (_mix(draw) >> np.uint64(11)) * (1.0 / (1 << 53))
        np.minimum.at(flat, owner * size + place, rank)
        active = (ranks.max(axis=1) >= j + 1)[owner]
        if not active.all():
            seeds, owner, order = seeds[active], owner[active], order[active]


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _agree(same: np.ndarray) -> np.ndarray:
    """Which rows have enough true values to be verified."""
    return np.count_nonzero(same, axis=1) >= LIKELY * same.shape[1]


def _matrix(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype=np.uint16).reshape(len(sigs), SIZE)


def sketch(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, text_hash, n_shingles, set_a, set_b, sig): the set's size, its 128-bit hash and the signature. Empty sets:
    nulls."""

    def work(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                sets = [shingles(t, width) for t in part["text"]]
                sig = signatures(sets)
                full = np.array([len(s) > 0 for s in sets])
                hashed = lambda salt: pd.array([np.add.reduce(_mix(s ^ np.uint64(salt))).astype(np.int64) if len(s) else None for s in sets], dtype="Int64")
                yield pd.DataFrame(
                    {
                        "id": part["id"].array,
                        "text_hash": part["text_hash"].array,
                        "n_shingles": [len(s) for s in sets],
                        "set_a": hashed(0x5851F42D4C957F2D),
                        "set_b": hashed(0x14057B7EF767814F),
                        "sig": [x.tobytes() if f else None for x, f in zip(sig, full)],
                    }
                )

    # ids as texts on their way: a column of numbers with a null would come as floats
    rows = _texts(docs, id_col, text_col).withColumn("id", F.col("id").cast("string"))
    sketched = rows.mapInPandas(work, "id string, text_hash long, n_shingles long, set_a long, set_b long, sig binary")
    return sketched.withColumn("id", F.col("id").cast("long"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def _by_block(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work(frame, bounds)`` on whole blocks, many at a time: bounds are each block's first row and the row after its last.

    Blocks are dealt over all shuffle partitions, as they are few bytes for much work; rows come sorted by block, and what
    is not over at the end of a batch waits for the next one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if waiting is None else pd.concat([waiting, pdf], ignore_index=True)
            block = pdf["block"].to_numpy()
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist()]
            waiting = pdf.iloc[edges[-1] :]
            if len(edges) > 1:
                yield work(pdf, list(zip(edges, edges[1:])))
        if waiting is not None:
            waiting = waiting.reset_index(drop=True)
            yield work(waiting, [(0, len(waiting))])

    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")
    return dealt.sortWithinPartitions("block").mapInPandas(run, schema)


def _verified(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) found in blocks of (block, node, side, comp, sig). Side 0 is compared with side 1; nodes of side 2 with
    each other. Only nodes of different components are compared, and in a block the links found are a forest."""

    def work(pdf: pd.DataFrame, bounds) -> pd.DataFrame:
        nodes, comps, sides, found = pdf["node"].tolist(), pdf["comp"].tolist(), pdf["side"].to_numpy(), []
        all_texts, all_sigs = pdf["text"].tolist(), _matrix(pdf["sig"])
        for lo, hi in bounds:
            sets: dict[int, np.ndarray] = {}
            above = {c: c for c in comps[lo:hi]}

            def top(c):
                while above[c] != c:
                    above[c] = c = above[above[c]]
                return c

            def set_of(i):
                if i not in sets:
                    sets[i] = shingles(all_texts[i], width)
                return sets[i]

            for i in lo + np.flatnonzero(sides[lo:hi] != 1):
                # a node of side 2 looks at those after it, one of side 0 at side 1
                first = i + 1 if sides[i] == 2 else lo
                fits = _agree(all_sigs[i] == all_sigs[first:hi]) & (sides[first:hi] == (2 if sides[i] == 2 else 1))
                for j in first + np.flatnonzero(fits):
                    p, q = top(comps[i]), top(comps[j])
                    if p != q and _similar(set_of(i), set_of(j), percent):
                        above[max(p, q)] = min(p, q)
                        found.append((nodes[i], nodes[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return _by_block(rows.join(texts, "node").select("block", "node", "side", "comp", "sig", "text"), work, "a long, b long")


def _flagged(rows: DataFrame) -> DataFrame:
    """Of blocks of (block, band, node, comp, sig, side), the members that have a likely partner of another component.
    A pair counts in the first band that it shares."""

    def work(pdf: pd.DataFrame, bounds) -> pd.DataFrame:
        sigs, comps, sides, bands = _matrix(pdf["sig"]), pdf["comp"].to_numpy(), pdf["side"].to_numpy(), pdf["band"].tolist()
        wanted = np.zeros(len(pdf), bool)
        for lo, hi in bounds:
            sig, comp, side, band = sigs[lo:hi], comps[lo:hi], sides[lo:hi], bands[lo]
            for i in np.flatnonzero(side != 1):
                same = sig[i] == sig
                at = np.flatnonzero(_agree(same) & (comp != comp[i]) & (side == (2 if side[i] == 2 else 1)))
                if band and len(at):
                    at = at[~same[at].reshape(len(at), BANDS, -1)[:, :band].all(axis=2).any(axis=1)]
                if len(at):
                    wanted[lo + at] = wanted[lo + i] = True
        return pdf.loc[wanted, ["block", "node", "comp", "side", "sig"]]

    return _by_block(rows, work, "block long, node long, comp long, side int, sig binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, band, node, pivot, weight_of): the members of each bucket, its pivot being the most copied class. A bucket with
    the same members as one of a lower band is left out: all its pairs share that lower band too."""
    bytes_per_band = SIZE // BANDS * 2
    band_keys = [F.xxhash64(F.substring("sig", 1 + i * bytes_per_band, bytes_per_band), F.lit(i)) for i in range(BANDS)]
    banded = classes.select("node", F.posexplode(F.array(*band_keys)).alias("band", "key"))
    # most keys are of one class only: they go no further than a count, and rows of the others are few enough to be told more
    shared = banded.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    met = cut(banded.join(shared, "key", "left_semi").join(classes.select("node", "copies", "weight"), "node"))
    members = [F.bit_xor(F.xxhash64(F.lit(salt), "node")).alias(f"_m{salt}") for salt in (1, 2)]
    same = met.groupBy("key").agg(F.count("*").alias("_n"), F.min("band").alias("_band"), F.max_by("node", "copies").alias("pivot"), *members)
    kept = same.groupBy("_n", "_m1", "_m2").agg(F.min_by(F.struct("key", "pivot"), "_band").alias("_k")).select("_k.key", "_k.pivot")
    return cut(met.join(kept, "key").select("key", "band", "node", "pivot", F.col("weight").alias("weight_of")))


def group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the least id reachable over links) and kept (id is that).

    A null or empty text, or one without words, has no shingles and is linked with nothing. Rows that repeat an id, with
    whatever texts, are linked with each other. A row with a null id isn't linked: its component is null, and it is kept.
    """
    rows = cut(sketch(docs, id_col, text_col, width))
    usable = rows.filter("n_shingles > 0 and id is not null")
    classes = usable.groupBy("set_a", "set_b").agg(
        F.first("sig").alias("sig"), F.min(F.struct("id", "text_hash")).alias("rep"), F.count("*").alias("copies"), (1 + F.first("n_shingles") / 1000).alias("weight")
    )
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    members = _buckets(classes)

    # of classes that meet no other neither text nor signature is needed
    met = cut(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "sig", "rep.*"))
    wanted, sigs = met.select("node", "id", "text_hash"), met.select("node", "sig")
    texts = _texts(docs, id_col, text_col).join(wanted, ["id", "text_hash"])
    texts = cut(texts.groupBy("id", "text_hash").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text"))

    # each member with the most copied class of its buckets
    star = members.filter("node <> pivot").select("node", "pivot").distinct()
    star = star.join(sigs, "node").join(sigs.select(F.col("node").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot")
    star = _likely(star.select("node", "pivot", "sig", "pivot_sig"))
    sizes = star.groupBy("pivot").agg(F.count("*").alias("m"))
    chunk = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("m") / CHUNK)))
    star = cut(star.join(sizes, "pivot").select(F.xxhash64("pivot", chunk).alias("block"), "node", "pivot"))
    side = lambda node, n: F.struct(node.alias("node"), F.lit(n).alias("side"))
    blocks = star.select("block", side(F.col("node"), 1).alias("x")).union(star.select("block", side(F.col("pivot"), 0).alias("x")).distinct())
    blocks = blocks.select("block", "x.*", F.col("x.node").alias("comp")).join(sigs, "node")
    links = cut(_verified(blocks, texts, width, percent))
    roots = components(links)

    # buckets whose members lie in several components yet: those apart from the pivot's are held against all others
    of_pivot = roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root"))
    placed = members.join(roots, "node", "left").join(of_pivot, "pivot", "left")
    apart = F.coalesce("root", "node") != F.coalesce("pivot_root", "pivot")
    placed = cut(placed.select("key", "band", "node", "weight_of", F.coalesce("root", "node").alias("comp"), apart.alias("apart")))
    weigh = lambda c: F.ceil(F.sum(F.when(c, F.col("weight_of")).otherwise(0)) / CHUNK).cast("int")
    # written down, so that a bucket with very many members can be dealt anew in the join
    open_keys = cut(placed.groupBy("key").agg(weigh(F.col("apart")).alias("s"), weigh(~F.col("apart")).alias("m")).filter("s > 0"))
    left = placed.join(open_keys, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("apart"), F.col("s")).otherwise(F.col("m"))).cast("int"))
    block = lambda a, b, side: F.struct(F.xxhash64("key", a, b).alias("block"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own, rest = F.col("part"), lambda j: -1 - j
    with_rest = F.transform(upto("m"), lambda j: block(own, rest(j), 0))
    with_apart = F.transform(upto("s"), lambda i: block(F.least(own, i), F.greatest(own, i), F.when(own == i, 2).when(own < i, 0).otherwise(1)))
    as_rest = F.transform(upto("s"), lambda i: block(i, rest(own), 1))
    blocks = F.when(F.col("apart"), F.concat(with_rest, with_apart)).otherwise(as_rest)
    left = left.select("band", "node", "comp", F.explode(blocks).alias("x")).select("band", "node", "comp", "x.*").join(sigs, "node")
    flagged = cut(_flagged(left))
    more = cut(_verified(flagged, texts, width, percent))

    # the earlier links hold as (node, root); classes that hold one id are linked by it
    of_row = usable.select("id", "set_a", "set_b").join(classes.select("set_a", "set_b", "node"), ["set_a", "set_b"]).select("id", "node")
    several = of_row.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("_last")).filter("a <> _last")
    by_id = of_row.join(several, "id").select("a", F.col("node").alias("b"))
    roots = components(more.union(roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).union(by_id))

    classed = classes.select("set_a", "set_b", "node", F.col("rep.id").alias("least")).join(roots, "node", "left")
    classed = classed.select("set_a", "set_b", "least", F.coalesce("root", "node").alias("root"))
    least = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    classed = classed.join(least, "root").select("set_a", "set_b", "component_id")
    out = rows.join(classed, ["set_a", "set_b"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _likely(pairs: DataFrame) -> DataFrame:
    def work(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.loc[_agree(_matrix(pdf["sig"]) == _matrix(pdf["pivot_sig"])), ["node", "pivot"]]

    return cut(pairs.mapInPandas(work, "node long, pivot long"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The input's rows and columns, one row of each group: that of the least id. Of rows that repeat a kept id that stays
    whose text has the least hash (ties: whose other columns come first as JSON); rows with a null id all stay."""
    kept = group(docs, id_col, text_col, **settings).filter(F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_kept")).distinct()
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]))
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(F.xxhash64(text_col).alias("hash"), others.alias("others")).alias("_order"), F.struct("*").alias("_row"))
    named = rows.filter("_id is not null").join(kept, F.col("_id") == F.col("_kept"), "left_semi").groupBy("_id").agg(F.min_by("_row", "_order").alias("_row"))
    return named.select("_row").unionByName(rows.filter("_id is null").select("_row")).select("_row.*")
