"""Near duplicates, label conflicts, label outliers and recurring patterns over 64-bit hashes."""

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaya.functions.hashes import bits, hamming
from assaya.operators.graph import components
from assaya.shared import cut

#: Hashes are compared in blocks: of ``PACK`` at least where there are that many, and not more than ``BLOCKS`` of them until a
#: task would hold more than ``HELD`` hashes against one.
PACK, BLOCKS, HELD = 1 << 14, 33, 1 << 22
#: Candidates of a task at a time, and rows that it gives at a time.
CANDIDATES, ROWS = 1 << 20, 1 << 16
#: Centroids in one row that each doubtful sample is held against.
CENTROIDS = 256


def _bands(threshold: int, n: int) -> tuple[list[tuple[int, int]], int]:
    """(offset, width) of the bands, and the radius to probe in one: two hashes within ``threshold`` bits have a band
    within it. Of all numbers of bands that one is taken with which ``n`` hashes spread evenly make the fewest probes and
    candidates together: more hashes, wider bands."""
    if not 0 <= threshold <= 63:
        raise ValueError(f"a threshold is 0 to 63 bits, not {threshold}")

    def plan(bands: int):
        edges = [round(64 * i / bands) for i in range(bands + 1)]
        return [(a, b - a) for a, b in zip(edges, edges[1:])], threshold // bands

    def cost(bands: int) -> float:
        widths, radius = plan(bands)
        probes = [sum(comb(w, r) for r in range(radius + 1)) for _, w in widths]
        return sum(p + n * p / 2**w for p, (_, w) in zip(probes, widths)) if max(probes) <= 5000 else float("inf")

    return plan(min(range(1, threshold + 2), key=cost))


def near_hashes(hashes: DataFrame, threshold: int) -> DataFrame:
    """(a, b, distance) for all pairs a < b of distinct non-null hashes within ``threshold`` bits; input: column ``h``. A pair
    is taken in its first band that is near, so it comes once. See ``_compared``."""
    return _compared(hashes, threshold, pairs=True)


def near_forest(hashes: DataFrame, threshold: int) -> DataFrame:
    """(a, b, distance): links that join what pairs within ``threshold`` bits join, without the pairs; ``distance`` is the
    largest of a pair among the hashes that a task linked with them. Input: column ``h``. A task gives a spanning star of
    each component it sees, so a family of n near hashes has some links for each hash. See ``_compared``."""
    return _compared(hashes, threshold, pairs=False)


def _deal(n: int) -> tuple[int, list[tuple[int, int]]]:
    """The number of blocks for ``n`` hashes (odd), and the ranges of offsets: a task holds a block against those that lie at
    a range of offsets after it, round the ring, so that each two blocks meet once. More hashes make larger blocks, until
    one is as large as a task may hold."""
    blocks = 1 if n <= PACK else max(min(-(-n // PACK), BLOCKS), -(-n // HELD))
    blocks += 1 - blocks % 2
    offsets = blocks // 2 + 1
    step = max(1, min(offsets, HELD * blocks // max(n, 1)))
    return blocks, [(lo, min(lo + step, offsets)) for lo in range(0, offsets, step)]


def _compared(hashes: DataFrame, threshold: int, pairs: bool) -> DataFrame:
    """Near pairs of distinct hashes, or the stars that they make.

    Only the hashes go through the shuffle, dealt in blocks: some ``BLOCKS`` copies of each, not one for each key near its
    own. A task holds a block against others, and probes the keys within the radius of each band in memory."""
    distinct = cut(hashes.select("h").filter("h is not null").distinct())
    n = distinct.count()
    blocks, ranges = _deal(n)
    bands, radius = _bands(threshold, min(n, HELD))

    def packs(batches):
        for batch in batches:
            h = np.asarray(batch.column(0)).astype(np.int64)
            mixed = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # families are spread over the blocks
            block = ((mixed >> np.uint64(32)) % np.uint64(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            own, firsts = np.unique(block[order], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(h)).astype(np.int32)), pa.array(h[order]))
            yield pa.RecordBatch.from_arrays([pa.array(own), lists], names=["block", "hs"])

    roles = []
    for g, (lo, hi) in enumerate(ranges):
        task = lambda offset, g=g: F.pmod(F.col("block") - F.lit(offset), F.lit(blocks)) * F.lit(len(ranges)) + F.lit(g)
        roles.append(F.struct(task(0).alias("task"), F.lit(True).alias("probes")))
        roles += [F.struct(task(o).alias("task"), F.lit(False).alias("probes")) for o in range(lo, hi)]
    dealt = distinct.mapInArrow(packs, "block int, hs array<long>").select(F.explode(F.array(*roles)).alias("r"), "hs").select("r.*", "hs")

    def work(batches):
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            probes = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            for side, rows in ((left, batch.filter(pa.array(probes))), (right, batch.filter(pa.array(~probes)))):
                side.append(rows.column(2).flatten().to_numpy())
        left, right = np.sort(np.concatenate(left)), np.concatenate(right)
        for a, b, d in near_pairs(left, right, threshold, bands, radius) if pairs else [near_stars(left, right, threshold, bands, radius)]:
            for lo in range(0, len(a), ROWS):
                part = slice(lo, lo + ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(a[part]), pa.array(b[part]), pa.array(d[part])], names=["a", "b", "distance"])

    return dealt.repartitionById(blocks * len(ranges), "task").mapInArrow(work, "a long, b long, distance int")


def near_pairs(left: np.ndarray, right: np.ndarray, threshold: int, bands: list[tuple[int, int]], radius: int, once: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches (a, b, distance) of the pairs within ``threshold`` bits of the hashes ``left`` (sorted, each once) and those of
    ``right``; a pair of two of the left comes once. ``once``: a < b, and a pair in its first near band alone."""
    limit = np.uint64(2**64 - 1)
    for i, (at, width) in enumerate(bands):
        whole = limit if width == 64 else np.uint64((1 << width) - 1)
        key = lambda x: (x.view(np.uint64) >> np.uint64(at)) & whole  # noqa: B023,E731
        mine = left[np.argsort(key(left), kind="stable")]  # neighbours look up neighbouring keys
        probe = key(mine)
        keys = key(right)
        order = np.argsort(keys, kind="stable")
        theirs, keys = right[order], keys[order]
        tabled = width <= 22 and (1 << width) <= 64 * max(len(right), 1024)
        starts = np.append(0, np.cumsum(np.bincount(keys.astype(np.int64), minlength=1 << width))).astype(np.int32) if tabled else None
        for flips in (c for r in range(radius + 1) for c in combinations(range(width), r)):
            at_key = probe ^ np.uint64(sum(1 << x for x in flips))
            if tabled:
                lo = starts[at_key]
                count = starts[at_key + np.uint64(1)] - lo
            else:
                lo = np.searchsorted(keys, at_key)
                count = np.searchsorted(keys, at_key, "right") - lo
            some = np.flatnonzero(count)
            if not len(some):
                continue
            lo, count = lo[some], count[some]
            ends = np.cumsum(count, dtype=np.int64)
            at_part = 0
            while at_part < len(some):  # candidates in parts of bounded size, of a hash at least
                done = int(ends[at_part - 1]) if at_part else 0
                until = max(at_part + 1, int(np.searchsorted(ends, done + CANDIDATES, "right")))
                c = count[at_part:until]
                place = np.arange(int(ends[until - 1]) - done) + np.repeat(lo[at_part:until] - (ends[at_part:until] - c - done), c)
                a, b = np.repeat(mine[some[at_part:until]], c), theirs[place]
                at_part = until
                distance = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))
                near = np.flatnonzero((distance <= threshold) & (a != b))
                if not len(near):
                    continue
                a, b, distance = a[near], b[near], distance[near]
                both = left[np.minimum(np.searchsorted(left, b), len(left) - 1)] == b
                keep = ~both | (a < b)
                if once:
                    differs = a.view(np.uint64) ^ b.view(np.uint64)
                    for was, w in bands[:i]:
                        keep &= np.bitwise_count((differs >> np.uint64(was)) & np.uint64((1 << w) - 1)) > radius
                if keep.any():
                    a, b, distance = a[keep], b[keep], distance[keep].astype(np.int32)
                    yield np.minimum(a, b), np.maximum(a, b), distance


def near_stars(left: np.ndarray, right: np.ndarray, threshold: int, bands: list[tuple[int, int]], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, distance) of stars that join what near pairs of ``left`` and ``right`` join, and the largest distance of a pair
    in each. Pairs are joined as they come, some of them at a time."""
    nodes = np.unique(np.append(left, right))
    label, most = np.arange(len(nodes)), np.full(len(nodes), -1, np.int32)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def join():
        if not waiting:
            return
        ends = np.concatenate([u for u, _ in waiting]), np.concatenate([v for _, v in waiting])
        waiting.clear()
        roots, places = np.unique(np.concatenate([label[x] for x in ends]), return_inverse=True)
        joined = _labels(len(roots), *np.split(places, 2))
        into = np.arange(len(nodes))
        into[roots] = roots[joined]
        label[:] = into[label]

    held = 0
    for a, b, d in near_pairs(left, right, threshold, bands, radius, once=False):
        u, v = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
        np.maximum.at(most, u, d)
        apart = label[u] != label[v]
        waiting.append((u[apart], v[apart]))
        held += int(apart.sum())
        if held > CANDIDATES:
            join()
            held = 0
    join()
    far = np.full(len(nodes), -1, np.int32)
    np.maximum.at(far, label, most)
    inner = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[inner]], nodes[inner], far[label[inner]]


def _labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches by the edges (u, v)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_clusters(samples: DataFrame, threshold: int = 10) -> DataFrame:
    """(cluster, size, max_distance, representative) over ``samples`` (seq, sha256, h): single-link clusters of samples
    whose hashes are within ``threshold`` bits and whose content differs. ``cluster`` is the least seq, whose hash is the
    representative. Samples with one hash are linked to its first one, not to each other, so edges grow in proportion; a
    hash whose samples are all one content and which has no near hash is no cluster.
    """
    return near_groups(samples, threshold)[0]


def near_groups(samples: DataFrame, threshold: int = 10) -> tuple[DataFrame, DataFrame]:
    """The rows of ``near_clusters``, and (cluster, sample_id) for every sample in one."""
    rows = samples.filter("h is not null").select("seq", "sha256", "h")
    groups = cut(rows.groupBy("h").agg(F.min("seq").alias("first"), F.min("sha256").alias("s0"), F.max("sha256").alias("s1")))
    links = cut(near_forest(groups.select("h"), threshold))
    firsts = groups.select("h", "first")
    across = links.join(firsts.withColumnsRenamed({"h": "a", "first": "fa"}), "a").join(firsts.withColumnsRenamed({"h": "b", "first": "fb"}), "b")
    within = groups.filter("s0 <> s1").select(F.col("first").alias("a"), F.col("first").alias("b"))
    roots = components(across.select(F.col("fa").alias("a"), F.col("fb").alias("b")).union(within))
    of_hash = firsts.join(roots, F.col("first") == F.col("node")).select("h", "root")
    placed = rows.join(of_hash, "h")
    sizes = placed.groupBy("root").agg(F.count("*").alias("size"), F.min_by("h", "seq").alias("representative"))
    reach = links.join(of_hash, F.col("a") == F.col("h")).groupBy("root").agg(F.max("distance").alias("d"))
    clusters = sizes.join(reach, "root", "left").select(F.col("root").alias("cluster"), "size", F.coalesce("d", F.lit(0)).alias("max_distance"), "representative")
    return clusters, placed.select(F.col("root").alias("cluster"), F.col("seq").alias("sample_id"))


def _first_by_sets(classes: DataFrame, key: str, most: int) -> DataFrame:
    """Of each key's classes, the first ``most`` of each of its first ``most`` label sets, in order of seq. Pairs of others
    of one key come after ``most`` pairs of these."""
    sets = first_per_key(classes.groupBy(key, "set").agg(F.min("seq").alias("_first")), [key], ["_first"], most)
    return first_per_key(classes.join(sets.select(key, "set"), [key, "set"], "left_semi"), [key, "set"], ["seq"], most)


def label_conflicts(samples: DataFrame, threshold: int = 4, cap: int | None = 20) -> DataFrame:
    """(seq_a, seq_b, distance) of samples (seq, sha256, h, labels) with different label sets and one content (distance
    0) or hashes within min(threshold, 4) bits; the first ``cap`` by (seq_a, seq_b), all for None. Unlabelled samples and
    those without a hash take no part.

    Samples are first collected to one row for each (content, hash, label set), whose first seq stands for them. With a
    cap, of a content or hash with very many of these rows only those go on that can be among the first pairs.
    """
    labelled = samples.filter("h is not null and size(labels) > 0")
    labelled = labelled.select("seq", "sha256", "h", F.array_join(F.array_sort(F.array_distinct("labels")), "\u0001").alias("set"))
    classes = cut(labelled.groupBy("sha256", "h", "set").agg(F.min("seq").alias("seq")))
    by_content, by_hash = (classes if cap is None else cut(_first_by_sets(classes, key, cap + 2)) for key in ("sha256", "h"))
    side = lambda rows, x: rows.select(*[F.col(c).alias(f"{c}_{x}") for c in ("seq", "sha256", "h", "set")])
    same = side(by_content, "a").join(side(by_content, "b"), F.col("sha256_a") == F.col("sha256_b")).withColumn("distance", F.lit(0))
    a, b = side(by_hash, "a"), side(by_hash, "b")
    near = near_hashes(classes, min(threshold, 4))
    near = near.union(classes.select("h", "h", F.lit(0)).distinct())
    near = near.union(near.filter("a <> b").select("b", "a", "distance"))
    near = near.join(a, F.col("a") == F.col("h_a")).join(b, F.col("b") == F.col("h_b")).drop("a", "b").filter("sha256_a <> sha256_b")
    found = same.unionByName(near.select(*same.columns)).filter("set_a <> set_b and seq_a < seq_b").select("seq_a", "seq_b", "distance")
    return found if cap is None else found.orderBy("seq_a", "seq_b").limit(cap)


def per_label(samples: DataFrame) -> DataFrame:
    """(seq, h, class): a row for each distinct label of a sample (seq, h, labels), as outliers are looked for in each of its
    classes."""
    return samples.select("seq", "h", F.explode(F.array_distinct("labels")).alias("class"))


def label_outliers(samples: DataFrame, least: int = 3) -> DataFrame:
    """(seq, class, distance, other_distance) of label outliers. ``samples``: seq, h, class.

    A class with ``least`` samples has a centroid, the mean of its bit vectors; with fewer than two such classes there are
    no outliers. d is the L1 distance to the own centroid; the sample is an outlier if the class's population deviation
    of d is above 0.5, d > mean + 2.2 deviations, d >= 12, and the nearest other centroid is nearer than d - 1.2
    deviations. Only samples that are far from their own are held against the others, ``CENTROIDS`` at a time.
    """
    rows = samples.filter("class is not null").select("seq", "class", bits(F.col("h")).alias("v"))
    means = [F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(64)]
    centroids = rows.groupBy("class").agg(F.count("*").alias("n"), *means).filter(F.col("n") >= least)
    centroids = cut(centroids.select("class", F.array(*[f"m{i}" for i in range(64)]).alias("c")))
    blocks = -(-centroids.count() // CENTROIDS)
    away = lambda v, c: F.aggregate(F.zip_with(v, c, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    own = cut(rows.join(centroids, "class").select("seq", "class", "v", away(F.col("v"), F.col("c")).alias("distance")))
    stats = own.groupBy("class").agg(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("std"))
    far = own.join(stats, "class").filter("std > 0.5 and distance > mean + 2.2 * std and distance >= 12")
    far = far.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1))).alias("block"))
    held = centroids.groupBy(F.pmod(F.xxhash64("class"), F.lit(max(1, blocks))).cast("int").alias("block")).agg(F.collect_list(F.struct("class", "c")).alias("some"))
    others = F.transform(F.filter("some", lambda x: x["class"] != F.col("class")), lambda x: away(F.col("v"), x["c"]))
    nearest = far.join(held, "block").select("seq", "class", "distance", "std", F.array_min(others).alias("other"))
    nearest = nearest.groupBy("seq", "class").agg(F.first("distance").alias("distance"), F.first("std").alias("std"), F.min("other").alias("other_distance"))
    return nearest.filter("other_distance < distance - 1.2 * std").select("seq", "class", "distance", "other_distance")


def recurring_patterns(patches: DataFrame, threshold: int = 2, least_variance: float = 5.0, share: float = 0.15) -> DataFrame:
    """(location, leader, n_members, n_contents, n_classes, mean_variance, severity) of recurring patches: see
    ``pattern_groups``."""
    return pattern_groups(patches, threshold, least_variance, share)[0]


def pattern_groups(patches: DataFrame, threshold: int = 2, least_variance: float = 5.0, share: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Recurring patterns, and their members (location, leader, seq).

    ``patches``: location, seq, sha256, class, h, variance. Patches under ``least_variance`` are dropped. In order of seq a
    patch joins the earliest leader within ``threshold`` bits at its location, else it leads; a pattern counts with
    max(3, floor(share * samples)) distinct contents, and is HIGH with two classes or five members.

    Leaders are found among distinct hashes: one is a leader if no earlier leader is near. Each round settles all
    hashes whose earlier neighbours are settled, so rounds are as many as the longest chain of such doubts.
    """
    total = patches.select("seq").distinct().count()
    rows = patches.filter(F.col("variance") >= least_variance)
    nodes = cut(rows.groupBy("location", "h").agg(F.min("seq").alias("first")))
    pairs = near_hashes(nodes, threshold)
    pairs = pairs.union(pairs.select("b", "a", "distance"))
    left, right = nodes.withColumnsRenamed({"h": "a", "first": "fa"}), nodes.withColumnsRenamed({"h": "b", "first": "fb"})
    earlier = cut(pairs.join(left, "a").join(right, ["location", "b"]).filter("fb < fa or (fb = fa and b < a)").select("location", "a", "b", "fb"))
    # a hash without earlier neighbours leads
    state = nodes.join(earlier.select("location", F.col("a").alias("h")).distinct().withColumn("_e", F.lit(True)), ["location", "h"], "left")
    state = cut(state.select("location", "h", "first", F.when(F.col("_e").isNull(), "leader").alias("state")))
    while state.filter("state is null").limit(1).count():
        known = earlier.join(state.select("location", F.col("h").alias("b"), F.col("state").alias("bs")), ["location", "b"])
        seen = known.groupBy("location", F.col("a").alias("h")).agg(F.max(F.col("bs") == "leader").alias("near"), F.count_if(F.col("bs").isNull()).alias("open"))
        decided = F.when(F.col("near"), "member").when(F.col("open") == 0, "leader")
        state = cut(state.join(seen, ["location", "h"], "left").select("location", "h", "first", F.coalesce("state", decided).alias("state")))
    leads = state.filter("state = 'leader'")
    joined = earlier.join(leads.select("location", F.col("h").alias("b")), ["location", "b"]).groupBy("location", F.col("a").alias("h")).agg(F.min(F.struct("fb", "b")).alias("l"))
    assigned = state.join(joined, ["location", "h"], "left").select("location", "h", F.when(F.col("state") == "leader", F.col("h")).otherwise(F.col("l.b")).alias("leader"))
    members = cut(rows.join(assigned, ["location", "h"]).select("location", "leader", "seq", "sha256", "class", "variance"))
    grouped = members.groupBy("location", "leader").agg(
        F.count("*").alias("n_members"), F.countDistinct("sha256").alias("n_contents"), F.countDistinct("class").alias("n_classes"), F.avg("variance").alias("mean_variance")
    )
    severity = F.when((F.col("n_classes") >= 2) | (F.col("n_members") >= 5), "HIGH").otherwise("MEDIUM")
    found = cut(grouped.filter(F.col("n_contents") >= max(3, int(share * total))).withColumn("severity", severity))
    return found, members.join(found, ["location", "leader"], "left_semi").select("location", "leader", "seq")


def hamming_of_hex(a: Column, b: Column, invalid: int = -1) -> Column:
    from assaya.functions.hashes import from_hex

    return hamming(from_hex(a), from_hex(b), invalid)


def first_per_key(rows: DataFrame, keys: list[str], order: list, cap: int | None) -> DataFrame:
    """The first ``cap`` rows of each key; all for None."""
    if cap is None:
        return rows
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= cap).drop("_rank")
