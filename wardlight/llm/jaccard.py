"""N-gram Jaccard join by prefix filter and prefix trees, and the components of its links.

Texts become sets of distinct word n-grams (64-bit hashes). Equal sets are one
*node*, so copies are never paired. Every node lists its n-grams in one global
order: those with a small hash come first, the rarer before the more frequent
of them, then the others by hash. Two sets in reach share an n-gram among the
first ``n - ceil(t n) + 1`` of each; n-grams that only one node has can be
skipped, and most nodes end there. What is left are small rows (n-gram, node).

Nodes that share such an n-gram form clusters (connected components, found in
DataFrame rounds). The sets of a cluster's nodes meet in one task, or in blocks
of bounded size where the cluster is large; a block holds sets of one class of
sizes and meets those of its own class and the two beside it, since no other
set can be in reach. There the sets are put in a prefix
tree, most frequent n-gram first; one walk over the tree carries the overlaps
with all probing sets at once, shares them among the sets below a tree node,
and drops a probe once what it has left cannot reach its bound. In a large
cluster all sets are first compared with one centre: linked ones are
connected already, so only the rest is compared with all.

Links within a task come out as a forest, so their number is linear. The
components over all forests are the classes.

Defined results: null and empty texts and texts without words have an empty
set, are linked with nothing and are their own component; a text with fewer
words than ``n`` has one n-gram, the whole sequence; the class id is the
smallest id of the class, nulls aside; equal ids with different texts are
different nodes; repeated rows are rows of their own in one class; extra
columns are ignored; an empty table gives an empty result. No partner is
dropped at any size. Sets are compared by hash: of 64 bits for n-grams and for
whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.llm.textio import Marks, handed_over, lowered, mix64, raw, release, slices, text_of, word_edges, word_hashes
from wardlight.session import broadcast_if_fits

WORDS, PERCENT = 3, 90
#: A block of a cluster holds at most so many sets, and n-grams in all.
BLOCK_SETS, BLOCK_GRAMS = 1_000, 300_000
#: Centres of large clusters, whole sets, that are broadcast.
CENTRES = 500
#: Frequencies are told apart up to here; any function of the n-gram gives a valid order.
FREQUENT = 4096
#: Cells of the running sums that the walk keeps for pruning; without them it only prunes by size.
PRUNE_CELLS = 20_000_000
_FLIP = np.uint64(1 << 63)


def gram_sets(column: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted set of each text, as signed longs whose order is that of the unsigned hashes."""
    data, bounds = raw(column)
    data = lowered(data)
    starts, ends, rows = word_edges(data, bounds)
    words = word_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        gram = words
        for j in range(1, n):
            gram = mix64(gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[j:]) if len(words) > j else gram[:0]
        at = np.searchsorted(rows, np.arange(len(bounds)))
        for i in range(len(bounds) - 1):
            a, b = at[i], at[i + 1]
            if b - a >= n:
                found = np.unique(gram[a:b - n + 1])
            elif b > a:
                whole = words[a:a + 1]
                for j in range(a + 1, b):
                    whole = mix64(whole * np.uint64(0x9E3779B97F4A7C15) + words[j:j + 1])
                found = mix64(whole + np.uint64(b - a))
            else:
                found = words[:0]
            yield np.sort((found ^ _FLIP).view(np.int64))


def set_key(grams: np.ndarray) -> int:
    """64-bit hash of a set."""
    with np.errstate(over="ignore"):
        total = mix64(grams.view(np.uint64)).sum(dtype=np.uint64)
        key = mix64(np.array([total], np.uint64) + np.uint64(len(grams)))
    return int(key.view(np.int64)[0])


def _prefix(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1  # n - ceil(percent n / 100) + 1


def _low_bound(percent: int) -> int:
    """N-grams below it count as small: twice the share that a prefix needs."""
    return min(-(1 << 63) + int(min(1.0, 2 * (100 - percent) / 100) * 2 ** 64), (1 << 63) - 1)


def signatures(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_grams, node, and of each node once a task ``first``: the n-grams that may be in its prefix."""
    bound = _low_bound(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches):
            sizes, nodes, first, low = [], [], [], []
            for grams in gram_sets(part.column("text"), n):
                node = set_key(grams)
                count = int(np.searchsorted(grams, bound, side="left"))
                sizes.append(len(grams))
                nodes.append(node)
                low.append(count)
                first.append(None if node in seen or not len(grams)
                             else grams[:max(count, _prefix(len(grams), percent))])
                seen.add(node)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(low, pa.int64()), pa.array(first, pa.list_(pa.int64()))],
                names=["doc_id", "n_grams", "node", "n_low", "first"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, n_grams long, node long, n_low long, first array<long>")


def _shared(rows: DataFrame) -> DataFrame:
    """(gram, node) -> (gram, node, df) of n-grams that at least two nodes have; equal rows count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_g = held_n = np.zeros(0, np.int64)
        hot: int | None = None  # an n-gram past FREQUENT, whose rows are passed on as they come
        last: tuple[int, int] | None = None

        def out(g: np.ndarray, n: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(n), pa.array(df.astype(np.int64))],
                                              names=["gram", "node", "df"])

        for batch in batches:
            g = batch.column("gram").to_numpy()
            n = batch.column("node").to_numpy()
            if not len(g):
                continue
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (n[1:] != n[:-1])
            new[0] = last != (int(g[0]), int(n[0]))
            last = (int(g[-1]), int(n[-1]))
            g, n = g[new], n[new]
            if hot is not None:
                same = g == hot
                if same.any():
                    yield out(g[same], n[same], np.full(int(same.sum()), FREQUENT))
                    g, n = g[~same], n[~same]
                if len(g):
                    hot = None
            g, n = np.concatenate([held_g, g]), np.concatenate([held_n, n])
            if not len(g):
                continue
            start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            size = np.diff(np.append(start, len(g)))
            done = len(g) - int(size[-1])  # the last run may go on
            df = np.repeat(np.minimum(size, FREQUENT), size)
            many = df[:done] > 1
            if many.any():
                yield out(g[:done][many], n[:done][many], df[:done][many])
            held_g, held_n = g[done:], n[done:]
            if len(held_g) >= FREQUENT:
                hot = int(held_g[0])
                yield out(held_g, held_n, np.full(len(held_g), FREQUENT))
                held_g = held_n = held_g[:0]
        if len(held_g) > 1:
            yield out(held_g, held_n, np.full(len(held_g), min(len(held_g), FREQUENT)))

    return (rows.repartition("gram").sortWithinPartitions("gram", "node")
            .mapInArrow(run, "gram long, node long, df long"))


def prefix_rows(nodes: DataFrame, shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(gram, node): the n-grams in each node's prefix that another node has as well."""
    bound = F.lit(_low_bound(percent))
    listed = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(
        (F.col("gram") >= bound).cast("int").alias("late"),
        F.when(F.col("gram") < bound, F.col("df")).otherwise(F.lit(0)).alias("df"), "gram"))).alias("grams"))
    low = F.size(F.filter("grams", lambda x: x["late"] == 0))
    prefix = F.col("n_grams") - F.ceil(F.col("n_grams") * percent / F.lit(100)) + 1
    alone = F.col("n_low") - low  # n-grams of small hash that no other node has: they come first
    room = F.greatest(F.lit(0), prefix - alone).cast("int")
    return (listed.join(nodes.select("node", "n_grams", "n_low"), "node")
            .select("node", F.explode(F.slice("grams", F.lit(1), room)).alias("g"))
            .select(F.col("g.gram").alias("gram"), "node"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): label is the smallest node reachable.

    Rounds of "smallest label among the neighbours, then the label's label";
    the number of rounds grows with the logarithm of the longest chain.
    """
    both = handed_over(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    labels = handed_over(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        lower = labels.join(near, "node").select("node", F.col("label").alias("before"),
                                                 F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = handed_over(lower.join(up, "label", "left").select(
            "node", F.least("label", F.coalesce("up", "label")).alias("label"), "before"), "labels")
        moved = after.where("label != before").limit(1).count()
        release(edges.sparkSession, labels)
        labels = after.drop("before")
        if not moved:
            release(edges.sparkSession, both)
            return labels


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in table.column("grams").to_pylist()]


def tree_links(targets: list[np.ndarray], probes: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each target in tree order, the probes whose Jaccard similarity with it reaches the bound.

    The tree is walked as the sorted list of its sets: what a set shares with
    the one before it is the path to their branching node, whose overlaps are
    on the stack.
    """
    total = np.concatenate([*targets, *probes])
    grams, df = np.unique(total, return_counts=True)
    grams, df = grams[df > 1], df[df > 1]
    order = np.lexsort((grams, -df))
    rank_of = np.empty(len(grams), np.int64)
    rank_of[order] = np.arange(len(grams))

    def ranked(values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(grams, values)
        at[at == len(grams)] = 0
        return np.sort(rank_of[at[grams[at] == values]]) if len(grams) else np.zeros(0, np.int64)

    paths = [ranked(t) for t in targets]
    size_t = np.array([len(t) for t in targets], np.int64)
    size_p = np.array([len(p) for p in probes], np.int64)
    member = np.zeros((len(grams), len(probes)), np.uint8)
    for j, p in enumerate(probes):
        member[ranked(p), j] = 1
    behind = None
    if member.size <= PRUNE_CELLS:  # n-grams of each probe at or behind a rank
        behind = np.zeros((len(grams) + 1, len(probes)), np.int32)
        if len(grams):
            np.cumsum(member[::-1], axis=0, dtype=np.int32, out=behind[-2::-1])
    least = -(-percent * size_p // 100)
    walk = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())

    def common(a: np.ndarray, b: np.ndarray) -> int:
        k = min(len(a), len(b))
        differ = np.flatnonzero(a[:k] != b[:k])
        return int(differ[0]) if len(differ) else k

    everyone = np.arange(len(probes))
    stack: list[tuple[int, np.ndarray, np.ndarray]] = [(0, everyone, np.zeros(len(probes), np.int64))]
    for k, i in enumerate(walk):
        path = paths[i]
        following = common(path, paths[walk[k + 1]]) if k + 1 < len(walk) else 0
        depth, alive, overlap = stack[-1]
        if following > depth:  # leave the next branching node's overlaps, without probes that cannot get there
            if len(alive):
                overlap = overlap + member[path[depth:following]][:, alive].sum(axis=0, dtype=np.int64)
                if behind is not None:
                    stay = overlap + behind[path[following - 1] + 1, alive] >= least[alive]
                    alive, overlap = alive[stay], overlap[stay]
            depth = following
            stack.append((depth, alive, overlap))
        if len(alive):
            fits = (100 * size_p[alive] >= percent * size_t[i]) & (100 * size_t[i] >= percent * size_p[alive])
            mine, got = alive[fits], overlap[fits]
            if len(mine):
                got = got + member[path[depth:]][:, mine].sum(axis=0, dtype=np.int64)
                yield i, mine[(100 + percent) * got >= percent * (size_t[i] + size_p[mine])]
        while len(stack) > 1 and stack[-1][0] > following:
            stack.pop()


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _link_group(percent: int):
    """Links (a, b) of a group: ``probe`` rows against the others, or all against all where none is a probe."""

    def run(table: pa.Table) -> pa.Table:
        probe = np.array(table.column("probe").to_pylist(), bool)
        nodes, sets = table.column("node").to_pylist(), _sets(table)
        target = np.flatnonzero(~probe)
        ask = np.flatnonzero(probe) if probe.any() else target
        forest, a, b = _Forest(len(nodes)), [], []
        for i, found in tree_links([sets[k] for k in target], [sets[k] for k in ask], percent):
            for j in found:
                x, y = int(target[i]), int(ask[j])
                if nodes[x] != nodes[y] and forest.join(x, y):
                    a.append(nodes[x])
                    b.append(nodes[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _with_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``wanted`` (doc_id, node, ...) with ``grams``, the node's whole set, read again from its document's text."""
    marks = Marks(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([marks.keep(batch)])):
                sets = list(gram_sets(part.column("text"), n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_key(g) for g in sets], pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())],
                    names=["node", "grams"])

    found = docs.select(marks.place("doc_id"), text_of().alias("text")).mapInArrow(run, "node long, grams binary")
    return (found.join(wanted, "node").select("node", "cluster", "n_grams", "sets_in", "grams_in", "grams")
            .dropDuplicates(["node"]))


def _against_centre(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for mine, centre in zip(batch.column("grams").to_pylist(), batch.column("centre_grams").to_pylist(),
                                    strict=True):
                x, y = np.frombuffer(mine, np.int64), np.frombuffer(centre, np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append((100 + percent) * both >= percent * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("centre"), pa.array(linked, pa.bool_())],
                                             names=["node", "centre", "linked"])

    return run


def _size_class(percent: int) -> Column:
    """Sets whose classes are more than one apart have sizes that are out of each other's reach."""
    if percent >= 100:
        return F.col("n_grams")
    if percent <= 0:
        return F.lit(0).cast("long")
    return F.floor(F.log("n_grams") / F.lit(-math.log(percent / 100) * (1 + 1e-9)))


def _block_pairs(members: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """Sets of large clusters (grams, probe) dealt by pairs of blocks: every set of ``rest`` as a probe to all that may be in reach.

    A pair is named by cluster, class and block of the probes (size_i, i), and of the others (size_j, j).
    """
    sized = members.withColumn("size_j", _size_class(percent))
    counts = sized.groupBy("cluster", "size_j").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    counts = broadcast_if_fits(counts)
    rows = sized.join(counts, ["cluster", "size_j"]).select(
        "cluster", "node", "grams", "size_j", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("j"))
    probes = rows.join(rest.select("node"), "node", "left_semi").withColumnsRenamed({"size_j": "size_i", "j": "i"})
    near = lambda size: F.explode(F.array(F.col(size) - 1, F.col(size), F.col(size) + 1))
    asked = (probes.withColumn("size_j", near("size_i")).join(counts, ["cluster", "size_j"])
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"))
    asking = broadcast_if_fits(probes.select("cluster", "size_i", "i").distinct())
    told = rows.withColumn("size_i", near("size_j")).join(asking, ["cluster", "size_i"])
    return asked.withColumn("probe", F.lit(True)).unionByName(told.withColumn("probe", F.lit(False)))


def _large_cluster_links(members: DataFrame, percent: int) -> DataFrame:
    """Links in clusters of more than one block: all with the centre, then what it does not reach with all."""
    centres = members.groupBy("cluster").agg(F.min("node").alias("node")).select("node")
    centre_sets = broadcast_if_fits(members.join(centres, "node", "left_semi").select(
        "cluster", F.col("node").alias("centre"), F.col("grams").alias("centre_grams")), CENTRES)
    near = handed_over(members.join(centre_sets, "cluster").select("node", "centre", "grams", "centre_grams").mapInArrow(
        _against_centre(percent), "node long, centre long, linked boolean"), "centres")
    far = (_block_pairs(members, near.where("not linked"), percent).groupBy("cluster", "size_i", "i", "size_j", "j")
           .applyInArrow(_link_group(percent), "a long, b long"))
    return near.where("linked").select(F.col("node").alias("a"), F.col("centre").alias("b")).union(far)


def links(docs: DataFrame, rows: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A forest of links (a, b) between nodes that has the components of all links. ``rows`` is ``narrow``."""
    spark = docs.sparkSession
    some = rows.where("n_grams > 0")
    nodes = some.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_grams").alias("n_grams"),
                                     F.first("n_low").alias("n_low"))
    # read from the texts again, so that the n-grams are in the shuffle only
    shared = handed_over(_shared(signatures(docs, n, percent).where("first is not null").select(
        F.explode("first").alias("gram"), "node")), "shared")
    keys = handed_over(prefix_rows(nodes, shared, percent), "prefixes")
    release(spark, shared)
    hubs = keys.groupBy("gram").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub != other")
    clusters = components(keys.join(hubs, "gram").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    release(spark, keys)
    wanted = clusters.select("node", F.col("label").alias("cluster")).join(nodes, "node")
    sizes = wanted.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets_in"), F.sum("n_grams").alias("grams_in"))
    wanted = wanted.join(sizes, "cluster").select("doc_id", "node", "cluster", "n_grams", "sets_in", "grams_in")
    members = handed_over(_with_sets(docs, wanted, n), "members")
    small = (F.col("sets_in") <= BLOCK_SETS) & (F.col("grams_in") <= BLOCK_GRAMS)
    near = (members.where(small).select("cluster", "node", "grams", F.lit(False).alias("probe"))
            .groupBy("cluster").applyInArrow(_link_group(percent), "a long, b long"))
    found = handed_over(near.union(_large_cluster_links(members.where(~small), percent)), "links")
    release(spark, members, clusters)
    return found


def narrow(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_grams, node and n_low of every document, handed over."""
    return handed_over(signatures(docs, n, percent).drop("first"), "signatures")


def labels(docs: DataFrame, rows: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, doc_id, label) of every node with n-grams: its smallest document and the class it is in."""
    found = components(links(docs, rows, n, percent))
    nodes = rows.where("n_grams > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    return nodes.join(found, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))


def classes(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    rows = narrow(docs, n, percent)
    labelled = labels(docs, rows, n, percent)
    smallest = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = labelled.join(smallest, "label").select("node", "component_id")
    return rows.select("doc_id", "n_grams", "node").join(named, "node", "left").select(
        "doc_id", F.col("n_grams").alias("n_shingles"),
        F.when(F.col("n_grams") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one document of each class: that of the smallest id.

    Rows with an empty set are in no class and stay; of equal rows one stays.
    """
    rows = narrow(docs, n, percent)
    labelled = labels(docs, rows, n, percent)
    kept = labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node"))
                                         .alias("k")).select(F.col("k.node").alias("kept_node"),
                                                             F.col("k.doc_id").alias("kept_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [(set_key(grams), len(grams)) for grams in gram_sets(part.column("text"), n)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([k for k, _ in sets], pa.int64()), pa.array([s for _, s in sets], pa.int64())],
                names=[*part.schema.names, *own])

    own = ["_node", "_grams"]
    while set(own) & set(docs.columns):
        own = [f"_{c}" for c in own]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in own)])
    known = docs.mapInArrow(run, schema)
    node, grams = (F.col(c) for c in own)
    first = F.row_number().over(Window.partitionBy("doc_id", own[0]).orderBy(F.lit(0)))
    chosen = (known.where(grams > 0)
              .join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (node == F.col("kept_node")),
                    "left_semi").withColumn(own[1], first).where(grams == 1))
    return chosen.select(*docs.columns).unionByName(known.where(grams == 0).select(*docs.columns))
