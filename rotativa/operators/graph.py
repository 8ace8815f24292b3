"""Co-occurrence graphs as node and edge tables, and their measures, by joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotativa.functions.arrow import ragged
from rotativa.session import bounded_broadcast, cut

#: Nodes of a block of the graph's matrix, and pairs of nodes held at once.
BLOCK, PAIRS = 8192, 1 << 20


def cooccurrence(index: DataFrame, key: str, item: str, least: int = 2) -> DataFrame:
    """(src, dst, weight): keys that hold both items, ``src < dst``.

    Items that stand in fewer than ``least`` keys cannot make an edge and are dropped before the self-join.
    """
    rows = index.select(key, F.col(item).alias("item")).distinct()
    common = rows.groupBy("item").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("item")
    rows = rows.join(common, "item", "left_semi")
    pairs = rows.withColumnRenamed("item", "src").join(rows.withColumnRenamed("item", "dst"), key).where("src < dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, strength, centrality): centrality is degree / (nodes - 1)."""
    edges = cut(edges)
    rows = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    n = rows.agg(F.count("*").alias("_n"))
    return rows.crossJoin(F.broadcast(n)).select("node", "degree", "strength", F.round(F.col("degree").cast("double") / F.greatest(F.col("_n") - 1, F.lit(1)), 4).alias("centrality"))


def summary(edges: DataFrame) -> DataFrame:
    """(nodes, edges, density, mean_degree)."""
    edges = cut(edges)
    nodes = both_ways(edges).agg(F.countDistinct("src").alias("nodes"))
    size = edges.agg(F.count("*").alias("edges"))
    n, e = F.col("nodes").cast("double"), F.col("edges").cast("double")
    return nodes.crossJoin(size).select("nodes", "edges", F.round(F.when(n > 1, 2.0 * e / (n * (n - 1.0))).otherwise(0.0), 4).alias("density"), F.round(F.when(n > 0, 2.0 * e / n).otherwise(0.0), 4).alias("mean_degree"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components by least label, with a jump to the label's label each round, to the end.

    Labels only fall and jumps double the way they travel, so the rounds end after some log2 of the longest path.
    """
    links = cut(both_ways(edges).select("src", "dst").distinct())
    labels = cut(links.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    changed = 1
    while changed:
        seen = links.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("component").alias("_near"))
        nearer = labels.join(seen, labels["node"] == seen["src"]).select("node", F.least("component", "_near").alias("component"), F.col("component").alias("_old"))
        jump = nearer.select(F.col("node").alias("_k"), F.col("component").alias("_to"))
        new = cut(nearer.join(jump, nearer["component"] == jump["_k"], "left").select("node", F.least("component", F.coalesce("_to", "component")).alias("component"), "_old"))
        changed = new.where("component != _old").limit(1).count()
        labels = new.select("node", "component")
    return labels


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank): weighted ranks of an undirected graph; rounds end when the ranks change by less than nodes x ``tolerance`` in sum."""
    links = both_ways(edges)
    out = links.groupBy("src").agg(F.sum("weight").alias("_w"))
    links = cut(links.join(out, "src").select("src", "dst", (F.col("weight").cast("double") / F.col("_w")).alias("share")))
    nodes = cut(links.select(F.col("src").alias("node")).distinct())
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for turn in range(rounds):
        before = ranks
        sent = links.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("_in"))
        ranks = nodes.join(sent, "node", "left").select("node", (F.lit((1 - damping) / max(n, 1)) + F.lit(damping) * F.coalesce("_in", F.lit(0.0))).alias("rank"))
        # the change is measured where lineage is cut, every fifth round
        if turn % 5 == 4:
            both = cut(ranks.join(before.withColumnRenamed("rank", "_before"), "node"))
            ranks = both.select("node", "rank")
            change = both.agg(F.sum(F.abs(F.col("rank") - F.col("_before")))).first()[0]
            if change is None or change < n * tolerance:
                break
    return ranks


def _numbered(names: DataFrame) -> tuple[DataFrame, int]:
    """(name, i) with i from 0 without gaps, and the number of names; ``names(name)`` is distinct."""
    placed = cut(names.select("name", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")))
    sizes = sorted((r["p"], r["m"], r["n"]) for r in placed.groupBy("p").agg(F.min("m").alias("m"), F.count("*").alias("n")).collect())
    shift = list(accumulate([n for _, _, n in sizes], initial=0))
    first = placed.sparkSession.createDataFrame([(p, before - m) for (p, m, _), before in zip(sizes, shift, strict=False)], "p int, d long")
    return placed.join(F.broadcast(first), "p").select("name", (F.col("m") + F.col("d")).cast("int").alias("i")), shift[-1]  # one row a partition


def _coded(lo: np.ndarray, hi: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """(p, q, codes): the pairs of each pair of blocks of ``size`` nodes, each as one number."""
    low, high = np.minimum(lo, hi).astype(np.int64), np.maximum(lo, hi).astype(np.int64)
    p, q = low // size, high // size
    code = ((low - p * size) * size + high - q * size).astype(np.int32)
    order = np.lexsort((code, q, p))
    p, q, code = p[order], q[order], code[order]
    cuts = np.flatnonzero((np.diff(p) != 0) | (np.diff(q) != 0)) + 1
    first = np.append(0, cuts)[: len(code)]
    lists = pa.ListArray.from_arrays(np.append(first, len(code)).astype(np.int32), pa.array(code))
    yield pa.RecordBatch.from_arrays([pa.array(p[first].astype(np.int32)), pa.array(q[first].astype(np.int32)), lists], ["p", "q", "codes"])


def _list_pairs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """All pairs of each list of nodes, about ``PAIRS`` at once."""
    for batch in batches:
        column = batch.column(0)
        start, value = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
        length = np.diff(start)
        for m in np.unique(length[length > 1]).tolist():
            rows = np.flatnonzero(length == m)
            # the pairs of a long list are made for some of its items at once
            for first in range(0, m, max(1, PAIRS // m)):
                a = np.arange(first, min(first + max(1, PAIRS // m), m))
                a, b = np.repeat(a, m - 1 - a), ragged(a + 1, m - 1 - a)
                step = max(1, PAIRS // max(1, len(a)))
                for k in range(0, len(rows) if len(a) else 0, step):
                    held = value[start[rows[k : k + step]][:, None] + np.arange(m)]
                    yield from _coded(held[:, a].ravel(), held[:, b].ravel(), size)


def _edge_pairs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from _coded(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)), size)


def _blocks(batches: Iterator[pa.RecordBatch], size: int, least: int) -> Iterator[pa.RecordBatch]:
    """(p, q, bits, data): the pairs of each pair of blocks that come at least ``least`` times, rows of a pair of blocks following each other.

    A block is written as a matrix of bits, or as sorted numbers where these are fewer bytes.
    """
    at, codes, counts, waiting, many = None, np.empty(0, np.int32), np.empty(0, np.int64), [], 0

    def fold() -> None:
        nonlocal codes, counts, waiting, many
        each, n = np.unique(np.concatenate([codes, *waiting]), return_counts=True)
        # what was counted before is in there once
        n[np.searchsorted(each, codes)] += counts - 1
        codes, counts, waiting, many = each, np.minimum(n, least), [], 0

    def close() -> Iterator[pa.RecordBatch]:
        fold()
        kept = codes[counts >= least]
        if len(kept):
            bits = len(kept) * 4 > size * size // 8
            if bits:
                matrix = np.zeros(size * size, np.uint8)
                matrix[kept] = 1
            data = np.packbits(matrix).tobytes() if bits else kept.astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([bits]), pa.array([data], pa.binary())], ["p", "q", "bits", "data"])

    for batch in batches:
        lists = batch.column(2)
        start, value = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for k, here in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if at is not None and here != at:
                yield from close()
                codes, counts = codes[:0], counts[:0]
            at = here
            waiting.append(value[start[k] : start[k + 1]].copy())
            many += len(waiting[-1])
            if many > max(4 * PAIRS, len(codes)):
                fold()
    if at is not None:
        yield from close()


def _matrix(bits: bool, data: bytes, size: int) -> np.ndarray:
    if bits:
        return np.unpackbits(np.frombuffer(data, np.uint8)).reshape(size, size)
    out = np.zeros(size * size, np.uint8)
    out[np.frombuffer(data, "<i4")] = 1
    return out.reshape(size, size)


def _counts(ids: np.ndarray, degree: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero((degree > 0) | (twice > 0))
    return pa.RecordBatch.from_arrays([pa.array((ids[0] + used).astype(np.int32)), pa.array(degree[used].astype(np.int64)), pa.array(twice[used].astype(np.int64))], ["i", "degree", "twice"])


def _block_degrees(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p, q, bits, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            matrix = _matrix(bits, data, size)
            for k, axis in ((p, 1), (q, 0)):
                yield _counts(np.array([k * size]), matrix.sum(axis=axis, dtype=np.int64), np.zeros(size, np.int64))


def _to_triples(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """(i, j, k, p, q, bits, data): each block in the triples of blocks, in order, that hold both of its sides."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            p, q = one.column(0)[0].as_py(), one.column(1)[0].as_py()
            for r in range(blocks):
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in sorted((p, q, r))), *one.columns], ["i", "j", "k", "p", "q", "bits", "data"])


def _triangles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(i, degree, twice): twice the triangles of each node in each triple of blocks, whose rows follow each other."""
    at, held = None, {}

    def close() -> Iterator[pa.RecordBatch]:
        # rows of bits of one side's nodes over the other side's
        near: dict[tuple[int, int], np.ndarray] = {}
        for (p, q), block in held.items():
            matrix = _matrix(*block, size)
            if p == q:
                matrix = matrix | matrix.T
            near[p, q] = np.packbits(matrix, axis=1).view(np.uint64)
            if p != q:
                near[q, p] = np.packbits(np.ascontiguousarray(matrix.T), axis=1).view(np.uint64)
        twice = {k: np.zeros(size, np.int64) for k in at}
        for p, q, r in {(*sorted((at[x], at[y])), at[z]) for x, y, z in ((0, 1, 2), (0, 2, 1), (1, 2, 0))}:
            if not ((p, q) in held and (p, r) in near and (q, r) in near):
                continue
            edges, left, right = _matrix(*held[p, q], size), near[p, r], near[q, r]
            for u in np.flatnonzero(edges.any(axis=1) & left.any(axis=1)).tolist():
                v = np.flatnonzero(edges[u])
                common = np.bitwise_count(right[v] & left[u]).sum(axis=1, dtype=np.int64)
                twice[p][u] += common.sum()
                twice[q][v] += common
        for k, counted in twice.items():
            yield _counts(np.array([k * size]), np.zeros(size, np.int64), counted)

    for batch in batches:
        for i, j, k, p, q, bits, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at is not None and (i, j, k) != at:
                yield from close()
                held = {}
            at = (i, j, k)
            held[p, q] = (bits, data)
    if at is not None:
        yield from close()


def _block_clustering(named: DataFrame, nodes: int, pairs: Callable[[int], DataFrame], least: int) -> DataFrame:
    """(node, triangles, coefficient) of the pairs that come ``least`` times; ``pairs(size)`` gives (p, q, codes) for blocks of ``size`` nodes.

    The matrix of the graph is cut into blocks, and triangles are counted in each triple of blocks by the bits that
    the rows of an edge's ends have in common; neither edges nor pairs of edges are listed.
    """
    blocks = max(1, -(-nodes // BLOCK))
    size = -(-max(1, nodes) // (64 * blocks)) * 64
    made = pairs(size).repartition("p", "q").sortWithinPartitions("p", "q").mapInArrow(lambda b: _blocks(b, size, least), "p int, q int, bits boolean, data binary")
    kept = cut(made)
    out = "i int, degree long, twice long"
    degree = kept.mapInArrow(lambda b: _block_degrees(b, size), out)
    spread = kept.mapInArrow(lambda b: _to_triples(b, blocks), "i int, j int, k int, p int, q int, bits boolean, data binary")
    triangles = spread.repartition("i", "j", "k").sortWithinPartitions("i", "j", "k").mapInArrow(lambda b: _triangles(b, size), out)
    rows = degree.unionByName(triangles).groupBy("i").agg(F.sum("degree").alias("degree"), F.expr("sum(twice) div 2").alias("triangles")).join(named, "i")
    k = F.col("degree").cast("double")
    return rows.select(F.col("name").alias("node"), "triangles", F.round(F.when(k > 1, 2.0 * F.col("triangles") / (k * (k - 1.0))).otherwise(0.0), 4).alias("coefficient"))


def clustering(edges: DataFrame) -> DataFrame:
    """(node, triangles, coefficient): local clustering; nodes of degree under two have 0."""
    edges = cut(edges)
    named, nodes = _numbered(edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct())
    side = bounded_broadcast(named)
    ends = edges.join(side.withColumnsRenamed({"name": "src", "i": "a"}), "src").join(side.withColumnsRenamed({"name": "dst", "i": "b"}), "dst").select("a", "b")
    return _block_clustering(named, nodes, lambda size: ends.mapInArrow(lambda b: _edge_pairs(b, size), "p int, q int, codes array<int>"), 1)


def cooccurrence_clustering(index: DataFrame, key: str, item: str, least: int = 2) -> DataFrame:
    """``clustering(cooccurrence(index, key, item, least))`` from the lists of each key's items, without a table of edges."""
    rows = cut(index.where(F.col(key).isNotNull()).select(key, F.col(item).alias("name")).distinct())
    named, nodes = _numbered(rows.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("name"))
    lists = rows.join(bounded_broadcast(named), "name").groupBy(key).agg(F.collect_list("i").alias("l")).where(F.size("l") > 1).select("l")
    return _block_clustering(named, nodes, lambda size: lists.mapInArrow(lambda b: _list_pairs(b, size), "p int, q int, codes array<int>"), least)


def ego(edges: DataFrame, node: str) -> DataFrame:
    """Edges among a node and its neighbours."""
    edges = cut(edges)
    near = both_ways(edges).where(F.col("src") == node).select(F.col("dst").alias("n")).unionByName(edges.sparkSession.createDataFrame([(node,)], "n string")).distinct()
    return edges.join(near.withColumnRenamed("n", "src"), "src", "left_semi").join(near.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst", "weight")


def by_period(index: DataFrame, periods: DataFrame, key: str, item: str, period: str, least: int = 1) -> DataFrame:
    """(period, nodes, edges, density): the co-occurrence graph of each period, in one pass with the period as a key."""
    rows = index.select(key, F.col(item).alias("item")).distinct().join(periods.select(key, F.col(period).alias("period")), key)
    pairs = rows.withColumnRenamed("item", "src").join(rows.withColumnRenamed("item", "dst"), ["period", key]).where("src < dst")
    edges = pairs.groupBy("period", "src", "dst").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)
    nodes = edges.select("period", F.explode(F.array("src", "dst")).alias("n")).distinct().groupBy("period").agg(F.count("*").alias("nodes"))
    counted = edges.groupBy("period").agg(F.count("*").alias("edges")).join(nodes, "period")
    n, e = F.col("nodes").cast("double"), F.col("edges").cast("double")
    return counted.select("period", "nodes", "edges", F.round(F.when(n > 1, 2.0 * e / (n * (n - 1.0))).otherwise(0.0), 4).alias("density"))


def strongest(edges: DataFrame, most: int) -> DataFrame:
    """Edges among the ``most`` nodes of greatest strength (ties by name): the graph that is shown and measured as a whole."""
    edges = cut(edges)
    kept = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("_s")).orderBy(F.desc("_s"), "node").limit(most).select("node")
    side = F.broadcast(cut(kept))  # at most ``most`` rows
    return edges.join(side.withColumnRenamed("node", "src"), "src", "left_semi").join(side.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "weight")


def distances(edges: DataFrame) -> DataFrame:
    """(src, dst, d): lengths of shortest paths between the nodes of each component, by joins of the frontier.

    The result has the square of the nodes; it is meant for a graph cut by ``strongest``.
    """
    links = cut(both_ways(edges).select("src", "dst").distinct())
    found = links.select(F.col("src"), F.col("src").alias("dst"), F.lit(0).alias("d")).distinct()
    frontier, turn = found, 0
    while True:
        turn += 1
        step = frontier.select("src", F.col("dst").alias("_via")).join(links.withColumnRenamed("src", "_via"), "_via").select("src", "dst").distinct()
        frontier = cut(step.join(found.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("d", F.lit(turn)))
        if frontier.isEmpty():
            return found
        found = cut(found.unionByName(frontier))


def closeness(edges: DataFrame) -> DataFrame:
    """(node, closeness, eccentricity): ((r - 1) / sum of distances) x ((r - 1) / (n - 1)), r the nodes reached with itself."""
    reached = distances(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("r"), F.sum("d").alias("s"), F.max("d").alias("eccentricity"))
    n = reached.agg(F.count("*").alias("_n"))
    near = (F.col("r") - 1).cast("double")
    return reached.crossJoin(F.broadcast(n)).select("node", F.round(F.when((F.col("s") > 0) & (F.col("_n") > 1), near / F.col("s") * near / (F.col("_n") - 1)).otherwise(0.0), 6).alias("closeness"), "eccentricity")  # one row


def shape(edges: DataFrame) -> DataFrame:
    """(nodes, edges, most, least, diameter, bipartite): sizes, greatest and least degree, longest shortest path, and whether two colours suffice.

    A component has an odd cycle if an edge joins two nodes equally far from its least node.
    """
    all_ = cut(distances(edges))
    level = all_.groupBy(F.col("src").alias("node")).agg(F.min_by("d", "dst").alias("d")).select("node", (F.col("d") % 2).alias("colour"))
    a, b = level.select(F.col("node").alias("src"), F.col("colour").alias("_a")), level.select(F.col("node").alias("dst"), F.col("colour").alias("_b"))
    odd = edges.join(a, "src").join(b, "dst").agg(F.count_if(F.col("_a") == F.col("_b")).alias("odd"))
    ends = both_ways(edges).groupBy("src").agg(F.count("*").alias("k")).agg(F.count("*").alias("nodes"), F.max("k").alias("most"), F.min("k").alias("least"))
    longest = all_.agg(F.max("d").alias("diameter"))
    size = edges.agg(F.count("*").alias("edges"))
    return ends.crossJoin(size).crossJoin(longest).crossJoin(odd).select("nodes", "edges", "most", "least", "diameter", (F.col("odd") == 0).alias("bipartite"))  # one row each


def communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, community): label propagation in step, each node taking the heaviest label around it and its own (ties by the least label).

    A node's own label weighs as much as its heaviest edge, which keeps pairs from swapping labels for ever; the
    rounds end when no label changes, and at ``rounds`` at the latest.
    """
    links = cut(both_ways(edges))
    own = links.groupBy(F.col("src").alias("node")).agg(F.max("weight").alias("_own"))
    labels = cut(own.select("node", F.col("node").alias("community")))
    for _ in range(rounds):
        heard = links.join(labels.select(F.col("node").alias("dst"), "community"), "dst").select(F.col("src").alias("node"), "community", "weight")
        kept = labels.join(own, "node").select("node", "community", F.col("_own").alias("weight"))
        summed = heard.unionByName(kept).groupBy("node", "community").agg(F.sum("weight").alias("w"))
        new = summed.groupBy("node").agg(F.min_by("community", F.struct((-F.col("w")).alias("w"), "community")).alias("community"))
        both = cut(new.join(labels.withColumnRenamed("community", "_old"), "node"))
        labels = both.select("node", "community")
        if both.where("community != _old").isEmpty():
            break
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(communities, modularity) of a partition of a weighted graph."""
    ways = both_ways(edges)
    total = ways.agg(F.sum("weight").cast("double").alias("_m"))  # twice the weight of all edges
    a, b = labels.select(F.col("node").alias("src"), F.col("community").alias("_a")), labels.select(F.col("node").alias("dst"), F.col("community").alias("_b"))
    placed = ways.join(a, "src").join(b, "dst")
    each = placed.groupBy(F.col("_a").alias("community")).agg(F.sum("weight").cast("double").alias("k"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("weight")).otherwise(0)).cast("double").alias("inside"))
    return each.crossJoin(F.broadcast(total)).agg(F.count("*").alias("communities"), F.round(F.sum(F.col("inside") / F.col("_m") - (F.col("k") / F.col("_m")) * (F.col("k") / F.col("_m"))), 4).alias("modularity"))  # one row


def betweenness(edges: DataFrame, most: int = 300) -> DataFrame:
    """(node, betweenness) on the ``most`` strongest nodes, weights read as lengths, normalised by (n - 1)(n - 2) / 2.

    Shortest path counts from every source, in one task over the bounded graph, which every source needs as a whole.
    """
    import pandas as pd

    def measure(table: pd.DataFrame) -> pd.DataFrame:
        import heapq

        near: dict[str, list[tuple[str, float]]] = {}
        for a, b, w in zip(table["src"], table["dst"], table["weight"], strict=True):
            near.setdefault(a, []).append((b, float(w)))
            near.setdefault(b, []).append((a, float(w)))
        score = dict.fromkeys(near, 0.0)
        for source in near:
            length, paths, before, done = {source: 0.0}, {source: 1.0}, {source: []}, []
            heap, settled = [(0.0, source)], set()
            while heap:
                d, v = heapq.heappop(heap)
                if v in settled:
                    continue
                settled.add(v)
                done.append(v)
                for u, w in near[v]:
                    reach = d + w
                    if u not in length or reach < length[u]:
                        length[u], paths[u], before[u] = reach, paths[v], [v]
                        heapq.heappush(heap, (reach, u))
                    elif reach == length[u] and u not in settled:
                        paths[u] += paths[v]
                        before[u].append(v)
            share = dict.fromkeys(done, 0.0)
            for v in reversed(done):
                for u in before[v]:
                    share[u] += paths[u] / paths[v] * (1 + share[v])
                if v != source:
                    score[v] += share[v]
        n = len(near)
        scale = (n - 1) * (n - 2) if n > 2 else 1
        return pd.DataFrame({"node": list(score), "betweenness": [round(x / scale, 6) for x in score.values()]})

    whole = strongest(edges, most).withColumn("_all", F.lit(1))
    return whole.groupBy("_all").applyInPandas(lambda t: measure(t), "node string, betweenness double")
