"""Graphs of tables, columns and links: edges are a DataFrame (a, b) and optionally a weight. Large graphs stay in Spark;
schema graphs, of at most some thousand nodes, may be taken to the driver by the functions that say so."""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.storage import discard, materialize


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once in either direction, without loops."""
    e = edges.select("a", "b").where("a <> b")
    return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that can be reached. Star rounds, so their number grows with the logarithm of the size."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "graph")
    mark = None
    for _ in range(max_rounds):
        found = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.crc32(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"))))).first())
        if found == mark or not found[0]:
            break
        mark = found
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = materialize(small, "graph")
    else:
        raise RuntimeError("the components did not settle")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("r")), "node", "left").select("node", F.coalesce("r", "node").alias("component"))


def degree(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """Undirected: every node has an edge, so no rank is lost. One join and one aggregation a round."""
    e = undirected(edges)
    out = e.groupBy("a").agg(F.count("*").alias("d"))
    links = materialize(e.join(out, "a"), "pagerank-links")
    n = out.count()
    ranks = out.select(F.col("a").alias("node"), F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(rounds):
        given = links.join(ranks, F.col("a") == F.col("node")).groupBy("b").agg(F.sum(F.col("rank") / F.col("d")).alias("s"))
        ranks = given.select(F.col("b").alias("node"), (F.lit((1 - damping) / max(n, 1)) + damping * F.col("s")).alias("rank"))
        if k % 5 == 4:
            ranks = materialize(ranks, "pagerank")
    return ranks


def hits(edges: DataFrame, rounds: int = 15) -> DataFrame:
    """Hub and authority of a directed graph, each of length 1. Every half round is written, so plans do not grow."""
    e = edges.select("a", "b").distinct()
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()

    def scaled(df: DataFrame, key: str, name: str) -> DataFrame:
        made = materialize(df, "hits")
        length = made.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        return made.select(F.col(key).alias("n"), (F.col("x") / length).alias(name))

    hub = nodes.select(F.col("node").alias("n"), F.lit(1.0).alias("hub"))
    for _ in range(rounds):
        auth = scaled(e.join(hub, F.col("a") == F.col("n")).groupBy("b").agg(F.sum("hub").alias("x")), "b", "authority")
        hub = scaled(e.join(auth, F.col("b") == F.col("n")).groupBy("a").agg(F.sum("authority").alias("x")), "a", "hub")
    out = nodes.join(hub.withColumnRenamed("n", "node"), "node", "left").join(auth.withColumnRenamed("n", "node"), "node", "left")
    return out.select("node", F.coalesce("hub", F.lit(0.0)).alias("hub"), F.coalesce("authority", F.lit(0.0)).alias("authority"))


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, label): each round a node takes its neighbours' most frequent label, the least of ties."""
    e = undirected(edges)
    labels = e.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    for _ in range(rounds):
        seen = e.join(labels, F.col("b") == F.col("node")).groupBy("a", "label").agg(F.count("*").alias("n"))
        best = seen.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "label"))).where("r = 1")
        labels = materialize(best.select(F.col("a").alias("node"), "label"), "labels")
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    e = undirected(edges)
    m2 = e.agg(F.count("*").alias("m2"))
    la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    both = e.join(la, "a").join(lb, "b")
    inside = both.agg(F.count_if(F.col("la") == F.col("lb")).alias("i"))
    sums = both.groupBy("la").agg(F.count("*").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return m2.crossJoin(inside).crossJoin(sums).select(F.round(F.col("i") / F.col("m2") - F.col("dd") / (F.col("m2") * F.col("m2")), 6).alias("modularity"))


def distances(edges: DataFrame, sources: DataFrame, most: int = 10_000) -> DataFrame:
    """(source, node, distance) by breadth-first rounds from each source (column source), until no node is new."""
    e = undirected(edges)
    seen = sources.select("source", F.col("source").alias("node"), F.lit(0).alias("distance"))
    front = seen
    for k in range(1, most + 1):
        step = front.join(e, F.col("node") == F.col("a")).select("source", F.col("b").alias("node")).distinct()
        front = materialize(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("distance", F.lit(k)), "distances")
        if front.isEmpty():
            return seen
        seen = materialize(seen.unionByName(front), "distances")
    raise RuntimeError(f"there are nodes at more than {most - 1} steps")


_WORDS = 8  # of 64 sources each, that a row of a level holds at most


def closeness(edges: DataFrame, sources: DataFrame, most: int = 10_000) -> DataFrame:
    """Reachable nodes by the sum of their distances.

    A node's row holds which sources have reached it, a bit each, so a round reads every edge once for 512 sources.
    """
    spark = edges.sparkSession
    e = materialize(undirected(edges), "closeness-edges")
    place = F.row_number().over(Window.orderBy("source")) - 1
    asked = materialize(sources.select("source").where("source is not null").distinct().withColumn("_n", place.cast("long")), "closeness-sources")
    width = min(_WORDS, max(1, -(-asked.count() // 64)))
    words, size = [f"w{k}" for k in range(width)], 64 * width
    bits = [F.when(F.floor(F.col("_n") % size / 64) == k, F.expr("shiftleft(1L, cast(_n % 64 AS int))")).otherwise(F.lit(0).cast("long")) for k in range(width)]
    state = asked.select(F.floor(F.col("_n") / size).alias("block"), F.col("source").alias("node"), *(x.alias(f"w{k}") for k, x in enumerate(bits)), *(x.alias(f"f{k}") for k, x in enumerate(bits)))
    fresh = " or ".join(f"f{k} <> 0" for k in range(width))
    found, held = [], None

    def counted(batches):
        for batch in batches:
            block, data = batch.column(0).to_numpy(), np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            for b in np.unique(block).tolist():
                n = np.unpackbits(np.ascontiguousarray(data[block == b]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                at = np.nonzero(n)[0]
                yield pa.RecordBatch.from_arrays([pa.array(at + b * size), pa.array(n[at])], ["_n", "n"])

    for k in range(1, most + 1):
        step = state.where(fresh).join(e, F.col("node") == F.col("a")).groupBy("block", F.col("b").alias("node")).agg(*(F.bit_or(f"f{i}").alias(f"g{i}") for i in range(width)))
        both = state.select("block", "node", *words).join(step, ["block", "node"], "full")
        old, new = ([F.coalesce(f"{x}{i}", F.lit(0).cast("long")) for i in range(width)] for x in "wg")
        state = materialize(both.select("block", "node", *(x.bitwiseOR(y).alias(f"w{i}") for i, (x, y) in enumerate(zip(old, new, strict=True))), *(y.bitwiseAND(F.bitwise_not(x)).alias(f"f{i}") for i, (x, y) in enumerate(zip(old, new, strict=True)))), "closeness")
        if held is not None:
            discard(held)
        held = state
        level = state.where(fresh).select("block", *(f"f{i}" for i in range(width))).mapInArrow(counted, "_n long, n long")
        level = materialize(level.groupBy("_n").agg(F.sum("n").alias("n")).withColumn("distance", F.lit(k)), "closeness-counts")
        if level.isEmpty():
            break
        found.append(level)
    else:
        raise RuntimeError(f"there are nodes at more than {most - 1} steps")
    rows = spark.createDataFrame([], "_n long, n long, distance int")
    for level in found:
        rows = rows.unionByName(level)
    sums = rows.groupBy("_n").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("distance")).alias("d"))
    return sums.join(asked, "_n").select(F.col("source").alias("node"), F.round(F.col("n") / F.col("d"), 6).alias("closeness"))


def triangles(edges: DataFrame) -> DataFrame:
    """Number of triangles: edges point from the node of lower degree, so a hub's pairs are never formed."""
    e = undirected(edges)
    d = e.groupBy("a").agg(F.count("*").alias("d"))
    da, db = d.select("a", F.col("d").alias("da")), d.select(F.col("a").alias("b"), F.col("d").alias("db"))
    o = e.join(da, "a").join(db, "b").where(F.struct("da", "a") < F.struct("db", "b")).select("a", "b")
    x, y = o.select("a", F.col("b").alias("x")), o.select("a", F.col("b").alias("y"))
    wedges = x.join(y, "a").where("x <> y")
    return wedges.join(o.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"]).agg(F.count("*").alias("triangles"))


def betti(edges: DataFrame) -> DataFrame:
    """Components, independent cycles (edges - nodes + components) and triangles // 4."""
    e = undirected(edges).where("a < b")
    c = components(edges)
    return c.agg(F.count("*").alias("nodes"), F.count_distinct("component").alias("b0")).crossJoin(e.agg(F.count("*").alias("edges"))).crossJoin(triangles(edges)).select("b0", (F.col("edges") - F.col("nodes") + F.col("b0")).alias("b1"), F.floor(F.col("triangles") / 4).alias("b2"))


def density(edges: DataFrame) -> DataFrame:
    e = undirected(edges).where("a < b")
    n = undirected(edges).select("a").distinct().agg(F.count("*").alias("nodes"))
    return e.agg(F.count("*").alias("edges")).crossJoin(n).select("nodes", "edges", F.round(2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6).alias("density"))


def graph_similarity(x: DataFrame, y: DataFrame) -> DataFrame:
    """Jaccard of the edges of two graphs."""
    a, b = undirected(x).where("a < b"), undirected(y).where("a < b").withColumn("hit", F.lit(1))
    both = a.withColumn("one", F.lit(1)).join(b, ["a", "b"], "full")
    return both.agg(F.round(F.count_if(F.col("one").isNotNull() & F.col("hit").isNotNull()) / F.count("*"), 6).alias("jaccard"))


def coexistence(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, share) of the rows in which both columns are filled."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.round(F.avg((F.col(x).isNotNull() & F.col(y).isNotNull()).cast("int")), 6).alias("share")) for x, y in pairs]
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("p")).select("p.*")


class SchemaGraph:
    """A small undirected graph on the driver: paths, bridges, betweenness, communities, embeddings."""

    def __init__(self, edges: list[tuple[str, str]]):
        self.near: dict[str, set[str]] = defaultdict(set)
        for a, b in edges:
            if a != b:
                self.near[a].add(b)
                self.near[b].add(a)
        self.nodes = sorted(self.near)

    def shortest(self, a: str, b: str) -> list[str] | None:
        back: dict[str, str | None] = {a: None}
        queue = deque([a])
        while queue:
            x = queue.popleft()
            if x == b:
                out = [x]
                while back[out[-1]] is not None:
                    out.append(back[out[-1]])
                return out[::-1]
            for y in sorted(self.near[x]):
                if y not in back:
                    back[y] = x
                    queue.append(y)
        return None

    def all_paths(self, a: str, b: str, most: int = 5) -> list[list[str]]:
        """Simple paths of at most most nodes."""
        out, queue = [], [[a]]
        while queue:
            path = queue.pop()
            if path[-1] == b:
                out.append(path)
            elif len(path) < most:
                queue += [[*path, y] for y in self.near[path[-1]] if y not in path]
        return sorted(out, key=lambda p: (len(p), p))

    def bridges(self) -> list[tuple[str, str]]:
        """Edges whose loss parts the graph, by low links without recursion."""
        seen: dict[str, int] = {}
        low: dict[str, int] = {}
        out = []
        for root in self.nodes:
            if root in seen:
                continue
            seen[root] = low[root] = len(seen)
            stack = [(root, None, iter(sorted(self.near[root])))]
            while stack:
                x, parent, rest = stack[-1]
                y = next(rest, None)
                if y is None:
                    stack.pop()
                    if parent is not None:
                        low[parent] = min(low[parent], low[x])
                        if low[x] > seen[parent]:
                            out.append((min(parent, x), max(parent, x)))
                elif y not in seen:
                    seen[y] = low[y] = len(seen)
                    stack.append((y, x, iter(sorted(self.near[y]))))
                elif y != parent:
                    low[x] = min(low[x], seen[y])
        return sorted(out)

    def betweenness(self) -> dict[str, float]:
        """Brandes, exact, each pair once."""
        score = dict.fromkeys(self.nodes, 0.0)
        for s in self.nodes:
            order, before, paths, dist = [], defaultdict(list), defaultdict(float, {s: 1.0}), {s: 0}
            queue = deque([s])
            while queue:
                x = queue.popleft()
                order.append(x)
                for y in self.near[x]:
                    if y not in dist:
                        dist[y] = dist[x] + 1
                        queue.append(y)
                    if dist[y] == dist[x] + 1:
                        paths[y] += paths[x]
                        before[y].append(x)
            part = dict.fromkeys(order, 0.0)
            for x in reversed(order):
                for y in before[x]:
                    part[y] += paths[y] / paths[x] * (1 + part[x])
                if x != s:
                    score[x] += part[x] / 2
        return score

    def louvain(self, passes: int = 100) -> dict[str, str]:
        """Communities by local moves in a fixed order, until none raises the modularity."""
        label = {n: n for n in self.nodes}
        degree = {n: len(self.near[n]) for n in self.nodes}
        m2 = sum(degree.values()) or 1
        total = dict(degree)
        for _ in range(passes):
            moved = False
            for n in self.nodes:
                total[label[n]] -= degree[n]
                links = defaultdict(int)
                for y in self.near[n]:
                    links[label[y]] += 1
                best = max(sorted({label[n], *links}), key=lambda c: links[c] - total.get(c, 0) * degree[n] / m2)
                gain = links[best] - total.get(best, 0) * degree[n] / m2 - (links[label[n]] - total[label[n]] * degree[n] / m2)
                if best != label[n] and gain > 1e-12:
                    label[n], moved = best, True
                total[label[n]] = total.get(label[n], 0) + degree[n]
            if not moved:
                break
        return label

    def embedding(self, size: int = 8, walks: int = 10, length: int = 20, window: int = 5, seed: int = 42) -> dict[str, np.ndarray]:
        """Random walks, co-occurrence, positive mutual information, singular vectors of length 1."""
        rng, at = np.random.default_rng(seed), {n: k for k, n in enumerate(self.nodes)}
        counts = np.zeros((len(at), len(at)))
        for _ in range(walks):
            for n in self.nodes:
                path = [n]
                while len(path) < length and self.near[path[-1]]:
                    path.append(sorted(self.near[path[-1]])[rng.integers(len(self.near[path[-1]]))])
                for i, x in enumerate(path):
                    for y in path[max(0, i - window) : i]:
                        counts[at[x], at[y]] += 1
                        counts[at[y], at[x]] += 1
        total = counts.sum() or 1.0
        expected = np.outer(counts.sum(1), counts.sum(0)) / total
        pmi = np.log(np.maximum(counts, 1e-12) / np.maximum(expected, 1e-12))
        u, s, _ = np.linalg.svd(np.where(counts > 0, np.maximum(pmi, 0), 0))
        made = u[:, :size] * np.sqrt(s[:size])
        made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
        return {n: made[k] for n, k in at.items()}

    def persistence(self, weights: dict[tuple[str, str], float]) -> list[tuple[float, float]]:
        """(birth, death) of components as edges come in by falling weight (Kruskal)."""
        root = {n: n for n in self.nodes}

        def find(x: str) -> str:
            while root[x] != x:
                x = root[x]
            return x

        out = []
        for (a, b), w in sorted(weights.items(), key=lambda e: (-e[1], e[0])):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((0.0, 1.0 - w))
        return out


def column_cloud(df: DataFrame) -> DataFrame:
    """(column, distinct, filled, length): each column of a table as a point of three shares and sizes, in one pass."""
    cells = [F.struct(F.lit(c).alias("column"), F.round(F.count_distinct(c) / F.count("*"), 6).alias("distinct"), F.round(F.count(c) / F.count("*"), 6).alias("filled"), F.round(F.avg(F.length(F.col(c).cast("string"))), 6).alias("length")) for c in df.columns]
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("p")).select("p.*")


def bottleneck(x: list[tuple[float, float]], y: list[tuple[float, float]]) -> float:
    """Distance of two persistence diagrams: the least longest step of a matching in which points may also go to the diagonal."""
    n, m = len(x), len(y)
    far = lambda p, q: max(abs(p[0] - q[0]), abs(p[1] - q[1]))
    to_line = lambda p: abs(p[1] - p[0]) / 2
    size = n + m
    cost = [[far(x[i], y[j]) if i < n and j < m else to_line(x[i]) if i < n else to_line(y[j]) if j < m else 0.0 for j in range(size)] for i in range(size)]

    def matched(limit: float) -> bool:
        of: list[int | None] = [None] * size

        def place(i: int, seen: set[int]) -> bool:
            for j in range(size):
                if cost[i][j] <= limit and j not in seen:
                    seen.add(j)
                    if of[j] is None or place(of[j], seen):
                        of[j] = i
                        return True
            return False

        return all(place(i, set()) for i in range(size))

    steps = sorted({c for row in cost for c in row})
    low, high = 0, len(steps) - 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if matched(steps[mid]) else (mid + 1, high)
    return steps[low] if steps else 0.0
