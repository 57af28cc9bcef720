"""Embedding near-duplicates by NN-descent.

Vectors are compared only within a label (and a dimension). Equal vectors are one node with a weight. The neighbour graph starts
from a random-projection forest (nearest nodes within leaves) and is refined by joining neighbours of neighbours: of any
two neighbours of a node, of which one is new, each is proposed to the other. A list holds SHORT neighbours, and is
enlarged up to LONG while all it holds are links. A node whose list is saturated even then lies in a dense family: it is
compared with all nodes of its label exactly, in pairs of chunks that give counts and joining links, not pairs. Lists
hold the best neighbours whatever their cosine, as descent walks over weak edges too. Trees and rounds grow with a label's size. Recall is
audited in each label by itself, as the mean over nodes that have links, on AUDIT nodes against all rows; a label under TARGET gets another
forest and is refined again, unless it has fewer than EVIDENCE audited nodes with links or had FORESTS of them. An exact check of all nodes
follows in labels of every size, so results don't depend on SMALL, up to which a label has no descent; it is quadratic in a label.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label or a null id
link with nothing; their component is themselves. Repeated rows count as different vectors; an id with several different vectors links
where any of them does. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .components import components, roots

SHORT, LONG = 16, 64
#: Least trees of a forest (two more for each doubling over TASK), nodes of a leaf, nodes that one task splits; nodes that the coarse trees are fitted on in all.
TREES, LEAF, TASK, SAMPLE = 5, 96, 8192, 1 << 14
ROUNDS, CHUNK, AUDIT, TARGET, FORESTS = 4, 1024, 2000, 0.97, 4
#: At 5,000 nodes of a label all pairs cost a fifteenth of descent; SMALL is an estimate of where both cost the same. Nodes with links that an audit needs.
SMALL, EVIDENCE = 1 << 16, 30
EDGES = "a long, b long, s double"
#: All pairs, in DuckDB; for small tables.
SQL = """
WITH RECURSIVE e AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93
), r AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u), n AS (SELECT u, count(*) AS n FROM e GROUP BY u)
SELECT c.u AS vec_id, coalesce(n.n, 0) AS n_links, component_id, c.u = component_id AS kept FROM c LEFT JOIN n ON n.u = c.u
"""


def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, dim, v: components as double bytes, null where the vector can't link."""
    for batch in batches:
        out = []
        for v, label, i in zip(batch.column("embedding"), batch.column("label").to_pylist(), batch.column("vec_id").to_pylist(), strict=True):
            x = None
            if v.is_valid and label is not None and i is not None and not v.values.null_count and len(v.values):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0 becomes 0
                if not np.isfinite(x).all() or not x.any():
                    x = None
            out.append(x)
        dim = [0 if x is None else len(x) for x in out]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(dim, pa.int32()), pa.array([None if x is None else x.tobytes() for x in out], pa.binary())], names=["vec_id", "label", "dim", "v"])


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension with length 1, as rows. A first scaling keeps squares finite."""
    parts = column.to_pylist()
    x = np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def split(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Side of each row of a plane between two of them; the halves are equal in size to one."""
    i, j = rng.choice(len(x), 2, replace=False)
    side = np.zeros(len(x), bool)
    side[np.argsort(x @ (x[i] - x[j]), kind="stable")[len(x) // 2 :]] = True
    return side


def leaves(x: np.ndarray, rng: np.random.Generator, most: int = LEAF) -> Iterator[np.ndarray]:
    stack = [np.arange(len(x))]
    while stack:
        own = stack.pop()
        if len(own) <= most:
            yield own
        else:
            side = split(x[own], rng)
            stack += [own[side], own[~side]]


def fit_cells(x: np.ndarray, size: float, rng: np.random.Generator) -> list:
    """A coarse tree on a sample that stands for `size` nodes: [direction, threshold, below, above] or []."""
    if size <= TASK or len(x) < 8:
        return []
    i, j = rng.choice(len(x), 2, replace=False)
    direction = x[i] - x[j]
    dots = x @ direction
    threshold = float(np.median(dots))
    above = dots > threshold
    if above.all() or not above.any():
        return []
    return [direction, threshold, fit_cells(x[~above], size / 2, rng), fit_cells(x[above], size / 2, rng)]


def cells(x: np.ndarray, tree: list) -> np.ndarray:
    out = np.ones(len(x), np.int64)
    stack = [(np.arange(len(x)), tree)]
    while stack:
        own, node = stack.pop()
        if node and len(own):
            above = x[own] @ node[0] > node[1]
            out[own] = out[own] * 2 + above
            stack += [(own[~above], node[2]), (own[above], node[3])]
    return out


def plane_cells(x: np.ndarray, bits: int, rng: np.random.Generator) -> np.ndarray:
    """Cells of a group that the sample has too few nodes of for a tree: sides of random planes."""
    return (x @ rng.normal(size=(x.shape[1], bits)) > 0) @ (1 << np.arange(bits)) + (1 << bits)


def doublings(n: int) -> int:
    """How often TASK nodes double until there are n."""
    return max(0, int(np.ceil(np.log2(max(1, n) / TASK))))


def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    label, dim = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
    for key in sorted(set(zip(label.tolist(), dim.tolist(), strict=True))):
        yield key, np.flatnonzero((label == key[0]) & (dim == key[1]))


def forest_edges(nodes: DataFrame, seed: int) -> DataFrame:
    """Neighbours found within the leaves of TREES trees or more."""
    sizes = {(r["label"], r["dim"]): r["n"] for r in nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > TASK).collect()}
    bits = {key: doublings(n) for key, n in sizes.items()}
    most = TREES + 2 * max(bits.values(), default=0)
    trees: dict[tuple[int, int, int], list] = {}
    if sizes:  # fitted on SAMPLE nodes in all
        total = sum(sizes.values())
        sample = nodes.where(F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / total) * (1 << 30))).select("label", "dim", "v").toArrow()
        for batch in sample.combine_chunks().to_batches():
            for key, own in by_dim(batch):
                if key in sizes:
                    x = unit_rows(batch.column("v").take(pa.array(own)))
                    for t in range(TREES + 2 * bits[key]):
                        trees[(*key, t)] = fit_cells(x, sizes[key], np.random.default_rng([seed, t, *(k & 0xFFFFFFFF for k in key)]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = list(by_dim(batch)) if bits else []
            for t in range(most):
                cell = np.full(batch.num_rows, t < TREES, np.int64)  # 0: no such tree
                for key, own in groups:
                    if key in bits and t < TREES + 2 * bits[key]:
                        x = unit_rows(batch.column("v").take(pa.array(own)))
                        tree = trees.get((*key, t))
                        cell[own] = cells(x, tree) if tree else plane_cells(x, bits[key], np.random.default_rng([seed, t, 1, *(k & 0xFFFFFFFF for k in key)]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "label", "dim", "v")), pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(cell)], names=["node", "label", "dim", "v", "tree", "cell"]).filter(pa.array(cell > 0))

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("node").to_numpy(), kind="stable")
        node, x = rows.column("node").to_numpy()[order], unit_rows(rows.column("v"))[order]
        rng = np.random.default_rng([seed, *(k.as_py() & 0xFFFFFFFF for k in key)])
        a, b, s = [], [], []
        for own in leaves(x, rng):
            sims = x[own] @ x[own].T
            np.fill_diagonal(sims, -2)
            k = min(SHORT, len(own) - 1)
            if k < 1:
                continue
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(sims, best, 1)
            a.append(np.repeat(node[own], k))
            b.append(node[own[best]].ravel())
            s.append(value.ravel())
        return edge_table(a, b, s)

    dealt = nodes.mapInArrow(deal, "node long, label int, dim int, v binary, tree int, cell long")
    return dealt.groupBy("label", "dim", "tree", "cell").applyInArrow(search, EDGES)


def edge_table(a: list, b: list, s: list) -> pa.Table:
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return pa.table([pa.array(join(a, np.int64)), pa.array(join(b, np.int64)), pa.array(join(s, np.float64))], names=["a", "b", "s"])


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups of a partition sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        last = int(np.searchsorted(values, values[-1]))
        if last or (held and held[-1].column(key)[-1].as_py() != values[0]):
            done = pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
            if done.num_rows:
                yield done
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def neighbours(edges: DataFrame, threshold: float) -> DataFrame:
    """a, b, s, fresh, full: of proposals (a, b, s, fresh) the best SHORT of each a, and up to LONG as long as they are links. full: the
    list has LONG links."""
    best = edges.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    kept = best.withColumn("rank", rank).where((F.col("rank") <= SHORT) | ((F.col("rank") <= LONG) & (F.col("s") >= threshold)))
    links = F.sum((F.col("s") >= threshold).cast("int")).over(Window.partitionBy("a"))
    return kept.withColumn("full", links >= LONG).drop("rank")


def join_round(graph: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Proposals from neighbours of neighbours: to each node the best SHORT of a centre's, and all its links. No other could enter its list."""
    ways = graph.select("a", "b", "fresh").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "fresh"))
    own = ways.groupBy("a", "b").agg(F.max("fresh").alias("fresh"))
    full = graph.where("full").select(F.col("a").alias("node"), "full").distinct()
    # only centres with a new neighbour; a node with very many of them is joined in random parts of about LONG
    degree = own.groupBy("a").agg(F.count("*").alias("n"), F.max("fresh").alias("any_fresh")).where("any_fresh")
    members = own.join(degree.select("a", "n"), "a").withColumn("part", F.pmod(F.xxhash64("a", "b", "n"), F.ceil(F.col("n") / (4 * LONG))))
    members = members.withColumn("key", F.xxhash64("a", "part"))
    loaded = members.select("key", F.col("b").alias("node"), "fresh").join(nodes.select("node", "label", "dim", "v"), "node").join(full, "node", "left")

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            key, label, dim = (table.column(c).to_numpy() for c in ("key", "label", "dim"))
            order = np.lexsort((dim, label, key))
            table, key, label, dim = table.take(pa.array(order)), key[order], label[order], dim[order]
            node, fresh = table.column("node").to_numpy(), table.column("fresh").to_numpy()
            sated = table.column("full").fill_null(False).to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (label[1:] != label[:-1]) | (dim[1:] != dim[:-1]))))
            a, b, s = [], [], []
            for i, j in zip(edge.tolist(), np.append(edge[1:], len(key)).tolist(), strict=True):
                if j - i < 2 or sated[i:j].all():
                    continue
                x = unit_rows(table.column("v").slice(i, j - i))
                sims = x @ x.T
                wanted = (fresh[i:j][:, None] | fresh[i:j]) & ~sated[i:j][:, None] & (node[i:j][:, None] != node[i:j])
                sims[~wanted] = -2
                if j - i > SHORT:
                    least = -np.partition(-sims, SHORT - 1, axis=1)[:, SHORT - 1 : SHORT]
                    wanted &= sims >= np.minimum(least, threshold)
                p, q = np.nonzero(wanted)
                a.append(node[i + p])
                b.append(node[i + q])
                s.append(sims[p, q])
            out = edge_table(a, b, s)
            yield from out.to_batches()

    return loaded.repartition("key").sortWithinPartitions("key").mapInArrow(propose, EDGES)


def refine(graph: DataFrame, nodes: DataFrame, threshold: float, rounds: int) -> DataFrame:
    graph = cut(neighbours(graph, threshold))
    for _ in range(rounds):
        proposed = join_round(graph, nodes, threshold).withColumn("fresh", F.lit(True))
        graph = cut(neighbours(graph.select("a", "b", "s").withColumn("fresh", F.lit(False)).unionByName(proposed), threshold))
        n, fresh = graph.agg(F.count("*"), F.sum((F.col("fresh") & ~F.col("full")).cast("int"))).first()
        if not n or (fresh or 0) < 0.002 * n:
            break
    return graph


def exact_links(asked: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """asked: node; nodes: node, label, dim, v, weight. Compares each asked node with all nodes of its label and dimension, in pairs of
    chunks, and returns rows (node, links, root), one of the two null: links sums to the weight of all that an asked node links to, and of the
    asked ones that another node links to; root is a node that links of the pair of chunks join to the node."""
    # chunks are larger in labels of very many nodes, so that fewer copies of rows travel
    per = F.greatest(F.lit(CHUNK), F.least(F.lit(8 * CHUNK), (F.count("*") / 64).cast("long")))
    marked = nodes.join(asked.select("node", F.lit(1).alias("asked")).distinct(), "node", "left")
    sizes = marked.groupBy("label", "dim").agg(F.ceil(F.count("*") / per).cast("int").alias("highs"), F.ceil(F.count("asked") / per).cast("int").alias("lows")).where("lows > 0")
    dealt = marked.join(sizes, ["label", "dim"])
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("asked = 1").select("label", "dim", place("lows").alias("low"), every("highs").alias("high"), "node", "v", "weight", F.lit(0).alias("side"))
    right = dealt.select("label", "dim", every("lows").alias("low"), place("highs").alias("high"), "node", "v", "weight", F.when(F.col("asked") == 1, 1).otherwise(2).alias("side"))

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        node, weight = rows.column("node").to_numpy(), rows.column("weight").to_numpy().astype(np.float64)
        x = unit_rows(rows.column("v"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side)
        xr, links = x[right].T, np.zeros(len(node))
        u, v = [], []
        for k in range(0, len(left), 256):
            part = left[k : k + 256]
            near = x[part] @ xr >= threshold
            i, j = np.nonzero(near)
            other = node[part[i]] != node[right[j]]
            i, j = i[other], j[other]
            links[part] = np.bincount(i, weight[right[j]], len(part))
            links[right] += np.bincount(j, weight[part[i]], len(right))
            ids, index = np.unique(np.concatenate([node[part], node[right]]), return_inverse=True)
            root = roots(len(ids), index[i], index[len(part) + j])
            far = root != np.arange(len(ids))
            u.append(ids[far])
            v.append(ids[root[far]])
        some = (links > 0) & (side != 1)
        counted, joined = node[some], np.concatenate(u) if u else np.zeros(0, np.int64)
        ends = np.concatenate(v) if v else joined
        return pa.table([
            pa.array(np.concatenate([counted, joined])),
            pa.concat_arrays([pa.array(links[some].astype(np.int64)), pa.nulls(len(joined), pa.int64())]),
            pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(ends)]),
        ], names=["node", "links", "root"])

    return left.unionByName(right).groupBy("label", "dim", "low", "high").applyInArrow(compare, "node long, links long, root long")


def all_links(near: DataFrame, asked: DataFrame, exact: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """node and links: what was counted exactly, and the listed links between nodes that weren't asked."""
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    for end in ("a", "b"):
        both = both.join(asked.select(F.col("node").alias(end)), end, "left_anti")
    listed = both.join(nodes.select(F.col("node").alias("b"), "weight"), "b")
    counts = listed.select(F.col("a").alias("node"), F.col("weight").alias("links"))
    if exact is not None:
        counts = counts.unionByName(exact.where("links IS NOT NULL").select("node", "links"))
    return counts.groupBy("node").agg(F.sum("links").alias("links"))


def of_labels(rows: DataFrame, labels: list[tuple[int, int]]) -> DataFrame:
    return rows.join(rows.sparkSession.createDataFrame(labels, "label int, dim int"), ["label", "dim"], "left_semi")


def audited(nodes: DataFrame, sizes: dict[tuple[int, int], int], threshold: float) -> DataFrame:
    """Of about AUDIT nodes of each label, chosen by a hash: node, label, dim and true, the links with all nodes; those that have any."""
    shares = nodes.sparkSession.createDataFrame([(*key, min(1.0, AUDIT / n)) for key, n in sizes.items()], "label int, dim int, share double")
    of_them = nodes.join(shares, ["label", "dim"])
    picked = cut(of_them.where(F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("node", "label", "dim"))
    true = exact_links(picked, of_them.drop("share"), threshold).where("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("true"))
    return cut(picked.join(true, "node"))


def recall(truth: DataFrame, full: DataFrame, links: DataFrame) -> dict[tuple[int, int], tuple[int, float, int, int]]:
    """By label, of audited nodes that aren't full: their number, mean share of links found, links that there are, and those found."""
    rows = truth.join(full, "node", "left_anti").join(links, "node", "left").withColumn("found", F.least("true", F.coalesce("links", F.lit(0))))
    by = rows.groupBy("label", "dim").agg(F.count("*"), F.avg(F.col("found") / F.col("true")), F.sum("true"), F.sum("found"))
    return {(r[0], r[1]): tuple(r)[2:] for r in by.collect()}


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """vectors: vec_id, embedding, label. Returns vec_id, n_links, component_id, kept. report gets the audit's counts of links: all, and found."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"), vectors["label"].cast("int").alias("label"))
    rows = cut(rows.mapInArrow(prepare, "vec_id long, label int, dim int, v binary"))
    nodes = cut(rows.where("v IS NOT NULL").groupBy("label", "dim", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")))
    sizes = {(r["label"], r["dim"]): r["n"] for r in nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).collect()}
    near, full = vectors.sparkSession.createDataFrame([], EDGES), vectors.sparkSession.createDataFrame([], "node long")
    if sizes:
        truth = audited(nodes, sizes, threshold)
        rounds = ROUNDS + doublings(max(sizes.values()))
        graph, pending = None, sorted(sizes)
        for seed in range(FORESTS):
            start = forest_edges(of_labels(nodes, pending), seed).withColumn("fresh", F.lit(True))
            if graph is not None:
                start = start.unionByName(graph.select("a", "b", "s").withColumn("fresh", F.lit(False)))
            graph = refine(start, nodes, threshold, rounds)
            near = graph.where(F.col("s") >= threshold)
            full = cut(graph.where("full").select(F.col("a").alias("node")).distinct())
            got = recall(truth, full, all_links(near, full.where("false"), None, nodes))
            whole = {key for key in sizes if key not in got or got[key][0] < EVIDENCE}
            pending = [key for key in sorted(sizes) if key not in whole and got[key][1] < TARGET]
            if report:
                report(sum(x[2] for x in got.values()), sum(x[3] for x in got.values()))
            if not pending:
                break
    asked = cut(nodes.select("node"))  # an exact check of every label follows, so that results are the same on both sides of SMALL
    exact = cut(exact_links(asked, nodes, threshold))
    found = near.select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots_ = components(found.unionByName(exact.where("root IS NOT NULL").select(F.col("node").alias("u"), F.col("root").alias("v"))))
    links = cut(all_links(near, asked, exact, nodes))
    if report and not sizes:  # all is compared whole
        n = links.agg(F.sum("links")).first()[0] or 0
        report(n, n)
    answer = nodes.join(roots_, "node", "left").join(links, "node", "left").select("label", "dim", "v", F.coalesce("root", "node").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"))
    out = rows.where("v IS NOT NULL").join(answer, ["label", "dim", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
