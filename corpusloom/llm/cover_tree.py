"""Embedding near-dedup: all pairs at or above a cosine, by dual traversal of cover trees.

On unit vectors a cosine threshold is a distance threshold. The upper levels are Spark tables: each label's
vectors go to their nearest pivot and there to rings of halving radius, and pairs of these nodes are excluded,
or taken whole, by their covering radii. Pairs that the bounds leave open are split into blocks, and each pair
of blocks is one group, in which trees with halving radii are traversed together. Whole node pairs are counted,
not written out; links leave a task as a star around the smallest id of each local component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import connected_components, join_groups, materialize

THRESHOLD = 0.93
#: Bound of all labels' pivots together, which are broadcast; vectors of a node that one task takes.
MAX_PIVOTS, BLOCK = 2048, 2048
#: Rows of a block that are tried as centres at once.
CANDIDATES = 128
#: Bounds are held with this margin, so rounding never decides; open pairs are decided by the cosine itself.
MARGIN = 1e-6


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Level:
    """One level of a cover tree: each row's node, and the nodes' centres and covering radii."""

    def __init__(self, node_of: np.ndarray, centre: np.ndarray, radius: np.ndarray):
        self.node_of, self.centre, self.radius = node_of, centre, radius
        self.order = np.argsort(node_of, kind="stable")
        self.start = np.searchsorted(node_of[self.order], np.arange(len(centre) + 1))

    def members(self, node: int) -> np.ndarray:
        return self.order[self.start[node] : self.start[node + 1]]


def covered(x: np.ndarray, rows: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, float]]:
    """(members, covering radius) of nodes of rows: each takes what is left within the radius of the first row left, its first.

    The next CANDIDATES rows are held against what is left at once; what a node takes is held against no later one."""
    left = rows
    while len(left):
        apart2 = np.maximum(0.0, 2 - 2 * (x[left[:CANDIDATES]] @ x[left].T))
        free, near = np.ones(len(left), bool), apart2 <= radius * radius
        near[np.arange(len(near)), np.arange(len(near))] = True
        several = near.sum(axis=1) > 1
        for k, far in enumerate(apart2):
            if free[k] and not several[k]:
                free[k] = False
                yield left[k : k + 1], 0.0
            elif free[k]:
                own = free & near[k]
                free &= ~own
                members = np.flatnonzero(own)
                yield left[np.concatenate([[k], members[members != k]])], float(np.sqrt(far[own].max())) if len(members) > 1 else 0.0
        left = left[free]


def levels(x: np.ndarray, apart: float) -> list[Level]:
    """Nested covers: a node's members are within the level's radius of its centre, from 2 * apart halving to apart / 4."""
    radius, groups, alone, out = 2 * apart, [np.arange(len(x))], [], []
    while True:
        node_of, centre, reach, below = np.empty(len(x), np.int64), [], [], []
        for rows in groups:
            for members, far in covered(x, rows, radius):
                if len(members) == 1:  # a node of its own from here on
                    alone.append(members[0])
                else:
                    node_of[members] = len(centre)
                    centre.append(members[0])
                    reach.append(far)
                    below.append(members)
        node_of[alone] = len(centre) + np.arange(len(alone))
        out.append(Level(node_of, np.array(centre + alone, np.int64), np.array(reach + [0.0] * len(alone))))
        if radius <= apart / 4 or not below:
            return out
        groups, radius = below, radius / 2


def link_blocks(a: np.ndarray, b: np.ndarray | None, wa: np.ndarray, wb: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, local component of each row) over the rows of a, then b; b None: pairs within a."""
    apart = float(np.sqrt(2 - 2 * cosine))
    same = b is None
    x = a if same else np.vstack([a, b])
    weight, shift = (wa, 0) if same else (np.concatenate([wa, wb]), len(a))
    b = a if same else b
    deg, comp = np.zeros(len(x), np.int64), np.arange(len(x))
    ta = levels(a, apart)
    tb = ta if same else levels(b, apart)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    at = None
    for k in range(max(len(ta), len(tb))):
        la, lb = ta[min(k, len(ta) - 1)], tb[min(k, len(tb) - 1)]
        if at is None:
            dots = a[la.centre] @ b[lb.centre].T
            close = dots >= 1 - np.square((la.radius + apart + MARGIN)[:, None] + lb.radius[None, :]) / 2
            if same:
                close = np.triu(close)
                np.fill_diagonal(close, np.diff(la.start) > 1)
            at = np.array(np.nonzero(close))
            dist = np.sqrt(np.maximum(0, 2 - 2 * dots[at[0], at[1]]))
        else:
            dots = [np.einsum("ij,ij->i", a[la.centre[i]], b[lb.centre[j]]) for i, j in zip(np.array_split(at[0], at.shape[1] // 65536 + 1), np.array_split(at[1], at.shape[1] // 65536 + 1), strict=True)]
            dist = np.sqrt(np.maximum(0, 2 - 2 * np.concatenate(dots)))
        reach = la.radius[at[0]] + lb.radius[at[1]]
        whole = dist + reach <= apart - MARGIN
        for i, j in at[:, whole].T:
            ma, mb = la.members(i), lb.members(j) + shift
            if same and i == j:
                deg[ma] += weight[ma].sum() - weight[ma]
            else:
                deg[ma] += weight[mb].sum()
                deg[mb] += weight[ma].sum()
            both = np.concatenate([ma, mb])
            edges.append((both[1:], np.full(len(both) - 1, both[0])))
        at = at[:, ~whole & (dist - reach <= apart + MARGIN)]
        if k + 1 < max(len(ta), len(tb)):  # the children of what stays open
            na, nb = ta[min(k + 1, len(ta) - 1)], tb[min(k + 1, len(tb) - 1)]
            kids = []
            for i, j in at.T:
                p, q = np.unique(na.node_of[la.members(i)]), np.unique(nb.node_of[lb.members(j)])
                p, q = np.repeat(p, len(q)), np.tile(q, len(p))
                kids.append(np.stack([p, q])[:, p <= q] if same and i == j else np.stack([p, q]))
            at = np.concatenate(kids, axis=1) if kids else np.zeros((2, 0), np.int64)
        else:
            for i, j in at.T:
                ma, mb = la.members(i), lb.members(j)
                hit = a[ma] @ b[mb].T >= cosine
                p, q = np.nonzero(np.triu(hit, 1) if same and i == j else hit)
                p, q = ma[p], mb[q] + shift
                np.add.at(deg, p, weight[q])
                np.add.at(deg, q, weight[p])
                edges.append((p, q))
    if edges:
        p, q = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
        while True:
            before = comp.copy()
            low = np.minimum(comp[p], comp[q])
            np.minimum.at(comp, p, low)
            np.minimum.at(comp, q, low)
            comp = comp[comp]
            if (before == comp).all():
                break
    return deg, comp


def _verify(cosine: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["second", "rep"])
        a, b = group[~group["second"]], group[group["second"]]
        rep = group["rep"].to_numpy()
        deg, comp = link_blocks(unit_rows(a["embedding"]), unit_rows(b["embedding"]) if len(b) else None, a["copies"].to_numpy(), b["copies"].to_numpy(), cosine)
        # The smallest id of a component, not the first row's.
        low = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(low, comp, rep)
        has = deg > 0
        return pd.DataFrame({"rep": rep[has], "links": deg[has], "other": low[comp][has]})

    return run


def _nearest(pivots: dict):
    """Adds the nearest pivot of the vector's group, the distance to it, and the pivot itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, dist = np.full(len(pdf), -1, np.int64), np.zeros(len(pdf))
            for key, rows in pdf.groupby("grp").indices.items():
                if key in pivots:
                    ids, centres = pivots[key]
                    x = unit_rows(pdf["embedding"].iloc[rows])
                    d = np.sqrt(np.maximum(0, 2 - 2 * (x @ centres.T)))
                    best = d.argmin(axis=1)
                    # Again from the difference: a dot product near 1 loses digits.
                    cell[rows], dist[rows] = ids[best], np.sqrt(((x - centres[best]) ** 2).sum(axis=1))
            yield pdf.assign(cell=cell, dist=dist)

    return run


def _norm2(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def near_duplicates(vectors: DataFrame, cosine: float = THRESHOLD, block: int = BLOCK, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(vec_id long, embedding array, label) -> a row each: vec_id, n_links, component_id, kept.

    Vectors are compared when their labels and lengths are equal. Null, empty and zero vectors, vectors with null
    or non-finite components, and vectors without a label link with nothing; so does a null vec_id, whose
    component is null. Vectors whose squares add up to zero count as zero. Equal vectors are linked and compared once; rows that repeat a vec_id are a vector each.
    Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fit = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite, F.lit(False))
    v = v.withColumn("fit", fit).withColumn("fit", F.col("fit") & F.coalesce((_norm2(F.col("embedding")) > 0) & (_norm2(F.col("embedding")) < F.lit(float("inf"))), F.lit(False)))
    grp = F.concat_ws("/", F.size("embedding").cast("string"), F.col("label").cast("string"))
    good = v.filter("fit").select("vec_id", grp.alias("grp"), "embedding")
    reps = materialize(good.groupBy("grp", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct_vectors")

    per_group = reps.groupBy("grp").agg(F.count("*").alias("n"))
    total = max(1, reps.count())
    share = F.when(F.col("n") > block, F.floor(F.col("n") * F.lit(min(max_pivots, 1 + total // block)) / F.lit(total)) + 1).otherwise(1)
    sized = join_groups(reps, per_group.select("grp", "n", share.alias("p")), "grp")
    chosen = sized.filter((F.col("n") > block) & (F.pmod(F.xxhash64("rep"), F.col("n")) < F.col("p")))
    pivots: dict = {}
    # At most one pivot for block vectors, and max_pivots and one for each such group in all.
    for r in chosen.select("grp", "rep", "embedding").orderBy(F.xxhash64("rep")).limit(4 * max_pivots).collect():
        pivots.setdefault(r["grp"], []).append((r["rep"], r["embedding"]))
    pivots = {g: (np.array([i for i, _ in p]), unit_rows(pd.Series([e for _, e in p]))) for g, p in pivots.items()}

    apart, kind = float(np.sqrt(2 - 2 * cosine)), reps.schema["embedding"].dataType.simpleString()
    members = reps.mapInPandas(_nearest(pivots), f"grp string, embedding {kind}, rep long, copies long, cell long, dist double") if pivots else reps.withColumns({"cell": F.lit(-1).cast("long"), "dist": F.lit(0.0)})
    # Rings halve towards the pivot: the innermost, of radius apart / 2, is linked throughout.
    ring = F.when(F.col("cell") == -1, -1).when(F.col("dist") <= apart / 2 - MARGIN, 0).otherwise(F.ceil(F.log2(F.col("dist") / F.lit(apart / 2 - MARGIN))).cast("int"))
    members = materialize(members.withColumn("ring", ring), "tree_members")
    node = ["grp", "cell", "ring"]
    nodes = members.groupBy(*node).agg(
        F.count("*").alias("n"), F.sum("copies").alias("w"), F.min("rep").alias("low"), F.min("dist").alias("d_min"), F.max("dist").alias("d_max")
    )
    centres = spark.createDataFrame([(int(i), [float(x) for x in c]) for ids, cs in pivots.values() for i, c in zip(ids, cs, strict=True)], "cell long, centre array<double>")
    # No pivot: the ball around the origin holds all.
    nodes = nodes.join(F.broadcast(centres), "cell", "left").withColumn("d_max", F.when(F.col("cell") == -1, 1.0).otherwise(F.col("d_max")))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("salts", F.ceil(F.col("n") / F.lit(block)).cast("int")), "tree_nodes")

    a, b = nodes.select(*[F.col(c).alias(f"a_{c}") for c in nodes.columns]), nodes.select(*[F.col(c).alias(f"b_{c}") for c in nodes.columns])
    gap2 = F.aggregate(F.zip_with("a_centre", "b_centre", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x)
    gap = F.when(F.col("a_cell") == F.col("b_cell"), F.lit(0.0)).otherwise(F.coalesce(F.sqrt(gap2), F.lit(0.0)))
    pairs = a.join(b, (F.col("a_grp") == F.col("b_grp")) & (F.col("a_node") <= F.col("b_node"))).withColumn("gap", gap)
    least = F.greatest(F.col("gap") - F.col("a_d_max") - F.col("b_d_max"), F.col("a_d_min") - F.col("gap") - F.col("b_d_max"), F.col("b_d_min") - F.col("gap") - F.col("a_d_max"))
    tree = F.col("a_cell") != -1
    pairs = pairs.filter(~tree | (least <= apart + MARGIN)).withColumn("all_in", tree & (F.col("gap") + F.col("a_d_max") + F.col("b_d_max") <= apart - MARGIN))
    pairs = materialize(pairs.select("a_node", "b_node", "a_w", "b_w", "a_low", "b_low", "a_salts", "b_salts", "all_in"), "node_pairs")

    members = members.join(nodes.select(*node, "node", "salts", "low"), node).withColumn("salt", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("salts")).cast("int"))
    members = materialize(members.select("rep", "copies", "embedding", "node", "salt", "low"), "tree_blocks")
    open_pairs = pairs.filter("not all_in").select("a_node", "b_node", F.explode(F.sequence(F.lit(0), F.col("a_salts") - 1)).alias("a_salt"), "b_salts")
    open_pairs = open_pairs.select("a_node", "a_salt", "b_node", F.explode(F.sequence(F.lit(0), F.col("b_salts") - 1)).alias("b_salt"))
    open_pairs = materialize(open_pairs.filter("a_node < b_node or a_salt <= b_salt").withColumn("pair", F.monotonically_increasing_id()), "block_pairs")
    sides = open_pairs.select("pair", F.col("a_node").alias("node"), F.col("a_salt").alias("salt"), F.lit(False).alias("second"))
    sides = sides.unionByName(open_pairs.filter("a_node <> b_node or a_salt <> b_salt").select("pair", F.col("b_node").alias("node"), F.col("b_salt").alias("salt"), F.lit(True).alias("second")))
    work = members.drop("low").join(sides, ["node", "salt"]).select("pair", "second", "rep", "copies", "embedding")
    tested = materialize(work.groupBy("pair").applyInPandas(_verify(cosine), "rep long, links long, other long"), "tested_links")

    sure = pairs.filter("all_in")
    gains = sure.select(F.col("a_node").alias("node"), F.col("b_w").alias("gain")).unionByName(sure.filter("a_node <> b_node").select(F.col("b_node").alias("node"), F.col("a_w").alias("gain")))
    inner = sure.filter("a_node = b_node").select(F.col("a_node").alias("node"), F.lit(True).alias("inner"))
    gains = gains.groupBy("node").agg(F.sum("gain").alias("gain")).join(inner, "node", "left")
    whole = join_groups(members.select("rep", "copies", "node", "low"), gains, "node").select(
        "rep", (F.col("gain") - F.when(F.col("inner"), F.col("copies")).otherwise(0)).alias("links"), F.when(F.col("inner"), F.col("low")).otherwise(F.col("rep")).alias("other"), "low", "inner"
    )
    # A node that is whole with another but not in itself: its members meet in the other's smallest.
    partner = sure.filter("a_node <> b_node")
    across = members.select("rep", "node").join(partner.select(F.col("a_node").alias("node"), F.col("b_low").alias("other")), "node").select("rep", "other")
    back = members.select("rep", "node").join(partner.select(F.col("b_node").alias("node"), F.col("a_low").alias("other")), "node").select("rep", "other")
    edges = tested.select("rep", "other").unionByName(whole.select("rep", "other")).unionByName(across).unionByName(back)
    comps = connected_components(edges.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    degrees = tested.select("rep", "links").unionByName(whole.select("rep", "links")).groupBy("rep").agg(F.sum("links").alias("links"))
    decided = reps.join(degrees, "rep", "left").join(comps, F.col("rep") == F.col("id"), "left")
    decided = materialize(decided.select("grp", "embedding", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector_classes")
    linked = good.join(decided, ["grp", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = v.filter("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
