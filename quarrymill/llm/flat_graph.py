"""Operator 3: embedding near-duplicates by a robust-pruned flat graph and range-expanding greedy search.

The vectors of a label are cut into overlapping cluster shards of bounded size. Each shard builds a graph of pruned
neighbour lists; the lists of a vector from all its shards are united. Every vector is then searched for in the
shards it belongs to, from the shard's medoid: a greedy beam first, then, from all that lies in range, on through
whatever else lies in range. Neighbours from other shards are looked at too. Links are confirmed in double precision.

A search sees a bounded part of a group that is far larger than a shard, so it only tells which vectors belong
together. The links of a vector are counted by comparing it with its whole component in exact blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import drop, stage, table, width

DEGREE, BEAM, STRETCH = 20, 28, 1.44
#: Places of a list that hold random far links.
FAR = 3
#: Vectors in a shard, about; shards a vector belongs to; centres of one split.
SHARD, OVERLAP, CENTRES = 1000, 2, 64
#: Points of a block, and rounds of splitting.
ROWS, LEVELS = 4096, 6
#: Similarities within this of the threshold are worked out again in double precision.
MARGIN = 1e-4
BLOCK = 256
#: Points of a component that are compared with as many others in one task.
WHOLE = 8192


# --- one shard -------------------------------------------------------------------------------------------------


def medoid(x: np.ndarray) -> int:
    return int(np.argmax(x @ x.mean(0)))


def greedy(x: np.ndarray, lists: np.ndarray, queries: np.ndarray, start: int, beam: int, least: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Beam search of all ``queries`` at once: ids and similarities of each beam, best first, what was visited, and
    (query, node) arrays of all visited nodes of similarity ``least`` or more, also those that left the beam."""
    b = len(queries)
    beam = min(beam, len(x))
    ids, sims = np.full((b, beam), start), np.full((b, beam), -np.inf, np.float32)
    sims[:, 0] = queries @ x[start]
    done = np.ones((b, beam), bool)
    done[:, 0] = False
    seen = np.zeros((b, len(x) + 1), bool)  # the last column stands for no neighbour
    seen[:, start] = seen[:, -1] = True
    rows = np.arange(b)
    close = np.flatnonzero(sims[:, 0] >= least)
    hits = [(close, np.full(len(close), start))]
    while len(rows):
        at = np.argmax(np.where(done[rows], -np.inf, sims[rows]), axis=1)
        open_ = ~done[rows, at]
        rows, at = rows[open_], at[open_]
        if not len(rows):
            break
        done[rows, at] = True
        near = lists[ids[rows, at]]
        fresh = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        found = np.where(fresh, np.einsum("bnd,bd->bn", x[near], queries[rows]), -np.inf)
        q, at = np.nonzero(found >= least)
        hits.append((rows[q], near[q, at]))
        every, every_id = np.concatenate([sims[rows], found], 1), np.concatenate([ids[rows], near], 1)
        every_done = np.concatenate([done[rows], ~fresh], 1)
        top = np.argsort(-every, axis=1, kind="stable")[:, :beam]
        sims[rows], ids[rows] = np.take_along_axis(every, top, 1), np.take_along_axis(every_id, top, 1)
        done[rows] = np.take_along_axis(every_done, top, 1) | np.isneginf(sims[rows])
    return ids, sims, seen, hits


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of each row's candidates from its own vector."""
    off = x - y[:, None]
    return np.einsum("bcd,bcd->bc", off, off)


def robust_prune(x: np.ndarray, nodes: np.ndarray, ids: np.ndarray, degree: int, stretch: float) -> np.ndarray:
    """For each node the nearest candidates, leaving out those that are much nearer to one chosen before; room that is
    left goes to the nearest of those left out. Without them a dense group is a star: all prune to its middle, and
    from there only a few of them are in reach.

    -1 in ``ids`` is no candidate; distances are squared, so ``stretch`` is the square of the usual factor."""
    cand = x[ids]
    # from differences: the similarities of very close vectors are all alike in single precision
    away = np.where((ids < 0) | (ids == nodes[:, None]), np.inf, _apart(cand, x[nodes]))
    order = np.lexsort((ids, away), axis=1)
    ids, away = np.take_along_axis(ids, order, 1), np.take_along_axis(away, order, 1)
    cand = np.take_along_axis(cand, order[:, :, None], 1)
    alive = np.isfinite(away)
    alive[:, 1:] &= ids[:, 1:] != ids[:, :-1]
    out = np.full((len(nodes), degree), -1)
    rows = np.arange(len(nodes))
    left = alive.copy()
    for j in range(degree):
        first = np.argmax(alive, axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        pick = ids[rows, first]
        out[some, j] = pick[some]
        left[rows[some], first[some]] = False
        between = _apart(cand, x[pick])
        alive &= ((stretch * between > away) | (away == 0)) & some[:, None]
        alive[rows, first] = False
    rank = np.cumsum(left, axis=1) - 1 + (out >= 0).sum(1)[:, None]
    row, at = np.nonzero(left & (rank < degree))
    out[row, rank[row, at]] = ids[row, at]
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, stretch: float = STRETCH, seed: int = 3) -> np.ndarray:
    """Neighbour lists (-1: none) of unit vectors ``x``: the nearest ``degree + beam`` of each, found in blocks, are robustly
    pruned; the last FAR places of a list are random far links, so that a search gets from anywhere to anywhere."""
    n = len(x)
    if n == 1:
        return np.full((1, degree), -1)
    lists = np.empty((n, degree), np.int64)
    k = min(n, degree + beam)
    for lo in range(0, n, BLOCK):
        nodes = np.arange(lo, min(n, lo + BLOCK))
        away = -(x[nodes] @ x.T)
        near = np.argpartition(away, k - 1, axis=1)[:, :k]
        lists[nodes, : degree - FAR] = robust_prune(x, nodes, near, degree - FAR, stretch)
    lists[:, degree - FAR :] = np.random.default_rng(seed).integers(0, n, (n, FAR))
    return lists


def in_range(x: np.ndarray, lists: np.ndarray, queries: np.ndarray, start: int, least: float, beam: int = BEAM, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) of similarity ``least`` or more: greedy search, then everything in range is opened in turn.
    Queries that are nodes themselves, ``own``, are in their own range, whether the greedy search came there or not."""
    *_, seen, hits = greedy(x, lists, queries, start, beam, least)
    if own is not None:
        late = np.flatnonzero(~seen[np.arange(len(queries)), own])
        seen[late, own[late]] = True
        hits.append((late, own[late]))
    q, node = (np.concatenate(part) for part in zip(*hits, strict=True))
    out_q, out_n = [q], [node]
    while len(q):
        near = lists[node]
        q2, n2 = np.repeat(q, near.shape[1]), near.ravel()
        fresh = ~seen[q2, n2]
        key = np.unique(q2[fresh] * len(x) + n2[fresh])
        q2, n2 = key // len(x), key % len(x)
        seen[q2, n2] = True
        hit = np.einsum("bd,bd->b", x[n2], queries[q2]) >= least
        q, node = q2[hit], n2[hit]
        out_q.append(q)
        out_n.append(node)
    return np.concatenate(out_q), np.concatenate(out_n)


# --- all shards ------------------------------------------------------------------------------------------------


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def units(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, unit): usable rows only; unit is the bytes of doubles of length one. Rows that are null,
    zero, without label or id, or hold null or non-finite components are not usable."""

    def run(batches):
        for batch in batches:
            ids, labels, out = [], [], []
            for i, label, x in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding"), strict=True):
                if i is None or label is None or not x.is_valid or x.values.null_count or not len(x.values):
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                size = np.linalg.norm(v / np.abs(v).max()) * np.abs(v).max() if np.isfinite(v).all() and v.any() else 0
                if size and np.isfinite(size):
                    ids.append(i)
                    labels.append(label)
                    out.append((v / size + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array([len(b) // 8 for b in out], pa.int32()), pa.array(out, pa.binary())], ["vec_id", "label", "dim", "unit"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding").mapInArrow(run, "vec_id long, label string, dim int, unit binary")


def split(points: DataFrame, size: int, overlap: int) -> DataFrame:
    """(shard, vec_id, unit): clusters around sampled centres; clusters that are still too large are split again. A
    point goes to its ``overlap`` nearest centres in the first and in the last split of a cluster, and to the nearest
    in those between, so that the number of its copies doesn't grow with the levels.

    A cluster is dealt out in blocks of about ROWS points, and its centres, CENTRES at most, go along with each block,
    ahead of the points. What LEVELS splits leave too large, points closer together than centres can tell, is dealt
    out by hash, and the same CENTRES points go to each part: they hold the parts of a dense group together."""
    todo = points.select(F.concat_ws("/", F.hex(F.encode("label", "utf-8")), "dim").alias("shard"), "vec_id", "unit")
    done = None
    for level in range(LEVELS + 1):
        sizes = todo.groupBy("shard").agg(F.count("*").alias("n"))
        todo = todo.join(sizes, "shard")
        ready = todo.where(F.col("n") <= 2 * size).select("shard", "vec_id", "unit")
        done = ready if done is None else done.unionByName(ready)
        large = todo.where(F.col("n") > 2 * size)
        if large.isEmpty():
            break
        # about as many as give shards of the right size, picked by a hash
        want = F.least(F.lit(CENTRES), F.ceil(F.col("n") / size) + 1)
        order = F.xxhash64("vec_id", F.lit(level))
        drawn = large.where(F.pmod(order, F.lit(1 << 30)) < F.lit(2 << 30) * want / F.col("n"))
        centres = drawn.withColumn("_nth", F.row_number().over(Window.partitionBy("shard").orderBy(order))).where(F.col("_nth") <= want)
        if level == LEVELS:
            parts = F.ceil(F.col("n") / size).cast("int")
            own = large.select("shard", F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"), "vec_id", "unit")
            held = centres.select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "vec_id", "unit")
            both = own.unionByName(held).dropDuplicates(["shard", "part", "vec_id"])
            done = done.unionByName(both.select(F.concat_ws("#", "shard", "part").alias("shard"), "vec_id", "unit"))
            break
        blocks = F.ceil(F.col("n") / ROWS).cast("int")
        copies = F.lit(overlap) if level == 0 else F.when(F.col("n") <= CENTRES * size // 2, overlap).otherwise(1)
        ahead = centres.select("shard", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(0).alias("role"), "vec_id", "unit")
        members = large.select("shard", F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("block"), copies.cast("int").alias("role"), "vec_id", "unit")
        dealt = ahead.unionByName(members).repartition(width(points.sparkSession), "shard", "block").sortWithinPartitions("shard", "block", "role", "vec_id")
        todo = stage(dealt.mapInPandas(_nearest, "shard string, vec_id long, unit binary"), "clusters")
    return done


def _nearest(frames):
    """Rows of sorted blocks, centres first -> each point once for each of its nearest centres; ``role`` says how many."""
    at, centres = None, []
    for pdf in frames:
        for key, rows in pdf.groupby(["shard", "block"], sort=False):
            if key != at:
                at, centres = key, []
            first = rows["role"].to_numpy() == 0
            centres += list(rows["unit"][first])
            own = rows[~first]
            if not len(own):
                continue
            if not centres:  # no point of a small cluster was drawn
                yield own[["shard", "vec_id", "unit"]]
                continue
            near = _matrix(own["unit"]) @ _matrix(pd.Series(centres)).T
            top = np.argsort(-near, axis=1, kind="stable")[:, : int(own["role"].iat[0])]
            for j in range(top.shape[1]):
                yield pd.DataFrame({"shard": [f"{key[0]}/{c}" for c in top[:, j]], "vec_id": own["vec_id"].to_numpy(), "unit": own["unit"].to_numpy()})


def graph(shards: DataFrame) -> DataFrame:
    """(vec_id, near): the united neighbour lists of each vector."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["vec_id"].to_numpy()
        lists = build(_matrix(pdf["unit"]).astype(np.float32))
        return pd.DataFrame({"vec_id": ids, "near": [ids[row[row >= 0]] for row in lists]})

    lists = shards.groupBy("shard").applyInPandas(run, "vec_id long, near array<long>")
    return lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def merge(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``top``, the smallest known member of each node's component, after the links (a, b)."""
    while True:
        x, y = top[a], top[b]
        if (x == y).all():
            return top
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(top[top], top):
            top = top[top]


def search(shards: DataFrame, lists: DataFrame, points: DataFrame, least: float) -> DataFrame:
    """(a, b), b < a: what is linked, from all vectors in all their shards, confirmed in double precision. A shard gives
    one row for each member of its components and not one for each link."""
    members = shards.join(lists, "vec_id")
    beyond = members.select("shard", F.explode("near").alias("vec_id")).distinct().join(shards.select("shard", "vec_id"), ["shard", "vec_id"], "left_anti")
    empty = F.lit(None).cast("array<long>").alias("near")
    every = members.select("shard", "vec_id", "unit", "near").unionByName(beyond.join(points.select("vec_id", "unit"), "vec_id").select("shard", "vec_id", "unit", empty))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        ids, exact = pdf["vec_id"].to_numpy(), _matrix(pdf["unit"])
        x = exact.astype(np.float32)
        home = np.flatnonzero(pdf["near"].notna())
        most = max((len(pdf["near"].iat[i]) for i in home), default=0)
        table_ = np.full((len(ids), max(1, most)), len(ids))  # the last number stands for no neighbour
        for i in home:
            near = np.searchsorted(ids, pdf["near"].iat[i])
            table_[i, : len(near)] = near
        x = np.vstack([x, np.zeros((1, x.shape[1]), np.float32)])
        start = int(home[medoid(x[home])])
        top = np.arange(len(ids))
        for lo in range(0, len(home), BLOCK):
            some = home[lo : lo + BLOCK]
            q, node = _range_padded(x, table_, some, start, least - MARGIN)
            a, b = some[q], node
            keep = a != b
            a, b = a[keep], b[keep]
            for at in range(0, len(a), 1 << 16):
                p, r = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                ok = np.einsum("bd,bd->b", exact[p], exact[r]) >= least
                top = merge(top, p[ok], r[ok])
        tied = np.flatnonzero(top != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[tied], "b": ids[top[tied]]})

    return every.groupBy("shard").applyInPandas(run, "a long, b long").distinct()


def _range_padded(x: np.ndarray, lists: np.ndarray, own: np.ndarray, start: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    q, node = in_range(x, np.vstack([lists, np.full((1, lists.shape[1]), len(x) - 1)]), x[own], start, least, own=own)
    real = node < len(x) - 1
    return q[real], node[real]


def tile(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the weights ``of_y`` of its links in ``y`` together, and the reverse; rows are not their own
    links where ``same``."""
    fx, fy = x.astype(np.float32), y.astype(np.float32)
    to_x, to_y = np.zeros(len(x)), np.zeros(len(y))
    for lo in range(0, len(x), BLOCK):
        sims = fx[lo : lo + BLOCK] @ fy.T
        hit = sims >= least
        p, r = np.nonzero(np.abs(sims - least) <= MARGIN)
        for at in range(0, len(p), 1 << 16):
            a, b = p[at : at + (1 << 16)], r[at : at + (1 << 16)]
            hit[a, b] = np.einsum("bd,bd->b", x[lo + a], y[b]) >= least
        if same:
            rows = np.arange(len(sims))
            hit[rows, lo + rows] = False
        hit = hit.astype(np.float64)
        to_x[lo : lo + BLOCK] = hit @ of_y
        to_y += of_x[lo : lo + BLOCK] @ hit
    return to_x, to_y


def count_links(points: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """(vec_id, others): how many vectors each of ``points(vec_id, unit, times)`` links with in its component, each as
    often as it occurs. Components are dealt out in blocks of about WHOLE points; each block meets each, as one task
    that gives one row a point. Two that are a component are linked, and are not compared."""
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    members = points.select("vec_id", "unit", "times").join(parts.withColumnRenamed("id", "vec_id"), "vec_id").join(sizes, "component")
    two = members.where("n = 2").select("component", "vec_id", "times")
    sums = two.groupBy("component").agg(F.sum("times").alias("both"))
    couples = two.join(sums, "component").select("vec_id", (F.col("both") - F.col("times")).alias("others"))
    blocks = F.ceil(F.col("n") / WHOLE).cast("int")
    dealt = members.where("n > 2").select("component", "vec_id", "unit", "times", F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vec_id", "unit", "times")
    dealt = dealt.repartition(width(points.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        x, times, ids = _matrix(group["unit"]), group["times"].to_numpy(np.float64), group["vec_id"].to_numpy()
        if group["i"].iat[0] == group["j"].iat[0]:
            n = tile(x, x, times, times, least, True)[0]
        else:
            own = (group["own"] == group["i"]).to_numpy()
            n = np.empty(len(x))
            n[own], n[~own] = tile(x[own], x[~own], times[own], times[~own], least, False)
        return pd.DataFrame({"vec_id": ids, "others": n.astype(np.int64)})

    def run(frames):
        held: list[pd.DataFrame] = []  # parts of the group that may go on
        for pdf in frames:
            key = pdf[["component", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            if held and tuple(held[0][["component", "i", "j"]].iloc[0]) != tuple(key[0]):
                yield compare(pd.concat(held, ignore_index=True))
                held = []
            for a, b in zip(starts, starts[1:], strict=False):
                yield compare(pd.concat([*held, pdf.iloc[a:b]], ignore_index=True))
                held = []
            held.append(pdf.iloc[starts[-1] :])
        if held:
            yield compare(pd.concat(held, ignore_index=True))

    counted = dealt.mapInPandas(run, "vec_id long, others long").unionByName(couples)
    return counted.groupBy("vec_id").agg(F.sum("others").alias("others"))


def near_duplicates(vectors: DataFrame, least: float = 0.93, size: int = SHARD, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept.

    Vectors of one label (and dimension) link at cosine ``least`` or more. Equal directions are one point of the
    graph, and count as often as they occur. Rows that are not usable (see units), and all rows of labels that are
    null, have no links and are their own component; kept is true for them, also without vec_id. Repeated rows of one
    vec_id get one row each, all the same; if they differ, the usable one of smallest label and vector stands for all. An empty table gives no rows. Other columns are not looked at.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    one = units(vectors).groupBy("vec_id").agg(F.min(F.struct("label", "dim", "unit")).alias("_one"))
    usable = stage(one.select("vec_id", "_one.*"), "units")
    classes = stage(usable.groupBy("label", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("dim").alias("dim")), "classes")
    points = classes.select(F.col("rep").alias("vec_id"), "label", "dim", "unit")
    shards = stage(split(points, size, overlap), "shards")
    lists = stage(graph(shards), "lists")
    links = stage(search(shards, lists, points, least), "links")
    drop(lists, shards)
    parts = components(links)
    degree = stage(count_links(classes.withColumnRenamed("rep", "vec_id"), parts, least), "degrees")
    known = classes.join(degree.withColumnRenamed("vec_id", "rep"), "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("label", "unit", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    of_id = usable.join(known, ["label", "unit"]).select("vec_id", "n_links", "component_id")
    joined = vectors.select("vec_id").join(of_id, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def audit_recall(vectors: DataFrame, found: DataFrame, least: float = 0.93, every: int = 50) -> tuple[int, int]:
    """(links found, links there are) of the vectors whose id is divisible by ``every``, by comparing them with all
    rows of their label in blocks. The queries are broadcast: a fixed share, meant for tables of known size."""
    usable = units(vectors)
    asked = usable.where(F.col("vec_id") % every == 0).toPandas()
    ids, labels = asked["vec_id"].to_numpy(), asked["label"].to_numpy()
    x = _matrix(asked["unit"]) if len(asked) else None

    def run(frames):
        for pdf in frames:
            if x is None or not len(pdf):
                continue
            near = (x @ _matrix(pdf["unit"]).T >= least) & (labels[:, None] == pdf["label"].to_numpy()[None])
            near &= ids[:, None] != pdf["vec_id"].to_numpy()[None]
            yield pd.DataFrame({"vec_id": ids, "n": near.sum(1)})

    there = usable.mapInPandas(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    row = there.join(found.select("vec_id", "n_links").dropDuplicates(["vec_id"]), "vec_id").agg(F.sum("n_links"), F.sum("n")).first()
    return int(row[0] or 0), int(row[1] or 0)


def op3_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates at cosine 0.93 over all of ``embeddings``: vec_id, n_links, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
