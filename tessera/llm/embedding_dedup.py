"""Near-duplicate embeddings by a robust-pruned flat graph.

Equal vectors collapse to one class.  Cluster centres of a bounded sample
(``SAMPLE``) deal every class to the shards of its ``OVERLAP`` most similar
centres.  A shard above ``SHARD_MOST`` is dealt on to centres of a bounded
sample of its own (``SUB_SAMPLE`` rows; each row to its ``SUB_OVERLAP`` most
similar ones), level by level, so that shards stay small and the work in
proportion at any size; a shard that does not split any more, a dense group of
vectors alike, is dealt on to pairs of its blocks, so that a task's memory is
bounded and every pair of it still meets.  Each shard builds its part of the
graph: candidate neighbours pruned by the robust rule (a candidate goes when a
kept neighbour is ``ALPHA`` times closer to it than the node is), and edges
back to nodes that few others keep, up to ``DEGREE`` more from each node: in a
dense group all keep the same middle ones, and two others would never meet.
Adjacency lists of the shards are united per class.  Every class then searches its
shards from their medoid with a greedy beam, and from all it finds within the
range (plus a slack) the search expands along the edges until nothing new lies
in range.  Found pairs are verified in double precision; a pair that meets in
several shards counts in the first only.

No pair leaves its task: a shard emits each member's number of links and the
root of its local component.  As every found link is verified, the links found
of a class are a part of its true ones, and recall is a ratio of numbers: it
is audited for ``AUDITED`` classes, compared with all others in blocks, and
below ``RECALL_LEAST`` the build is repeated with twice the overlap.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of several lengths link among their own
length only; rows that share a vec_id count as separate vectors and all get
the same component; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, lists_of
from tessera.llm.components import connected_components

THRESHOLD = 0.95
SAMPLE, SHARD_SIZE, SHARD_MOST, OVERLAP = 20_000, 1_000, 3_000, 3
SUB_SAMPLE, FANOUT, SUB_OVERLAP, LEVELS = 2_000, 64, 2, 8
AUDITED, RECALL_LEAST, TRIES = 256, 0.95, 3
ALPHA, DEGREE, POOL, BEAM, STEPS, SLACK = 1.2, 24, 64, 8, 24, 0.03
BACK = (1, 2, 4, 8)
_QUERIES_AT_ONCE = 256


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square leaves the range."""
    top = np.abs(x).max(-1, keepdims=True, initial=0)
    x = x / np.where(top > 0, top, 1)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def centres(x: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(np.bincount(at, minlength=len(c))[:, None] > 0, unit(sums), c)
    return c


def robust_pruned(x: np.ndarray) -> np.ndarray:
    """Neighbours of each row (-1: none), all rows at once."""
    m = len(x)
    pool = min(POOL, m - 1)
    if pool < 1:
        return np.full((m, 1), -1)
    near = np.empty((m, pool), np.int64)
    for a in range(0, m, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        top = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
        near[a : a + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1)
    out = np.full((m, min(DEGREE, pool)), -1)
    for a in range(0, m, 256):
        cand = near[a : a + 256]
        v = x[cand]  # rows, pool, size
        to_node = 2 - 2 * np.einsum("rps,rs->rp", v, x[a : a + 256])
        among = 2 - 2 * np.einsum("rps,rqs->rpq", v, v)
        alive = np.ones(cand.shape, bool)
        rows = np.arange(len(cand))
        for d in range(out.shape[1]):
            first = alive.argmax(1)
            has = alive[rows, first]
            out[a : a + 256, d] = np.where(has, cand[rows, first], -1)
            alive &= ~((ALPHA * among[rows, first] <= to_node) & has[:, None])
            alive[rows, first] = False
            if not alive.any():
                break
    return out


def reachable(graph: np.ndarray) -> np.ndarray:
    """The graph with edges back from the neighbours of nodes that few others
    keep: one for each first, then up to the last of ``BACK``."""
    m = len(graph)
    kept = np.bincount(graph[graph >= 0], minlength=m)
    back, used = np.full((m, DEGREE), -1), np.zeros(m, np.int64)
    for least in BACK:
        for d in range(graph.shape[1]):
            node = np.flatnonzero((kept < least) & (graph[:, d] >= 0))
            at = graph[node, d]
            order = np.argsort(at, kind="stable")
            at, node = at[order], node[order]
            place = used[at] + np.arange(len(at)) - np.searchsorted(at, at)
            fits = place < DEGREE
            back[at[fits], place[fits]] = node[fits]
            used += np.bincount(at[fits], minlength=m)
            kept[node[fits]] += 1
    return np.concatenate([graph, back[:, : used.max(initial=0)]], 1)


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, found) pairs of rows at least ``threshold`` similar, by greedy
    beam search from the medoid and expansion along edges within the range."""
    medoid = int((x @ unit(x.mean(0))).argmax())
    graph = np.where(graph < 0, medoid, graph)
    q = len(queries)
    seen = np.zeros((q, len(x)), bool)
    rows = np.arange(q)
    beam = np.full((q, BEAM), -1)
    value = np.full((q, BEAM), -3.0)
    done = np.ones((q, BEAM), bool)
    beam[:, 0], value[:, 0], done[:, 0] = medoid, x[queries] @ x[medoid], False
    seen[:, medoid] = True
    for _ in range(STEPS):
        best = np.where(done, -9.0, value).argmax(1)
        live = ~done[rows, best]
        if not live.any():
            break
        done[rows, best] = True
        near = graph[np.maximum(beam[rows, best], 0)]
        fresh = ~seen[rows[:, None], near] & live[:, None]
        seen[rows[:, None], near] |= live[:, None]
        sims = np.where(fresh, np.einsum("qs,qds->qd", x[queries], x[near]), -3.0)
        all_v = np.concatenate([value, sims], 1)
        keep = np.argsort(-all_v, axis=1)[:, :BEAM]
        beam = np.take_along_axis(np.concatenate([beam, near], 1), keep, 1)
        done = np.take_along_axis(np.concatenate([done, ~fresh], 1), keep, 1)
        value = np.take_along_axis(all_v, keep, 1)
    # Expansion: from the query's own node and all of the beam in range.
    seen[:] = False
    at_q, at_x = np.concatenate([rows, np.repeat(rows, BEAM)[(value >= threshold - SLACK).ravel()]]), np.concatenate([queries, beam[value >= threshold - SLACK]])
    found_q, found_x = [], []
    while len(at_q):
        flat = np.unique(at_q * len(x) + at_x)
        at_q, at_x = flat // len(x), flat % len(x)
        fresh = ~seen[at_q, at_x]
        at_q, at_x = at_q[fresh], at_x[fresh]
        seen[at_q, at_x] = True
        sims = np.einsum("ps,ps->p", x[queries[at_q]], x[at_x])
        hit = (sims >= threshold) & (queries[at_q] != at_x)
        found_q.append(at_q[hit])
        found_x.append(at_x[hit])
        go = sims >= threshold - SLACK
        at_q, at_x = np.repeat(at_q[go], graph.shape[1]), graph[at_x[go]].ravel()
    return queries[np.concatenate(found_q)], np.concatenate(found_x)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _vectors(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(flat.values.to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype("f8"))


def _top(x: np.ndarray, c: np.ndarray, overlap: int) -> np.ndarray:
    """The most similar centres of each row."""
    overlap = min(overlap, len(c))
    return np.argpartition(-(x @ c.T), overlap - 1, axis=1)[:, :overlap].astype("i8")


def _dealt(classes: DataFrame, c: np.ndarray, overlap: int) -> DataFrame:
    """A row (shard, node, embedding, times) per class and shard."""
    centre = classes.sparkSession.sparkContext.broadcast(c)

    def deal(batches):
        for b in batches:
            if b.num_rows:
                top = _top(_vectors(b.column("embedding")), centre.value, overlap)
                at = pa.array(np.repeat(np.arange(len(top)), top.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(top.ravel()), *(b.column(n).take(at) for n in ("node", "embedding", "times"))], ["shard", "node", "embedding", "times"])

    return classes.mapInArrow(deal, _shard_schema(classes))


def _shard_schema(classes: DataFrame) -> str:
    return f"shard long, node long, embedding {classes.schema['embedding'].dataType.simpleString()}, times long"


def _split(scratch: Scratch, placed: DataFrame, name: str) -> DataFrame:
    """Deal shards above ``SHARD_MOST`` on to centres of their own until none
    is left or none splits."""
    sizes = placed.groupBy("shard").agg(F.count("*").alias("size"))
    final, open_, parents = [], placed, sizes.where(F.col("size") > SHARD_MOST)
    for level in range(LEVELS):
        parents = scratch.save(parents.select("shard", "size", F.monotonically_increasing_id().alias("slot")), f"{name}-large{level}")
        if not parents.limit(1).count():
            return _union([*final, open_])
        final.append(open_.join(parents.select("shard"), "shard", "left_anti"))
        large = open_.join(parents, "shard")
        # A bounded sample of each shard, of about SUB_SAMPLE rows.
        share = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) / float(1 << 30) * F.col("size")
        picked = large.where(share < SUB_SAMPLE).select("shard", "size", "embedding")

        def fit(key, rows):
            k = int(np.clip(SUB_OVERLAP * rows.column("size")[0].as_py() // SHARD_SIZE, 2, FANOUT))
            c = centres(_vectors(rows.column("embedding")), k)
            return pa.table({"shard": pa.array([key[0].as_py()]), "k": pa.array([len(c)]), "centres": pa.array([c.ravel()], pa.list_(pa.float64()))})

        fitted = scratch.save(picked.groupBy("shard").applyInArrow(fit, "shard long, k long, centres array<double>"), f"{name}-centres{level}")

        def deal(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                x, shard, slot = _vectors(b.column("embedding")), b.column("shard").to_numpy(), b.column("slot").to_numpy()
                known = b.column("centres")
                starts = known.offsets.to_numpy()
                out_at, out_shard = [], []
                for s in np.unique(shard):
                    own = np.flatnonzero(shard == s)
                    c = known.values.to_numpy()[starts[own[0]] : starts[own[0] + 1]].reshape(-1, x.shape[1])
                    top = _top(x[own], c, SUB_OVERLAP)
                    out_at.append(np.repeat(own, top.shape[1]))
                    out_shard.append(slot[own[0]] * FANOUT + top.ravel() + ((level + 1) << 56))
                at = pa.array(np.concatenate(out_at))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_shard)), *(b.column(n).take(at) for n in ("node", "embedding", "times", "size"))], ["shard", "node", "embedding", "times", "parent"])

        # The centres of a shard travel with its rows only within a task's batch.
        children = large.join(fitted.select("shard", "centres"), "shard").mapInArrow(deal, f"{_shard_schema(placed)}, parent long")
        children = scratch.save(children, f"{name}-level{level}")
        counted = children.groupBy("shard").agg(F.count("*").alias("size"), F.first("parent").alias("parent"))
        # What hardly splits is dense: pairs of its blocks do the rest.
        parents = counted.where(f"size > {SHARD_MOST} AND size < 0.9 * parent").select("shard", "size")
        open_ = children.drop("parent")
    return _union([*final, open_])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _placed(rows: DataFrame) -> DataFrame:
    """Deal shards above ``SHARD_MOST`` on to pairs of blocks: (part, own
    block, node ...); a part is a shard or a pair of its blocks.  ``shards``
    are all shards of the class."""
    sizes = rows.groupBy("shard").agg(F.count("*").alias("size"))
    every = rows.groupBy("node").agg(F.sort_array(F.collect_set("shard")).alias("shards"))
    half = SHARD_MOST // 2
    blocks = F.when(F.col("size") <= SHARD_MOST, 1).otherwise(F.ceil(F.col("size") / half)).cast("int")
    rows = rows.join(sizes.select("shard", blocks.alias("blocks")), "shard").join(every, "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return rows.select("shard", (low.cast("long") * (1 << 31) + high).alias("pair"), (low != high).alias("crossed"), "block", "node", "embedding", "times", "shards")


def near_duplicates(spark: SparkSession, vectors: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", shard_size: int = SHARD_SIZE, audit: dict[str, float] | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.  ``audit``, if
    given, takes the audited recall (the least over lengths of vectors)."""
    scratch = Scratch(spark, "embeddings")
    # Single and double precision stay as they are; other numbers become double.
    kind = "float" if vectors.select(vector_col).schema[0].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("embedding"))
    good = F.expr(f"embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < CAST('Infinity' AS {kind})) AND exists(embedding, x -> x <> 0)")
    rows = scratch.save(rows.withColumn("good", F.coalesce(good, F.lit(False))), "rows")
    grouped = rows.where("good").groupBy("embedding").agg(F.count("*").alias("times"), F.min("vec_id").alias("first"))
    classes = scratch.save(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    sizes = [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]  # lengths in use
    parts = []
    for size in sizes:
        own = classes.where(F.size("embedding") == size).select("node", "embedding", "times")
        found, reached = _audited(spark, scratch, own, threshold, shard_size, size)
        parts.append(found)
        if audit is not None:
            audit["recall"] = min(audit.get("recall", 1.0), reached)
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = scratch.save(found, "found")
        links = found.groupBy("node").agg(F.sum("n").alias("n"))
        labels = connected_components(scratch, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        named = classes.join(links, "node", "left").join(labels, "node", "left").select("embedding", "first", "times", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("label", "node").alias("label"))
        named = scratch.save(named, "linked")
        least = named.groupBy("label").agg(F.min("first").alias("component_id"))
        named = named.join(least, "label").select("embedding", "component_id", (F.col("n") + F.col("times") - 1).alias("n_links"))
        out = rows.withColumn("key", F.when(F.col("good"), F.col("embedding"))).join(named.withColumnRenamed("embedding", "key"), "key", "left")
    else:
        out = rows.withColumns({"component_id": F.lit(None).cast("long"), "n_links": F.lit(0)})
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _audited(spark: SparkSession, scratch: Scratch, classes: DataFrame, threshold: float, shard_size: int, size: int) -> tuple[DataFrame, float]:
    """Links of the classes, and their audited recall."""
    sample = classes.orderBy(F.xxhash64("node", F.lit("audit")), "node").limit(AUDITED)
    truth = {r["node"]: r["truth"] for r in _true_links(spark, classes, sample.toArrow(), threshold).collect()}  # AUDITED rows
    overlap, reached = OVERLAP, 1.0
    for k in range(TRIES):
        found = scratch.save(_links_of(spark, scratch, classes, threshold, shard_size, overlap, f"{size}-{k}"), f"found{size}-{k}")
        got = found.where(F.col("node").isin(list(truth))).groupBy("node").agg(F.sum("n").alias("n")).agg(F.sum("n")).first()[0] or 0
        reached = got / sum(truth.values()) if sum(truth.values()) else 1.0
        if reached >= RECALL_LEAST:
            break
        overlap *= 2
    return found, reached


def _true_links(spark: SparkSession, rows: DataFrame, sample: pa.Table, threshold: float) -> DataFrame:
    """(node, truth): vectors of other classes within the threshold of each
    sampled one, by comparing it with all rows."""
    known = spark.sparkContext.broadcast((_vectors(sample.column("embedding")) if sample.num_rows else np.zeros((0, 1)), sample.column("node").to_numpy()))

    def count(batches):
        q, node = known.value
        total = np.zeros(len(q), "i8")
        for b in batches:
            if b.num_rows and len(q):
                hit = q @ _vectors(b.column("embedding")).T >= threshold
                hit &= node[:, None] != b.column("node").fill_null(-1).to_numpy()[None]
                total += hit @ b.column("times").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total)], ["node", "truth"])

    return rows.select("node", "embedding", "times").mapInArrow(count, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))


def _links_of(spark: SparkSession, scratch: Scratch, classes: DataFrame, threshold: float, shard_size: int, overlap: int, name: str) -> DataFrame:
    """(node, n, root) rows: links of each class by shard part, weighted by
    how many vectors the linked classes hold."""
    total = classes.count()
    order = F.xxhash64("node")
    sample = classes.select("embedding", "node").orderBy(order, "node").limit(SAMPLE).toArrow()
    k = int(np.clip(overlap * total // shard_size, 1, SAMPLE // 10))
    dealt = scratch.save(_dealt(classes, centres(_vectors(sample.column("embedding")), k), overlap), f"dealt{name}")
    placed = scratch.save(_placed(_split(scratch, dealt, f"split{name}")), f"placed{name}")

    def build(key, rows):
        x = _vectors(rows.column("embedding"))
        graph = reachable(robust_pruned(x))
        node = rows.column("node").to_numpy()
        lists = [node[g[g >= 0]] for g in graph]
        return pa.table({"node": pa.array(node), "near": pa.array(lists, pa.list_(pa.int64()))})

    edges = placed.groupBy("shard", "pair").applyInArrow(build, "node long, near array<long>")
    united = scratch.save(edges.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), f"graph{name}")

    def search(key, rows):
        x = _vectors(rows.column("embedding"))
        node, times = rows.column("node").to_numpy(), rows.column("times").to_numpy()
        graph = _local(node, rows.column("near"))
        block, shard = rows.column("block").to_numpy(), rows.column("shard").to_numpy()
        crossed = bool(rows.column("crossed")[0].as_py())
        shards = _padded(rows.column("shards"))
        pairs = [range_search(x, graph, np.arange(a, min(a + _QUERIES_AT_ONCE, len(x))), threshold) for a in range(0, len(x), _QUERIES_AT_ONCE)]
        a, b = (np.concatenate(v) for v in zip(*pairs, strict=True))
        both = np.unique(np.concatenate([a * len(x) + b, b * len(x) + a]))
        a, b = both // len(x), both % len(x)
        # Count a pair in the first shard that holds both ends, and there in
        # the one part that pairs their blocks.
        mine = (_first_common(shards, a, b) == shard[a]) & ((block[a] != block[b]) == crossed)
        n = np.bincount(a[mine], times[b[mine]], len(x)).astype("i8")
        root = node[_roots(len(x), a, b)]
        return pa.table({"node": node, "n": n, "root": root})

    return placed.join(united, "node").groupBy("shard", "pair").applyInArrow(search, "node long, n long, root long")


_NONE = np.iinfo(np.int64).max


def _padded(column) -> np.ndarray:
    """Lists as rows of one length, filled up with a number that is no shard."""
    lists = lists_of(column)
    out = np.full((len(lists), max(map(len, lists))), _NONE)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _first_common(shards: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), np.int64)
    for k in range(0, len(a), 1 << 18):
        left, right = shards[a[k : k + (1 << 18)]], shards[b[k : k + (1 << 18)]]
        out[k : k + (1 << 18)] = np.where((left[:, :, None] == right[:, None, :]).any(2), left, _NONE).min(1)
    return out


def _local(node: np.ndarray, near) -> np.ndarray:
    """United adjacency as row numbers of this part; others are left out."""
    order = np.argsort(node)
    lists = near.combine_chunks()
    ids = lists.values.to_numpy()
    lengths = np.diff(lists.offsets.to_numpy())
    at = np.minimum(np.searchsorted(node[order], ids), len(node) - 1)
    here = node[order][at] == ids
    owner = np.repeat(np.arange(len(node)), lengths)[here]
    rows = order[at[here]]
    count = np.bincount(owner, minlength=len(node))
    graph = np.full((len(node), max(1, int(count.max()) if len(count) else 1)), -1)
    place = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    graph[owner, place] = rows
    return graph


def recall(spark: SparkSession, vectors: DataFrame, result: DataFrame, *, every: int = 20, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", at_once: int = 500) -> float:
    """Links found of those that brute force gives for all vectors whose id is
    divisible by ``every``, compared with all rows, ``at_once`` at a time.
    Found links are verified, so their numbers tell the recall."""
    rows = vectors.select(F.col(id_col).cast("long").alias("node"), F.col(vector_col).cast("array<double>").alias("embedding"), F.lit(1).cast("long").alias("times"))
    rows = rows.where("size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < CAST('Infinity' AS double)) AND exists(embedding, x -> x <> 0)")
    found = true = 0
    for size in [r[0] for r in rows.select(F.size("embedding")).distinct().collect()]:
        own = rows.where(F.size("embedding") == size)
        asked = own.where(f"node % {every} = 0")
        blocks = max(1, -(-asked.count() // at_once))
        for k in range(blocks):
            sample = asked.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == k).toArrow()
            truth = _true_links(spark, own, sample, threshold)
            r = truth.join(result, truth.node == result.vec_id).agg(F.sum("truth").alias("t"), F.sum(F.least("truth", "n_links")).alias("f")).first()
            found, true = found + (r["f"] or 0), true + (r["t"] or 0)
    return found / true if true else 1.0
