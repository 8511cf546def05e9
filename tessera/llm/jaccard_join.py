"""Size-aware heavy-light Jaccard join of documents on word shingles.

Documents with the same set of shingles collapse to one class first.  Classes
below a size boundary are light: each enumerates its subsets of the fixed
sizes that a link needs, and classes that share a subset meet.  The others are
heavy: they scan inverted lists, of which a link needs only those of their
first n - c + 1 tokens in one global order, c being the overlap that the pair
needs.  The order puts frequent tokens last, as told by a fixed-size count
sketch of all shingles; any order gives the same result.  The boundary is
where the estimated cost is least: the subsets that light sets would write
against the lists that heavy sets of that size join, priced by the lengths
that these lists have among the texts.

Meeting classes are not compared all with all.  In every list the members are
first compared with one hub, links make components, and only then pairs of
different components remain, which are all compared, so no link between
components is lost.  Bounds on size, position and the known prefixes dismiss
most pairs exactly before whole sets, read again from the texts, are compared.
The links of every class are counted at last within its component, in blocks
of sets that a task holds at once, so that no pair of a dense group is written.

Words are runs of characters other than space and U+0009 to U+000D after
lower-casing A-Z; shingles are told by 64-bit hashes, classes by 128 bits.

Defined cases: null, empty and wordless texts have the empty set and link with
nothing; a text of fewer words than a shingle is one shingle; exact copies are
always linked; rows that share a doc_id are separate; rows with a null doc_id
link others but never name a component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, lists_of, tune
from tessera.llm.components import connected_components

SKETCH = 1 << 23
#: Sizes that may be light at all, and the small sets of a task that tell the
#: lengths of lists (an estimate; it never changes results).
MOST_LIGHT, PRICED_SETS = 32, 50_000
#: Sets and shingles of a component that one block holds at most.
BLOCK_SETS, BLOCK_SHINGLES = 250, 1_000_000
_BLOOM = 1 << 24
_P = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """Shingle length in words and the similarity num / den."""

    words: int = 5
    num: int = 80
    den: int = 100

    def overlap(self, n, m):
        """Least intersection of linked sets of sizes n and m."""
        return -((-self.num * (n + m)) // (self.den + self.num))

    def least(self, n):
        """Smallest size that can link with n."""
        return -((-self.num * n) // self.den)

    def subset_sizes(self, n: int) -> list[int]:
        most = self.den * n // self.num
        return sorted({self.overlap(n, m) for m in range(self.least(n), most + 1)})

    def subsets(self, n: int) -> int:
        return sum(comb(n, c) for c in self.subset_sizes(n))

    def prefix(self, n):
        """Lists that a set of size n takes part in."""
        return n - self.least(n) + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word of lower-cased bytes."""
    b = np.frombuffer(data, "u1")
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(np.concatenate([[0], inside.view("i1"), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, "u8")
    # Each byte is weighted by its place in its word, so equal words agree.
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b)))) if start[0] == 0 else np.concatenate([np.zeros(start[0], np.int64), np.arange(start[0], len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))])
    value = _mix(b.astype("u8") + np.uint64(1) + (place.astype("u8") << np.uint64(8)))
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum(value, dtype="u8")])
    return _mix(total[end] - total[start] + (end - start).astype("u8") * _P)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one whole text."""
    h = _word_hashes((text or "").encode().lower())
    if not len(h):
        return h
    k = min(words, len(h))
    s = np.zeros(len(h) - k + 1, "u8")
    for i in range(k):
        s = _mix(s * _P + h[i : len(h) - k + 1 + i] + np.uint64(i + 1))
    return np.unique(s)


def _long(x: np.ndarray) -> np.ndarray:
    return x.view("i8")


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set: two independent sums of mixed hashes."""
    with np.errstate(over="ignore"):
        a, b = _mix(s).sum(dtype="u8"), _mix(s ^ _P).sum(dtype="u8") ^ np.uint64(len(s))
    return int(a.view("i8")), int(b.view("i8"))


def _list_costs(small: list[np.ndarray], cells: np.ndarray, total: int, rule: Rule) -> np.ndarray:
    """By set size, the postings that the small sets of a task would write if
    they were heavy, and the entries of other sets in their lists."""
    out = np.zeros((2, MOST_LIGHT + 1))
    for s in small:
        others = cells[(s % np.uint64(SKETCH)).astype("i8")] - 1 - total / SKETCH
        rarest = np.sort(np.maximum(others, 0))[: rule.prefix(len(s))]
        out[:, len(s)] += len(rarest), rarest.sum()
    return out


def _kinds(cell: np.ndarray, n: np.ndarray, mean: float) -> np.ndarray:
    """Class of each sketch cell; only cells that stand out are computed with,
    so that the driver holds one byte for each of the others."""
    out = np.zeros(SKETCH, "u1")
    out[cell] = np.clip(2 * np.log2(1 + n.astype("f4") / np.float32(mean + 8)), 0, 120)
    return out


def _sketch(docs: DataFrame, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each sketch cell (0 = not frequent), the histogram of small
    set sizes and the cost of their lists; all of fixed size.

    A task counts the shingles of its documents by cell and passes on the
    cells that stand out from its own mean; their sums rank the cells.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, sizes = np.zeros(SKETCH, "i4"), np.zeros(MOST_LIGHT + 1, "i8")
        small: list[np.ndarray] = []
        for b in batches:
            sets = [shingles(t, rule.words) for t in b.column(0).to_pylist()]
            if sets:
                at, n = np.unique((np.concatenate(sets) % np.uint64(SKETCH)).astype("i8"), return_counts=True)
                cells[at] += n.astype("i4")
                sizes += np.bincount(np.minimum([len(s) for s in sets], MOST_LIGHT), minlength=MOST_LIGHT + 1)
                small += [s for s in sets if 0 < len(s) < MOST_LIGHT][: PRICED_SETS - len(small)]
        total = int(cells.sum(dtype="i8"))
        mean = total / SKETCH
        out = np.flatnonzero(cells >= mean + 2 * np.sqrt(mean) + 1)
        costs = _list_costs(small, cells, total, rule) * max(1.0, sizes[1:MOST_LIGHT].sum() / max(1, len(small)))
        # Negative cells hold the total, the tasks, the sizes and the costs.
        cell = np.concatenate([out, [-1, -2], -3 - np.arange(3 * (MOST_LIGHT + 1))])
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.concatenate([cells[out], [total, 1], sizes, *costs]).astype("i8"))], ["cell", "n"])

    sums = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = sums.column("cell").to_numpy(), sums.column("n").to_numpy()
    small = dict(zip(cell[cell < 0].tolist(), n[cell < 0].tolist(), strict=True))
    kinds = _kinds(cell[cell >= 0], n[cell >= 0], small.get(-1, 0) / SKETCH)
    sizes, postings, entries = np.array([small.get(-3 - k, 0) for k in range(3 * (MOST_LIGHT + 1))], "f8").reshape(3, -1)
    # Lists are as much longer over all tasks as they are in one.
    return kinds, sizes, postings + small.get(-2, 0) * entries


def _boundary(rule: Rule, sizes: np.ndarray, costs: np.ndarray) -> int:
    """Sets smaller than this are light: least sum of the subset keys of the
    light sizes and the lists of the heavy ones.  Heavy lists also hold the
    light sets that may link with heavy ones."""

    def cost(b: int) -> float:
        heavy = sum(costs[n] for n in range(rule.least(b), MOST_LIGHT))
        return heavy + sum(sizes[n] * rule.subsets(n) for n in range(1, b))

    return 1 + int(np.argmin([cost(b) for b in range(1, MOST_LIGHT + 1)]))


def _light_keys(s: np.ndarray, rule: Rule) -> np.ndarray:
    """Hashes of the subsets of each size that a link may need."""
    m = _mix(s)
    out = []
    for c in rule.subset_sizes(len(s)):
        if c == len(s):
            sums = m.sum(keepdims=True, dtype="u8")
        else:  # leave out len(s) - c elements
            gone = np.array(list(combinations(range(len(s)), len(s) - c)))
            sums = m.sum(dtype="u8") - m[gone].sum(1, dtype="u8")
        out.append(_mix(sums + np.array([c], "u8") * _P))
    return np.unique(np.concatenate(out))


def _profiles(docs: DataFrame, rule: Rule, classes, boundary: int) -> DataFrame:
    """doc_id, n, signature, keys (light) and prefix tokens (heavy) per row."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = np.frombuffer(classes.value, "u1")
        for b in batches:
            rows: list[tuple] = []
            for t in b.column(1).to_pylist():
                s = shingles(t, rule.words)
                n = len(s)
                light = _light_keys(s, rule) if 0 < n < boundary else s[:0]
                heavy = s[:0]
                if n and n >= rule.least(boundary):
                    order = np.lexsort((s, cell[(s % np.uint64(SKETCH)).astype("i8")]))
                    heavy = s[order[: rule.prefix(n)]]
                rows.append((n, *_signature(s), _long(light), _long(heavy)))
            if rows:
                n, a, c, light, heavy = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(light, pa.list_(pa.int64())), pa.array(heavy, pa.list_(pa.int64()))], ["doc_id", "row", "n", "sig1", "sig2", "light", "heavy"])

    kind = docs.schema["row"].dataType.simpleString()
    return docs.select("doc_id", "text", "row").mapInArrow(profile, f"doc_id long, row {kind}, n long, sig1 long, sig2 long, light array<long>, heavy array<long>")


def _pair_bound(rule: Rule, n: str, m: str) -> str:
    """SQL of the least overlap of sizes n and m."""
    return f"(({rule.num} * ({n} + {m}) + {rule.den + rule.num - 1}) div {rule.den + rule.num})"


def _fits(rule: Rule, a: str, b: str) -> str:
    """SQL: sizes can link, and the list's token is early enough in both."""
    need = _pair_bound(rule, f"{a}.n", f"{b}.n")
    sizes = f"{rule.den} * least({a}.n, {b}.n) >= {rule.num} * greatest({a}.n, {b}.n)"
    return f"({sizes}) AND ({a}.pos < 0 OR ({a}.pos <= {a}.n - {need} AND {b}.pos <= {b}.n - {need}))"


def _survivors(pairs: DataFrame, classes: DataFrame, rule: Rule, cells) -> DataFrame:
    """Pairs (a, b) that their known prefixes do not dismiss.

    Both prefixes are known completely up to the earlier of their ends; if one
    set has more tokens there that the other lacks than a link of these sizes
    allows, the pair is none.  Pairs with a light class pass.
    """
    side = lambda k: classes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("heavy").alias(f"p{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb")

    def dismiss(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = np.frombuffer(cells.value, "u1")
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(_possible(batch, cell, rule)))

    return both.mapInArrow(dismiss, "a long, b long, na long, nb long")


def _possible(batch: pa.RecordBatch, cell: np.ndarray, rule: Rule) -> np.ndarray:
    """Whether the prefixes pa and pb of each row allow a link."""
    rows = batch.num_rows
    na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
    need = rule.overlap(na, nb)
    sides = []
    for name in ("pa", "pb"):
        lists = batch.column(name)
        sides.append((np.repeat(np.arange(rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().view("u8")))
    pair = np.concatenate([p for p, _ in sides])
    if not len(pair):
        return np.ones(rows, bool)
    token, left = np.concatenate([t for _, t in sides]), np.arange(len(pair)) < len(sides[0][0])
    kind = cell[(token % np.uint64(SKETCH)).astype("i8")]
    order = np.lexsort((token, kind, pair))
    pair, token, left = pair[order], token[order], left[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (token[1:] != token[:-1])
    rank = np.cumsum(new)  # equal tokens of a pair have one rank
    last = np.full((2, rows), -1)
    np.maximum.at(last[0], pair[left], rank[left])
    np.maximum.at(last[1], pair[~left], rank[~left])
    known = rank <= last.min(0)[pair]
    twice = np.bincount(pair[known & ~new], minlength=rows)
    lack_a = np.bincount(pair[known & left], minlength=rows) - twice
    lack_b = np.bincount(pair[known & ~left], minlength=rows) - twice
    return ((lack_a <= na - need) & (lack_b <= nb - need)) | (last.min(0) < 0)


def _verified(spark: SparkSession, scratch: Scratch, docs: DataFrame, classes: DataFrame, pairs: DataFrame, rule: Rule, name: str) -> tuple[DataFrame, DataFrame]:
    """The pairs whose whole sets are similar enough, and the sets."""
    pairs = scratch.save(pairs, f"{name}-pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = scratch.save(classes.join(nodes, "node").select("node", "doc_id", "sig1", "sig2"), f"{name}-wanted")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(_BLOOM))
    bits = np.zeros(_BLOOM // 64, "i8")
    words = wanted.select(place.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS int)))").alias("v"))
    held = words.toArrow()  # at most _BLOOM / 64 rows, and one job
    bits[held.column("w").to_numpy()] = held.column("v").to_numpy()
    bloom = spark.sparkContext.broadcast(bits.tobytes())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(bloom.value, "u1"), bitorder="little")
        for b in batches:
            hit = np.flatnonzero(known[b.column(0).to_numpy()])
            if len(hit):
                sets = [shingles(t, rule.words) for t in b.column(2).take(pa.array(hit)).to_pylist()]
                a, c = zip(*map(_signature, sets), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(hit)), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array([_long(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "sig1", "sig2", "members"])

    texts = docs.select(place.alias("p"), "doc_id", "text").mapInArrow(read, "doc_id long, sig1 long, sig2 long, members array<long>")
    # One row per class: its document of smallest id stands for it.
    sets = texts.join(wanted, (texts.doc_id.eqNullSafe(wanted.doc_id)) & (texts.sig1 == wanted.sig1) & (texts.sig2 == wanted.sig2)).select("node", "members")
    sets = scratch.save(sets.dropDuplicates(["node"]), f"{name}-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = both.where(common * (rule.den + rule.num) >= rule.num * (F.col("na") + F.col("nb"))).select("a", "b")
    links = scratch.save(links, f"{name}-links")
    scratch.drop(f"{name}-wanted")
    return links, sets


def _linked(n: np.ndarray, members: list[np.ndarray], rule: Rule) -> np.ndarray:
    """Matrix of links among sets.  Shingles that the same sets hold count at
    once: near copies differ in a few kinds of shingles only."""
    row = np.repeat(np.arange(len(n)), [len(m) for m in members])
    order = np.argsort(token := np.concatenate(members), kind="stable")
    row, token = row[order], token[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.append(first, len(token)))
    # Two hashes of the rows of a shingle tell its kind.
    marks = [np.add.reduceat(_mix(row.astype("u8") + np.uint64(c)), first) for c in (1, 1 << 40)]
    kinds, at, weight = np.unique(np.stack([*marks, size.astype("u8")], 1)[size > 1], axis=0, return_index=True, return_counts=True)
    first, size = first[size > 1][at], size[size > 1][at]
    common = np.zeros((len(n), len(n)))
    for a in range(0, len(kinds), 2048):
        part = slice(a, a + 2048)
        held = np.zeros((len(n), len(first[part])))
        for k, (f, z) in enumerate(zip(first[part], size[part], strict=True)):
            held[row[f : f + z], k] = 1
        common += (held * weight[part]) @ held.T
    out = common * (rule.den + rule.num) >= rule.num * (n[:, None] + n[None])
    np.fill_diagonal(out, False)
    return out


def _link_counts(scratch: Scratch, classes: DataFrame, labels: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(node, n): documents of other classes that each class links with, for
    all classes in a component of several."""
    rows = sets.join(labels, "node").join(classes.select("node", "times"), "node")
    sizes = rows.groupBy("label").agg(F.count("*").alias("sets"), F.sum(F.size("members")).alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    parts = max(1, -(-labels.count() // BLOCK_SETS))
    rows = rows.join(sizes.select("label", blocks.alias("blocks")), "label")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    low, high, one = F.least("block", "other"), F.greatest("block", "other"), F.col("blocks") == 1
    # Small components share a task, large ones take one per pair of blocks.
    group = F.when(one, F.pmod(F.xxhash64("label"), F.lit(parts))).otherwise(F.col("label"))
    pair = F.when(one, F.lit(-1).cast("long")).otherwise(low.cast("long") * (1 << 31) + high)
    rows = rows.select(group.alias("group"), pair.alias("pair"), "label", (low != high).alias("crossed"), "block", "node", "times", "members")

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        label, node, times, block = (table.column(c).to_numpy() for c in ("label", "node", "times", "block"))
        crossed, members = table.column("crossed").to_numpy(), lists_of(table.column("members"))
        out = np.zeros(len(node), "i8")
        order = np.argsort(label, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            held = [members[i] for i in own]
            links = _linked(np.array([len(m) for m in held]), held, rule)
            if crossed[own[0]]:
                links &= block[own][:, None] != block[own][None]
            out[own] = links @ times[own]
        return pa.table({"node": node, "n": out})

    counted = rows.groupBy("group", "pair").applyInArrow(count, "node long, n long")
    return scratch.save(counted.groupBy("node").agg(F.sum("n").alias("n")), "counted")


def jaccard_components(spark: SparkSession, docs: DataFrame, rule: Rule = Rule(), *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, group_id and n_links (the
    other documents that link with it, copies included) of every row; group_id
    tells components apart even without doc_ids and is null for empty sets.
    ``row`` repeats ``row_col`` of the input, of any type."""
    tune(spark)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.col(row_col) if row_col else F.lit(None).cast("long")).alias("row"))
    cells, sizes, costs = _sketch(docs, rule)
    boundary = _boundary(rule, sizes, costs)
    order = spark.sparkContext.broadcast(cells.tobytes())
    rows = scratch.save(_profiles(docs, rule, order, boundary), "rows")

    named = rows.where("n > 0").groupBy("sig1", "sig2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("times"), F.first("n").alias("n"), F.first("light").alias("light"), F.first("heavy").alias("heavy"))
    classes = scratch.save(named.withColumn("node", F.monotonically_increasing_id()), "classes")

    heavy = classes.select("node", "n", F.posexplode("heavy").alias("pos", "token"))
    light = classes.select("node", "n", F.lit(-1).alias("pos"), F.explode("light").alias("token"))
    lists = heavy.select("token", "pos", "n", "node").unionByName(light.select("token", "pos", "n", "node"))
    # A light key and a heavy token that happen to be equal make one list
    # more to compare, no wrong result.
    hubs = lists.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("pos", "n", "node")).alias("hub")).where("size > 1").select("token", "hub")
    shared = scratch.save(hubs, "hubs")
    posts = scratch.save(lists.join(shared, "token"), "posts")

    star = posts.alias("posts").where(f"node <> hub.node AND {_fits(rule, 'posts', 'hub')}")
    star = star.groupBy(F.col("node").alias("a"), F.col("hub.node").alias("b")).agg(F.count("*").alias("times"))
    best = star.groupBy("a").agg(F.max(F.struct("times", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    tried = _survivors(best, classes, rule, order)
    links, star_sets = _verified(spark, scratch, docs, classes, tried, rule, "star")
    labels = connected_components(scratch, links, "star-cc")

    # What is left: pairs of different components in one list.
    marked = posts.join(labels, "node", "left").select("token", "pos", "n", "node", F.coalesce("label", "node").alias("label"))
    marked = scratch.save(marked, "marked")
    mixed = marked.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    mixed = scratch.save(mixed, "mixed")
    open_lists = scratch.save(marked.join(mixed, "token"), "open")
    x, y = open_lists.alias("x"), open_lists.alias("y")
    rest = x.join(y, F.expr(f"x.token = y.token AND x.label < y.label AND {_fits(rule, 'x', 'y')}")).select(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b")).distinct()
    more, rest_sets = _verified(spark, scratch, docs, classes, _survivors(rest, classes, rule, order), rule, "rest")
    scratch.drop("posts", "marked", "open", "hubs", "mixed")
    labels = connected_components(scratch, links.unionByName(more), "all-cc")
    # Every class of a component was compared, so its set is at hand.
    sets = star_sets.unionByName(rest_sets.join(star_sets.select("node"), "node", "left_anti"))
    counted = _link_counts(scratch, classes, labels, sets, rule)

    linked = (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links")
    joined = classes.drop("n").join(labels, "node", "left").join(counted, "node", "left").select("sig1", "sig2", "node", "doc_id", F.coalesce("label", "node").alias("label"), linked)
    joined = scratch.save(joined, "joined")
    least = joined.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    whole = scratch.save(joined.join(least, "label").select("sig1", "sig2", "node", "label", "component_id", "n_links"), "named")
    scratch.drop("star-sets", "rest-sets", "star-pairs", "rest-pairs", "joined")
    out = rows.select("doc_id", "row", "n", "sig1", "sig2").join(whole, ["sig1", "sig2"], "left")
    empty = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(~empty, F.col("node")).alias("class_id"), F.when(~empty, F.col("label")).alias("group_id"), "row", F.coalesce("n_links", F.lit(0)).alias("n_links"))
