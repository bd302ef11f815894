"""MinHash near-duplicates by a chosen-path set similarity join.

A text's set is its distinct 5-word shingles (white-space words, A-Z lowered; the whole word
sequence when shorter). Texts with equal sets are one class; classes are joined:

1. Every class has T minwise values. Each of R independent trees starts with all classes and
   branches a node by the minwise token at coordinates that a hash of the node chooses, 1/J of
   them on average (J: the similarity asked for), so that a pair at J stays together on one
   expected path. A node of at most NODE classes is a leaf and is compared exhaustively on byte
   sketches; larger ones branch again, DEPTH times at most. Leaves give a forest of loose links, pairs whose estimate
   reaches J - 0.15, about five deviations below J.
2. The components of those links are families. All pairs of a family are confirmed exactly, on full sets by inverted
   lists.
3. The components of the confirmed links are the result.

A node that branching cannot split, or a family of over FAMILY members or LEAF_SHINGLES shingles, is met() whole in bounded
tasks: about PIVOTS of its members, chosen by a hash, are compared with all others, dealt out in parts. Members that are
connected to the pivots' main group need no comparison among themselves; the rest is compared with all members, block against
block. So no pair that could add a link is left out, and a group of a third of all rows costs PIVOTS comparisons a row.

Recall: a pair at J stays together in one tree with chance 0.87 after one level, 0.64 after four and 0.38 after twelve (a critical branching
process), so all ten trees miss it with chance 1e-9, 4e-5 and 8e-3. Only members of nodes over NODE classes go deeper
than a level, and a pair is lost only where no other chain of links joins it.

Rows: null, empty and blank texts have the empty set and link with nothing. Repeated rows of a
doc_id are kept, one result each; two texts under one id are judged apart. A row without an id gets its group's least id or
null, and only equal sets join it. Columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .common import components, cut, forget, release, slices

K, T, R = 5, 128, 10
NODE, FAMILY, DEPTH, PIVOTS = 1024, 2048, 12, 32
#: Shingles that the sets of one leaf may have together (8 bytes each).
LEAF_SHINGLES = 4_000_000
_A = np.random.default_rng(7).integers(1, 2**63, T // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FEATURES = "id long, n long, k1 long, k2 long, sig array<int>"


def minwise(u: np.ndarray) -> np.ndarray:
    """T minwise values (unsigned 32 bits) of a set of mixed 64-bit hashes."""
    low = np.full(T, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(u), 4096):
            low = np.minimum(low, (u[i : i + 4096, None] * _A).view(np.uint32).min(0))
    return low


def shingle_sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    h, b = text.words(col)
    for i in range(len(b) - 1):
        yield text.distinct(text.shingles(h[b[i] : b[i + 1]], k))


def _keys(u: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell a set, as signed integers; zeros for the empty set."""
    if not len(u):
        return 0, 0
    return int(np.add.reduce(u).view(np.int64)), int(np.bitwise_xor.reduce(text.mix(u + np.uint64(1))).view(np.int64))


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, k1, k2, sig = [], [], [], []
                for u in shingle_sets(part.column("text"), k):
                    n.append(len(u))
                    a, b = _keys(u)
                    k1.append(a)
                    k2.append(b)
                    sig.append(minwise(u))
                sigs = pa.ListArray.from_arrays(np.arange(0, T * len(n) + 1, T, np.int32), np.concatenate(sig).view(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), sigs], names=["id", "n", "k1", "k2", "sig"])

    return run


def _chosen(rows: DataFrame, jaccard: float) -> DataFrame:
    """Branch rows (node, depth, id, sig): a row (node, depth, id) for each coordinate that the node's hash chooses."""
    f = f"pmod(xxhash64(node, depth), {T})"
    second = f"if(pmod(xxhash64(depth, node, 1), 1000) < {round(1000 / jaccard - 1000)}, array(pmod({f} + 1 + pmod(xxhash64(node, 2), {T} - 1), {T})), array())"
    nodes = f"transform(concat(array({f}), {second}), at -> xxhash64(node, at, sig[cast(at as int)]))"
    return rows.select(F.explode(F.expr(nodes)).alias("node"), (F.col("depth") + 1).alias("depth"), "id")


def leaves(roots: DataFrame, sigs: DataFrame, jaccard: float, most: int, depth: int = DEPTH) -> tuple[DataFrame, list[DataFrame]]:
    """Last nodes (root, id, many) of the trees whose roots the rows (root, id, sig) name, and the tables to forget.

    Trees are grown level by level; minwise values are fetched from sigs (id, sig) again for the
    rows of nodes that are too large, and never kept with the rows. Nodes of one row go; of nodes with equal rows that depth
    levels could not split one stays. Counts are written, so that their join with the rows can be split.
    """
    level = cut(_chosen(roots.select(F.col("root").alias("node"), F.lit(0).alias("depth"), "id", "sig"), jaccard))
    done: list[DataFrame] = []
    used = [level]
    for at in range(depth + 1):
        counts = cut(level.groupBy("node").agg(F.count("*").alias("many"), F.min("id").alias("least"), F.expr("bit_xor(xxhash64(id))").alias("sign")).where("many > 1"))
        used.append(counts)
        large = counts.where(f"many > {most}")
        ends = counts.where(f"many <= {most}").select("node", "many")
        last = at == depth or not large.take(1)
        if last:
            ends = ends.unionByName(large.groupBy("many", "least", "sign").agg(F.min("node").alias("node")).select("node", "many"))
        done.append(level.join(ends, "node").select(F.col("node").alias("root"), "id", "many"))
        if last:
            break
        level = cut(_chosen(level.join(large.select("node"), "node").select("node", "depth", "id").join(sigs, "id"), jaccard).dropDuplicates(["node", "id"]))
        used.append(level)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, used


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, x: int, y: int) -> bool:
        x, y = sorted((self.find(x), self.find(y)))
        self.up[y] = x
        return x != y


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal key in batches sorted by it, also where a run spans batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Sketches:
    """Members of a leaf by byte sketches: pairs whose sketches agree in a share of least at least."""

    def __init__(self, t: pa.Table, least: float) -> None:
        self.sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(t.num_rows, T)
        self.n, self.least = t["n"].to_numpy(), least

    def near(self, i: int, low: int) -> np.ndarray:
        agree = (self.sketch[low:] == self.sketch[i]).sum(1) >= self.least * T
        n = self.n[low:]
        return np.flatnonzero(agree & (np.minimum(self.n[i], n) >= (self.least + 0.1) * np.maximum(self.n[i], n))) + low


class Sets:
    """Members of a leaf by full sets: pairs with 100 * intersection >= percent * union, by inverted lists."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.n, self.percent = np.array([len(x) for x in sets]), percent
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)]  # of each token's posts
        del flat
        self.at = np.append(np.flatnonzero(first), len(first))
        self.tokens = np.empty(len(first), np.int32)
        self.tokens[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
        self.posts = np.repeat(np.arange(len(sets), dtype=np.int32), self.n)[order]
        self.ends = np.cumsum(self.n)

    def near(self, i: int, low: int) -> np.ndarray:
        own = self.tokens[self.ends[i] - self.n[i] : self.ends[i]]
        common = np.zeros(len(self.n), np.int64)
        for x in range(0, len(own), 256):  # a bounded share of the lists at a time
            common += np.bincount(np.concatenate([self.posts[self.at[t] : self.at[t + 1]] for t in own[x : x + 256]]), minlength=len(self.n))
        found = np.flatnonzero(100 * common >= self.percent * (self.n + self.n[i] - common))
        return found[found >= low]


def linked(members: Sketches | Sets, forest: Forest, rows: range, low: int = 0) -> Iterator[tuple[int, int]]:
    """A forest of the links of rows with the members from max(low, row + 1) on."""
    left = len(members.n) - 1
    for i in rows:
        for j in members.near(i, max(low, i + 1)):
            if forest.join(i, int(j)):
                left -= 1
                yield i, int(j)
        if not left:
            return


def unpacked(col: pa.ChunkedArray) -> list[np.ndarray]:
    """The sets of a column of their bytes, as views of its buffers."""
    out = []
    for c in col.chunks:
        at = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, 4 * c.offset) // 8
        values = np.frombuffer(c.buffers()[2] or b"", np.uint64, int(at[-1]))
        out += [values[x:y] for x, y in zip(at[:-1], at[1:])]
    return out


#: Sides of a leaf's rows: all pairs among these; pivots; their others; the rest; all that it is compared with.
ALL, PIVOT, OTHER, REST, EVERY = range(5)


def _met(make):
    """Links (a, b) of the rows (node, side, id, root, payload) of each leaf; (a, null): a is of the rest of its root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "node"):
            ids, side = t["id"].to_numpy(), t["side"].to_numpy()
            members, own, forest, n = make(t), None, Forest(len(ids)), len(ids)
            first = int(np.searchsorted(side, [PIVOT + 1, REST + 1][int(side[0] >= REST)]))  # pivots, or the rest
            far: list[int] = []
            if side[0] == ALL:
                found = list(linked(members, forest, range(n - 1)))
            elif side[0] >= REST:
                found = list(linked(members, forest, range(first), first))
            else:
                own = make(t.slice(0, first)) if first else None
                found = list(linked(own, forest, range(first - 1))) if first > 1 else []
                main = np.bincount([forest.find(i) for i in range(first)]).argmax() if first else -1
                if first < n:
                    found += linked(members, forest, range(first), first)
                top = forest.find(int(main)) if first else -1
                far = [i for i in range(first, n) if forest.find(i) != top]
            a = np.array([i for i, _ in found] + far, np.int64)
            b = pa.array([int(ids[j]) for _, j in found] + [None] * len(far), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), b, t["root"].combine_chunks().take(pa.array(a))], names=["a", "b", "root"])
            members = own = None
        release()

    return run


def met(members: DataFrame, attach, make) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect what the links among all members of each root connect; and a table to forget.

    members: root, id, many (of the root), parts (over 1: the root is too large for one leaf). attach: adds the payload
    that make, given a leaf, compares. See the module's docstring.
    """
    pivot = F.expr(f"pmod(xxhash64(id, 11), greatest(1L, many div {PIVOTS})) = 0")
    own = F.expr("pmod(xxhash64(id, root), parts)")
    every = F.expr("sequence(0L, parts - 1)")

    def dealt(rows: DataFrame) -> DataFrame:
        return attach(rows).repartition("node").sortWithinPartitions("node", "side", "id").mapInArrow(_met(make), "a long, b long, root long")

    small = members.where("parts = 1").select("root", "id", F.col("root").alias("node"), F.lit(ALL).alias("side"))
    large = members.where("parts > 1").withColumn("side", F.when(pivot, PIVOT).otherwise(OTHER)).withColumn("part", F.explode(F.when(pivot, every).otherwise(F.array(own))))
    first = cut(dealt(small.unionByName(large.select("root", "id", F.xxhash64("root", "part").alias("node"), "side"))))
    links, rest = first.where("b is not null").select("a", "b"), first.where("b is null").select("root", F.col("a").alias("id"))
    if not rest.take(1):
        return links, first
    sizes = cut(rest.groupBy("root").agg(F.count("*").alias("far")))
    roots = members.join(sizes, "root").select("root", "id", "parts", F.expr("cast(ceil(parts * far / many) as long)").alias("blocks"))
    blocks = F.expr("sequence(0L, blocks - 1)")
    from_rest = roots.join(rest, ["root", "id"]).select("root", "id", F.lit(REST).alias("side"), F.expr("pmod(xxhash64(id, root), blocks)").alias("block"), F.explode(every).alias("part"))
    to_all = roots.select("root", "id", F.lit(EVERY).alias("side"), own.alias("part"), F.explode(blocks).alias("block"))
    more = dealt(from_rest.unionByName(to_all).select("root", "id", F.xxhash64("root", "block", "part").alias("node"), "side"))
    return links.unionByName(more.where("b is not null").select("a", "b")), first


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys = zip(part.column("k1").to_numpy().tolist(), part.column("k2").to_numpy().tolist())
                sets, same = [], []
                for u, key in zip(shingle_sets(part.column("text"), k), keys):
                    same.append(_keys(u) == key)  # another text may have the same id
                    sets.append(u.tobytes())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], names=["id", "shingles"]).filter(pa.array(same))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = 85, trees: int = R, node: int = NODE, family: int = FAMILY, depth: int = DEPTH) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept (see the module's docstring)."""
    j = percent / 100
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    seen = cut(rows.mapInArrow(_features(k), _FEATURES))
    # a class is known by a hash of its keys; its texts have one signature
    classes = seen.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    reps = cut(classes.select(F.xxhash64("k1", "k2", "n").alias("id"), "rep", "copies", "n", "k1", "k2", "sig"))
    # 1. families
    alone = reps.where("rep is not null")
    roots = alone.select("id", "sig", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree")).select(F.xxhash64("tree").alias("root"), "id", "sig")
    sketch = alone.select("id", "n", F.expr("unhex(array_join(transform(sig, x -> lpad(hex(x & 255), 2, '0')), ''))").alias("sketch"))
    ends, used = leaves(roots, alone.select("id", "sig"), j, node, depth)
    ends = ends.withColumn("parts", F.expr(f"if(many <= {node}, 1L, ceil(many * 4 / {node}))"))
    loose, held = met(ends, lambda x: x.join(sketch, "id"), lambda t: Sketches(t, j - 0.15))
    families = components(loose)
    forget(*used, held)
    # 2. exact links
    members = cut(families.join(reps.select("id", "n", "rep", "k1", "k2"), families["node"] == reps["id"]).select(F.col("label").alias("root"), "id", "n", "rep", "k1", "k2"))
    forget(families)
    sizes = cut(members.groupBy("root").agg(F.count("*").alias("many"), F.sum("n").alias("total")))
    parts = F.expr(f"if(many <= {family} and total <= {LEAF_SHINGLES}, 1L, ceil(greatest(many * 4 / {family}, total * 2 / {LEAF_SHINGLES})))")
    # members grow with the texts, so they are never broadcast: the plan is the same at every size
    texts = rows.join(members.select(F.col("rep").alias("rid"), F.col("id").alias("class"), "k1", "k2").hint("merge"), F.col("id") == F.col("rid")).select(F.col("class").alias("id"), "k1", "k2", "text")
    sets = texts.mapInArrow(_sets(k), "id long, shingles binary").dropDuplicates(["id"])
    known = members.join(sizes, "root").select("root", "id", "many", parts.alias("parts"))
    links, held = met(known, lambda x: x.join(sets, "id"), lambda t: Sets(unpacked(t["shingles"]), percent))
    final = components(links)
    forget(members, sizes, held)
    # 3. back to the documents, through their classes; least ids are written, so that a large component's rows can be split
    of = reps.select("id", "rep", "copies", "k1", "k2", "n").join(final.select(F.col("node").alias("id"), "label"), "id", "left")
    least = cut(of.where("label is not null").groupBy("label").agg(F.min("rep").alias("least")))
    named = of.where("copies > 1 or label is not null").join(least, "label", "left")
    named = cut(named.select("k1", "k2", "n", F.coalesce("least", "rep").alias("least")))
    forget(reps, final, least)
    out = seen.select("id", "n", "k1", "k2").join(named, ["k1", "k2", "n"], "left")
    comp = F.coalesce("least", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), comp.eqNullSafe(F.col("id")).alias("kept"))
