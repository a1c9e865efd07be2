"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

How a run goes:

1. One pass over the texts makes a row of a few hundred bytes for each document: size and hash of its
   shingle set, band keys, and a one-bit sketch.  Documents with equal sets collapse to one node.
2. Band buckets with two or more nodes get a hub, the node that shares the most buckets.  Each node is
   compared with one hub only (a star, never all pairs); links are confirmed on the full shingle sets.
3. Buckets whose nodes are all in one component are settled.  In the others, nodes outside the bucket's largest
   component are held against those of other components: the bucket is cut by set size, then dealt to blocks of
   bounded size, so no task holds a whole bucket.  A first look compares sketches and leaves the nodes that have a
   partner which sketches can't rule out (five standard deviations below the threshold).  A second look compares the
   full sets of those, nearest sketches first, and gives one link for each two components that it joins.  What leaves
   a block is at most a row for each of its nodes, never a row for each pair, and no link is lost to the stars.
4. Components come from large-star/small-star rounds over DataFrames; nothing goes through the driver.

Edge cases: null and empty texts, and texts of spaces alone, have an empty set, are linked with nothing and are
their own component.  Texts of fewer than ``width`` words are one shingle.  Rows that repeat a doc_id are kept, each
with the component of its own set, even if the sets of one id are unlike.  A null doc_id never represents a group.
An empty table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm import text as tx
from sieveline.session import scratch, ship, spare, stash

BINS = 512
BANDS = 32
#: Bins of the one-bit sketches, and the longs that hold a bit for each.
FINE = 2048
SKETCH = FINE // 64
#: Nodes on each side of a block in which sketches are compared, and members that are compared with one copy of a hub.
BLOCK = 4096
#: Shingles on each side of a block in which sets are compared.
HELD = 2_000_000
_SETS = ["n_shingles", "set_a", "set_b"]
_SIGNS = "doc_id long, mark long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"


def band_rows(threshold: float, bands: int = BANDS, miss: float = 1e-6) -> int:
    """Most rows in a band with which a pair at the threshold is missed by all bands less often than ``miss``."""
    rows = 1
    while rows < BINS // bands and (1 - threshold ** (rows + 1)) ** bands <= miss:
        rows += 1
    return rows


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles, A-Z in lower case."""
    for lo, hi, raw, at in tx.blocks(column):
        raw = tx.LOWER[raw]
        starts, ends, first = tx.words(raw, at)
        hashes = tx.word_hashes(raw, starts, ends)
        rolled = tx.rolling(hashes, width)
        for d in range(hi - lo):
            a, b = first[d], first[d + 1]
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                yield tx.rolling(hashes[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)


def shared_values(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets have in common."""
    if len(x) < len(y):
        x, y = y, x
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int((x[at] == y).sum()) if len(x) else 0


class Signer:
    """One-permutation signature of a sorted set of hashes: the least value in each of 512 equal ranges."""

    def __init__(self, rows: int, bands: int = BANDS) -> None:
        rng = np.random.default_rng(11)
        self.bands, self.used = bands, rows * bands
        #: For optimal densification every bin has its own random order of all bins; an empty bin borrows from the first that isn't empty.
        self.order = np.argsort(rng.random((self.used, BINS)), axis=1).argsort(axis=1).astype(np.int16)
        self.weights = rng.integers(1 << 62, size=rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.tags = rng.integers(1 << 63, size=bands, dtype=np.uint64)

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins = (values >> np.uint64(64 - 11)).astype(np.int64)
        lead = np.flatnonzero(np.diff(bins, prepend=-1))
        seen, bits = np.zeros(FINE, bool), np.zeros(FINE, bool)
        seen[bins[lead]] = True
        bits[bins[lead]] = (tx.mix(values[lead]) & np.uint64(1)).astype(bool)
        sketch = np.concatenate([np.packbits(seen), np.packbits(bits)]).view(np.int64)
        bins //= FINE // BINS
        lead = np.flatnonzero(np.diff(bins, prepend=-1))
        full, least = np.zeros(BINS, bool), np.zeros(BINS, np.uint64)
        full[bins[lead]] = True
        least[bins[lead]] = values[lead]
        used = least[: self.used].copy()
        if len(empty := np.flatnonzero(~full[: self.used])):
            some = np.flatnonzero(full)
            used[empty] = least[some[self.order[empty[:, None], some].argmin(1)]]
        keys = tx.mix((used.reshape(self.bands, -1) * self.weights).sum(1, dtype=np.uint64) + self.tags)
        return keys.view(np.int64), sketch


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a mark that tells the texts of a repeated id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def signatures(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc_id, mark, n_shingles, set hash, band keys and sketch of each document."""
    rows = band_rows(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(rows)
        for batch in batches:
            sizes, sums, folds, keys, sketches = [], [], [], [], []
            for values in shingle_sets(batch.column(2), width):
                sizes.append(len(values))
                sums.append(values.sum(dtype=np.uint64))
                folds.append(np.bitwise_xor.reduce(tx.mix(values + np.uint64(1))) if len(values) else np.uint64(0))
                if len(values):
                    k, s = signer(values)
                    keys.append(k)
                    sketches.append(s)
            n = np.array(sizes, np.int64)
            flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(np.array(sums, np.uint64).view(np.int64)), pa.array(np.array(folds, np.uint64).view(np.int64)), tx.lists(flat(keys), (n > 0) * BANDS, pa.int64()), tx.lists(flat(sketches), (n > 0) * 2 * SKETCH, pa.int64())],
                names=[x.split()[0] for x in _SIGNS.split(", ")],
            )

    return _marked(docs).mapInArrow(sign, _SIGNS)


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those distinct (a, b) with 100 * intersection >= percent * union of their full shingle sets.

    The texts that are compared with one a meet it at a copy of its text, one copy for about ``BLOCK`` of them; so each
    text moves twice, and no a with very many pairs lands in one task.
    """
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("copies"))
    dealt = pairs.join(copies, "a").select("a", F.pmod(F.xxhash64("b"), F.col("copies")).alias("copy"), F.col("b").alias("node"), F.lit(1).alias("side"))
    heads = copies.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.col("a").alias("node"), F.lit(0).alias("side"))
    asked = dealt.union(heads).join(nodes.select("node", "rep.doc_id", "rep.mark"), "node")
    rows = _marked(docs).join(asked, ["doc_id", "mark"]).select("a", "copy", "side", "node", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A head's set stays until the next head; repeated rows of one document are compared once."""
        head, own, before = None, np.zeros(0, np.uint64), None
        for batch in batches:
            left, right = [], []
            ids = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for (a, copy, side, node), values in zip(ids, shingle_sets(batch.column(4), width), strict=True):
                if side == 0:
                    head, own = a, values
                elif (a, copy, node) != before:
                    assert head == a
                    both = shared_values(own, values)
                    if 100 * both >= percent * (len(own) + len(values) - both):
                        left.append(a)
                        right.append(node)
                before = (a, copy, node)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.repartition("a", "copy").sortWithinPartitions("a", "copy", "side", "node").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): large-star and small-star rounds until only stars are left.

    Each round only takes minima and joins them back, so a node with many neighbours is never gathered in one place.
    """
    stars = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", sweep=False)
    while True:
        roles = stars.select(F.col("u").alias("x"), F.lit(1).alias("below")).union(stars.select(F.col("v").alias("x"), F.lit(0).alias("below")))
        if roles.groupBy("x").agg(F.sum("below").alias("below"), F.count("*").alias("n")).where("below > 1 or below = 1 and n > 1").isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        stars = stash(small, "edges", sweep=False)


def unlike(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether sketches (pairs x longs) rule links out: their distance exceeds its mean at the threshold by five deviations.

    Also that distance, as a share of the bins that either sketch fills.
    """
    far = 1 - percent / 100
    count = lambda v: np.bitwise_count(v).sum(1, dtype=np.int64)
    xm, ym = x[:, :SKETCH], y[:, :SKETCH]
    seen = count(xm | ym)
    apart = count(xm ^ ym) + 2 * count((x[:, SKETCH:] ^ y[:, SKETCH:]) & xm & ym)
    spread = seen * far * (1 - far) * np.maximum(0.05, 1 - seen * (2 - far) / sizes) + seen * far * np.minimum(1.0, sizes / (2.0 * FINE))
    return apart > seen * far + 5 * np.sqrt(spread), apart / np.maximum(seen, 1)


def _unsettled(shared: DataFrame, label: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Rows of (key, cell, node, component, odd, own) and the node's set, of the buckets with several components.

    Sets of linked documents differ in size by less than the threshold's inverse, so in level by one at most: a cell of a
    bucket holds the nodes of one level (own) and those of the next.  odd: outside the bucket's largest component.
    """
    placed = shared.join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    counted = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    counted = counted.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    # Buckets of the same nodes are looked at once.
    several = counted.where("parts > 1").groupBy("n", "x", "y", F.col("most.component").alias("most")).agg(F.min("key").alias("key"))
    rows = placed.join(several.select("key", "most"), "key").select("key", "node", "component", (F.col("component") != F.col("most")).alias("odd"))
    base = math.log(100 / percent) * 1.0001 if percent < 100 else 1e-9
    rows = rows.join(groups.select("node", *_SETS), "node").withColumn("level", F.floor(F.log(F.col("n_shingles").cast("double")) / base))
    return rows.withColumn("cell", F.explode(F.array("level", F.col("level") - 1))).withColumn("own", F.col("cell") == F.col("level")).drop("level")


def _dealt(cells: DataFrame, weight: Column, limit: int) -> DataFrame:
    """``cells`` dealt to blocks (i, j) of about ``limit`` a side: odd nodes of part i at the left, all of part j at the right."""
    sized = cells.groupBy("key", "cell").agg(F.ceil(F.sum(F.when(F.col("odd"), weight).otherwise(0)) / limit).alias("rows"), F.ceil(F.sum(weight) / limit).alias("columns"), F.count("*").alias("n"), F.max("own").alias("any"))
    spread = cells.join(sized.where("rows > 0 and any and n > 1").drop("n", "any"), ["key", "cell"]).withColumns({"i": F.pmod(F.xxhash64("node"), F.col("rows")), "j": F.pmod(F.xxhash64("node"), F.col("columns"))})
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    spot = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    right = F.transform(upto("rows"), lambda i: spot(i, F.col("j")))
    spots = F.when(F.col("odd"), F.array_union(F.transform(upto("columns"), lambda j: spot(F.col("i"), j)), right)).otherwise(right)
    flags = {"left": F.col("odd") & (F.col("spot.i") == F.col("i")), "right": F.col("spot.j") == F.col("j")}
    return spread.withColumn("spot", F.explode(spots)).withColumns(flags).withColumns({"i": F.col("spot.i"), "j": F.col("spot.j")}).drop("spot", "rows", "columns", "odd")


_SPOT = ["key", "cell", "i", "j"]


class _Block:
    """The rows of one block, and those pairs of them that sketches can't rule out, nearest first."""

    def __init__(self, table: pa.Table, percent: int) -> None:
        table = table.filter(pa.array(np.diff(table.column("node").to_numpy(), prepend=-1) != 0))  # repeated rows of one document
        self.percent = percent
        self.key, self.cell, self.node, self.component, self.size, self.own = (table.column(c).to_numpy() for c in ("key", "cell", "node", "component", "n_shingles", "own"))
        self.x, self.y = (np.flatnonzero(table.column(c).to_numpy()) for c in ("left", "right"))
        self.sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, 2 * SKETCH)
        self.sets = table.column("shingles").combine_chunks() if "shingles" in table.column_names else None

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, (1 << 20) // max(1, len(self.y)))
        for lo in range(0, len(self.x), step):
            part = self.x[lo : lo + step]
            small, big = np.minimum(self.size[part][:, None], self.size[self.y]), np.maximum(self.size[part][:, None], self.size[self.y])
            i, j = np.nonzero((self.component[part][:, None] != self.component[self.y]) & (self.own[part][:, None] | self.own[self.y]) & (100 * small >= self.percent * big))
            i, j = part[i], self.y[j]
            for at in range(0, len(i), 1 << 14):
                p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                far, apart = unlike(self.sketch[p], self.sketch[q], (self.size[p] + self.size[q]).astype(float), self.percent)
                near = np.flatnonzero(~far)
                near = near[np.argsort(apart[near], kind="stable")]
                yield p[near], q[near]

    def partnered(self) -> list[np.ndarray]:
        """(key, cell, node) of the rows that are in such a pair."""
        hit = np.zeros(len(self.node), bool)
        for p, q in self.pairs():
            hit[p] = hit[q] = True
        return [self.key[hit], self.cell[hit], self.node[hit]]

    def links(self) -> list[np.ndarray]:
        """(a, b): confirmed links, one where they join two components that were apart until then."""
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        flat, at = self.sets.values.to_numpy().view(np.uint64), self.sets.offsets.to_numpy()
        found = []
        for p, q in self.pairs():
            for a, b in zip(p.tolist(), q.tolist(), strict=True):
                one, two = find(int(self.component[a])), find(int(self.component[b]))
                if one == two:
                    continue
                x, y = flat[at[a] : at[a + 1]], flat[at[b] : at[b + 1]]
                both = shared_values(x, y)
                if 100 * both >= self.percent * (len(x) + len(y) - both):
                    root[one] = two
                    found.append((self.node[a], self.node[b]))
        return list(np.array(found, np.int64).reshape(-1, 2).T)


def _looked(dealt: DataFrame, percent: int, names: list[str]) -> DataFrame:
    """Each block's answer: ``names`` are key, cell, node of ``partnered`` or a, b of ``links``."""
    columns = dealt.columns

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks follow each other in order; one is held at a time."""

        def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            block = _Block(pa.Table.from_batches(held).rename_columns(columns), percent)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (block.links() if len(names) == 2 else block.partnered())], names=names)

        held: list[pa.RecordBatch] = []
        last = None
        where = [columns.index(c) for c in _SPOT]
        for batch in batches:
            spots = np.stack([batch.column(i).to_numpy() for i in where], 1)
            edges = [0, *(np.flatnonzero((np.diff(spots, axis=0) != 0).any(1)) + 1).tolist(), len(spots)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b == a:
                    continue
                if held and tuple(spots[a]) != last:
                    yield answer(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(spots[a])
        if held:
            yield answer(held)

    return dealt.repartition(*_SPOT).sortWithinPartitions(*_SPOT, "node").mapInArrow(look, ", ".join(f"{x} long" for x in names))


def _open_links(shared: DataFrame, label: DataFrame, groups: DataFrame, signs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links that join the components of ``label`` that share a bucket and have a link."""
    cells = stash(_unsettled(shared, label, groups, percent), "cells", sweep=False)
    sketches = signs.join(cells.select(*_SETS).distinct(), _SETS, "left_semi").select(*_SETS, "sketch").dropDuplicates(_SETS)
    first = _dealt(cells, F.lit(1), BLOCK).join(sketches, _SETS).drop("set_a", "set_b")
    partnered = stash(_looked(first, percent, ["key", "cell", "node"]).distinct(), "partnered")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [*shingle_sets(batch.column(1), width)]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), tx.lists(flat.view(np.int64), np.array([len(x) for x in sets], np.int64), pa.int64())], names=["node", "shingles"])

    asked = partnered.select("node").distinct().join(groups.select("node", "rep.doc_id", "rep.mark"), "node")
    sets = _marked(docs).join(asked, ["doc_id", "mark"]).select("node", "text").mapInArrow(take, "node long, shingles array<long>")
    second = _dealt(cells.join(partnered, ["key", "cell", "node"]), F.col("n_shingles"), HELD).join(sketches, _SETS).drop("set_a", "set_b").join(sets, "node")
    return stash(_looked(second, percent, ["a", "b"]), "links")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (node, component) after more links (a, b) between its components or nodes that it lacks."""
    of = lambda side: label.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    wider = stash(components(between), "wider", sweep=False)
    old = label.join(wider.select(F.col("node").alias("component"), F.col("component").alias("wider")), "component", "left").select("node", F.coalesce("wider", "component").alias("component"))
    return stash(old.union(wider.join(label.select("node"), "node", "left_anti")), "label", sweep=False)


def _classed(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, kept for each row of ``docs``; all other stashes are gone."""
    spark = docs.sparkSession
    ship(spark)
    percent = round(100 * threshold)
    with scratch(spark) as keep:
        signs = stash(signatures(docs, width, threshold), "signs", sweep=False)
        sets = signs.where("n_shingles > 0 and doc_id is not null").groupBy(*_SETS).agg(F.min(F.struct("doc_id", "mark", "bands")).alias("rep"))
        # The number of a node is settled by being written.
        groups = stash(sets.withColumn("node", F.monotonically_increasing_id()), "groups")
        member = groups.select("node", F.explode("rep.bands").alias("key"))
        shared = stash(member.join(member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "buckets")

        pulled = shared.join(shared.groupBy("node").agg(F.sum("size").alias("pull")), "node")
        hubs = pulled.groupBy("key").agg(F.max(F.struct("pull", "node")).alias("hub"))
        star = pulled.join(hubs, "key").groupBy("node").agg(F.max("hub").alias("hub")).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).where("a <> b")
        links = stash(confirmed(stash(star, "star", sweep=False), groups, docs, width, percent), "links")

        label = stash(components(links), "label", sweep=False)
        label = _joined(label, _open_links(shared, label, groups, signs, docs, width, percent))
        placed = stash(groups.join(label, "node", "left").select(*_SETS, "rep.doc_id", F.coalesce("component", "node").alias("component")), "placed", sweep=False)
        found = placed.join(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select(*_SETS, "component_id")
        out = signs.select("doc_id", "mark", *_SETS).join(found, _SETS, "left").select("doc_id", "mark", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        return keep(stash(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near", sweep=False))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    return _classed(docs, width, threshold).drop("mark")


def keep_one(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the near copies: of each component the document with the smallest id stays; null ids stay."""
    out = _classed(docs, width, threshold)
    key, mark = spare(docs.columns, "key"), spare(docs.columns, "mark")
    gone = out.where("not kept").select(F.col("doc_id").alias(key), F.col("mark").alias(mark)).distinct()
    rows = docs.withColumns({key: F.col("doc_id").cast("long"), mark: F.xxhash64("text")})
    return rows.join(gone, [key, mark], "left_anti").select(*docs.columns)
