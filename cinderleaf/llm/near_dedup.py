"""Near-duplicates by min-max hashing.

Every permutation of the shingles gives two values, its minimum and its maximum, so 70 permutations
make a signature of 140. Bands of five values, each from another permutation, put similar sets into
common buckets: two sets with a similarity of 0.75 miss each other in all 28 bands with a probability
of 5e-4, two with 0.4 meet in a quarter of the cases. Equal sets are one node throughout.

Links come in steps, all confirmed on the full sets. First every node is compared with one hub, the one
that leads most of its buckets, which ties a crowd of near copies together with a pair a node. Buckets
that then still hold nodes of several components are joined to clusters, and the nodes of a cluster are
compared in cells of two blocks, except blocks that lie in the same component. A cell counts the common
shingles of all its nodes at once and tells only the links that tie components together, so the rows
grow with the nodes and not with the pairs. Nothing is capped: every two nodes of a bucket are compared,
too different in size, or known to be connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderleaf.llm import wordhash
from cinderleaf.llm.common import attach, free_name, shuffle_partitions, whole
from cinderleaf.operators.components import components
from cinderleaf.session import checkpoint

PERMUTATIONS, BAND = 70, 5
VALUES = 2 * PERMUTATIONS
BANDS = VALUES // BAND
# Hundredths of the union that two sets must share.
SIMILAR = 75
# Nodes of a block, and spokes that share a copy of their hub's set.
BLOCK, MEET = 256, 64
# Bytes of text that a worker hashes together; it holds some sixty times as many.
HASHED = 256 << 10
# Shingles whose places in a cell's sets are counted together.
COLUMNS = 4096
SIGNED = "id long, check long, n long, low long, high long, bands array<long>"
KEY = ["n", "low", "high"]


def signatures(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, band keys) of every set; `first` bounds the sets, none of which is empty."""
    n = len(first) - 1
    values = np.zeros((VALUES, n), np.uint64)
    steps = wordhash.mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(wordhash.PLACES[3]))
    for k in range(PERMUTATIONS):
        order = hashes * (steps[2 * k] | np.uint64(1)) + steps[2 * k + 1]
        values[k] = np.minimum.reduceat(order, first[:-1])
        values[PERMUTATIONS + k] = np.maximum.reduceat(order, first[:-1])
    keys = np.zeros((BANDS, n), np.uint64)
    for b in range(BANDS):
        # values of five permutations, two or three of them minima
        key = np.full(n, b, np.uint64)
        for row in range(b, VALUES, BANDS):
            key = wordhash.mix(key ^ values[row]) * np.uint64(wordhash.PLACES[4])
        keys[b] = key
    return values.T, keys.T


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, check, text) to SIGNED rows; `low` and `high` are a digest of the set."""
    for batch in batches:
        texts = batch.column(2)
        for a, b in wordhash.slices(texts, HASHED):
            hashes, first = wordhash.shingle_sets(*wordhash.text_bytes(texts.slice(a, b - a)))
            counts = np.diff(first)
            some = np.flatnonzero(counts)
            low, high = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
            keys = [None] * (b - a)
            if len(some):
                starts = first[:-1][some]
                low[some] = np.add.reduceat(wordhash.mix(hashes ^ np.uint64(wordhash.BASE)), starts)
                high[some] = np.add.reduceat(wordhash.mix(hashes ^ np.uint64(wordhash.PLACES[0])), starts)
                for at, key in zip(some.tolist(), signatures(hashes, np.append(starts, len(hashes)))[1].view(np.int64), strict=True):
                    keys[at] = key
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    batch.column(1).slice(a, b - a),
                    pa.array(counts.astype(np.int64)),
                    pa.array(low.view(np.int64)),
                    pa.array(high.view(np.int64)),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["id", "check", "n", "low", "high", "bands"],
            )


def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, size, packed): the text's bytes, compressed."""
    for batch in batches:
        texts = [t.as_buffer() for t in batch.column(1)]
        cells = [
            batch.column(0),
            pa.array([t.size for t in texts], pa.int64()),
            pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in texts], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(cells, names=["node", "size", "packed"])


def _sets(sizes: list[int], packed: list[bytes]) -> list[np.ndarray]:
    """The sorted shingle hashes of compressed texts."""
    texts = [pa.decompress(p, decompressed_size=n, codec="zstd", asbytes=True) for n, p in zip(sizes, packed, strict=True)]
    out, at = [], pa.array(texts, pa.large_binary())
    for a, b in wordhash.slices(at, HASHED):
        hashes, first = wordhash.shingle_sets(*wordhash.text_bytes(at.slice(a, b - a)))
        out += [hashes[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
    return out


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * shared >= SIMILAR * (len(x) + len(y) - shared)


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, salt, node, size, packed), sorted, the hub's own set first in a null node, to links (a, b)."""
    hub, own = None, []
    for batch in batches:
        hubs, nodes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        left, right = [], []
        sets = _sets(batch.column(3).to_pylist(), batch.column(4).to_pylist())
        for at, node, found in zip(hubs, nodes, sets, strict=True):
            if at != hub:
                hub, own = at, []
            if node is None:
                own.append(found)  # a repeated id has several sets
            elif any(_similar(x, found) for x in own):
                left.append(hub)
                right.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def cell_links(sets: list[np.ndarray], nodes: list[int], roots: list[int]) -> list[tuple[int, int]]:
    """Links between the nodes of a cell that tie the components `roots` together, no more than needed."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes.astype(np.int64))
    often = np.bincount(column) > 1
    column, row = (np.cumsum(often) - 1)[column[often[column]]], row[often[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    shared = np.zeros((n, n), np.float64)
    for low in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        held = np.zeros((n, COLUMNS), np.float32)
        held[row[a:b], column[a:b] - low] = 1
        shared += held @ held.T
    roots = np.array(roots)
    near = (100 * shared >= SIMILAR * (sizes[:, None] + sizes[None, :] - shared)) & (roots[:, None] != roots[None, :])
    parent = {r: r for r in roots.tolist()}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    links = []
    for i, j in zip(*np.nonzero(np.triu(near)), strict=True):
        x, y = find(int(roots[i])), find(int(roots[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            links.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    return links


def compare_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, node, root, size, packed), sorted by cell, to links (a, b); holds one cell at a time."""
    current, held = None, []

    def told() -> Iterator[pa.RecordBatch]:
        links = cell_links(_sets([r[3] for r in held], [r[4] for r in held]), [r[1] for r in held], [r[2] for r in held])
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*links, strict=True)], names=["a", "b"])

    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if r[0] != current:
                if held:
                    yield from told()
                current, held = r[0], []
            held.append(r)
    if held:
        yield from told()


def _stars(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The (a, b) of `pairs`, hub and spoke, that are similar on the full sets.

    The hub's set is copied once per MEET spokes, so no task meets all spokes of a hub.
    """
    fan = checkpoint(pairs.groupBy("a").agg(F.count("*").alias("links")))
    salts = F.ceil(F.col("links") / MEET).cast("long")
    salted = attach(pairs, fan, ["a"], "links", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), salts).alias("salt"))
    spokes = salted.join(held, F.col("b") == F.col("node")).select("a", "salt", "node", "size", "packed")
    hubs = fan.join(held, F.col("a") == F.col("node")).select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(None).cast("long").alias("node"), "size", "packed"
    )
    both = spokes.unionByName(hubs)
    parts = shuffle_partitions(pairs.sparkSession)
    placed = both.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("node").asc_nulls_first())
    return placed.mapInArrow(confirmed, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_shingles, component_id, kept.

    Documents are linked when their shingle sets share 75 hundredths of their union; component_id is
    the smallest id a document reaches, and that one is kept. Texts without words (null, empty, white
    space) have no shingles and no links. Rows that repeat an id are one document with the links of
    all of them. A row with a null id has no links, a null component, and is kept. An empty table
    gives an empty result. Other columns are not read.
    """
    own = whole(text)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(own).alias("check"), own.alias("text"))
    signed = checkpoint(rows.mapInArrow(sign, SIGNED))
    linked = signed.where("n > 0 AND id IS NOT NULL")
    groups = linked.groupBy(*KEY).agg(
        F.min(F.struct("id", "check")).alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands")
    )
    groups = checkpoint(groups.select(*KEY, F.col("least.id").alias("node"), F.col("least.check").alias("check"), "copies", "bands"))
    roots = connected(groups.select("node", "check", "n", "bands"), rows.where("id IS NOT NULL"))
    # rows that repeat an id with other words tie the groups of their texts together
    repeated = linked.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1")
    tied = linked.join(repeated, "id", "left_semi").select(*KEY, "id").distinct()
    groups = groups.drop("check", "bands")
    bridges = tied.join(groups, KEY).select(F.col("node").alias("a"), F.col("id").alias("b"))
    roots = _joined(roots, bridges)
    named = groups.join(roots, "node", "left").select(
        *KEY, "copies", F.coalesce("root", "node").alias("component_id")
    )
    named = checkpoint(named)
    found = attach(linked.select("id", *KEY), named, KEY, "copies", linked.count())
    alone = signed.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return (
        found.select("id", "n", "component_id")
        .unionByName(alone)
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            "component_id",
            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after `links` (a, b) were added."""
    if links.isEmpty():
        return roots
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return checkpoint(components(known.unionByName(links)))


def _followed(links: DataFrame) -> DataFrame:
    """(node, root) of the spokes `b`, each with one hub `a` before it: the end of the chain of hubs.

    Every round doubles the chain that a node has behind it.
    """
    ahead = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    while True:
        further = ahead.select(F.col("node").alias("root"), F.col("root").alias("next"))
        joined = checkpoint(ahead.join(further, "root", "left"))
        ahead = joined.select("node", F.coalesce("next", "root").alias("root"))
        if joined.where("next IS NOT NULL").isEmpty():
            return ahead


def _mixed(placed: DataFrame, roots: DataFrame) -> DataFrame:
    """The postings (key, node, n, root) of the buckets that hold nodes of several components."""
    rooted = placed.select("key", "node", "n").join(roots, "node", "left")
    rooted = checkpoint(rooted.select("key", "node", "n", F.coalesce("root", "node").alias("root")))
    spread = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    return checkpoint(rooted.join(spread.where("least != most").select("key"), "key", "left_semi"))


def _spokes(placed: DataFrame) -> DataFrame:
    """(a, b): every node with the hub that leads most of its buckets, in another component and of like size.

    The smallest node leads a bucket.
    """
    hubs = placed.groupBy("key").agg(F.min(F.struct("node", "n", "root")).alias("hub"), F.count("*").alias("size"))
    hubs = checkpoint(hubs.where("size > 1"))
    members = hubs.agg(F.sum("size")).first()[0] or 0
    met = attach(placed, hubs, ["key"], "size", members).where("root != hub.root")
    alike = 100 * F.least("n", F.col("hub.n")) >= SIMILAR * F.greatest("n", F.col("hub.n"))
    chosen = met.where(alike).groupBy("node").agg(F.mode("hub.node", True).alias("a"))
    return checkpoint(chosen.select("a", F.col("node").alias("b")))


def _cells(placed: DataFrame, held: DataFrame) -> DataFrame:
    """The links (a, b) between components among the nodes that common buckets tie to clusters."""
    least = placed.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("size"))
    ties = attach(placed, checkpoint(least), ["key"], "size", placed.count()).select("a", F.col("node").alias("b")).distinct()
    clusters = checkpoint(components(ties)).withColumnRenamed("root", "cluster")
    nodes = checkpoint(placed.select("node", "root").distinct().join(clusters, "node"))
    # a component with more nodes than a block in its cluster is a unit of blocks, the others share units
    sizes = checkpoint(nodes.groupBy("cluster", "root").agg(F.count("*").alias("size")))
    small = sizes.where(F.col("size") <= BLOCK).groupBy("cluster").agg(F.sum("size").alias("pool"))
    sizes = sizes.join(small, "cluster", "left")
    shared = F.pmod(F.xxhash64("root"), F.ceil(F.col("pool") / BLOCK)).cast("long")
    big = F.col("size") > BLOCK
    # units of a component carry its root, shared ones a number below zero
    units = checkpoint(
        sizes.select("cluster", "root", F.when(big, F.col("root")).otherwise(-1 - shared).alias("unit"), F.when(big, F.ceil(F.col("size") / BLOCK)).otherwise(1).cast("int").alias("blocks"), "size")
    )
    own = units.select("cluster", "unit", "blocks", big.alias("big")).distinct()
    other = own.select("cluster", F.col("unit").alias("unit_b"), F.col("blocks").alias("blocks_b"))
    pairs = own.join(other, "cluster").where((F.col("unit") < F.col("unit_b")) | ((F.col("unit") == F.col("unit_b")) & ~F.col("big")))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pairs = pairs.select("cluster", "unit", "unit_b", span("blocks").alias("block"), "blocks_b")
    pairs = checkpoint(pairs.select("cluster", "unit", "unit_b", "block", span("blocks_b").alias("block_b")))
    numbered = pairs.withColumn("cell", F.xxhash64("cluster", "unit", "unit_b", "block", "block_b"))
    sides = numbered.select("cluster", "unit", "block", "cell").unionByName(
        numbered.select("cluster", F.col("unit_b").alias("unit"), F.col("block_b").alias("block"), "cell")
    ).distinct()
    total = nodes.count()
    labelled = attach(nodes, units, ["cluster", "root"], "size", total)
    labelled = labelled.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed_nodes = labelled.select("node", "root", "cluster", "unit", "block").join(sides, ["cluster", "unit", "block"])
    full = placed_nodes.select("cell", "node", "root").join(held, "node")
    parts = shuffle_partitions(placed.sparkSession)
    rows = full.select("cell", "node", "root", "size", "packed").repartition(parts, "cell").sortWithinPartitions("cell")
    return rows.mapInArrow(compare_cells, "a long, b long")


def connected(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) of every node that similarity connects to another one.

    `nodes` (node, check, n, bands) are texts of `rows` (id, check, text).
    """
    postings = checkpoint(nodes.select("node", "n", F.explode("bands").alias("key")))
    shared = postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    placed = checkpoint(postings.join(shared, "key", "left_semi").withColumn("root", F.col("node")))
    if placed.isEmpty():
        return placed.select("node", "root")
    wanted = nodes.join(placed.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("id"), "check").distinct()
    texts = rows.groupBy("id", "check").agg(F.first("text").alias("text")).join(wanted, ["id", "check"], "left_semi")
    held = checkpoint(texts.select(F.col("id").alias("node"), "text").mapInArrow(compressed, "node long, size long, packed binary"))
    links = checkpoint(_stars(_spokes(placed), held))
    placed = _mixed(placed, _followed(links))
    more = checkpoint(_cells(placed, held)) if not placed.isEmpty() else links.limit(0)
    return checkpoint(components(links.unionByName(more)))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one document per component, all columns unchanged.

    Rows without words and rows with a null id stay; rows that repeat a kept id all stay. Columns of any name
    are allowed. An empty table gives an empty result.
    """
    gone = near_groups(docs, id_col, text).where("NOT kept").select(F.col(id_col).alias("id")).distinct()
    name = free_name(docs)
    return docs.join(gone.withColumnRenamed("id", name), F.col(id_col) == F.col(name), "left_anti")
