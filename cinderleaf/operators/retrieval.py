"""Vector, keyword and prompt-similarity retrieval, and index maintenance."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderleaf.fixed import templates as text_rules
from cinderleaf.functions.subsequence import common_characters, common_subsequences
from cinderleaf.functions.template import render
from cinderleaf.functions.text import strip, words
from cinderleaf.operators.lookup import contains_join
from cinderleaf.session import bounded, checkpoint, fits_broadcast

# Queries that a part of documents has at least, parts of all queries, and queries that are scored together.
QUERY_BATCH, QUERY_PARTS, ASK_SLICE = 4096, 24, 512
# Documents a block holds about, pivots, steps an angle of one is cut into, and what rounding may add to an angle.
DOC_SLICE, PIVOTS, ANGLE_STEPS, SLACK = 4096, 64, 1024, 1e-6
# Numbers that the vectors of a shelf of blocks have about, and documents whose largest score is looked at first.
SHELF_NUMBERS, LOOK = 1 << 22, 64
SIMILAR_SHOWN = 0.60
SIMILAR_DUPLICATE = 0.65


def _matrix(vecs: pa.Array) -> np.ndarray:
    return vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vecs), -1)


def _plain(ids: pa.Array) -> np.ndarray:
    """Ids to compare; a null equals nothing."""
    if not ids.null_count:
        return ids.to_numpy(zero_copy_only=False)
    return np.array([np.nan if v is None else v for v in ids.to_pylist()], object)


def _first_copies(vecs: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows, sorted by id, that can be among the first `k` of their vector's copies when any one id is left out."""
    factors = np.random.default_rng(0).integers(1 << 62, size=vecs.shape[1], dtype=np.uint64) | np.uint64(1)
    codes = (vecs.view(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
    order = np.argsort(codes, kind="stable")
    alike = np.flatnonzero(codes[order[1:]] == codes[order[:-1]]) + 1
    alike = alike[(vecs[order[alike]] == vecs[order[alike - 1]]).all(axis=1)]
    if not len(alike):
        return np.arange(len(vecs))
    new = np.ones(len(vecs), bool)
    new[alike] = False
    other = new.copy()  # an id or a vector that the row before does not have
    other[alike] = ids[order[alike]] != ids[order[alike - 1]]
    begins, firsts = np.flatnonzero(new), np.flatnonzero(other)
    number = np.cumsum(other)  # the how many-th id
    number -= np.repeat(number[begins], np.diff(np.append(begins, len(new))))
    again = np.arange(len(new)) - np.repeat(firsts, np.diff(np.append(firsts, len(new))))
    return np.sort(order[(number <= k) & (again < k)])


def _directions(vecs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Vectors of length one; zeros for those without a length."""
    return np.divide(vecs, sizes[:, None], out=np.zeros_like(vecs), where=sizes[:, None] > 0).astype(np.float32)


class _Held:
    """Documents that queries are scored with: in slices of like direction, copies that cannot be found left out.

    Products of single precision tell which documents can be among the best, by the most that rounding may
    add to them; those are scored in double precision, equal vectors to equal scores.
    """

    def __init__(self, ids: pa.Array, vecs: np.ndarray, k: int, centres: np.ndarray | None):
        place = _first_copies(vecs, _plain(ids), k)
        place = place[~np.isinf(vecs[place]).any(axis=1)]  # others have no score
        cell, angle = np.zeros(len(place), np.int64), np.zeros(len(place))
        if centres is not None:
            angles = _angles(vecs[place], centres)
            cell, angle = angles.argmin(axis=1), angles.min(axis=1)
        order = np.lexsort((angle, cell))
        cell, angle = cell[order], angle[order]
        edges = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
        cuts = [range(a, b, DOC_SLICE) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        starts = np.array([x for cut in cuts for x in cut], np.int64)
        stops = np.append(starts[1:], len(order))[: len(starts)]
        self.cell, self.low, self.high = cell[starts], angle[starts], angle[stops - 1]
        self.ids, self.place, self.centres = ids, place[order], centres
        self.plain, self.vecs = _plain(ids)[self.place], vecs[self.place]
        self.sizes = np.linalg.norm(self.vecs, axis=1)
        unit = _directions(self.vecs, self.sizes)
        # every slice is filled up to a multiple of LOOK
        self.slices = [(a, b, np.concatenate([unit[a:b], np.zeros((-(b - a) % LOOK, unit.shape[1]), np.float32)]))
                       for a, b in zip(starts, stops, strict=True)]
        self.slack = 4 * (unit.shape[1] + 4) * 2.0**-24

    def best(
        self, ids: np.ndarray, vecs: np.ndarray, least: np.ndarray, k: int, skip_self: bool
    ) -> tuple[np.ndarray, np.ndarray]:
        """(scores, rows of `ids`) of the best `k` documents of every query, -1 for none; `least` of them are known."""
        n = len(vecs)
        sizes = np.linalg.norm(vecs, axis=1)
        unit = np.ascontiguousarray(_directions(vecs, sizes).T)
        score, at = np.full((n, k), -np.inf), np.full((n, k), -1)
        gaps = None if self.centres is None else _gaps(_angles(vecs, self.centres), self.cell, self.low, self.high)
        for s, (a, b, directions) in enumerate(self.slices):
            bound = np.maximum(least, score[:, -1])
            some = np.arange(n)
            if gaps is not None:
                some = np.flatnonzero(~(gaps[:, s] > np.arccos(np.clip(bound, -1, 1)) + SLACK))
                if not len(some):
                    continue
            near = directions @ (unit if len(some) == n else unit[:, some])
            near[b - a :] = -np.inf
            cut = bound[some] - self.slack
            fresh = np.flatnonzero(np.isneginf(cut))
            if skip_self and len(fresh):
                near[: b - a][self.plain[a:b, None] == ids[some]] = -np.inf
            top = near.reshape(-1, LOOK, len(some)).max(axis=1)
            if len(fresh) and len(top) >= k:  # the largest scores of `k` groups are `k` scores
                cut[fresh] = np.partition(top[:, fresh], len(top) - k, axis=0)[-k] - 2 * self.slack
            cut = cut.astype(np.float32)
            group, asked = np.nonzero(top >= cut)
            step = max(1, (1 << 20) // LOOK)
            for i in range(0, len(group), step):
                groups, asks = group[i : i + step], asked[i : i + step]
                hit, inner = np.nonzero(near.reshape(-1, LOOK, len(some))[groups, :, asks] >= cut[asks, None])
                doc, ask = groups[hit] * LOOK + inner, asks[hit]
                real = doc < b - a
                doc, ask = a + doc[real], some[ask[real]]
                if skip_self:
                    other = ~(self.plain[doc] == ids[ask])
                    doc, ask = doc[other], ask[other]
                if len(doc):
                    self._take(score, at, ask, doc, self._scores(doc, vecs, sizes, ask))
        return score, at

    def _scores(self, doc: np.ndarray, vecs: np.ndarray, sizes: np.ndarray, ask: np.ndarray) -> np.ndarray:
        out = np.zeros(len(doc))
        step = max(1, SHELF_NUMBERS // (8 * vecs.shape[1]))
        for i in range(0, len(doc), step):
            d, q = doc[i : i + step], ask[i : i + step]
            scale = self.sizes[d] * sizes[q]
            np.divide(np.einsum("ij,ij->i", self.vecs[d], vecs[q]), scale, out=out[i : i + step], where=scale > 0)
        return out

    def _take(self, score: np.ndarray, at: np.ndarray, ask: np.ndarray, doc: np.ndarray, found: np.ndarray) -> None:
        """Puts the documents found among the best of their queries; of equal scores the smallest id goes first."""
        k = score.shape[1]
        finite = np.isfinite(found)
        ask, place, found = ask[finite], self.place[doc[finite]], found[finite]
        asks = np.unique(ask)
        held = at[asks] >= 0
        ask = np.concatenate([np.repeat(asks, held.sum(axis=1)), ask])
        place = np.concatenate([at[asks][held], place])
        found = np.concatenate([score[asks][held], found])
        order = np.lexsort((place, -found, ask))
        ask, place, found = ask[order], place[order], found[order]
        firsts = np.flatnonzero(np.diff(ask, prepend=-1))
        rank = np.arange(len(ask)) - np.repeat(firsts, np.diff(np.append(firsts, len(ask))))
        few = rank < k
        at[ask[few], rank[few]] = place[few]
        score[ask[few], rank[few]] = found[few]


def _best_of_blocks(k: int, skip_self: bool, centres: np.ndarray | None = None):
    """The best `k` documents of every query of rows (block, part, asks, query_id, doc_id, vec, least).

    The rows of a part come together, its documents by their id and then its queries. A worker holds the
    documents of one block or shelf and scores a few queries at a time. `least` is a score that the best `k`
    documents of a query reach, if one is known; with `centres` its documents out of reach are passed over.
    """

    def scored(asks: pa.RecordBatch, held: _Held) -> Iterator[pa.RecordBatch]:
        for start in range(0, asks.num_rows, ASK_SLICE):
            some = asks.slice(start, ASK_SLICE)
            ids, least = some.column("query_id"), np.full(some.num_rows, -np.inf)
            if "least" in some.schema.names:
                known = some.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                least = np.where(np.isnan(known), -np.inf, known)
            score, at = held.best(_plain(ids), _matrix(some.column("vec")), least, k, skip_self)
            ask, rank = np.nonzero(at >= 0)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(ask)), held.ids.take(pa.array(at[ask, rank])), pa.array(score[ask, rank])],
                names=["query_id", "doc_id", "score"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, docs, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if b == a:
                    continue
                part, asks = (keys[0, a], keys[1, a]), keys[2, a]
                if part != current:
                    current, docs, held = part, [], None
                if not asks:
                    docs.append(batch.slice(a, b - a))
                elif docs or held:
                    if held is None:
                        vecs = np.concatenate([_matrix(d.column("vec")) for d in docs])
                        held = _Held(pa.concat_arrays([d.column("doc_id") for d in docs]), vecs, k, centres)
                        docs = []
                    yield from scored(batch.slice(a, b - a), held)

    return run


def _angles(vecs: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles between vectors, none of them zero, and the pivots."""
    rows = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    return np.arccos(np.clip(rows @ pivots.T, -1, 1))


def _gaps(angles: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least angles that vectors at `angles` to the pivots can make with documents between two angles to theirs."""
    own = angles[:, cells]
    return np.maximum(np.maximum(own - high, low - own), 0)


def _rows(vecs: pd.Series) -> np.ndarray:
    return np.array(vecs.tolist(), np.float64).reshape(len(vecs), -1)


class VectorIndex:
    """Documents in blocks of like direction, for an exact search that skips blocks.

    Blocks side by side form a shelf. What moves are queries and shelves: a query goes to a shelf once, whatever
    the number of blocks there that it has to be compared with, and a shelf once to every part of its queries.

    A document belongs to the pivot it makes the smallest angle with; the documents of a pivot are cut into
    blocks by that angle. As angles obey the triangle inequality, no document of a block is closer to a query
    than the gap between the query's angle to the pivot and the block's range of angles. The pivots are a
    bounded number of documents drawn by hash; they decide how many blocks are skipped, not what is found.
    Documents without a vector take no part; those of zero length have a score of 0 with every query.
    """

    def __init__(self, docs: DataFrame, doc_id: str, doc_vec: str, pivots: int, block: int):
        rows = docs.select(F.col(doc_id).alias("id"), F.col(doc_vec).alias("vec")).where(F.col(doc_vec).isNotNull())
        self.rows = rows
        solid = rows.where(_solid("vec"))
        self.zero = rows.where(~_solid("vec"))
        drawn = solid.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
        found = np.array([r["vec"] for r in drawn], np.float64).reshape(len(drawn), -1)
        self.pivots = found / np.linalg.norm(found, axis=1, keepdims=True) if len(drawn) else found
        kind = dict(rows.dtypes)["id"]
        centres = self.pivots

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                angles = _angles(_rows(pdf["vec"]), centres)
                yield pdf.assign(cell=angles.argmin(axis=1).astype(np.int32), angle=angles.min(axis=1))

        if not len(drawn):
            self.docs = None
            return
        placed = checkpoint(solid.mapInPandas(place, f"id {kind}, vec {dict(rows.dtypes)['vec']}, cell int, angle double"))
        step = F.floor(F.col("angle") * ANGLE_STEPS).cast("int").alias("step")
        # at most ANGLE_STEPS * pi steps a pivot
        steps = placed.groupBy("cell", step).agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("cell").orderBy("step")) - F.col("n")
        steps = steps.withColumns({"first": F.floor(before / block), "parts": F.ceil(F.col("n") / block)})
        cut = placed.withColumn("step", step).join(F.broadcast(steps), ["cell", "step"])
        # a step that fills blocks of its own is split by hash
        part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(0)
        docs = cut.select(F.xxhash64("cell", "first", part).alias("block"), "id", "vec", "cell", "angle")
        self.blocks = checkpoint(
            docs.groupBy("block", "cell").agg(
                F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("size")
            )
        )
        # as many rows as there are blocks
        spans = self.blocks.orderBy("cell", "low", "block").toPandas()
        rows = max(block, SHELF_NUMBERS // centres.shape[1])
        spans["shelf"] = (spans["size"].cumsum() - spans["size"]) // rows
        self.spans = spans
        shelves = docs.sparkSession.createDataFrame(spans[["block", "shelf"]], "block long, shelf long")
        self.docs = docs.join(F.broadcast(shelves), "block")

    def best(self, visits: DataFrame, k: int, skip_self: bool, group: int) -> DataFrame:
        """(query_id, doc_id, score): the best `k` of every visit (block or shelf, id, vec, least).

        About `group` queries of a block or shelf meet it together.
        """
        key = "shelf" if "shelf" in visits.columns else "block"
        counts = checkpoint(visits.groupBy(key).agg(F.ceil(F.count("*") / group).alias("parts")))
        tasks = counts.agg(F.sum("parts")).first()[0] or 0
        tasks = max(2 * tasks, int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        kinds = dict(visits.dtypes)["id"], dict(self.docs.dtypes)["id"]
        wide = dict(visits.dtypes)["vec"] != dict(self.docs.dtypes)["vec"]
        vec = F.col("vec").cast("array<double>").alias("vec") if wide else F.col("vec")
        asks = visits.join(F.broadcast(counts), key).select(
            key, F.pmod(F.xxhash64("id", "vec"), F.col("parts")).alias("part"), F.lit(True).alias("asks"),
            F.col("id").alias("query_id"), F.lit(None).cast(kinds[1]).alias("doc_id"), vec, "least", "cell",
        )
        held = self.docs.select(key, "id", "vec").join(F.broadcast(counts), key).select(
            key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
            F.lit(False).alias("asks"), F.lit(None).cast(kinds[0]).alias("query_id"), F.col("id").alias("doc_id"), vec,
            F.lit(None).cast("double").alias("least"), F.lit(None).cast("int").alias("cell"),
        )
        # queries of like direction are scored together
        met = held.unionByName(asks).repartition(tasks, key, "part")
        met = met.sortWithinPartitions(key, "part", "asks", "doc_id", "cell").drop("cell")
        centres = self.pivots if key == "shelf" else None
        return met.mapInArrow(_best_of_blocks(k, skip_self, centres), f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")

    def home(self, asks: DataFrame, least: int) -> DataFrame:
        """(block, id, vec, least, cell): for every query a block near it with at least `least` documents, if there is any.

        Nothing is known yet of the scores.
        """
        centres, spans = self.pivots, self.spans[self.spans["size"] >= least]
        blocks, cells = spans["block"].to_numpy(), spans["cell"].to_numpy()
        low, high = spans["low"].to_numpy(), spans["high"].to_numpy()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in (b.iloc[i : i + ASK_SLICE // 4] for b in batches for i in range(0, len(b), ASK_SLICE // 4)):
                if len(blocks):
                    angles = _angles(_rows(pdf["vec"]), centres)
                    gaps = _gaps(angles, cells, low, high)
                    angles = np.where(gaps > gaps.min(axis=1, keepdims=True), np.inf, angles[:, cells])
                    at = angles.argmin(axis=1)
                    yield pdf.assign(block=blocks[at], cell=cells[at])

        kinds = dict(asks.dtypes)
        found = asks.mapInPandas(run, f"id {kinds['id']}, vec {kinds['vec']}, block long, cell int")
        return found.withColumn("least", F.lit(None).cast("double"))

    def visits(self, asks: DataFrame, least: DataFrame) -> DataFrame:
        """(shelf, id, vec, least, cell): the shelves that may hold a document with the query's `least` score (id, least).

        A null `least` keeps all of them.
        """
        centres, spans, kinds = self.pivots, self.spans, dict(asks.dtypes)
        cells, low, high = spans["cell"].to_numpy(), spans["low"].to_numpy(), spans["high"].to_numpy()
        shelves, first = np.unique(spans["shelf"].to_numpy(), return_index=True)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in (b.iloc[i : i + ASK_SLICE // 4] for b in batches for i in range(0, len(b), ASK_SLICE // 4)):
                angles = _angles(_rows(pdf["vec"]), centres)
                reach = np.arccos(np.clip(pdf["least"].to_numpy(np.float64), -1, 1))[:, None]
                near = ~(_gaps(angles, cells, low, high) > reach + SLACK)
                near = np.logical_or.reduceat(near, first, axis=1)
                yield pdf.assign(cell=angles.argmin(axis=1).astype(np.int32), shelves=[shelves[x] for x in near])

        known = asks.join(least, "id", "left").select("id", "vec", "least")
        found = known.mapInPandas(run, f"id {kinds['id']}, vec {kinds['vec']}, least double, cell int, shelves array<long>")
        return found.select(F.explode("shelves").alias("shelf"), "id", "vec", "least", "cell")


def _solid(vec: str) -> Column:
    """Whether a vector has a direction."""
    return F.exists(vec, lambda x: x != 0)


def vector_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vec: str = "embedding",
    doc_id: str = "doc_id",
    doc_vec: str = "embedding",
    skip_self: bool = False,
    index: VectorIndex | None = None,
) -> DataFrame:
    """(query_id, doc_id, score, rank): the `k` documents with the highest cosine per query, ties by document.

    A block near the query gives `k` documents and with them the angle within which all better ones lie; only
    blocks that reach into it are visited. Exact whatever the data: where directions do not cluster, all blocks are
    visited, and queries and documents meet by shelves of blocks. Rows without a vector take no part. `index` reuses a VectorIndex of `docs`.
    """
    index = index or VectorIndex(docs, doc_id, doc_vec, PIVOTS, DOC_SLICE)
    asks = queries.select(F.col(query_id).alias("id"), F.col(query_vec).alias("vec")).where(F.col(query_vec).isNotNull())
    solid, zero = asks.where(_solid("vec")), asks.where(~_solid("vec"))
    ask_kind, doc_kind = dict(asks.dtypes)["id"], dict(index.rows.dtypes)["id"]
    few = k + bool(skip_self)
    # a score of 0: of documents without a direction, or for queries without one, the smallest ids
    def level(rows: DataFrame, alike: DataFrame) -> DataFrame:
        ids = [r["id"] for r in alike.select("id").orderBy("id").limit(few).collect()]
        listed = F.array(*[F.lit(i) for i in ids]).cast(f"array<{doc_kind}>")
        return rows.select(F.col("id").alias("query_id"), F.explode(listed).alias("doc_id"), F.lit(0.0).alias("score"))

    found = level(solid, index.zero).unionByName(level(zero, index.rows))
    if skip_self:
        found = found.where(~F.col("query_id").eqNullSafe(F.col("doc_id").cast(ask_kind)))
    if index.docs is not None:
        solid = checkpoint(solid)
        start = index.best(index.home(solid, few), k, skip_self, QUERY_BATCH)
        least = start.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        least = least.where(F.col("n") >= k).select(F.col("query_id").alias("id"), "least")
        visits = index.visits(solid, checkpoint(least))
        group = max(QUERY_BATCH, min(solid.count() // QUERY_PARTS, SHELF_NUMBERS // index.pivots.shape[1]))
        found = found.unionByName(index.best(visits, k, skip_self, group))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def context_prompt(
    queries: DataFrame, query_id: str, question: str, hits: DataFrame, docs: DataFrame,
    doc_id: str, content: str, fallback: str = "", joiner: str = "\n",
) -> DataFrame:
    """Adds `context` (hit texts in rank order, else the fallback) and the joined `prompt`."""
    texts = hits.join(docs.select(F.col(doc_id).alias("doc_id"), F.col(content).alias("_c")), "doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "_c")))  # at most k entries per query
    context = texts.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda e: e["_c"]), joiner).alias("context")
    )
    joined = queries.join(context.withColumnRenamed("query_id", query_id), query_id, "left")
    joined = joined.withColumn("context", F.coalesce("context", F.lit(fallback)))
    slots = {"context": F.col("context"), "question": F.col(question)}
    prompt = F.when(F.col("context") == "", F.col(question)).otherwise(
        render(text_rules.CONTEXT_PROMPT, slots)
    )
    return joined.withColumn("prompt", prompt)


def keyword_retrieve(
    queries: DataFrame, query_id: str, query: str, docs: DataFrame, order: str,
    title: str = "title", tags: str = "tags", limit: int = 2,
) -> DataFrame:
    """(query_id, order, title, rank): documents with a tag in the query or a query word in the title.

    The first `limit` in document order; queries without a hit get the first document.
    """
    asked = queries.select(query_id, F.lower(query).alias("_q"))
    slim = docs.select(order, title, tags, F.lower(title).alias("_title"))
    tagged = slim.select(order, F.explode(tags).alias("_tag")).distinct()
    by_tag = contains_join(asked, "_q", tagged, "_tag").select(query_id, order)
    asked_words = checkpoint(asked.select(query_id, F.explode(words(F.col("_q"))).alias("_word")).distinct())
    vocabulary = asked_words.select("_word").distinct()
    titles = contains_join(slim.select(order, "_title"), "_title", vocabulary, "_word")
    by_word = asked_words.join(bounded(checkpoint(titles.select(order, "_word"))), "_word")
    hits = by_tag.unionByName(by_word.select(query_id, order)).distinct()
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(order))
    best = hits.withColumn("rank", rank).where(F.col("rank") <= limit)
    first = docs.agg(F.min(order).alias(order))
    none = queries.select(query_id).join(hits.select(query_id), query_id, "left_anti")
    fallback = none.withColumns({order: first.scalar(), "rank": F.lit(1)})
    found = best.unionByName(fallback.select(query_id, order, "rank"))
    return found.join(bounded(docs.select(order, title)), order).select(query_id, order, title, "rank")


@F.pandas_udf(T.DoubleType())
def _sequence_ratio(new: pd.Series, old: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio where its upper bounds leave a chance above the shown limit.

    The matching blocks are a common subsequence and share its characters: both bound them from above.
    """
    a, left = pd.factorize(new)
    b, right = pd.factorize(old)
    size = np.array([len(x) for x in left])[a] + np.array([len(x) for x in right])[b]
    out = np.full(len(new), np.nan)
    some = np.flatnonzero(2.0 * common_characters(left, right, a, b) / size > SIMILAR_SHOWN)
    some = some[2.0 * common_subsequences(left, right, a[some], b[some]) / size[some] > SIMILAR_SHOWN]
    for i in some:
        value = difflib.SequenceMatcher(None, left[a[i]], right[b[i]]).ratio()
        out[i] = value if value > SIMILAR_SHOWN else np.nan
    return pd.Series([None if np.isnan(x) else x for x in out], dtype="float64")


def _length_band(text: Column) -> Column:
    """Bands in steps of 7/3: a ratio above 0.6 needs lengths within that factor."""
    return F.floor(F.log(F.length(text).cast("double")) / F.log(F.lit(7.0 / 3.0)))


def similar_prompt(
    new: DataFrame, new_id: str, new_prompt: str, existing: DataFrame, prompt: str, order: str
) -> DataFrame:
    """Best existing prompt per new prompt: similarity, duplicate flag and match.

    Equal prompts count 1.0 and need no comparison. Similarities up to 0.60 are reported as null.
    """
    asked = new.select(new_id, strip(F.lower(new_prompt)).alias("_new")).where("_new <> ''")
    stored = existing.select(order, prompt, F.lower(prompt).alias("_old")).where("_old <> ''")
    stored = stored.withColumn("_key", strip(F.col("_old")))
    equal = asked.join(stored, asked["_new"] == stored["_key"]).groupBy(new_id).agg(
        F.min_by(prompt, order).alias("match"), F.lit(1.0).alias("similarity")
    )
    equal = checkpoint(equal)
    rest = asked.join(equal.select(new_id), new_id, "left_anti")
    size_new, size_old = F.length("_new"), F.length("_old")
    near = 2 * F.least(size_new, size_old) > SIMILAR_SHOWN * (size_new + size_old)
    # comparing costs far more than moving: the stored prompts are dealt out, however few bytes they have
    tasks = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    old = stored.repartition(tasks).withColumn("_band", _length_band(F.col("_old")))
    band = _length_band(F.col("_new"))
    spread = rest.withColumn("_band", F.explode(F.array(band - 1, band, band + 1)))
    # the new prompts are the small side; a large set takes the shuffle join on the bands
    small = F.broadcast(spread) if fits_broadcast(rest, 10_000) else spread
    scored = old.join(small, "_band").where(near).withColumn("_r", _sequence_ratio("_new", "_old"))
    best = scored.where("_r IS NOT NULL").groupBy(new_id).agg(
        F.min_by(F.struct(prompt, "_r"), F.struct((-F.col("_r")).alias("r"), order)).alias("_b")
    )
    fuzzy = best.select(new_id, F.col(f"_b.{prompt}").alias("match"), F.col("_b._r").alias("similarity"))
    found = equal.unionByName(fuzzy)
    joined = new.select(new_id).join(found, new_id, "left")
    return joined.select(
        new_id,
        F.coalesce(F.col("similarity") > SIMILAR_DUPLICATE, F.lit(False)).alias("duplicate"),
        F.round("similarity", 2).alias("similarity"),
        "match",
    )


def document_chunk_counts(files: DataFrame, chunks: DataFrame, source: str) -> DataFrame:
    """Files with the number of indexed chunks, 0 for none."""
    counts = chunks.groupBy(source).agg(F.count("*").alias("chunks"))
    return files.join(counts, source, "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def delete_by_source(chunks: DataFrame, sources: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(chunks that stay, deleted chunk count per source)."""
    gone = chunks.join(sources.select(source), source, "left_semi")
    return (
        chunks.join(sources.select(source), source, "left_anti"),
        gone.groupBy(source).agg(F.count("*").alias("deleted")),
    )
