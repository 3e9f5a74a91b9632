"""Spelling variants of words by k-d trees over letter counts.

A word is a vector of letter counts, the letters a to z in places of their own and all others in six more.
One replaced letter takes one from a count and adds one to another, one inserted letter adds one: near words
are at an L1 distance of two at most, and for a pair of lengths the direction of the change is known too. A k-d
tree over the vectors of one length therefore needs to be searched only where its boxes lie within one step up
and one step down of the word. What is left in a leaf is compared by counts, and then letter by letter.

The upper part of every length's tree is drawn from a bounded sample and deals the words to cells; a word goes
to the one cell that holds it and, as a query, to all cells whose box it can reach. A cell then has a tree of its
own. The sample only places the cuts: every word lies in a cell, and every reachable cell is searched.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderleaf.llm.common import shuffle_partitions, whole
from cinderleaf.session import checkpoint

PLACES = 32
# Words of the sample that places the cuts, about, all lengths together; words a cell and a leaf hold about.
SAMPLE, CELL, LEAF = 100_000, 4_000, 64
# Words a task counts before it hands them on, and letters compared at a time.
HELD, LETTERS = 200_000, 8 << 20
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
COUNTED = "word string, n long"
ROUTED = "cell int, query boolean, word string"
NEAR = "word string, near string"

_PLACE = np.array([c - 97 if 97 <= c <= 122 else 26 + c % (PLACES - 26) for c in range(256)])


def letters(words: list[bytes], width: int) -> np.ndarray:
    """The Latin-1 letters of words of one length, a row each."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), width)


def letter_counts(rows: np.ndarray) -> np.ndarray:
    """The vector of every word."""
    n, width = rows.shape
    at = np.repeat(np.arange(n) * PLACES, width) + _PLACE[rows].reshape(-1)
    return np.bincount(at, minlength=n * PLACES).reshape(n, PLACES).astype(np.int32)


def packed(vectors: np.ndarray) -> np.ndarray:
    """The vectors with four bits a count, as many set as the count, at most four: an L1 distance by counting bits."""
    bits = (vectors[:, :, None] > np.arange(4)).reshape(len(vectors), -1)
    return np.packbits(bits, axis=1).view(np.uint64)


def build(vectors: np.ndarray, size: int) -> list[tuple[int, int, int, int]]:
    """The cuts of a k-d tree whose leaves hold about `size` vectors: (place, most on the left, left, right).

    The first node is the root; a negative child -1 - k is the leaf k, leaves counted from the left.
    """
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0

    def grow(own: np.ndarray) -> int:
        nonlocal leaves
        if len(own) > size:
            part = vectors[own]
            place = int(part.var(axis=0).argmax())
            values = np.sort(part[:, place])
            if values[0] < values[-1]:
                cut = int(values[(len(values) - 1) // 2])
                cut = cut if cut < values[-1] else int(values[np.searchsorted(values, cut) - 1])
                at = len(nodes)
                nodes.append((place, cut, 0, 0))
                left = grow(own[part[:, place] <= cut])
                right = grow(own[part[:, place] > cut])
                nodes[at] = (place, cut, left, right)
                return at
        leaves += 1
        return -leaves

    grow(np.arange(len(vectors)))
    return nodes


def leaf_of(nodes: list[tuple[int, int, int, int]], vectors: np.ndarray) -> np.ndarray:
    """The leaf of every vector."""
    out = np.zeros(len(vectors), np.int64)
    waiting = [(0 if nodes else -1, np.arange(len(vectors)))]
    while waiting:
        node, own = waiting.pop()
        if node < 0:
            out[own] = -1 - node
            continue
        place, cut, left, right = nodes[node]
        low = vectors[own, place] <= cut
        waiting += [(left, own[low]), (right, own[~low])]
    return out


def reachable(nodes: list[tuple[int, int, int, int]], vectors: np.ndarray, down: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, vectors whose change by one step up, and with `down` one step down too, may lie in its box).

    A box that is more than one step away in either direction is pruned.
    """
    steps = np.zeros(len(vectors), np.int8)
    waiting = [(0 if nodes else -1, np.arange(len(vectors)), steps, steps, {})]
    while waiting:
        node, own, up, under, box = waiting.pop()
        if not len(own):
            continue
        if node < 0:
            yield -1 - node, own
            continue
        place, cut, left, right = nodes[node]
        value = vectors[own, place]
        low, high = box.get(place, (0, 1 << 30))
        # to the left half the count must fall to `cut` at least, to the right half rise above it
        less = under + np.maximum(0, value - cut) - np.maximum(0, value - high)
        more = up + np.maximum(0, cut + 1 - value) - np.maximum(0, low - value)
        near = less <= (1 if down else 0)
        waiting.append((left, own[near], up[near], less[near], {**box, place: (low, min(cut, high))}))
        near = more <= 1
        waiting.append((right, own[near], more[near], under[near], {**box, place: (max(cut + 1, low), high)}))


def _one_edit(queries: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced letter, or by one that the wider member has more."""
    width = queries.shape[1]
    if members.shape[1] == width:
        return (queries != members).sum(axis=1) == 1
    ahead = queries == members[:, :width]
    behind = queries == members[:, 1:]
    same = np.where(ahead.all(axis=1), width, ahead.argmin(axis=1))
    back = behind[:, ::-1]
    return same + np.where(back.all(axis=1), width, back.argmin(axis=1)) >= width


def near_pairs(queries: list[bytes], members: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, member) numbers that are one edit apart; queries have one length, members the same or one more."""
    wide, own = len(members[0]), len(queries[0])
    asked, held = letters(queries, own), letters(members, wide)
    query, member = letter_counts(asked), letter_counts(held)
    nodes = build(member, LEAF)
    leaf = leaf_of(nodes, member)
    order = np.argsort(leaf, kind="stable")
    bounds = np.searchsorted(leaf[order], np.arange(leaf.max() + 2))
    asks, holds = packed(query), packed(member)
    for k, some in reachable(nodes, query, down=wide == own):
        inside = order[bounds[k] : bounds[k + 1]]
        step = max(1, LETTERS // (max(1, len(inside)) * max(PLACES, wide)))
        for at in range(0, len(some), step):
            part = some[at : at + step]
            apart = np.zeros((len(part), len(inside)), np.uint8)
            for column in range(asks.shape[1]):
                apart += np.bitwise_count(asks[part, column][:, None] ^ holds[inside, column][None, :])
            i, j = np.nonzero(apart <= 1 + (wide == own))
            i, j = part[i], inside[j]
            right = _one_edit(asked[i], held[j])
            yield i[right], j[right]


def _changed(doc_id: object, words: Counter) -> Iterator[tuple[str, int]]:
    """The words of a document; of those whose crc32 with the id 31 divides, one letter is dropped."""
    head = f"{doc_id}:".encode()
    for word, n in words.items():
        h = zlib.crc32(word.encode(), zlib.crc32(head))
        if h % 31 == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        yield word, n


def _count(changed: bool):
    """(id, text) to COUNTED rows, summed over what a task holds."""

    def told(total: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own: Counter = Counter()
                for word, n in Counter(RUN.findall(text.as_py())).items():
                    if len(word) >= LEAST_LENGTH:
                        own[word.lower() if word.isascii() else word.translate(LOWER)] += n
                for word, n in _changed("" if doc_id is None else doc_id, own) if changed else own.items():
                    if len(word) >= LEAST_LENGTH:
                        total[word] = total.get(word, 0) + n
                if len(total) > HELD:
                    yield told(total)
                    total = {}
        if total:
            yield told(total)

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", changed: bool = False) -> DataFrame:
    """(word, n) of the runs of Latin letters in all texts, A-Z in lower case: at least 7 letters and twice.

    With `changed`, where 31 divides the crc32 of "<id>:<word>" the word loses the letter at that crc32 modulo
    its length, in all places of the document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text).alias("text"))
    counts = rows.mapInArrow(_count(changed), COUNTED).groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def _upper_trees(words: DataFrame) -> dict[int, tuple[int, list]]:
    """length -> (first cell, cuts): the upper trees over about SAMPLE words drawn by hash.

    A length has about as many cells as its words need; cells are numbered through.
    """
    sizes = {r.length: r.n for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    every = sum(sizes.values())
    drawn = words.select("word").where(F.pmod(F.xxhash64("word", F.lit(7)), F.lit(max(1, every))) < SAMPLE)
    by_length: dict[int, list[bytes]] = {}
    for r in drawn.collect():
        by_length.setdefault(len(r.word), []).append(r.word.encode("latin-1"))
    trees, first = {}, 0
    for length, n in sorted(sizes.items()):
        sample = by_length.get(length, [])
        cells = max(1, n // CELL)
        nodes = build(letter_counts(letters(sample, length)), max(1, len(sample) // cells)) if cells > 1 and len(sample) > 1 else []
        trees[length] = (first, nodes)
        first += len(nodes) + 1
    return trees


def _route(trees: dict[int, tuple[int, list]]):
    """words to ROUTED rows: the word's cell, and the cells it may find near words in."""

    def rows(first: int, leaf: np.ndarray, query: bool, words: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(first + leaf, pa.int32()), pa.array(np.full(len(leaf), query)), words], names=["cell", "query", "word"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.array([w.encode("latin-1") for w in batch.column(0).to_pylist()], object)
            sizes = np.array([len(w) for w in words], np.int64)
            for length in np.unique(sizes):
                own = np.flatnonzero(sizes == length)
                vectors = letter_counts(letters(list(words[own]), int(length)))
                shown = batch.column(0).take(pa.array(own))
                first, nodes = trees[int(length)]
                yield rows(first, leaf_of(nodes, vectors), False, shown)
                for wide in (length, length + 1):
                    if int(wide) in trees:
                        first, nodes = trees[int(wide)]
                        for leaf, some in reachable(nodes, vectors, down=wide == length):
                            yield rows(first, np.full(len(some), leaf), True, shown.take(pa.array(some)))

    return run


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ROUTED rows to NEAR rows, cell by cell; a pair of other lengths is told both ways."""
    cell, members, queries = None, [], {}

    def told() -> Iterator[pa.RecordBatch]:
        for asked in queries.values():
            if not members:
                continue
            both = len(asked[0]) != len(members[0])
            for i, j in near_pairs(asked, members):
                if len(i):
                    a, b = [asked[k].decode("latin-1") for k in i], [members[k].decode("latin-1") for k in j]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a + b if both else a, pa.string()), pa.array(b + a if both else b, pa.string())],
                        names=["word", "near"],
                    )

    for batch in batches:
        for at, query, word in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if at != cell:
                yield from told()
                cell, members, queries = at, [], {}
            raw = word.encode("latin-1")
            if query:
                queries.setdefault(len(raw), []).append(raw)
            else:
                members.append(raw)
    yield from told()


def near_words(words: DataFrame) -> DataFrame:
    """(word, near) of all ordered pairs of `words` (word, distinct, letters of Latin-1) one edit apart."""
    trees = _upper_trees(words)
    routed = words.select("word").mapInArrow(_route(trees), ROUTED)
    cells = routed.repartition(shuffle_partitions(words.sparkSession), "cell").sortWithinPartitions("cell")
    return cells.mapInArrow(_search, NEAR)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: the end of its chain of forms.

    A form is ten times as frequent as its word, so a chain has fewer than twenty links; every round
    doubles what a word has behind it.
    """
    ahead = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = checkpoint(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ahead = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return ahead


def group_variants(words: DataFrame) -> DataFrame:
    """Per row of `words` (word, n): word, n, n_near, form, form_n, root.

    Two words are near if one code point inserted, deleted or replaced turns one into the other. The form of
    a word is its most frequent near word (ties: the smallest), if that is at least ten times as frequent;
    the root follows forms to the last, the word itself without one. Words are distinct, not null and of
    Latin-1 letters; an empty table gives an empty result.
    """
    words = checkpoint(words.select("word", "n"))
    pairs = near_words(words)
    ranked = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = ranked.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near"))).alias("best")
    )
    likely = -F.col("best.order") >= TIMES * F.col("n")
    formed = checkpoint(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(likely, F.col("best.near")).alias("form"),
            F.when(likely, -F.col("best.order")).alias("form_n"),
        )
    )
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
