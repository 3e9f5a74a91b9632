"""Scores texts with a probabilistic suffix tree over words, learned from the corpus.

The symbols are the words of the training texts in lower case, one end per text, and one symbol for all
other words. A context of up to DEPTH words is a state of the tree when it occurs LEAST_COUNT times and
what follows it diverges enough from what follows its longest suffix, or when it is the suffix of a state.
A state keeps the successors that it has twice or more, discounted; the rest of its probability goes to
its suffix's distribution. The empty context discounts every word and gives the rest to the unknown
symbol, so each distribution adds up to one. A token is scored by the longest suffix state before it.

Counting covers all training texts, level by level: a context is counted only where the words that make
it up were seen often enough, which a filter of bits tells; what the filter lets through wrongly is
dropped by a join. The tree is a table that grows with the corpus. A token's log chance is a sum over
its states: of what the state leaves to its suffix, or of what the state's own successor adds. So a text
asks for keys and adds up their values. The most frequent keys, a bounded number, go to all executors;
every other one is looked up where the keys that the texts ask for are dealt. Word counts are split in
the same way.

Counts, keys and answers outnumber the words of the corpus, so they are dealt in blocks: a task's rows of
a bucket are one compressed value. Tables that no later step reads and the shuffles of written ones go
at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cinderleaf.llm import wordhash
from cinderleaf.llm.common import attach, remainder, shuffle_partitions, whole
from cinderleaf.session import discard, shuffles_dropped, written

DEPTH = 2
# Occurrences and nats of divergence that make a context a state; occurrences that keep a successor.
LEAST_COUNT, DIVERGENCE, LEAST_FOLLOWER = 16, 0.01, 2
# What is taken from every kept successor of a state.
DISCOUNT = 0.75
# Words whose counts are sent to all executors, and for each of them keys of the tree.
FREQUENT, KEYS_A_WORD = 1 << 19, 1
# Distinct keys a task holds before it hands its counts on, and how many at once; bytes of text it looks at.
HELD, HANDED, SLICE = 1 << 20, 1 << 16, 512 << 10
# The end of a text as a symbol; words with a number come after it, the others are negative.
END, FIRST = 1, 2
SIGN = np.uint64(1 << 63)
# A filter has 16 bits a key, up to 2 ** SIEVE_BITS, and is filled in so many slices.
SIEVE_BITS, SLICES = 26, 16
STEP = np.uint64(wordhash.BASE)
# Keys that a task sends at once. Training tokens whose contexts make a bucket, and tokens whose keys do.
SENT, COUNTED, SOUGHT = 1 << 19, 1 << 20, 1 << 21
BLOCK = "bucket int, size long, data binary"
HEADS = "row long, id long, held_out boolean, n_tokens long, known long, logs double, chances double"
FOUND = f"{HEADS}, one long, log double, chance double"

Columns = list[np.ndarray]


def _combined(columns: Columns, counts: np.ndarray) -> tuple[Columns, np.ndarray]:
    """The distinct rows of the columns and the sums of their counts; a row may be told twice."""
    key = columns[0].view(np.uint64)
    for column in columns[1:]:  # rows whose sums agree by chance may interleave
        key = key * STEP + column.view(np.uint64)
    order = np.argsort(key)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(counts[order], first)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _batches(columns: Columns, names: list[str]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]), HANDED):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + HANDED]) for c in columns], names=names)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of every hash, by its leading 32 bits."""
    return ((hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def packed(buckets: np.ndarray, columns: Columns) -> pa.RecordBatch:
    """Rows of 64-bit values as a block a bucket: the steps of the first column, the others, byte by byte.

    They lie in order of the first column's lower bits, so what the steps save does not hang on its range.
    """
    order = np.argsort((buckets << np.uint64(40)) | (columns[0].view(np.uint64) & np.uint64((1 << 40) - 1)))
    buckets, columns = buckets[order], [c[order].view(np.uint64) for c in columns]
    edges = np.append(np.flatnonzero(np.diff(buckets)) + 1, len(order))
    sizes, data, a = np.diff(edges, prepend=0), [], 0
    for b in edges.tolist():
        steps = np.diff(columns[0][a:b], prepend=np.uint64(0))
        values = np.stack([steps, *(c[a:b] for c in columns[1:])]).view(np.uint8).reshape(len(columns), b - a, 8)
        planes = np.ascontiguousarray(values.transpose(0, 2, 1))  # bytes that agree in most rows come together
        data.append(pa.compress(planes, codec="zstd", asbytes=True))
        a = b
    arrays = [pa.array(buckets[edges - 1].astype(np.int32)), pa.array(sizes), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=_names(BLOCK))


def unpacked(size: int, data: bytes, n_columns: int) -> Columns:
    """The columns of a block."""
    raw = pa.decompress(data, 8 * n_columns * size, codec="zstd")
    planes = np.frombuffer(raw, np.uint8).reshape(n_columns, 8, size)
    columns = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64).reshape(n_columns, size)
    return [np.cumsum(columns[0]), *columns[1:]]


class Counter:
    """Counts rows of 64-bit values in bounded memory; hands over columns and counts that may repeat a row."""

    def __init__(self) -> None:
        self.held: list[tuple[Columns, np.ndarray]] = []

    def _merge(self) -> None:
        columns = [np.concatenate(c) for c in zip(*(h[0] for h in self.held), strict=True)]
        self.held = [_combined(columns, np.concatenate([h[1] for h in self.held]))]

    def add(self, columns: Columns) -> Iterator[tuple[Columns, np.ndarray]]:
        if not len(columns[0]):
            return
        self.held.append(_combined(columns, np.ones(len(columns[0]), np.int64)))
        if sum(len(h[1]) for h in self.held) > HELD:
            self._merge()
            if len(self.held[0][1]) > HELD // 2:
                yield self.held.pop()

    def rest(self) -> Iterator[tuple[Columns, np.ndarray]]:
        if self.held:
            self._merge()
            yield self.held.pop()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (key, n): the hashes of the words."""
    counter = Counter()

    def counted() -> Iterator[tuple[Columns, np.ndarray]]:
        for batch in batches:
            for a, b in wordhash.slices(batch.column(0), SLICE):
                yield from counter.add([wordhash.word_hashes(*wordhash.text_bytes(batch.column(0).slice(a, b - a)))[0]])
        yield from counter.rest()

    for (keys,), n in counted():
        yield from _batches([keys.view(np.int64), n], ["key", "n"])


class Lookup:
    """Finds 64-bit hashes among sorted ones from where their leading bits begin."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        leading = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.starts = np.append(np.searchsorted(keys, leading), len(keys)).astype(np.int32)
        self.keys = np.append(keys, np.uint64(wordhash.MASK))
        self.steps = int(np.diff(self.starts).max()) - 1

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of every hash, whether it is there)."""
        group = asked >> self.shift
        at, end = self.starts[group], self.starts[group + np.uint64(1)]
        last = end - 1
        for _ in range(self.steps):
            at = at + ((at < last) & (self.keys[at] < asked))
        return at, (at < end) & (self.keys[at] == asked)


def symbols_of(hashes: np.ndarray, known: Lookup, numbers: np.ndarray) -> np.ndarray:
    """The symbol of every word: its number, or its hash as a negative value."""
    at, there = known.find(hashes)
    out = (hashes | SIGN).view(np.int64)
    out[there] = numbers[at[there]]
    return out


def streams(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts: an end, the words, an end; first symbol of each text)."""
    n_docs = len(first) - 1
    begin = first + 2 * np.arange(n_docs + 1)
    out = np.full(begin[-1], END, np.int64)
    owners = np.repeat(np.arange(n_docs), np.diff(first))
    out[np.arange(len(symbols)) + 2 * owners + 1] = symbols
    return out, begin


def _mixed(values: np.ndarray) -> np.ndarray:
    return wordhash.mix(np.ascontiguousarray(values).view(np.uint64))


def _sum(level: int, code: np.ndarray) -> np.ndarray:
    """A context's polynomial over its mixed symbols, the latest lowest."""
    return _mixed(code) if level == 1 else code.view(np.uint64)


def context_codes(stream: np.ndarray, begin: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per level from 1 on: (code of the context in front of every symbol, whether there is one).

    A code is the symbol for one word and the polynomial for more. A context never reaches back beyond
    the end in front of its text.
    """
    place = np.arange(len(stream)) - np.repeat(begin[:-1], np.diff(begin))
    mixed, total, power = _mixed(stream), np.zeros(len(stream), np.uint64), np.uint64(1)
    for level in range(1, depth + 1):
        total[level:] += mixed[:-level] * power
        power = power * STEP
        if level == 1:
            code = np.zeros(len(stream), np.int64)
            code[1:] = stream[:-1]
        else:
            code = total.view(np.int64).copy()
        yield code, place >= level


def tree_keys(level: int, code: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """The keys of states or, with the symbols after them, of their successors."""
    own = _sum(level, code) * np.uint64(wordhash.PLACES[1]) + np.uint64(level)
    if after is not None:
        own = own + _mixed(after) * np.uint64(wordhash.PLACES[2])
    return wordhash.mix(own)


def sieve(keys: DataFrame) -> np.ndarray:
    """Bits that are set where a `key` begins with them; a key whose bit is not set is not in the table."""
    size = min(SIEVE_BITS, max(12, (16 * keys.count()).bit_length()))
    each = 1 << (size - SLICES.bit_length() + 1)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            places = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - size)
            owners = places // np.uint64(each)
            for s in np.unique(owners).tolist():
                slices.setdefault(s, np.zeros(each, bool))[places[owners == s] - np.uint64(s * each)] = True
        for s, bits in slices.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([s]), pa.array([np.packbits(bits).tobytes()])], names=["slice", "bits"]
            )

    dealt = keys.select("key").repartition(SLICES, F.shiftrightunsigned("key", 64 - SLICES.bit_length() + 1))
    out = np.zeros((SLICES, each // 8), np.uint8)
    for r in dealt.mapInArrow(fill, "slice long, bits binary").collect():
        out[r["slice"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def passing(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a key's bit is set."""
    place = keys.view(np.uint64) >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return (bits[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1 > 0


def _mapped(df: DataFrame, names: list[str], schema: str, make: Callable[..., Columns]) -> DataFrame:
    """The columns of the schema, as `make` gives them for arrays of the named columns."""
    fields = _names(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.array(c) for c in make(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))]
            yield pa.RecordBatch.from_arrays(made, names=fields)

    return df.select(*names).mapInArrow(run, schema)


def _stored(df: DataFrame) -> DataFrame:
    with shuffles_dropped(df.sparkSession):
        return written(df)


def merged_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, size, data) in order of buckets to (code, next, n): what is there twice or more."""
    blocks: list[Columns] = []
    last = -1

    def told() -> Iterator[pa.RecordBatch]:
        if blocks:
            *columns, n = (np.concatenate(c) for c in zip(*blocks, strict=True))
            columns, n = _combined(columns, n)
            often = n >= LEAST_FOLLOWER
            yield from _batches([*(c[often] for c in columns), n[often]], ["code", "next", "n"])

    for batch in batches:
        for bucket, size, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != last:
                yield from told()
                blocks.clear()
                last = bucket
            blocks.append(unpacked(size, data, 3))
    yield from told()


def successor_counts(
    training: DataFrame, sent: Broadcast, level: int, may: np.ndarray | None, least: int, unnumbered: bool, tokens: int
) -> DataFrame:
    """(code, next, n) of the contexts of a level and what follows them twice or more.

    `may` is the filter of the contexts that occur often enough; at the first level the words' own counts
    tell, and `unnumbered` whether words without a number can. Buckets are as many as `tokens` asks for.
    """
    parts = shuffle_partitions(training.sparkSession)
    buckets = parts * -(-tokens // (parts * COUNTED))
    bits = training.sparkSession.sparkContext.broadcast(may)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Columns, np.ndarray]]:
        known_words, numbers, by_number = sent.value
        counter = Counter()
        for batch in batches:
            for a, b in wordhash.slices(batch.column(0), SLICE):
                data, offsets = wordhash.text_bytes(batch.column(0).slice(a, b - a))
                hashes, first, _, _ = wordhash.word_hashes(data, offsets)
                stream, begin = streams(symbols_of(hashes, known_words, numbers), first)
                for code, some in context_codes(stream, begin, level):
                    pass
                if level == 1:
                    some = some & np.where(code > 0, by_number[np.maximum(code, 0)] >= least, unnumbered)
                else:
                    some[some] = passing(bits.value, code[some])
                yield from counter.add([code[some], stream[some]])
        yield from counter.rest()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (code, after), n in counted(batches):
            mixed = wordhash.mix(code.view(np.uint64) * STEP + after.view(np.uint64))
            yield packed(bucket_of(mixed, buckets), [code, after, n])

    runs = training.mapInArrow(count, BLOCK).repartitionById(parts, "bucket").sortWithinPartitions("bucket")
    counts = _stored(runs.mapInArrow(merged_counts, "code long, next long, n long"))
    bits.destroy()
    return counts


def grow_tree(
    training: DataFrame,
    words: DataFrame,
    sent: Broadcast,
    ends: int,
    tokens: int,
    discount: float,
    unnumbered: bool,
    depth: int,
    least: int,
    divergence: float = DIVERGENCE,
) -> DataFrame:
    """(key, n, value): the states and their kept successors, how often they occur and what they add.

    `value` of a state is the log10 of what it leaves to its suffix; that of a successor is the log10 of
    its chance after the state over its chance after the state's suffix, less the state's value.
    """

    def numbered(hashes: np.ndarray, n: np.ndarray) -> Columns:
        known, numbers, _ = sent.value
        return [symbols_of(hashes.view(np.uint64), known, numbers), n]

    symbols = _mapped(words, ["key", "n"], "symbol long, n long", numbered)
    contexts = symbols.where(F.col("n") >= least).select(
        F.col("symbol").alias("code"), F.lit(0).cast("long").alias("suffix"), F.col("n").alias("total")
    )
    if ends >= least:
        contexts = contexts.unionByName(
            training.sparkSession.range(1).select(
                F.lit(END).cast("long").alias("code"), F.lit(0).cast("long").alias("suffix"),
                F.lit(ends).cast("long").alias("total"),
            )
        )
    levels: list[tuple[DataFrame, DataFrame, int]] = []
    may = None
    for level in range(1, depth + 1):
        pairs = successor_counts(training, sent, level, may, least, unnumbered, tokens)
        if level == 1:
            # chances of the successors alone: of numbered words at once, of the others by their counts
            def alone(code: np.ndarray, after: np.ndarray, n: np.ndarray) -> Columns:
                found = np.where(after > 0, sent.value[2][np.maximum(after, 0)], 0).astype(np.int64)
                return [code, after, n, found]

            own = _mapped(pairs, ["code", "next", "n"], "code long, next long, n long, times long", alone)
            rare = symbols.where("symbol < 0").select(F.col("symbol").alias("next"), F.col("n").alias("times"))
            others = own.where("next < 0").drop("times").join(rare, "next")
            own = own.where("next > 0").unionByName(others)
            own = own.withColumn("before", (F.col("times") - discount) / tokens).drop("times")
        else:
            own = pairs
        sizes = own.groupBy("code").agg(
            F.count("*").alias("size"), F.sum(F.col("n") - DISCOUNT).alias("taken")
        )
        left = F.greatest(1 - F.col("taken") / F.col("total"), F.lit(1e-12))
        groups = _stored(sizes.join(contexts, "code").withColumn("left", left).drop("taken"))
        if level > 1:
            discard(contexts)
        n_pairs = max(pairs.count(), 1)
        own = attach(own, groups, ["code"], "size", n_pairs)
        if level > 1:
            # a successor kept after a context is kept after its suffix
            shorter = levels[-1][0].select(F.col("code").alias("suffix"), "next", F.col("now").alias("before"))
            own = own.join(shorter, ["suffix", "next"])
        now = (F.col("n") - DISCOUNT) / F.col("total") + F.col("left") * F.col("before")
        own = _stored(own.select("code", "suffix", "next", "n", "before", now.alias("now")))
        discard(pairs)
        gains = own.groupBy("code").agg(
            F.sum(F.col("now") * F.log(F.col("now") / F.col("before"))).alias("gain"),
            F.greatest(1 - F.sum("now"), F.lit(1e-12)).alias("rest"),
            F.greatest(1 - F.sum("before"), F.lit(1e-12)).alias("rest_before"),
        )
        gain = F.col("gain") + F.col("rest") * F.log(F.col("rest") / F.col("rest_before"))
        diverging = gains.select("code", (gain >= divergence).alias("own"))
        levels.append((own, _stored(groups.join(diverging, "code")), n_pairs))
        discard(groups)
        if level == depth:
            break

        def longer(code: np.ndarray, after: np.ndarray, suffix: np.ndarray, n: np.ndarray, level: int = level) -> Columns:
            """The contexts that end in a successor."""
            mixed = _mixed(after)
            code = (mixed + STEP * _sum(level, code)).view(np.int64)
            suffix = after if level == 1 else (mixed + STEP * _sum(level - 1, suffix)).view(np.int64)
            return [code, suffix, n]

        often = own.where((F.col("n") >= least) & (F.col("next") != END))
        contexts = _stored(
            _mapped(often, ["code", "next", "suffix", "n"], "code long, suffix long, total long", longer)
        )
        may = sieve(contexts.select(F.col("code").alias("key")))

    tree, needed, done = [], None, []
    for level in range(depth, 0, -1):
        own, states, n_pairs = levels[level - 1]
        done += [own, states]
        kept = states.where("own")
        if needed is not None:  # a state's suffix is a state
            kept = _stored(states.join(needed, "code", "left").where("own OR needed"))
            done.append(kept)
        needed = kept.select(F.col("suffix").alias("code"), F.lit(True).alias("needed")).distinct()

        def state(code: np.ndarray, n: np.ndarray, value: np.ndarray, level: int = level) -> Columns:
            return [tree_keys(level, code).view(np.int64), n, value]

        def successor(
            code: np.ndarray, after: np.ndarray, n: np.ndarray, value: np.ndarray, level: int = level
        ) -> Columns:
            return [tree_keys(level, code, after).view(np.int64), n, value]

        schema = "key long, n long, value double"
        left = F.log10("left")
        tree.append(_mapped(kept.withColumn("value", left), ["code", "total", "value"], schema, state))
        after = attach(own.drop("suffix"), kept.select("code", "size", "left"), ["code"], "size", n_pairs)
        value = F.log10(F.col("now") / F.col("before")) - left
        tree.append(_mapped(after.withColumn("value", value), ["code", "next", "n", "value"], schema, successor))
    found = _stored(reduce(DataFrame.unionByName, tree))
    discard(*done)
    return found


def _steps(n: Column) -> Column:
    """A count's step on a scale of sixteen steps an octave: a bounded number of steps."""
    return F.floor(F.log2(n.cast("double")) * 16)


def frequent_rows(rows: DataFrame, most: int) -> int:
    """The lowest step of `n` such that at most `most` rows are at it or above."""
    steps = rows.groupBy(_steps(F.col("n")).alias("step")).agg(F.count("*").alias("rows")).collect()
    left, lowest = most, 1 << 20
    for step, n in sorted(steps, reverse=True):
        if n > left:
            break
        left, lowest = left - n, step
    return lowest


def _by_key(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, what belongs to them), read as Arrow columns: rows of Python objects take far more memory."""
    found = rows.toArrow()
    keys = found.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column(1).to_numpy()[order]


def _dealt(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of the rows of a table whose first column is a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            if sum(len(h[0]) for h in held) > SENT:
                yield _block_rows(held, buckets)
                held = []
        if any(len(h[0]) for h in held):
            yield _block_rows(held, buckets)

    return run


def _block_rows(held: list[Columns], buckets: int) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    return packed(bucket_of(columns[0], buckets), columns)


def _found(discount: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A bucket's answers, then what its texts ask for, to what each text gains; heads are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: list[Columns] = []
        known = None
        for batch in batches:
            kinds, sizes, data = (batch.column(c) for c in ("kind", "size", "data"))
            heads = batch.filter(pc.equal(kinds, 2)).select(_names(HEADS))
            zeros = np.zeros(len(heads), np.int64)
            none = [pa.array(zeros), pa.array(zeros.astype(float)), pa.array(zeros.astype(float))]
            yield pa.RecordBatch.from_arrays([*heads.columns, *none], names=_names(FOUND))
            for kind, size, block in zip(kinds.to_pylist(), sizes.to_pylist(), data, strict=True):
                if kind == 0:
                    answers.append(unpacked(size, block.as_buffer(), 3))
                elif kind == 1 and answers:
                    if known is None:
                        keys, n, value = (np.concatenate(c) for c in zip(*answers, strict=True))
                        order = np.argsort(keys.view(np.uint64))
                        known, n = Lookup(keys.view(np.uint64)[order]), n[order]
                        one = n > 0
                        log, value = np.where(one, np.log10(n + 1.0), 0.0), value.view(np.float64)[order]
                        chance = np.where(one, np.log10(np.where(one, n - discount, 1.0)), value)
                    key, row = unpacked(size, block.as_buffer(), 2)
                    at, there = known.find(key.view(np.uint64))
                    at = at[there]
                    rows, owners = np.unique(row[there], return_inverse=True)
                    sums = [np.bincount(owners, weights=c[at], minlength=len(rows)) for c in (one, log, chance)]
                    arrays = [pa.array(rows), *(pa.nulls(len(rows), c.type) for c in heads.columns[1:])]
                    arrays += [pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
                    yield pa.RecordBatch.from_arrays(arrays, names=_names(FOUND))

    return run


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    parts: int = 7,
    held: int = 2,
    depth: int = DEPTH,
    least: int = LEAST_COUNT,
    frequent: int = FREQUENT,
) -> DataFrame:
    """Per row of `docs`: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32(id as text) mod `parts` is `held` are not learned from. A null text is empty and
    has the end as its only token; a null id counts as the empty text in the remainder; rows that repeat
    an id are scored on their own. An empty table gives an empty result. Without training texts every
    token is the unknown symbol, whose probability is then one. Other columns are not read. `least` (2 at
    least) is how often a context occurs to be a state; `frequent` bounds what is sent to all executors
    and changes no result.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (remainder(id_col, parts) == held).alias("held_out"),
        whole(text).alias("text"),
    )
    training = rows.where("NOT held_out").select("text")
    words = _stored(
        training.mapInArrow(count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    )
    ends = training.count()
    found = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    ).first()
    tokens, kinds = found[0] + ends, found[1] + (ends > 0)
    once, twice = found[2] + (ends == 1), found[3] + (ends == 2)
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
    lowest = frequent_rows(words, frequent)
    keys, counts = _by_key(words.where(_steps(F.col("n")) >= lowest).select("key", "n"))
    numbers = np.empty(len(keys), np.int64)  # the most frequent words have the smallest numbers
    ranked = np.argsort(-counts, kind="stable")
    numbers[ranked] = np.arange(FIRST, len(keys) + FIRST)
    by_number = np.concatenate([[0, ends], counts[ranked]]).astype(np.int64)
    sent = spark.sparkContext.broadcast((Lookup(keys), numbers, by_number))
    unnumbered = int(np.floor(np.log2(least) * 16)) < lowest
    tree = grow_tree(training, words, sent, ends, max(tokens, 1), discount, unnumbered, depth, least)
    lowest_key = frequent_rows(tree, KEYS_A_WORD * frequent)
    top = _by_key(tree.where(_steps(F.col("n")) >= lowest_key).select("key", "value"))
    others = tree.where(_steps(F.col("n")) < lowest_key)
    model = spark.sparkContext.broadcast((Lookup(top[0]), top[1], sieve(others)))
    del top

    buckets = max(spark.sparkContext.defaultParallelism, -(-tokens // SOUGHT))
    sought = f"{BLOCK}, kind int, {HEADS}"

    def asking(held: list[Columns]) -> pa.RecordBatch:
        blocks = _block_rows(held, buckets)
        kinds = [pa.array(np.ones(len(blocks), np.int32)), *(pa.nulls(len(blocks), t) for t in types[4:])]
        return pa.RecordBatch.from_arrays([*blocks.columns, *kinds], names=_names(sought))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text, its head, and blocks of the keys that the texts ask for."""
        held: list[Columns] = []
        known_words, numbers, by_number = sent.value
        carried, values, bits = model.value
        for batch in batches:
            for a, b in wordhash.slices(batch.column(3), SLICE):
                size = b - a
                data, offsets = wordhash.text_bytes(batch.column(3).slice(a, size))
                hashes, first, _, _ = wordhash.word_hashes(data, offsets)
                symbols = symbols_of(hashes, known_words, numbers)
                n_words = np.diff(first)
                owners = np.repeat(np.arange(size), n_words)
                hit = symbols > 0
                n = by_number[symbols[hit]]
                logs = np.bincount(owners[hit], weights=np.log10(n + 1.0), minlength=size)
                chances = np.bincount(owners[hit], weights=np.log10(n - discount), minlength=size)
                known = np.bincount(owners[hit], minlength=size).astype(np.int64)
                asked = [(owners[~hit], hashes[~hit])]
                stream, begin = streams(symbols, first)
                owners = np.repeat(np.arange(size), np.diff(begin))

                def look_up(places: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    """(what the texts gain from the keys sent along, where the keys may be in the tree)."""
                    at, there = carried.find(key)
                    gained = np.bincount(owners[places[there]], weights=values[at[there]], minlength=size)
                    ask = ~there
                    ask[ask] = passing(bits, key[ask])
                    asked.append((owners[places[ask]], key[ask]))
                    return gained, there | ask

                live = np.arange(len(stream))
                for level, (code, some) in enumerate(context_codes(stream, begin, depth), 1):
                    live = live[some[live]]
                    gained, there = look_up(live, tree_keys(level, code[live]))
                    live = live[there]  # what is no state has neither successors nor longer states
                    chances += gained + look_up(live, tree_keys(level, code[live], stream[live]))[0]
                owner, key = (np.concatenate(c) for c in zip(*asked, strict=True))
                row = batch.column(0).slice(a, size).to_numpy()
                heads = [
                    pa.array(row), batch.column(1).slice(a, size), batch.column(2).slice(a, size),
                    pa.array(n_words.astype(np.int64) + 1), pa.array(known),
                    pa.array(logs.astype(np.float64)), pa.array(chances.astype(np.float64)),
                ]
                kinds = [pa.array((row % buckets).astype(np.int32)), *(pa.nulls(size, t) for t in types[1:3]), pa.array(np.full(size, 2, np.int32))]
                yield pa.RecordBatch.from_arrays([*kinds, *heads], names=_names(sought))
                if len(key):
                    held.append([key.view(np.int64), row[owner]])
                if sum(len(h[0]) for h in held) > SENT:
                    yield asking(held)
                    held = []
        if held:
            yield asking(held)

    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text")
    types = [f.type for f in to_arrow_schema(StructType.fromDDL(sought))]
    asks = rows.mapInArrow(scored, sought)
    answers = words.where(_steps(F.col("n")) < lowest).select("key", "n", F.lit(0.0).alias("value"))
    answers = answers.unionByName(others.select("key", F.lit(0).cast("long").alias("n"), "value"))
    answers = answers.mapInArrow(_dealt(buckets), BLOCK).withColumn("kind", F.lit(0))
    both = asks.unionByName(answers, allowMissingColumns=True).repartitionById(buckets, "bucket")
    answered = both.sortWithinPartitions("kind").mapInArrow(_found(discount), FOUND).groupBy("row").agg(
        *(F.max(c).alias(c) for c in _names(HEADS)[1:]), *(F.sum(c).alias(c) for c in ("one", "log", "chance"))
    )
    end_known = int(ends > 0)
    per_token = float(np.log10(tokens + kinds + 1))
    log_tokens = float(np.log10(tokens)) if tokens else 0.0
    unknown = float(np.log10(discount * kinds / tokens)) if tokens else 0.0
    n_tokens, n_known = F.col("n_tokens"), F.col("known") + F.col("one") + end_known
    base = F.col("logs") + F.col("log") + float(np.log10(ends + 1))
    end_chance = float(np.log10(ends - discount)) if ends else 0.0
    chance = F.col("chances") + F.col("chance") + end_chance - n_known * log_tokens
    return answered.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        n_known.alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (base - n_tokens * per_token).alias("base_score"),
        (chance + (n_tokens - n_known) * unknown).alias("score"),
    )
