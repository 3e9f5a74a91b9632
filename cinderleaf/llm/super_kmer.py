"""Removal of word windows that start in an earlier document, by super-k-mers.

The minimiser of a window of 13 words is the smallest hash among its runs of two words. Consecutive windows
with the same minimiser travel as one string of words to the minimiser's bucket, so equal windows of any two
documents meet there, though a window is sent as a few words only. In the bucket windows are sorted by hash
and equal neighbours compared byte by byte; every window finds the smallest document that holds it.

Equal strings of one slice of texts are settled where they are read: the smallest document's travels, the
others are covered as a whole. So however many copies a passage has, a bucket gets one string a slice. Runs
of two words that begin more than 1/1024 of the strings are ranked behind all others, so that windows which
merely touch a frequent phrase go to the bucket of a rarer one; windows of nothing but frequent runs are few
different strings.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderleaf.llm import wordhash
from cinderleaf.llm.common import HOT_KEYS, shuffle_partitions, whole
from cinderleaf.session import checkpoint

WINDOW, RUN = 13, 2
# Buckets a shuffle partition, worked on one after the other, bytes of texts whose strings are made together,
# and bytes of strings a task gathers before it sends them.
BUCKETS, SLICE, HOLD = 8, 1 << 19, 6 << 20
# Bytes that are compared together, and the compression level of strings.
COMPARED = 1 << 20
LEVEL = 3
NO_ID = (1 << 63) - 1
HEAD = "<II"
SENT = "bucket int, covers boolean, data binary"
COVERED = "id long, check long, start int, stop int"
LEFT = "id long, n_words long, n_removed long, kept string"
_TOP = np.uint64(1 << 63)


class Strings:
    """Super-k-mers: their document (id, check), first word there, and bytes joined by single spaces."""

    def __init__(self, ids, checks, starts, data, offsets):
        self.ids, self.checks, self.starts, self.data, self.offsets = ids, checks, starts, data, offsets

    @staticmethod
    def joined(parts: list[Strings]) -> Strings:
        sizes = np.concatenate([[0], *(np.diff(p.offsets) for p in parts)])
        names = ("ids", "checks", "starts", "data")
        return Strings(*(np.concatenate([getattr(p, n) for p in parts]) for n in names), np.cumsum(sizes))

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, order: np.ndarray) -> Strings:
        """The strings of the numbers `order`."""
        buffers = [None, pa.py_buffer(self.offsets), pa.py_buffer(self.data)]
        taken = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), buffers).take(pa.array(order))
        return Strings(self.ids[order], self.checks[order], self.starts[order], *wordhash.text_bytes(taken))

    def stored(self, a: int, b: int) -> bytes:
        """The strings a to b as one compressed value."""
        text = self.data[self.offsets[a] : self.offsets[b]]
        cells = (self.ids[a:b], self.checks[a:b].astype("<u4"), self.starts[a:b].astype("<i4"))
        sizes = np.diff(self.offsets[a : b + 1]).astype("<u4")
        raw = b"".join([*(c.tobytes() for c in cells), sizes.tobytes(), text.tobytes()])
        return struct.pack(HEAD, b - a, len(raw)) + pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)

    @staticmethod
    def read(value: bytes) -> Strings:
        n, size = struct.unpack_from(HEAD, value)
        raw = pa.decompress(value[struct.calcsize(HEAD) :], decompressed_size=size, codec="zstd", asbytes=True)
        ids = np.frombuffer(raw, "<i8", n)
        checks, starts, sizes = np.frombuffer(raw, "<u4", 3 * n, 8 * n).reshape(3, n)
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return Strings(ids, checks.astype(np.int64), starts.astype(np.int64), np.frombuffer(raw, np.uint8, offset=20 * n), offsets)


def _sums(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of every n words in a row."""
    places = wordhash.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(wordhash.PLACES[seed])) | np.uint64(1)
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k, place in enumerate(places):
        out += words[k : k + len(out)] * place
    return wordhash.mix(out)


def _sliding_least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every n values in a row."""
    reach = 1
    while 2 * reach <= n:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return values if reach == n else np.minimum(values[: len(values) - (n - reach)], values[n - reach :])


def minimisers(words: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The minimiser of every window; the sorted runs of `hot` come after all others."""
    runs = _sums(words, RUN, 0) >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, runs), len(hot) - 1)
        runs = np.where(hot[at] == runs, runs | _TOP, runs)
    return _sliding_least(runs, WINDOW - RUN + 1)


def _stretches(words: np.ndarray, first: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first word, words, minimiser) of the super-k-mers of many texts."""
    counts = np.diff(first)
    if len(words) < WINDOW:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    least = minimisers(words, hot)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(owner[: len(least)] == owner[WINDOW - 1 :])
    opens = np.ones(len(at), bool)
    opens[1:] = (least[at[1:]] != least[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
    begin = np.flatnonzero(opens)
    windows = np.diff(np.append(begin, len(at)))
    begin = at[begin]
    return owner[begin], begin, windows + WINDOW - 1, least[begin]


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] and data[b : b + size] are equal; no size is 0."""
    out = np.zeros(len(a), bool)
    step = max(1, COMPARED // max(1, int(sizes.max(initial=1))))
    for at in range(0, len(a), step):
        n = sizes[at : at + step]
        ends = np.cumsum(n)
        inner = np.arange(ends[-1]) - np.repeat(ends - n, n)
        equal = data[np.repeat(a[at : at + step], n) + inner] == data[np.repeat(b[at : at + step], n) + inner]
        out[at : at + step] = np.logical_and.reduceat(equal, ends - n)
    return out


def _settled(strings: Strings, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(travel, covered) of the strings of a slice, `key` hashing their words.

    Of equal strings those of the smallest document travel, once where rows repeat, and the others are covered.
    """
    sizes = np.diff(strings.offsets)
    order = np.lexsort((strings.starts, strings.checks, strings.ids, key))
    opens = np.ones(len(order), bool)
    opens[1:] = key[order[1:]] != key[order[:-1]]
    lead = order[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))]
    alike = np.flatnonzero(~opens)
    alike = alike[sizes[order[alike]] == sizes[lead[alike]]]
    mine, least = order[alike], lead[alike]
    equal = _same_bytes(strings.data, strings.offsets[mine], strings.offsets[least], sizes[mine])
    mine, least, alike = mine[equal], least[equal], alike[equal]
    covered = strings.ids[mine] > strings.ids[least]
    before = order[alike - 1]
    repeat = ~covered & (strings.checks[before] == strings.checks[mine]) & (strings.starts[before] == strings.starts[mine])
    travel = np.ones(len(order), bool)
    travel[mine[covered | repeat]] = False
    return travel, mine[covered]


def slice_strings(
    ids: np.ndarray, checks: np.ndarray, texts: pa.Array, hot: np.ndarray
) -> tuple[Strings, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(strings, minimisers, travel, covered, words of every string) of one slice of texts."""
    data, offsets = wordhash.text_bytes(texts)
    words, first, starts, stops = wordhash.word_hashes(data, offsets, folded=False)
    text, begin, n, least = _stretches(words, first, hot)
    ends = np.cumsum(n)
    inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    word = np.repeat(begin, n) + inner
    spelled = wordhash.spell(data, starts[word], stops[word], np.concatenate([[0], ends]))
    strings = Strings(ids[text], checks[text], begin - first[text], *spelled)
    parts = wordhash.mix(words[word] + wordhash.mix(inner.astype(np.uint64) + np.uint64(wordhash.PLACES[1])))
    key = np.add.reduceat(parts, ends - n) if len(ends) else np.zeros(0, np.uint64)
    travel, covered = _settled(strings, key)
    return strings, least, travel, covered, n


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))


def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, check, text) to (run, strings): the frequent minimisers of each slice, and in a null run all its strings."""
    none = np.zeros(0, np.uint64)
    for batch in batches:
        ids, checks = _columns(batch)
        for a, b in wordhash.slices(batch.column(2), SLICE):
            _, least, travel, _, _ = slice_strings(ids[a:b], checks[a:b], batch.column(2).slice(a, b - a), none)
            runs, counts = np.unique(least[travel], return_counts=True)
            many = counts * HOT_KEYS > counts.sum()
            cells = [*runs[many].view(np.int64).tolist(), None], [*counts[many].tolist(), int(counts.sum())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=["run", "strings"])


def _ranges(texts: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """The unions of ranges of words that touch, text by text."""
    order = np.lexsort((starts, texts))
    texts, starts, stops = texts[order], starts[order], stops[order]
    if not len(order):
        return texts, starts, stops
    # stops shifted text by text, so that the running maximum starts anew with every text
    shift = np.cumsum(np.append(0, texts[1:] != texts[:-1])) * (int(stops.max()) + 1)
    reach = np.maximum.accumulate(stops + shift)
    opens = np.append(True, starts[1:] + shift[1:] > reach[:-1])
    begin = np.flatnonzero(opens)
    return texts[begin], starts[begin], (reach - shift)[np.append(begin[1:], len(order)) - 1]


def _covers(bucket: int, ids: np.ndarray, checks: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.RecordBatch:
    """Ranges of covered words as one SENT row."""
    raw = b"".join(x.astype("<i8").tobytes() for x in (ids, checks, starts, stops))
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([True]), pa.array([raw], pa.binary())], names=["bucket", "covers", "data"]
    )


def sender(hot: np.ndarray, buckets: int):
    """(id, check, text) to SENT rows."""

    def flush(held: list[Strings], targets: list[np.ndarray]) -> pa.RecordBatch:
        strings, to = Strings.joined(held), np.concatenate(targets)
        order = np.argsort(to, kind="stable")
        sent = strings.take(order)
        to = to[order]
        begin = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        values = [sent.stored(a, b) for a, b in zip(begin, np.append(begin[1:], len(to)), strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(to[begin], pa.int32()), pa.array([False] * len(begin)), pa.array(values, pa.binary())],
            names=["bucket", "covers", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, targets, size = [], [], 0
        for batch in batches:
            ids, checks = _columns(batch)
            for a, b in wordhash.slices(batch.column(2), SLICE):
                strings, least, travel, covered, n = slice_strings(ids[a:b], checks[a:b], batch.column(2).slice(a, b - a), hot)
                if len(covered):
                    # as texts (id, check) of a slice; rows that repeat both are covered alike
                    texts = np.unique(np.stack([strings.ids[covered], strings.checks[covered]]), axis=1, return_inverse=True)
                    starts = strings.starts[covered]
                    text, start, stop = _ranges(texts[1].reshape(-1), starts, starts + n[covered])
                    bucket = int(wordhash.mix(np.array([strings.ids[covered[0]]], np.int64).view(np.uint64))[0] % np.uint64(buckets))
                    yield _covers(bucket, texts[0][0][text], texts[0][1][text], start, stop)
                chosen = np.flatnonzero(travel)
                if not len(chosen):
                    continue
                held.append(strings.take(chosen))
                targets.append((wordhash.mix(least[chosen]) % np.uint64(buckets)).astype(np.int64))
                size += len(held[-1].data)
                if size > HOLD:
                    yield flush(held, targets)
                    held, targets, size = [], [], 0
        if held:
            yield flush(held, targets)

    return run


def _exact_least(windows: list[bytes], ids: np.ndarray) -> np.ndarray:
    """The smallest id of every window's text, for windows whose hashes agree though they differ."""
    least: dict[bytes, int] = {}
    for window, i in zip(windows, ids.tolist(), strict=True):
        least[window] = min(i, least.get(window, NO_ID))
    return np.array([least[w] for w in windows], np.int64)


def _words(strings: Strings) -> tuple[np.ndarray, ...]:
    """The word hashes of `word_hashes`, from a slice of the strings after the other."""
    found, at = [], 0
    words = 0
    while at < len(strings):
        stop = max(at + 1, int(np.searchsorted(strings.offsets, strings.offsets[at] + SLICE)))
        base = strings.offsets[at]
        stop = min(stop, len(strings))
        data = strings.data[base : strings.offsets[stop]]
        hashes, first, starts, stops = wordhash.word_hashes(data, strings.offsets[at : stop + 1] - base, folded=False)
        found.append((hashes, first[:-1] + words, starts + base, stops + base))
        words, at = words + len(hashes), stop
    hashes, first, starts, stops = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, np.append(first, words), starts, stops


def repeated_windows(strings: Strings) -> tuple[np.ndarray, np.ndarray]:
    """(string, window in it) of the windows of a bucket that a smaller document holds too."""
    words, first, starts, stops = _words(strings)
    owner = np.repeat(np.arange(len(strings)), np.diff(first))
    at = np.flatnonzero(owner[: len(words) - WINDOW + 1] == owner[WINDOW - 1 :])
    key = _sums(words, WINDOW, 1)[at]
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    same = np.append(key[1:] == key[:-1], False)
    some = same | np.append(False, same[:-1])
    key, at = key[some], at[some]
    if not len(at):
        return at, at
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
    # the leader of a group is its window in the smallest document
    ids = strings.ids[owner[at]]
    order = np.lexsort((ids, group))
    at, ids = at[order], ids[order]
    least, lead = ids[begin][group], at[begin][group]
    sizes = stops[at + WINDOW - 1] - starts[at]
    equal = sizes == stops[lead + WINDOW - 1] - starts[lead]
    later = np.flatnonzero(equal & (at != lead))
    equal[later] = _same_bytes(strings.data, starts[at[later]], starts[lead[later]], sizes[later])
    for g in np.unique(group[~equal]):
        own = np.flatnonzero(group == g)
        spelled = [strings.data[starts[w] : stops[w + WINDOW - 1]].tobytes() for w in at[own]]
        least[own] = _exact_least(spelled, ids[own])
    found = at[ids > least]
    return owner[found], found - first[owner[found]]


def _bucket_covers(values: list[bytes]) -> Iterator[pa.RecordBatch]:
    strings = Strings.joined([Strings.read(v) for v in values])
    string, window = repeated_windows(strings)
    start = strings.starts[string] + window
    string, start, stop = _ranges(string, start, start + WINDOW)
    if len(string):
        yield _covered(strings.ids[string], strings.checks[string], start, stop)


def _covered(ids: np.ndarray, checks: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(checks, pa.int64()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())],
        names=["id", "check", "start", "stop"],
    )


def read_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SENT rows sorted by bucket to COVERED rows; holds one bucket at a time."""
    current, held = None, []
    for batch in batches:
        for bucket, covers, data in zip(*(batch.column(k) for k in range(3)), strict=True):
            value = data.as_buffer().to_pybytes()
            if covers.as_py():
                yield _covered(*np.frombuffer(value, "<i8").reshape(4, -1))
                continue
            if bucket.as_py() != current:
                if held:
                    yield from _bucket_covers(held)
                current, held = bucket.as_py(), []
            held.append(value)
    if held:
        yield from _bucket_covers(held)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, ranges) to LEFT rows."""
    for batch in batches:
        for a, b in wordhash.slices(batch.column(1)):
            data, offsets = wordhash.text_bytes(batch.column(1).slice(a, b - a))
            starts, stops = wordhash.word_spans(data, offsets)
            first = np.searchsorted(starts, offsets)
            ranges = batch.column(2).slice(a, b - a)
            each = ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            cells = ranges.flatten()
            shift = np.repeat(first[:-1], each)
            gone = np.zeros(len(starts) + 1, np.int64)
            np.add.at(gone, cells.field(0).to_numpy(zero_copy_only=False) + shift, 1)
            np.add.at(gone, cells.field(1).to_numpy(zero_copy_only=False) + shift, -1)
            kept = np.cumsum(gone)[: len(starts)] == 0
            kept_first = np.concatenate([[0], np.cumsum(kept)])[first]
            counts = np.diff(first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(counts, pa.int64()),
                    pa.array(counts - np.diff(kept_first), pa.int64()),
                    wordhash.strings(*wordhash.spell(data, starts[kept], stops[kept], kept_first)),
                ],
                names=["id", "n_words", "n_removed", "kept"],
            )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_words, n_removed, kept (the words left, joined by single spaces).

    A word goes if a window of 13 consecutive words covers it whose words also start in a document with a
    smaller id; windows are judged on the input. Words are taken as they are, letter case included. Null,
    empty and white texts have no words. A null id counts as larger than all others. Rows that repeat an id
    are no smaller than each other; they are told apart by the crc32 of their texts, and rows that repeat
    both fare alike. An empty table gives an empty result. Other columns are not read.
    """
    parts = shuffle_partitions(docs.sparkSession)
    own = F.col(id_col).cast("long")
    check = F.crc32(whole(text).cast("binary"))
    rows = docs.select(F.coalesce(own, F.lit(NO_ID)).alias("id"), check.alias("check"), whole(text).alias("text"), own.alias("own"))
    narrow = rows.select("id", "check", "text")
    seen = checkpoint(narrow.mapInArrow(frequent, "run long, strings long").groupBy("run").agg(F.sum("strings").alias("strings")))
    every = seen.where("run IS NULL").first()
    # fewer than HOT_KEYS runs at any size
    many = seen.where("run IS NOT NULL").where(F.col("strings") * HOT_KEYS > (every.strings if every else 0)).collect()
    hot = np.sort(np.array([r.run for r in many], np.int64).view(np.uint64))
    sent = narrow.mapInArrow(sender(hot, parts * BUCKETS), SENT).repartitionById(parts, "bucket")
    covered = sent.sortWithinPartitions("bucket").mapInArrow(read_buckets, COVERED)
    ranges = covered.groupBy("id", "check").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    left = rows.join(ranges, ["id", "check"], "left").select("own", "text", "ranges").mapInArrow(_removed, LEFT)
    return left.withColumnRenamed("id", id_col)
