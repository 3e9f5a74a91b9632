"""Periodic runs of words by difference-cover longest common extensions.

Words of a text are numbers. Of its suffixes only those are sorted that start at a place whose remainder
modulo 7 is in the difference cover {0, 1, 3}: for any two places some shift below 7 takes both to sampled
ones. The sorted suffixes' common prefixes lie in a sparse table, so how far two places agree takes at most
six compared words and one minimum over a range.

A run of period q with at least four periods holds three places in a row of the grid 0, q, 2q, ... at which
the word equals the word q further on. The grids of all periods have n/1 + n/2 + ... places; at the few
that hold such a triple the extension gives the end of the run and a binary search over extensions its start.
Many texts are worked on at once, longest first; a text's suffixes are only sorted among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderleaf.llm import wordhash
from cinderleaf.llm.common import whole

CYCLE, COVER = 7, (0, 1, 3)
# A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
# Grid places that are followed up together: bounds the memory of a task.
TOGETHER = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
FOUND = f"id long, n_words long, runs {RUNS}, collapsed string"

_PLACE = np.full(CYCLE, -1)
_PLACE[list(COVER)] = np.arange(len(COVER))
# for two remainders the smallest shift that takes both into the cover
_SHIFT = np.array(
    [[next(d for d in range(CYCLE) if {(a + d) % CYCLE, (b + d) % CYCLE} <= {*COVER}) for b in range(CYCLE)] for a in range(CYCLE)]
)


def _refine(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Splits the classes of `rank` that `tied` lists by `key`; returns what is still tied.

    A rank is the place of the first member of its class in sorted order.
    """
    order = np.lexsort((key, rank[tied]))
    tied, key = tied[order], key[order]
    old = rank[tied]
    places = np.arange(len(tied))
    opens = np.ones(len(tied), bool)
    opens[1:] = old[1:] != old[:-1]
    parts = opens.copy()
    parts[1:] |= key[1:] != key[:-1]
    begin = np.maximum.accumulate(np.where(opens, places, 0))
    rank[tied] = old + np.maximum.accumulate(np.where(parts, places, 0)) - begin
    return tied[~(parts & np.append(parts[1:], True))]


class Extensions:
    """How far two places of the same text agree.

    `words` are numbers above 0 with one 0 after every text; `doc` is the text of every place.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        self.n = len(words)
        self.words = np.append(words, np.zeros(4 * CYCLE, words.dtype))
        blocks = self.n // CYCLE + 2
        at = (np.arange(blocks)[:, None] * CYCLE + np.array(COVER)).reshape(-1)
        owner = np.append(doc, np.full(3 * CYCLE, doc[-1] + 1 if len(doc) else 0))[at]
        rank = np.searchsorted(owner, owner)
        bits = max(1, int(words.max(initial=0)).bit_length())
        step = max(1, 62 // bits)
        tied = np.arange(len(at))
        wide = np.append(self.words, np.zeros(2 * CYCLE, words.dtype)).astype(np.int64)
        for first in range(0, CYCLE, step):
            if len(tied):
                key = np.zeros(len(tied), np.int64)
                for k in range(first, min(first + step, CYCLE)):
                    key = key << bits | wide[at[tied] + k]
                tied = _refine(rank, tied, key)
        tied = tied[at[tied] < self.n]
        levels, reach = [rank.copy()], CYCLE
        while len(tied):
            ahead = np.minimum(self.place(at[tied] + reach), len(at) - 1)
            tied = _refine(rank, tied, rank[ahead])
            levels.append(rank.copy())
            reach *= 2
        self.rank = rank
        self._table(at, owner, levels)

    @staticmethod
    def place(at: np.ndarray) -> np.ndarray:
        """The number of a sampled place."""
        return at // CYCLE * len(COVER) + _PLACE[at % CYCLE]

    def _table(self, at: np.ndarray, owner: np.ndarray, levels: list[np.ndarray]) -> None:
        """The sparse table of minima over the common prefixes of neighbours in sorted order."""
        order = np.argsort(self.rank, kind="stable")
        left, right = at[order[:-1]], at[order[1:]]
        live = (owner[order[:-1]] == owner[order[1:]]) & (left < self.n) & (right < self.n)
        left, right = left[live], right[live]
        agreed = np.zeros(len(left), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            a, b = self.place(left + agreed), self.place(right + agreed)
            equal = levels[k][np.minimum(a, len(at) - 1)] == levels[k][np.minimum(b, len(at) - 1)]
            agreed += equal * (CYCLE << k)
        going = np.ones(len(left), bool)
        for _ in range(CYCLE - 1):
            going &= self.words[left + agreed] == self.words[right + agreed]
            agreed += going
        row = np.zeros(len(at), np.int32)
        row[1:][live] = agreed
        self.minima = [row]
        for k in range(max(0, len(row).bit_length() - 1)):
            before, half = self.minima[-1], 1 << k
            after = before.copy()
            np.minimum(before[: len(row) - half], before[half:], out=after[: len(row) - half])
            self.minima.append(after)
        self.minima = np.stack(self.minima)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Equal words from `left` and `right` on, places of the same text and left < right."""
        shift = _SHIFT[left % CYCLE, right % CYCLE]
        agreed = np.zeros(len(left), np.int64)
        for k in range(CYCLE - 1):
            going = (agreed == k) & (shift > k)
            agreed += going & (self.words[left + k] == self.words[right + k])
        met = np.flatnonzero(agreed == shift)
        a = self.rank[self.place(left[met] + shift[met])]
        b = self.rank[self.place(right[met] + shift[met])]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        k = np.log2(high - low + 1).astype(np.int64)
        agreed[met] += np.minimum(self.minima[k, low], self.minima[k, high - (1 << k) + 1])
        return agreed


def _grid(words: np.ndarray, doc: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, place) of grid places that may begin a run's triple; texts are ordered by falling length."""
    lengths = np.diff(first) - 1
    waiting, held = [], 0
    for p in range(1, int(lengths.max(initial=0)) // LEAST_PERIODS + 1):
        stop = first[np.searchsorted(-lengths, -max(LEAST_WORDS, LEAST_PERIODS * p), "right")]
        if not stop:
            break
        same = words[: stop - p : p] == words[p:stop:p]
        # the words of a run but its last period equal those one period on: five, or three periods
        hit = same[:-2] & same[1:-1] & same[2:]
        if p == 1:
            hit = hit[:-2] & same[3:-1] & same[4:]
        at = np.flatnonzero(hit) * p
        if len(at):
            at = at[(words[at] > 0) & (doc[at] == doc[at + p])]
            waiting.append((np.full(len(at), p), at))
            held += len(at)
            if held > TOGETHER:
                yield tuple(np.concatenate(x) for x in zip(*waiting, strict=True))
                waiting, held = [], 0
    if waiting:
        yield tuple(np.concatenate(x) for x in zip(*waiting, strict=True))


def find_runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of all runs, by start, then period.

    `words` are numbers above 0 with one 0 after every text, `first` bounds the texts with their 0,
    longest first.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    reach, found = None, []
    for period, at in _grid(words, doc, first):
        reach = reach or Extensions(words, doc)
        ahead = reach(at, at + period)
        some = ahead >= np.where(period == 1, LEAST_WORDS - 1, (LEAST_PERIODS - 2) * period + 1)
        period, at, ahead = period[some], at[some], ahead[some]
        begin = first[doc[at]]
        inside = np.flatnonzero(at - period >= begin)
        before = np.zeros(len(at), bool)  # the grid place before lies in the same run
        before[inside] = reach(at[inside] - period[inside], at[inside]) >= period[inside]
        period, at, ahead, begin = (x[~before] for x in (period, at, ahead, begin))
        low, high = np.maximum(begin, at - period + 1), at.copy()
        while (low < high).any():
            middle = (low + high) // 2
            reached = reach(middle, middle + period) >= at - middle
            high = np.where(reached, middle, high)
            low = np.where(reached, low, middle + 1)
        stop = at + period + ahead
        long = stop - low >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.append((low[long], stop[long], period[long]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, stop, period = (np.concatenate(x) for x in zip(*found, strict=True))
    # a stretch is found at its smallest period and at multiples of it
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[new], stop[new], period[new]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def text_runs(
    data: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(words, (start, length, period) of all runs, bounds of runs, collapsed texts) of every text."""
    hashes, first, starts, stops = wordhash.word_hashes(data, offsets, folded=False)
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    sorted_first = np.concatenate([[0], np.cumsum(counts[order] + 1)])
    numbers = np.unique(hashes, return_inverse=True)[1] + 1
    # place of every word in the order by falling length, with a 0 after every text
    shift = np.empty(len(counts), np.int64)
    shift[order] = sorted_first[:-1]
    shift -= first[:-1]
    words = np.zeros(sorted_first[-1], np.int32)
    places = np.arange(len(hashes)) + np.repeat(shift, counts)
    words[places] = numbers
    start, stop, period = find_runs(words, sorted_first)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, stop, -1)
    kept = np.cumsum(gone)[places] == 0
    kept_first = np.concatenate([[0], np.cumsum(kept)])[first]
    collapsed = wordhash.spell(data, starts[kept], stops[kept], kept_first)
    owner = order[np.searchsorted(sorted_first, start, "right") - 1] if len(start) else start
    by_text = np.argsort(owner, kind="stable")
    start, stop, period, owner = start[by_text], stop[by_text], period[by_text], owner[by_text]
    own_start = start - shift[owner] - first[owner] if len(start) else start
    return counts, (own_start, stop - start, period), np.searchsorted(owner, np.arange(len(counts) + 1)), collapsed


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to FOUND rows."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b in wordhash.slices(texts):
            counts, runs, bounds, collapsed = text_runs(*wordhash.text_bytes(texts.slice(a, b - a)))
            cells = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in runs], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(a, b - a),
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), cells),
                    wordhash.strings(*collapsed),
                ],
                names=["id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_words, runs (start, length, period of every run), collapsed.

    A run is a stretch of words with smallest period q, at least max(6, 4 * q) words long, that no
    neighbouring word extends. `collapsed` is the text, joined by single spaces, without the words that
    any run holds after its first q ones. Null, empty and white texts have no words, no runs and an empty
    `collapsed`. Null and repeated ids are rows like others; an empty table gives an empty result. Other
    columns are not read. Nothing is shuffled; a task holds about two megabytes of texts, or one text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text).alias("text"))
    return rows.mapInArrow(_runs, FOUND).withColumnRenamed("id", id_col)


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text) of `docs`, a tenth of the texts with a periodic tail.

    With h the crc32 of the id's text and g = floor(h / 10): where 10 divides h, every word from
    a = g % n on becomes word a + (i - a) % p, where p = 1 + floor((n - a) / (3 + g % 8)). The crc32 of a
    null id is that of the empty text. Null texts become empty; all others stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, b in wordhash.slices(batch.column(1)):
                texts, hashes = batch.column(1).slice(at, b - at), batch.column(2).to_numpy()[at:b]
                data, offsets = wordhash.text_bytes(texts)
                _, first, starts, stops = wordhash.word_hashes(data, offsets)
                new = texts.to_pylist()
                for k in np.flatnonzero((hashes % 10 == 0) & (np.diff(first) > 0)):
                    n, g = int(first[k + 1] - first[k]), int(hashes[k]) // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    i = np.arange(n)
                    word = first[k] + np.where(i < a, i, a + (i - a) % p)
                    new[k] = wordhash.spell(data, starts[word], stops[word], np.array([0, n]))[0].tobytes().decode()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, b - at), pa.array(new, pa.string())], names=["id", "text"])

    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text).alias("text"), crc.alias("h"))
    return rows.mapInArrow(run, "id long, text string").withColumnsRenamed({"id": id_col, "text": text})


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The longest run and the digests of what `periodic_runs` found, per row.

    Of the longest runs the one with the smallest start, then period, is shown; without runs it is null.
    """
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))  # the largest of these
    )
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        F.col("best.length"),
        (-F.col("best.col3")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.col3")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
