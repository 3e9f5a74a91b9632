"""Languages of words and texts by a linear-chain conditional random field.

A word's score for each language is the sum of the weights of its features: the word itself (the
lexicon), its prefixes and suffixes of up to four bytes, and its runs of two to four bytes. Learned
transitions between the languages of neighbouring words tie the words of a text together, and forward-
backward over the whole text gives every word a distribution over the languages, also where a text
switches. The weights are fitted to words of texts with a known language, single and spliced together.

The fit uses a bounded number of texts per language (`TEXTS`) and segments (`SEGMENTS`); everything
else covers all rows and whole texts. The model has a fixed size and goes to all executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderleaf.llm import wordhash
from cinderleaf.llm.common import free_name, remainder, whole
from cinderleaf.session import checkpoint

# Texts of a language and segments of all texts that the fit may use, and words of a segment.
TEXTS, SEGMENTS, SEGMENT = 500, 8_000, 48
# Share of the segments that switch the language half-way.
SPLICED = 0.3
# Feature weights of a language are a power of two.
FEATURES = 1 << 18
PASSES, RATE, DECAY = 3, 0.4, 1e-6
# Words that are multiplied out together before their chunk is placed in its text.
CHUNK = 48
# Bytes of text that a worker looks at together; what it holds per byte is many times as much.
SLICE = 1 << 18
UNKNOWN = "und"
PREDICTED = "id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long, shares array<double>"
EVIDENCE = PREDICTED + ", lang string, lettered long, evidence double, variance double"
# A text is in none of the languages if its words speak less for its language than this share of what words of held-out
# texts of that language do, and less by so many deviations; a language with fewer held-out texts keeps all of its texts.
LEAST_SHARE, DEVIATIONS, LEAST_HELD = 0.5, 6, 20


def word_features(
    data: np.ndarray, starts: np.ndarray, stops: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, first feature of each word, whether the word has a letter).

    Words without a letter have no features.
    """
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] = lower[97:123]
    lettered_byte = np.zeros(256, bool)
    lettered_byte[97:123] = True
    lettered_byte[128:] = True
    lengths = stops - starts
    # the words side by side, each with a mark in front and behind
    first = np.concatenate([[0], np.cumsum(lengths + 2)])
    text = np.zeros(first[-1], np.uint8)
    inside = np.ones(first[-1], bool)
    inside[first[:-1]] = False
    inside[first[1:] - 1] = False
    source = np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    text[inside] = lower[data[source]]
    owner = np.repeat(np.arange(len(starts)), lengths + 2)
    lettered = np.bincount(owner, weights=lettered_byte[text], minlength=len(starts)) > 0
    codes, owners = [], []
    run = text.astype(np.uint64)
    for n in range(2, 5):
        run = (run[:-1] << np.uint64(8)) | text[n - 1 :]
        own = owner[: len(run)]
        # marks make runs at the edges affixes: the word's own mark stands for its begin or end
        codes.append(run | np.uint64(n << 56))
        owners.append(np.where(own == owner[n - 1 :], own, -1))
    plain = wordhash.mix(np.arange(1, 257, dtype=np.uint64))
    sums = np.zeros(len(text) + 1, np.uint64)
    powers = np.multiply.accumulate(
        np.concatenate([[1], np.full(int(lengths.max(initial=0)) + 2, wordhash.BASE, np.uint64)]).astype(np.uint64)
    )
    place = np.arange(len(text)) - np.repeat(first[:-1], lengths + 2)
    np.cumsum(plain[text] * powers[place], out=sums[1:])
    codes.append(sums[first[1:]] - sums[first[:-1]])
    owners.append(np.arange(len(starts)))
    # prefixes and suffixes of four bytes with their mark
    for size in (5,):
        long = np.flatnonzero(lengths + 2 >= size)
        for at, side in ((first[:-1][long], 1), (first[1:][long] - size, 2)):
            code = np.full(len(long), side, np.uint64)
            for k in range(size):
                code = (code << np.uint64(8)) | text[at + k]
            codes.append(code | np.uint64(9 << 56))
            owners.append(long)
    every, whose = np.concatenate(codes), np.concatenate(owners)
    some = whose >= 0
    some[some] = lettered[whose[some]]
    every, whose = every[some], whose[some]
    order = np.argsort(whose, kind="stable")
    numbers = (wordhash.mix(every[order]) & np.uint64(FEATURES - 1)).astype(np.int64)
    return numbers, np.searchsorted(whose[order], np.arange(len(starts) + 1)), lettered


def word_scores(weights: np.ndarray, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the feature weights of every word, per language."""
    sums = np.zeros((len(numbers) + 1, weights.shape[1]))
    np.cumsum(weights[numbers], axis=0, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def marginals(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Distribution over the languages of every word, given all words of its text.

    The words of a text are cut into chunks; the products of the chunks give the state at every
    chunk's edges, and the chunks are then run through side by side.
    """
    n, k = scores.shape
    if not n:
        return scores
    counts = np.diff(first)
    chunks = -(-counts // CHUNK)
    chunk_first = np.concatenate([[0], np.cumsum(chunks)])
    total = chunk_first[-1]
    text_of = np.repeat(np.arange(len(counts)), chunks)
    rank = np.arange(total) - chunk_first[text_of]
    start = first[text_of] + rank * CHUNK
    size = np.minimum(CHUNK, first[text_of + 1] - start)
    weight = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves - moves.max())
    at = start[:, None] + np.arange(CHUNK)
    filled = np.arange(CHUNK) < size[:, None]
    chance = weight[np.where(filled, at, 0)]  # chunk, place, language

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)

    # what a chunk does to the state in front of it: a move and a word at a time; the first word of a
    # text is not moved to
    begins = rank == 0
    product = np.where(begins[:, None, None], np.eye(k), step) * chance[:, 0][:, None, :]
    for t in range(1, CHUNK):
        some = np.flatnonzero(filled[:, t])
        if len(some) == 0:
            break
        product[some] = scaled((product[some] @ step) * chance[some, t][:, None, :])
    before = np.ones((total, k))  # in front of each chunk; of a text's first chunk nothing is known
    after = np.ones((total, k))
    for r in range(1, int(chunks.max())):
        own = chunk_first[:-1][chunks > r] + r
        before[own] = scaled(np.einsum("ci,cij->cj", before[own - 1], product[own - 1]))
    last = chunk_first[1:] - 1
    for r in range(1, int(chunks.max())):
        own = last[chunks > r] - r
        after[own] = scaled(np.einsum("cij,cj->ci", product[own + 1], after[own + 1]))
    forward = np.zeros((total, CHUNK, k))
    state = before
    for t in range(CHUNK):
        moved = state @ step
        if t == 0:
            moved[begins] = 1
        state = np.where(filled[:, t, None], scaled(moved * chance[:, t]), state)
        forward[:, t] = state
    out = np.zeros((n, k))
    state = after
    for t in range(CHUNK - 1, -1, -1):
        some = filled[:, t]
        both = forward[some, t] * state[some]
        out[at[some, t]] = both / both.sum(axis=1, keepdims=True)
        state = np.where(some[:, None], scaled((state * chance[:, t]) @ step.T), state)
    return out


class Model:
    """Languages, feature weights (FEATURES x languages) and moves between languages."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        k = len(languages)
        self.weights = np.zeros((FEATURES, k), np.float32)
        self.moves = np.zeros((k, k))

    def fit(self, segments: list[tuple[str, np.ndarray]]) -> None:
        """Steps of adaptive size up the likelihood of the words' languages, given the segments."""
        k = len(self.languages)
        sums = np.full((FEATURES, k), 1e-8)
        move_sums = np.full((k, k), 1e-8)
        chance = np.random.default_rng(1)
        for _ in range(PASSES):
            for batch in np.array_split(chance.permutation(len(segments)), max(1, len(segments) // 200)):
                if not len(batch):
                    continue
                texts = pa.array([segments[i][0] for i in batch])
                gold = np.concatenate([segments[i][1] for i in batch])
                data, offsets = wordhash.text_bytes(texts)
                starts, stops = wordhash.word_spans(data, offsets)
                first = np.searchsorted(starts, offsets)
                numbers, at, _ = word_features(data, starts, stops)
                scores = word_scores(self.weights, numbers, at)
                found = marginals(scores, first, self.moves)
                right = np.zeros_like(found)
                right[np.arange(len(gold)), gold] = 1
                slope = right - found
                spread = np.repeat(slope, np.diff(at), axis=0)
                for c in range(k):
                    step = np.bincount(numbers, weights=spread[:, c], minlength=FEATURES) / len(batch)
                    step -= DECAY * self.weights[:, c]
                    sums[:, c] += step * step
                    self.weights[:, c] += RATE * step / np.sqrt(sums[:, c])
                # moves seen, less moves expected by the neighbouring distributions
                inner = np.ones(len(gold), bool)
                inner[first[:-1][np.diff(first) > 0]] = False
                later = np.flatnonzero(inner)
                seen = np.zeros((k, k))
                np.add.at(seen, (gold[later - 1], gold[later]), 1)
                step = np.exp(self.moves - self.moves.max())
                weight = np.exp(scores - scores.max(axis=1, keepdims=True))
                pair = found[later - 1][:, :, None] * step[None] * weight[later][:, None, :]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                slope = (seen - pair.sum(axis=0)) / max(1, len(later))
                move_sums += slope * slope
                self.moves += 0.1 * RATE * slope / np.sqrt(move_sums)


def training_segments(docs: DataFrame, languages: list[str], texts: int, segments: int) -> list[tuple[str, np.ndarray]]:
    """Segments of the fit's texts (id, text, lang): (words, the language of each); some are spliced."""
    named = docs.select("id", "lang")
    # a draw by the id's hash leaves about four times the wanted rows of a language for the window
    sizes = named.groupBy("lang").agg(F.count("*").alias("rows"))
    share = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) * F.col("rows") < F.lit(4_000_000 * texts)
    drawn = named.join(F.broadcast(sizes), "lang").where(share)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= texts)
    # at most `texts` ids of each language
    sample = docs.join(F.broadcast(chosen.select("id", "lang").distinct()), ["id", "lang"]).toPandas()
    sample = sample.sort_values(["id", "text"])
    pieces: list[tuple[list[str], int]] = []
    for text, lang in zip(sample["text"], sample["lang"], strict=True):
        words = text.encode().split()
        number = languages.index(lang)
        pieces += [(words[i : i + SEGMENT], number) for i in range(0, len(words), SEGMENT)]
    chance = np.random.default_rng(0)
    by_language = [[p for p in pieces if p[1] == c] for c in range(len(languages))]
    share = segments // max(1, len(languages))
    few = []
    for own in by_language:
        few += [own[i] for i in chance.permutation(len(own))[:share]]
    out = []
    for i in chance.permutation(len(few)):
        words, number = few[i]
        gold = np.full(len(words), number)
        if chance.random() < SPLICED:
            other, second = few[int(chance.integers(len(few)))]
            half = len(words) // 2
            words = words[:half] + other[half:]
            gold = np.concatenate([gold[:half], np.full(len(words) - half, second)])
        out.append((b" ".join(words).decode(), gold))
    return out


def train(docs: DataFrame, texts: int = TEXTS, segments: int = SEGMENTS) -> Model:
    """A model fitted to `docs` (id, text, lang).

    Every language that is a label has 2**18 weights; labels are meant to be few, as names of languages are.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    languages = [r[0] for r in known.select("lang").distinct().orderBy("lang").collect()]
    model = Model(languages)
    if languages:
        model.fit(training_segments(known, languages, texts, segments))
    return model


def predict(rows: DataFrame, model: Model, evidence: bool = False) -> DataFrame:
    """PREDICTED rows of (id, held_out, text, letters); `letters` says whether the text has a letter.

    With `evidence`, EVIDENCE rows of (id, held_out, text, letters, lang): how many words have a letter, and mean and
    variance over them of what their features say for the language that the chain gives them, above the mean of
    all languages. Words unlike any that the model has learned from say next to nothing.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        k = len(model.languages)
        for batch in batches:
            for a, b in wordhash.slices(batch.column(2), SLICE):
                data, offsets = wordhash.text_bytes(batch.column(2).slice(a, b - a))
                hashes, first, starts, stops = wordhash.word_hashes(data, offsets)
                owners = np.repeat(np.arange(b - a), np.diff(first))
                _, at, back = np.unique(hashes, return_index=True, return_inverse=True)
                numbers, feature_first, lettered = word_features(data, starts[at], stops[at])
                letters = np.array(batch.column(3).slice(a, b - a).to_pylist(), bool)
                if k:
                    own = word_scores(model.weights, numbers, feature_first)[back]
                    chance = marginals(own, first, model.moves)
                    counted = chance * lettered[back][:, None]
                    shares = np.stack(
                        [np.bincount(owners, weights=counted[:, c], minlength=b - a) for c in range(k)], axis=1
                    )
                    shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1e-300)
                    best = chance.argmax(axis=1) if len(chance) else np.zeros(0, np.int64)
                    change = np.zeros(len(best))
                    change[1:] = (best[1:] != best[:-1]) & (owners[1:] == owners[:-1])
                    switches = np.bincount(owners, weights=change, minlength=b - a).astype(np.int64)
                else:
                    shares, switches = np.zeros((b - a, 1)), np.zeros(b - a, np.int64)
                named = letters & (shares.sum(axis=1) > 0)
                top = shares.argmax(axis=1)
                names = [model.languages[t] if s else UNKNOWN for t, s in zip(top, named, strict=True)]
                cells = {
                    "id": batch.column(0).slice(a, b - a),
                    "held_out": batch.column(1).slice(a, b - a),
                    "lang_pred": pa.array(names, pa.string()),
                    "score": pa.array(np.where(named, np.minimum(shares.max(axis=1), 1.0), 0.0)),
                    "n_words": pa.array(np.diff(first).astype(np.int64)),
                    "n_switches": pa.array(switches),
                    "shares": pa.array(list(shares), pa.list_(pa.float64())),
                }
                if evidence:
                    says = np.zeros(len(back))
                    if k:
                        says = (chance * own).sum(axis=1) - own.mean(axis=1)
                    count = np.bincount(owners, weights=lettered[back], minlength=b - a)
                    mean, square = (
                        np.bincount(owners, weights=x * lettered[back], minlength=b - a) / np.maximum(count, 1)
                        for x in (says, says * says)
                    )
                    cells["lang"] = batch.column(4).slice(a, b - a)
                    cells["lettered"] = pa.array(count.astype(np.int64))
                    cells["evidence"] = pa.array(mean)
                    cells["variance"] = pa.array(np.maximum(square - mean * mean, 0))
                yield pa.RecordBatch.from_arrays(list(cells.values()), names=list(cells))

    return rows.mapInArrow(run, EVIDENCE if evidence else PREDICTED)


def learn(
    docs: DataFrame, id_col: str, text: str, lang: str, parts: int, held: int, texts: int, segments: int
) -> tuple[Model, DataFrame]:
    """(the model of the rows that are not held out, rows (id, held_out, text, letters, lang) to ask it for)."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (remainder(id_col, parts) == held).alias("held_out"),
        F.col(text).alias("text"),
        F.col(lang).cast("string").alias("lang"),
    )
    model = train(rows.where("NOT held_out").select("id", "text", "lang"), texts, segments)
    letters = whole("text").rlike(r"\p{L}").alias("letters")
    return model, rows.select("id", "held_out", whole("text").alias("text"), letters, "lang")


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    parts: int = 5,
    held: int = 0,
    texts: int = TEXTS,
    segments: int = SEGMENTS,
) -> DataFrame:
    """Per row of `docs`: id, held_out, lang_pred, score, n_words, n_switches and the share of each language.

    Learns from texts and languages of rows whose crc32(id as text) mod `parts` is not `held`; null
    ids, texts and languages teach nothing. A language is predicted from the text alone. A null text or
    one without a letter is `und` with score 0, and so is every text when there is nothing to learn
    from. Rows that repeat an id are predicted on their own. An empty table gives an empty result.
    """
    model, asked = learn(docs, id_col, text, lang, parts, held, texts, segments)
    names = F.array(*[F.lit(name) for name in model.languages]) if model.languages else F.array(F.lit(UNKNOWN))
    found = predict(asked.drop("lang"), model).withColumn("shares", F.map_from_arrays(names, F.col("shares")))
    return found.withColumnRenamed("id", id_col)


def keep_identified(
    docs: DataFrame,
    least: float = 0.0,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    parts: int = 5,
    held: int = 0,
    texts: int = TEXTS,
    segments: int = SEGMENTS,
) -> DataFrame:
    """The rows of `docs` with a language that at least a share `least` of their words has, columns unchanged.

    The model decides: rows without a letter go, and rows whose words speak too little for the language predicted
    (`LEAST_SHARE`), measured by held-out rows that have this language as their label and are predicted so. The
    mean of few words varies more, so short texts go only if they are further off (`DEVIATIONS`). Short clean
    texts can be of even shares, so `least` is 0 unless asked for.
    Rows that repeat an id go together when one of them goes; rows with a null id share one verdict likewise.
    Null and empty texts go. Columns of any name are allowed; an empty table gives an empty result.
    """
    model, asked = learn(docs, id_col, text, lang, parts, held, texts, segments)
    found = predict(asked, model, evidence=True)
    found = checkpoint(found.drop("n_words", "n_switches", "shares"))
    usual = found.where("held_out AND lang = lang_pred").groupBy("lang_pred").agg(
        F.count("*").alias("texts"),
        F.avg("evidence").alias("mean"),
        F.var_samp("evidence").alias("between"),
        F.avg("variance").alias("within"),
    )
    known = found.join(F.broadcast(usual.where(F.col("texts") >= LEAST_HELD)), "lang_pred", "left")
    far = F.col("mean") - DEVIATIONS * F.sqrt(F.col("between") + F.col("within") / F.col("lettered"))
    foreign = F.col("evidence") < F.least(LEAST_SHARE * F.col("mean"), far)
    verdict = (F.col("lang_pred") == UNKNOWN) | (F.col("score") < least) | F.coalesce(foreign, F.lit(False))
    name = free_name(docs)
    gone = checkpoint(known.where(verdict).select(F.col("id").alias(name)).distinct())
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(name)), "left_anti")
