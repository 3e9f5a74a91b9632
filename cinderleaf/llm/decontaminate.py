"""Benchmark passages in documents, also with other numbers, names and units.

A text becomes a template: words in lower case, numbers, units after numbers and names inside sentences
replaced by typed placeholders that keep their value aside. Windows of template words are hashed and
joined with those of the benchmark. A document holds an item when its windows cover enough of the item,
or many in a row, and the placeholders within them pair up one to one, type by type. An item without a
usable window is held by documents with all of its words, values included. Only built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderleaf.functions.text import let
from cinderleaf.llm.common import free_name, whole
from cinderleaf.session import checkpoint

# Words of a window, and how many of them must be words rather than placeholders.
WINDOW, LITERALS = 6, 3
# Share of an item's windows that a document must hold, and of the placeholders in them that must pair up.
COVERED, PAIRED = 0.5, 0.8
# Windows in a row that are enough whatever their share: 13 template words.
IN_A_ROW = 8
# Benchmarks of up to this many windows (16 bytes each and the item id) are broadcast.
BROADCAST_WINDOWS = 1_000_000

# Units that may follow a number.
UNITS = [
    "kg", "g", "mg", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mi", "mile", "miles", "ft", "feet", "inch",
    "inches", "yard", "yards", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "l", "ml",
    "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min",
    "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year",
    "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees", "mph", "kmh",
]

# A placeholder is this mark, a letter for its type, a second mark and the value; the third stands for
# the commas and full stops within a number.
MARK, CUT, POINT = "\x01", "\x02", "\x03"


def template_words(text: Column) -> Column:
    """The words of a text's template; a placeholder word carries its value after the second mark."""
    marked = text.contains(MARK) | text.contains(CUT) | text.contains(POINT)
    plain = F.when(marked, F.regexp_replace(text, f"[{MARK}{CUT}{POINT}]", " ")).otherwise(text)
    # the capital comes first in the pattern, so what stands before it is looked at only there
    name = r"(\p{Lu})(?<=[\p{L}\p{N},;]\s{1,8}\p{Lu})([\p{L}'’-]+)"
    named = F.regexp_replace(plain, name, f"{MARK}p{CUT}$1$2")

    def numbered(t: Column) -> Column:
        joined = F.regexp_replace(t, r"(?<=\p{N})[.,](?=\p{N})", POINT)
        counted = F.regexp_replace(joined, rf"(?<![\p{{L}}\p{{N}}{CUT}])(\p{{N}}[\p{{N}}{POINT}]*)", f" {MARK}n{CUT}$1 ")
        unit = rf"(?i)({CUT}\p{{N}}[\p{{N}}{POINT}]*\x20\x20?)({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"
        return F.regexp_replace(counted, unit, f"$1{MARK}u{CUT}$2")

    # most texts hold no number, and then need no search for units
    shown = let(named, lambda t: F.when(t.rlike(r"\p{N}"), numbered(t)).otherwise(t))
    return F.array_remove(F.split(F.lower(shown), rf"[^\p{{L}}\p{{N}}{MARK}{CUT}{POINT}]+", -1), "")


def _shape(word: Column) -> Column:
    return F.substring_index(word, CUT, 1)


def window_hashes(words: Column, window: int = WINDOW) -> Column:
    """Hash of every run of `window` template words; none in shorter texts."""

    def hashed(shapes: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(shapes) - window)
        return F.when(
            F.size(shapes) >= window,
            F.transform(places, lambda i: F.xxhash64(*[F.get(shapes, i + k) for k in range(window)])),
        ).otherwise(F.array().cast("array<bigint>"))

    # bound once: an array expression within a lambda is computed anew for every element
    return let(F.transform(words, lambda w: F.xxhash64(_shape(w))), hashed)


def _usable(words: Column, at: Column, window: int) -> Column:
    """Whether a window has few enough placeholders."""
    return F.size(F.filter(F.slice(words, at + 1, window), lambda w: w.startswith(MARK))) <= window - LITERALS


def benchmark_windows(
    benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """(item, windows, at, hash): the usable windows of every item; see `whole_items` for items without any."""
    items = benchmark.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).alias("item"), template_words(whole(text)).alias("words")
    )
    cut = items.select("item", "words", F.posexplode(window_hashes(F.col("words"), window)).alias("at", "hash"))
    usable = cut.where(_usable(F.col("words"), F.col("at"), window)).drop("words")
    counts = usable.groupBy("item").agg(F.countDistinct("at").alias("windows"))
    return usable.join(counts, "item")


def plain_words(text: Column) -> Column:
    """The words of a text's template with the values in place of their placeholders."""
    return F.transform(template_words(text), lambda w: F.substring_index(w, CUT, -1))


def _starts(words: Column, length: Column | int) -> Column:
    """Hash of every run of `length` words."""
    places = F.sequence(F.lit(0), F.size(words) - length)
    return F.when(
        F.size(words) >= length, F.transform(places, lambda i: F.xxhash64(F.slice(words, i + 1, length)))
    ).otherwise(F.array().cast("array<bigint>"))


def whole_items(
    benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """(item, item_words, length, hash) of the items without a usable window: all words, and their first ones' hash.

    Items without words are left out.
    """
    items = benchmark.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).alias("item"), whole(text).alias("body"), template_words(whole(text)).alias("words")
    )
    places = F.sequence(F.lit(0), F.size("words") - window)
    some = F.when(F.size("words") >= window, F.exists(places, lambda i: _usable(F.col("words"), i, window)))
    bare = items.where((F.size("words") > 0) & ~F.coalesce(some, F.lit(False)))
    return bare.select(
        "item", plain_words(F.col("body")).alias("item_words"), F.least(F.size("words"), F.lit(window)).alias("length")
    ).withColumn("hash", F.xxhash64(F.expr("slice(item_words, 1, length)")))


def find_whole(body: DataFrame, bare: DataFrame, broadcast: bool) -> DataFrame:
    """(id, item) of the rows of `body` that hold all words of an item of `whole_items` in a row."""
    lengths = sorted(r[0] for r in bare.select("length").distinct().collect())
    hashes = let(plain_words(F.col("body")), lambda w: F.concat(*[_starts(w, n) for n in lengths]))
    keys = bare.select("item", "hash")
    placed = body.select("id", F.explode(F.array_distinct(hashes)).alias("hash"))
    wanted = placed.join(F.broadcast(keys) if broadcast else keys, "hash").select(F.col("id").alias("wanted"), "item")
    wanted = checkpoint(wanted.distinct().join(bare.select("item", "item_words").distinct(), "item"))

    def holds(words: Column) -> Column:
        item = F.col("item_words")
        places = F.sequence(F.lit(0), F.size(words) - F.size(item))
        return F.when(F.size(words) >= F.size(item), F.exists(places, lambda i: F.slice(words, i + 1, F.size(item)) == item))

    both = body.join(wanted, F.col("id").eqNullSafe(F.col("wanted")))
    return both.where(let(plain_words(F.col("body")), holds)).select("id", "item").distinct()


def _in_a_row(found: Column) -> Column:
    """Whether IN_A_ROW windows follow each other."""
    places = F.sequence(F.lit(0), F.size(found) - IN_A_ROW)
    many = let(
        F.array_sort(found),
        lambda f: F.exists(places, lambda i: F.get(f, i + IN_A_ROW - 1) - F.get(f, i) == IN_A_ROW - 1),
    )
    return F.when(F.size(found) >= IN_A_ROW, many).otherwise(False)


def _paired(words: Column, item_words: Column, shift: Column, copies: Column, window: int) -> Column:
    """Share of the item's placeholders in found windows whose values pair up one to one with the document's; 1
    without any.

    `copies` has the found windows of every shift. A placeholder is read at the shift of a window that holds it,
    the one closest to `shift` and no further from it than the item is long: an edit moves what follows it by a
    few words, other copies are far away. Found windows agree in their shapes, so only values can differ.
    """

    def read(near: Column) -> Column:
        def shift_of(i: Column) -> Column:
            holds = F.filter(near, lambda c: F.exists(c["found"], lambda at: (at <= i) & (i < at + window)))
            return F.array_min(F.transform(holds, lambda c: F.struct(F.abs(c["shift"] - shift), c["shift"].alias("s"))))["s"]

        places = F.filter(
            F.sequence(F.lit(0), F.size(item_words) - 1), lambda i: F.get(item_words, i).startswith(MARK)
        )
        pairs = F.transform(
            places, lambda i: F.struct(F.get(item_words, i).alias("a"), F.get(words, i + shift_of(i)).alias("b"))
        )
        return F.filter(pairs, lambda p: p["b"].isNotNull())

    def one_to_one(found: Column) -> Column:
        left = F.size(F.array_distinct(F.transform(found, lambda p: p["a"])))
        right = F.size(F.array_distinct(F.transform(found, lambda p: p["b"])))
        share = F.least(left, right) / F.greatest(F.size(F.array_distinct(found)), F.lit(1))
        return F.when(F.size(found) == 0, F.lit(1.0)).otherwise(share)

    close = F.filter(copies, lambda c: F.abs(c["shift"] - shift) <= F.size(item_words))
    return let(let(close, read), one_to_one)


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    covered: float = COVERED,
    paired: float = PAIRED,
) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, slot_share) of every document that holds an item.

    Null texts are empty and hold nothing; rows that repeat an id answer together; a null id is an id
    of its own; repeated benchmark rows answer once. An item without a usable window counts as one window;
    one of a single word is held by every document with that word. Empty tables give an empty result. Other columns
    are not read.
    """
    items = benchmark.select(item_id, item_text).distinct()
    windows = checkpoint(benchmark_windows(items, item_id, item_text, window))
    small = windows.count() <= BROADCAST_WINDOWS
    known = F.broadcast(windows) if small else windows
    body = docs.select(F.col(id_col).alias("id"), whole(text).alias("body"))
    cut = body.select("id", window_hashes(template_words(F.col("body")), window).alias("hashes"))
    placed = cut.select("id", F.posexplode("hashes").alias("pos", "hash"))
    hits = placed.join(known, "hash").select("id", "item", "windows", "at", (F.col("pos") - F.col("at")).alias("shift"))
    by_shift = hits.groupBy("id", "item", "windows", "shift").agg(F.collect_set("at").alias("found"))
    pairs = by_shift.groupBy("id", "item", "windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n_windows"),
        F.max_by("shift", F.struct(F.size("found"), -F.col("shift"))).alias("shift"),
        F.collect_list(F.struct("shift", "found")).alias("copies"),
        F.bool_or(_in_a_row(F.col("found"))).alias("long"),
    )
    enough = checkpoint(pairs.where((F.col("n_windows") >= F.col("windows") * covered) | F.col("long")).drop("long"))
    # only items with placeholders need the document's words again
    words = items.select(F.col(item_id).alias("item"), template_words(whole(item_text)).alias("item_words"))
    slotted = words.where(F.exists("item_words", lambda w: w.startswith(MARK)))
    if small:
        slotted = F.broadcast(slotted)
    to_check = checkpoint(enough.join(slotted, "item"))
    plain = enough.join(to_check.select("item").distinct(), "item", "left_anti")
    share = let(
        template_words(F.col("body")),
        lambda w: _paired(w, F.col("item_words"), F.col("shift"), F.col("copies"), window),
    )
    if to_check.isEmpty():
        checked = to_check.withColumn("slot_share", F.lit(1.0)).drop("item_words", "copies")
    else:
        wanted = to_check.withColumnRenamed("id", "wanted")
        checked = (
            body.join(wanted, F.col("id").eqNullSafe(F.col("wanted")))
            .withColumn("slot_share", share)
            .groupBy("id", "item", "windows", "n_windows", "shift")
            .agg(F.max("slot_share").alias("slot_share"))
        )
    found = plain.drop("copies").withColumn("slot_share", F.lit(1.0)).unionByName(checked)
    out = found.where(F.col("slot_share") >= paired).select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_id),
        F.col("n_windows").cast("long").alias("n_windows"),
        (F.col("n_windows") / F.col("windows")).alias("coverage"),
        "slot_share",
    )
    bare = checkpoint(whole_items(items, item_id, item_text, window))
    if bare.isEmpty():
        return out
    one = F.lit(1.0)
    exact = find_whole(body, bare, bare.count() <= BROADCAST_WINDOWS).select(
        F.col("id").alias(id_col), F.col("item").alias(item_id), F.lit(1).cast("long").alias("n_windows"),
        one.alias("coverage"), one.alias("slot_share"),
    )
    # an id of two texts may be found both ways
    return out.unionByName(exact).groupBy(id_col, item_id).agg(
        *[F.max(c).alias(c) for c in ("n_windows", "coverage", "slot_share")]
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, all columns unchanged.

    Null and empty texts hold none and stay. Rows that repeat an id go together when one of them holds an item;
    rows with a null id likewise. Columns of any name are allowed; an empty table gives an empty result, an empty
    benchmark leaves all rows.
    """
    name = free_name(docs)
    found = find_items(docs, benchmark, id_col, **options).select(F.col(id_col).alias(name)).distinct()
    return docs.join(found, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
