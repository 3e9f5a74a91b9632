"""Exact, near and first-wins deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderleaf.fixed import guard_rules as rules
from cinderleaf.functions.place import place_id
from cinderleaf.functions.text import let, strip, words
from cinderleaf.operators.resolve import dropped_rows, settle
from cinderleaf.session import checkpoint

# Pairs are formed only while they stay linear in the posting entries.
PAIRS_PER_ENTRY = 8
# Rows at the head of a crowded posting that are settled in its first round.
HEADS = 32
# Times the wanted head that a task orders of one key.
SPREAD = 64


def exact_dedup(docs: DataFrame, order: str, text: str = "text") -> DataFrame:
    """Keeps the first row of every distinct text (SHA-256)."""
    digest = F.sha2(F.col(text), 256)
    first = docs.groupBy(digest.alias("_digest")).agg(F.min(order).alias(order)).select(order)
    return docs.join(first, order, "left_semi")


def with_shingles(docs: DataFrame, text: str) -> DataFrame:
    """Adds `hashes`: sorted distinct 64-bit hashes of five-word runs; the raw text's for short texts.

    The words are a column of their own, so they are split once and not once per run.
    """
    n = rules.SHINGLE_WORDS
    split = docs.withColumn("_words", words(F.lower(text)))
    short = F.size("_words") < n
    places = F.when(~short, F.sequence(F.lit(1), F.size("_words") - (n - 1)))
    runs = F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice("_words", i, n), " ")))
    hashes = F.when(short, F.array(F.xxhash64(text))).otherwise(F.array_sort(F.array_distinct(runs)))
    return split.withColumn("hashes", hashes).drop("_words")


def _least_shared(n: Column) -> Column:
    """ceil(4n/5): shingles a similar partner must share with a set of size n."""
    return F.floor((n * rules.NEAR_DUPLICATE_FIFTHS + 4) / 5)


def _similar(shared: Column, n_a: Column, n_b: Column) -> Column:
    return shared * 5 >= (n_a + n_b - shared) * rules.NEAR_DUPLICATE_FIFTHS


def _normal(text: Column) -> Column:
    """What texts with the same shingle set by construction have in common."""
    return let(
        words(F.lower(text)),
        lambda w: F.when(F.size(w) < rules.SHINGLE_WORDS, F.concat(F.lit("r"), text)).otherwise(
            F.concat(F.lit("w"), F.array_join(w, " "))
        ),
    )


def _identity(text: Column) -> Column:
    """Digest of `_normal`."""
    return F.sha2(_normal(text), 256)


def _partnered(sets: DataFrame) -> DataFrame:
    """(ord) of all rows of `sets` that can have a similar partner with another `same`; some of the others too.

    Ordered by their hashes alone, the first n - ceil(4n/5) + l shingles of two similar sets share l of them,
    for any l up to the overlap. With a tenth of the set as l, three tenths of the shingles tell which rows the
    others need to be counted for. The partner has 4/5 of the row's size at least, so l is that of the smaller one.
    """
    n = F.col("n")
    tenth = lambda size: F.greatest(F.lit(1), F.floor(size / 10))
    head = F.slice("hashes", F.lit(1), (n - _least_shared(n) + tenth(n)).cast("int"))
    entries = sets.select("ord", "n", "same", F.explode(head).alias("hash"))
    holders = Window.partitionBy("hash")
    met = F.min("same").over(holders) != F.max("same").over(holders)
    shared = entries.withColumn("met", met).where("met").groupBy("ord", "n", "same").agg(F.count("*").alias("shared"))
    return shared.where(F.col("shared") >= tenth(_least_shared(n))).select("ord").distinct()


def _prefixes(sets: DataFrame) -> DataFrame:
    """(ord, n, m, hash, rank, lead): the rarest shared shingles a similar pair must meet in.

    Shingles that occur once cannot be shared, so a row needs at least ceil(4n/5) repeated ones to
    have a partner at all. Of those, rarest first, only ranks up to n - ceil(4n/5) + 1 can hold the
    first common shingle; `lead` marks the shorter prefix that suffices for the smaller set.
    """
    entries = sets.select("ord", "n", F.explode("hashes").alias("hash"))
    counts = entries.groupBy("hash").agg(F.count("*").alias("df")).where("df > 1")
    shared = entries.join(counts, "hash")
    ranked = (
        shared.groupBy("ord", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "hash"))).alias("common"))
        .where(F.size("common") >= _least_shared(F.col("n")))
    )
    alone = F.col("n") - F.size("common")
    room = F.col("n") - _least_shared(F.col("n")) + 1 - alone
    prefix = F.slice("common", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))
    kept = ranked.select("ord", "n", alone.alias("alone"), prefix.alias("prefix"))
    sized = kept.withColumn("m", F.size("prefix") * 2)  # every entry is posted in two size bands
    placed = sized.select("ord", "n", "m", "alone", F.posexplode("prefix").alias("at", "entry"))
    rank = F.col("alone") + F.col("at")
    both = F.floor((F.col("n") * 2 * 4 + 8) / 9)  # ceil(8n/9): overlap needed between equal sizes
    return placed.select(
        "ord", "n", "m", F.col("entry.hash").alias("hash"), rank.alias("rank"),
        (rank < F.col("n") - both + 1).alias("lead"),
    )


def _bands(n: Column) -> Column:
    """Size bands in steps of 5/4: similar sets lie in the same or in adjacent bands."""
    band = F.floor(F.log(n.cast("double")) / F.log(F.lit(1.25)))
    return F.array(band, band + 1)


def _meet(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """(a, b) with a < b that meet in a prefix shingle and can still reach the needed overlap."""
    meet = earlier.alias("l").join(
        later.alias("r"),
        (F.col("l.hash") == F.col("r.hash"))
        & (F.col("l.band") == F.col("r.band"))
        & (F.col("l.ord") < F.col("r.ord")),
    )
    n_l, n_r = F.col("l.n"), F.col("r.n")
    small_leads = F.when(n_l <= n_r, F.col("l.lead")).otherwise(F.col("r.lead"))
    need = (n_l + n_r) * 4  # overlap * 9 must reach this
    reach = 1 + F.least(n_l - F.col("l.rank") - 1, n_r - F.col("r.rank") - 1)
    close = (F.least(n_l, n_r) * 5 >= F.greatest(n_l, n_r) * 4) & (reach * 9 >= need)
    ids = [F.col("l.ord").alias("a"), F.col("r.ord").alias("b")]
    return meet.where(close & small_leads).select(*ids).distinct()


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with Jaccard >= 4/5, compared in integers."""
    left = sets.select(F.col("ord").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("h_a"))
    right = sets.select(F.col("ord").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("h_b"))
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("h_a", "h_b"))
    return both.where(_similar(shared, F.col("n_a"), F.col("n_b"))).select("a", "b")


def _edges_to_rules(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Similar pairs as claims and checks: every row claims itself, later ones check it."""
    claims = edges.select(F.col("a").alias("ord"), F.col("a").alias("key")).distinct()
    return claims, edges.select(F.col("b").alias("ord"), F.col("a").alias("key"))


def first_rows(rows: DataFrame, keys: list[str], order: str, width: int) -> DataFrame:
    """The first `width` rows of every key by `order`, which is unique within a key.

    The rows of a key are salted, every part is cut to its own first rows, and what is left is cut again, so that
    no task orders more than SPREAD times `width` rows of a key, about, however many it has.
    """
    most = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0

    def cut(some: DataFrame, by: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
        return some.withColumn("_at", place).where(F.col("_at") <= width).drop("_at")

    while most > SPREAD * width:
        salts = -(-most // (SPREAD * width))
        rows = checkpoint(cut(rows.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts))), [*keys, "_salt"]).drop("_salt"))
        most = salts * width
    return cut(rows, keys)


def _clear_crowds(posts: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Settles the heads of the postings until the remaining pairs stay linear in the entries.

    The first rows of every posting are compared among themselves. A row that is a head in all its
    postings has no earlier candidate outside the heads, so its verdict is final; kept heads are then
    compared with the members of their postings. A crowd of near copies thus costs a few comparisons
    per member, not one per pair. The heads double every round.
    """
    dropped: DataFrame | None = None
    width = HEADS
    while True:
        sizes = posts.groupBy("hash", "band").agg(F.count("*").alias("c"))
        load = sizes.agg(
            F.sum("c").alias("entries"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")
        ).first()
        if not load["entries"] or load["pairs"] <= PAIRS_PER_ENTRY * load["entries"]:
            return posts, dropped
        heads = checkpoint(first_rows(posts, ["hash", "band"], "ord", width))
        entries = heads.groupBy("ord", "m").agg(F.count("*").alias("_c"))
        final = checkpoint(entries.where("_c = m").select("ord"))
        stuck = checkpoint(entries.where("_c < m").select("ord"))
        edges = checkpoint(_verify(_meet(heads, heads), sets))
        gone, waiting = settle(*_edges_to_rules(edges), stuck)
        kept = final.join(gone.unionByName(waiting), "ord", "left_anti")
        kept = checkpoint(kept)
        members = _meet(posts.join(kept, "ord", "left_semi"), posts.join(kept, "ord", "left_anti"))
        similar = _verify(members, sets).select(F.col("b").alias("ord"))
        gone = checkpoint(gone.unionByName(similar).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        posts = checkpoint(posts.join(kept.unionByName(gone), "ord", "left_anti"))
        width *= 2


def _sized(texts: DataFrame, text: str) -> DataFrame:
    """Every text replaced by its shingles, `hashes`, and their number, `n`."""
    return with_shingles(texts, text).drop(text).withColumn("n", F.size("hashes"))


def near_duplicate_orders(docs: DataFrame, order: str, text: str = "text") -> DataFrame:
    """Orders dropped by the sequential rule: Jaccard >= 0.8 with an earlier kept row."""
    keyed = docs.select(F.col(order).alias("ord"), _identity(F.col(text)).alias("same"))
    keyed = checkpoint(keyed)
    firsts = keyed.groupBy("same").agg(F.min("ord").alias("ord")).select("ord")
    copies = checkpoint(keyed.select("ord").join(firsts, "ord", "left_anti"))
    texts = docs.select(F.col(order).alias("ord"), text)
    told = texts.withColumn("same", F.xxhash64(_normal(F.col(text))))
    partnered = _partnered(_sized(told, text)).join(copies, "ord", "left_anti")
    sets = checkpoint(_sized(texts.join(checkpoint(partnered), "ord", "left_semi"), text))
    posts = checkpoint(_prefixes(sets).withColumn("band", F.explode(_bands(F.col("n")))))
    posts, crowd = _clear_crowds(posts, sets)
    edges = checkpoint(_verify(_meet(posts, posts), sets))
    dropped = copies.unionByName(dropped_rows(*_edges_to_rules(edges)))
    if crowd is not None:
        dropped = dropped.unionByName(crowd)
    return dropped.select(F.col("ord").alias(order))


def near_dedup(docs: DataFrame, order: str, text: str = "text") -> DataFrame:
    """Rows that the sequential near-duplicate scan keeps."""
    return docs.join(near_duplicate_orders(docs, order, text), order, "left_anti")


def merge_records(records: DataFrame, order: str, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """First-wins merge by id and by lower-cased name; missing ids are made from the name."""
    name = F.lower(strip(F.coalesce(F.col(name_col).cast("string"), F.lit(""))))
    rid = F.coalesce(F.col(id_col), F.lit(""))
    made = F.when(rid == "", place_id(name)).otherwise(rid)
    keyed = records.select(
        F.col(order).alias("ord"),
        F.when(rid != "", F.concat(F.lit("i:"), rid)).alias("own"),
        F.concat(F.lit("i:"), made).alias("published"),
        F.when(name != "", F.concat(F.lit("n:"), name)).alias("named"),
    )
    claims = keyed.select("ord", F.explode(F.array_compact(F.array("published", "named"))).alias("key"))
    checks = keyed.select("ord", F.explode(F.array_compact(F.array("own", "named"))).alias("key"))
    gone = dropped_rows(checkpoint(claims), checkpoint(checks)).select(F.col("ord").alias(order))
    return records.withColumn(id_col, made).join(gone, order, "left_anti")


def normalised_food_name(name: Column) -> Column:
    """Name without bracketed parts, lower-cased and trimmed."""
    return strip(F.lower(F.regexp_replace(name, r"\(.*?\)", "")))


def dedup_normalised_names(
    items: DataFrame, order: str, name: str, existing: DataFrame | None = None
) -> DataFrame:
    """First row per normalised name that the existing names do not contain."""
    keyed = items.withColumn("_key", normalised_food_name(F.col(name)))
    first = keyed.groupBy("_key").agg(F.min(order).alias(order))
    if existing is not None:
        taken = existing.select(normalised_food_name(F.col(name)).alias("_key")).distinct()
        first = first.join(taken, "_key", "left_anti")
    return items.join(first.select(order), order, "left_semi")
