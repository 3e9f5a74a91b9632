"""Licence paragraphs by sparse word n-gram logistic regression, confirmed against templates.

The classifier is trained on notices put together from the names, phrases and sentences of
`license_terms`, and on statements that use the same words without granting anything. Its features are
runs of one to three words of those notices; the weights are sparse. A paragraph belongs to the family
of the highest probability if that reaches a threshold calibrated on notices left out of the training,
and is unknown otherwise, as is a paragraph that denies its licence. A family is confirmed when the paragraph
holds most of one of its notices or sentences, or is little more than one of its names and a label. Only built-in column functions and the JVM's regression; the model is a bounded table.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderleaf.functions.text import let
from cinderleaf.llm import license_terms as terms
from cinderleaf.llm.common import whole

UNKNOWN = "unknown"
LONGEST = 3
# Features must occur in this many notices; smaller weights are left out; share of left-out notices.
LEAST_NOTICES, LEAST_WEIGHT, LEFT_OUT = 2, 1e-3, 4
# Wrong families among the left-out notices that pass the threshold: this share at most.
WRONG = 0.01
# Share of a template's word runs that a paragraph must hold.
CONFIRMED = 0.8


def words_of(text: Column) -> Column:
    """Words in lower case: letters and digits, full stops within numbers."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9.]+", " ")
    plain = F.regexp_replace(plain, r"(?<![0-9])\.|\.(?![0-9])", " ")
    return F.array_remove(F.split(plain, " +"), "")


def runs_of(words: Column, longest: int = LONGEST) -> Column:
    """The distinct runs of one to `longest` words."""

    def of_length(w: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.size(w) - n + 1)
        joined = F.transform(places, lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, joined).otherwise(F.array().cast("array<string>"))

    def runs(w: Column) -> Column:
        return F.array_distinct(F.concat(*[of_length(w, n) for n in range(1, longest + 1)]))

    return let(words, runs)


def notices() -> list[tuple[str, str]]:
    """(family, statement) of every training notice."""
    out = [(f, phrase.format(name)) for f, names in terms.NAMES.items() for name in names for phrase in terms.NOTICES]
    out += [(f, s) for f, some in terms.SENTENCES.items() for s in some for _ in range(LEAST_NOTICES)]
    return out + [(UNKNOWN, s) for s in terms.OTHERS for _ in range(3)] + [(UNKNOWN, "")]


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small fixed table as one literal."""
    listed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(0, 1, 1, 1).select(F.explode(listed).alias("r")).select("r.*")


def _probabilities(runs: Column, model: dict) -> Column:
    """Probability of every class, in the order of the model's classes."""
    k = len(model["classes"])
    weights = F.from_json(F.lit(json.dumps(model["weights"])), "map<string,array<double>>")
    start = F.from_json(F.lit(json.dumps(model["intercepts"])), "array<double>")
    # runs without weight are left out before anything is added up
    known = F.from_json(F.lit(json.dumps(sorted(model["weights"]))), "array<string>")
    some = F.array_intersect(runs, known)
    logits = F.aggregate(some, start, lambda acc, r: F.zip_with(acc, weights[r], lambda a, b: a + b))

    def softmax(x: Column) -> Column:
        powers = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
        return let(powers, lambda p: F.transform(p, lambda v: v / F.aggregate(p, F.lit(0.0), lambda a, b: a + b)))

    assert k == len(model["intercepts"])
    return let(logits, softmax)


def _best(chances: Column, model: dict) -> Column:
    """(chance, family) of the most probable class."""
    names = F.array(*[F.lit(c) for c in model["classes"]])
    return F.array_max(F.zip_with(chances, names, lambda p, n: F.struct(p.alias("chance"), n.alias("family"))))


def train(spark: SparkSession) -> dict:
    """classes, intercepts, weights (run: one per class) and threshold of the fitted classifier."""
    given = [{"i": i, "family": f, "text": t} for i, (f, t) in enumerate(notices())]
    every = _table(spark, given, "i int, family string, text string").select(
        "i", "family", "text", runs_of(words_of(F.col("text"))).alias("runs")
    )
    # a sentence is the only notice with its words, so none is left out
    sentences = F.from_json(F.lit(json.dumps(sum(terms.SENTENCES.values(), []))), "array<string>")
    draw = F.pmod(F.xxhash64("i"), F.lit(LEFT_OUT)) == 0
    every = every.withColumn("left_out", draw & ~F.array_contains(sentences, F.col("text"))).drop("text").cache()
    fitted = every.where("NOT left_out")
    counted = fitted.select(F.explode("runs").alias("run")).groupBy("run").count()
    vocabulary = [r[0] for r in counted.where(F.col("count") >= LEAST_NOTICES).orderBy("run").collect()]
    classes = sorted(terms.NAMES) + [UNKNOWN]
    all_runs = F.from_json(F.lit(json.dumps(vocabulary)), "array<string>")
    held = F.transform(all_runs, lambda v: F.array_contains("runs", v).cast("double"))
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")) - 1
    rows = fitted.select(array_to_vector(held).alias("features"), number.cast("double").alias("label")).cache()
    found = LogisticRegression(
        family="multinomial", regParam=5e-4, elasticNetParam=0.3, maxIter=80, standardization=False
    ).fit(rows)
    matrix = found.coefficientMatrix.toArray()
    model = {
        "classes": classes,
        "intercepts": [round(float(v), 6) for v in found.interceptVector.toArray()],
        "weights": {
            run: [round(float(v), 6) for v in matrix[:, j]]
            for j, run in enumerate(vocabulary)
            if abs(matrix[:, j]).max() >= LEAST_WEIGHT
        },
    }
    best = every.where("left_out").select("family", _best(_probabilities(F.col("runs"), model), model).alias("b"))
    checks = best.where(F.col("b.family") != UNKNOWN).select("b.chance", (F.col("b.family") == F.col("family")).alias("ok"))
    model["templates"] = templates(spark)
    model["threshold"] = calibrated([(r["chance"], r["ok"]) for r in checks.collect()])
    rows.unpersist()
    every.unpersist()
    return model


def calibrated(checks: list[tuple[float, bool]], wrong: float = WRONG, least: float = 0.5) -> float:
    """The lowest threshold from `least` on at which at most a share `wrong` of what passes is wrong."""
    for threshold in sorted({least, *(c for c, _ in checks if c >= least)}):
        passed = [ok for c, ok in checks if c >= threshold]
        if passed.count(False) <= wrong * len(passed):
            return threshold
    return 1.0


def _similarity(runs: Column, family: Column, model: dict) -> Column:
    """Largest share of a template's word runs that a paragraph has, over the templates of a family.

    Templates are whole notices and sentences. A bare name, labelled or not, is one only of paragraphs that say little else: its
    share counts as far as its runs are a third of the paragraph's.
    """
    listed = F.from_json(F.lit(json.dumps(model["templates"])), "map<string,array<struct<bare:boolean,runs:array<string>>>>")

    def share(t: Column) -> Column:
        held = F.size(F.array_intersect(t["runs"], runs)) / F.size(t["runs"])
        return F.when(t["bare"], held * F.least(F.lit(1.0), F.size(t["runs"]) * 3 / F.size(runs))).otherwise(held)

    return F.coalesce(F.array_max(F.transform(listed[family], share)), F.lit(0.0))


def templates(spark: SparkSession) -> dict[str, list[dict]]:
    """family -> its templates: whether a bare name, and the runs."""
    given = [
        {"family": f, "bare": phrase in terms.LABELS, "text": phrase.format(name)}
        for f, names in terms.NAMES.items() for name in names for phrase in terms.NOTICES
    ]
    given += [{"family": f, "bare": False, "text": s} for f, some in terms.SENTENCES.items() for s in some]
    rows = _table(spark, given, "family string, bare boolean, text string")
    out: dict[str, list[dict]] = {}
    for r in rows.select("family", "bare", runs_of(words_of(F.col("text"))).alias("runs")).collect():
        out.setdefault(r["family"], []).append({"bare": r["bare"], "runs": sorted(r["runs"])})
    return out


def _judged(text: Column, model: dict) -> Column:
    """(predicted, probability, similarity, confirmed) of a paragraph's text."""

    def of_best(runs: Column, best: Column) -> Column:
        passed = (best["family"] != UNKNOWN) & (best["chance"] >= model["threshold"]) & ~text.rlike(terms.DENIAL)
        like = F.when(passed, _similarity(runs, best["family"], model)).otherwise(0.0)
        return let(
            like,
            lambda s: F.struct(
                F.when(passed, best["family"]).otherwise(UNKNOWN).alias("predicted"),
                best["chance"].alias("probability"),
                s.alias("similarity"),
                (s >= CONFIRMED).alias("confirmed"),
            ),
        )

    def of_runs(runs: Column) -> Column:
        return let(_best(_probabilities(runs, model), model), lambda best: of_best(runs, best))

    return let(runs_of(words_of(text)), of_runs)


def _blocks(body: Column) -> Column:
    """(first, lines) of every run of lines with letters or digits; `first` counts from 0."""

    def cut(lines: Column) -> Column:
        def written(i: Column) -> Column:
            return F.coalesce(F.get(lines, i).rlike(r"[\p{L}\p{N}]"), F.lit(False))

        places = F.sequence(F.lit(0), F.size(lines) - 1)
        starts = F.filter(places, lambda i: written(i) & ~written(i - 1))
        stops = F.filter(places, lambda i: written(i) & ~written(i + 1))
        return F.zip_with(
            starts, stops, lambda a, b: F.struct(a.alias("first"), F.slice(lines, a + 1, b - a + 1).alias("lines"))
        )

    return let(F.split(body, "\n", -1), cut)


def _rows(block: Column, model: dict) -> Column:
    """The paragraphs of a block: its lines, and what those say together that confirm nothing alone."""

    def judged(line: Column, i: Column) -> Column:
        said = F.when(line.rlike(terms.ANCHOR), _judged(line, model))
        return F.struct((block["first"] + i).alias("paragraph"), line.alias("line"), said.alias("said"))

    def sure(row: Column) -> Column:
        return F.coalesce(row["said"]["confirmed"], F.lit(False))

    def together(others: Column) -> Column:
        text = F.array_join(F.transform(others, lambda r: r["line"]), " ")
        return F.when((F.size(others) > 1) & text.rlike(terms.ANCHOR), _judged(text, model))

    def shown(row: Column) -> Column:
        return F.struct(row["paragraph"].alias("paragraph"), row["said"].alias("said"))

    def chosen(others: Column, joined: Column) -> Column:
        one = F.struct(F.get(others, F.lit(0))["paragraph"].alias("paragraph"), joined.alias("said"))
        alone = F.transform(F.filter(others, lambda r: r["said"].isNotNull()), shown)
        return F.when(F.coalesce(joined["confirmed"], F.lit(False)), F.array(one)).otherwise(alone)

    def split(lines: Column) -> Column:
        rest = let(F.filter(lines, lambda r: ~sure(r)), lambda o: let(together(o), lambda joined: chosen(o, joined)))
        return F.concat(F.transform(F.filter(lines, sure), shown), rest)

    return let(F.transform(block["lines"], judged), split)


def scan_licenses(docs: DataFrame, model: dict | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, predicted, probability, similarity, confirmed) of every paragraph with
    a word of licences.

    Paragraphs are lines, numbered from 0. Since notices are wrapped, the lines between two lines without a
    letter or digit that confirm no family alone are also read as one text: where that confirms a family, one
    row with the number of the first of them stands for all of them.
    `predicted` is the classifier's family, unknown below its threshold; `family` is that family if a template
    confirms it and unknown otherwise. Null texts are empty and have no such paragraph; rows that repeat an id
    each give their paragraphs; a null id stays null. An empty table gives an empty result. Other columns are
    not read.
    """
    model = model or train(docs.sparkSession)
    flagged = docs.select(F.col(id_col).alias("id"), whole(text).alias("body")).where(F.col("body").rlike(terms.ANCHOR))
    blocks = flagged.select("id", F.explode(_blocks(F.col("body"))).alias("block"))
    some = blocks.where(F.array_join("block.lines", " ").rlike(terms.ANCHOR))
    found = some.select("id", F.explode(_rows(F.col("block"), model)).alias("row")).select("id", "row.paragraph", "row.said.*")
    return found.select(
        F.col("id").alias(id_col),
        "paragraph",
        F.when(F.col("confirmed"), F.col("predicted")).otherwise(UNKNOWN).alias("family"),
        "predicted",
        "probability",
        "similarity",
        "confirmed",
    )
