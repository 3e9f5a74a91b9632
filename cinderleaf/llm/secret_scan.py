"""Secrets in texts, and who else in the corpus has them.

Candidates are keyword assignments, access keys and long hexadecimal runs, with their code-point spans,
and other mixed runs of letters and digits. Their hashes are counted over the whole corpus by distinct
repository and owner: a value that many owners hold is a copied example, one that stays with an owner
looks live. Mixed runs count as secrets only when they stay with an owner. Only built-in column
functions; values never leave the scan, their SHA-256 does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderleaf.llm.common import attach, whole
from cinderleaf.session import checkpoint

# The patterns of the three base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

# A run of 20 or more token characters with a letter and a digit among them.
RUN = (
    r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
)
ANY = rf"{ASSIGN}|{ACCESS}|{HEX}|{RUN}"
KINDS = ["assign", "access", "hex", "owned"]
# From this many owners on a value is a copied example.
EXAMPLE_OWNERS = 3
SPAN = "array<struct<start:bigint,kind:int,stop:bigint,hash:binary>>"


def _spans(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 1) -> Column:
    """Matches of a pattern: (start, kind, stop, hash of the value), in the order of the text.

    The matches and the gaps between them add up to the text, which gives the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gaps = F.split(text, pattern, -1)
    steps = F.filter(
        F.zip_with(
            F.arrays_zip(found.alias("m"), values.alias("v")),
            gaps,
            lambda s, gap: F.struct(
                F.length(gap).cast("bigint").alias("skip"),
                F.length(s["m"]).cast("bigint").alias("n"),
                s["v"].alias("value"),
            ),
        ),
        lambda s: s["value"].isNotNull(),
    )

    def add(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["skip"]
        span = F.struct(
            start.alias("start"),
            F.lit(kind).alias("kind"),
            (start + s["n"]).alias("stop"),
            F.when(F.length(s["value"]) >= least, F.unhex(F.sha2(s["value"], 256))).alias("hash"),
        )
        return F.struct(
            (start + s["n"]).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans")
        )

    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.from_json(F.lit("[]"), SPAN).alias("spans"))
    return F.filter(F.aggregate(steps, empty, add)["spans"], lambda s: s["hash"].isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: row, id, repository, owner, `base` and `runs` spans.

    The repository is the source, its owner the part before the first slash; a null source is a
    repository of its own. `runs` are the mixed runs that overlap no base span.
    """
    body = whole(text)
    none = F.from_json(F.lit("[]"), SPAN)
    flagged = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("repository"),
        body.alias("body"),
        body.rlike(ANY).alias("any"),
    )
    found = flagged.select(
        "id",
        "repository",
        *(
            F.when(F.col("any"), spans).otherwise(none).alias(name)
            for name, spans in (
                ("assign", _spans(F.col("body"), ASSIGN, 0, 2, ASSIGN_LEAST)),
                ("access", _spans(F.col("body"), ACCESS, 1)),
                ("hex", _spans(F.col("body"), HEX, 2)),
                ("run", _spans(F.col("body"), RUN, 3)),
            )
        ),
    )
    base = found.select(
        "id", "repository", "run", F.array_sort(F.concat("assign", "access", "hex")).alias("base")
    )
    apart = F.filter(
        "run",
        lambda r: ~F.exists("base", lambda b: (b["start"] < r["stop"]) & (b["stop"] > r["start"])),
    )
    return base.select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        "repository",
        F.substring_index("repository", "/", 1).alias("owner"),
        "base",
        F.when(F.size("run") > 0, apart).otherwise(F.col("run")).alias("runs"),
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, repositories, owners, uses) over all candidates; pre-aggregated at every step."""
    by_place = candidates.groupBy("hash", "owner", "repository").agg(F.count("*").alias("uses"))
    by_owner = by_place.groupBy("hash", "owner").agg(
        F.count("*").alias("repositories"), F.sum("uses").alias("uses")
    )
    return by_owner.groupBy("hash").agg(
        F.sum("repositories").alias("repositories"), F.count("*").alias("owners"), F.sum("uses").alias("uses")
    )


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))
        ),
        ",",
    )


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """Per row of `docs`: counts, digest and list of its secrets, and what the corpus says of them.

    Columns: id, n_assign, n_access, n_hex, base_sha256, spans, n_live and n_copied (spans whose value
    stays below `example_owners` owners, and the others). A null text is empty; rows that repeat an id
    are scanned on their own; an empty table gives an empty result. Other columns are not read.
    """
    scanned = checkpoint(scan(docs, id_col, text, source))
    candidates = scanned.select(
        "row", "repository", "owner", F.explode(F.concat("base", "runs")).alias("c")
    ).select("row", "repository", "owner", "c.*")
    counted = checkpoint(ownership(candidates))
    total = counted.agg(F.sum("uses")).first()[0] or 0
    known = attach(candidates.select("row", "hash", "start", "kind", "stop"), counted, ["hash"], "uses", total)
    copied = F.col("owners") >= example_owners
    span = F.struct("start", "kind", "stop")
    judged = known.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") < 3) | ~copied, span))).alias("all"),
        F.sum(F.when(~copied, 1).otherwise(0)).alias("n_live"),
        F.sum(F.when(copied & (F.col("kind") < 3), 1).otherwise(0)).alias("n_copied"),
    )

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return scanned.join(judged, "row", "left").select(
        F.col("id").alias(id_col),
        *(count(kind).alias(f"n_{KINDS[kind]}") for kind in range(3)),
        F.sha2(_told(F.col("base")), 256).alias("base_sha256"),
        F.coalesce(_told(F.col("all")), F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )
