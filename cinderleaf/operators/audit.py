"""Tamper-evident logs, log pages and safety event summaries."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderleaf.fixed import guard_rules as rules
from cinderleaf.functions.crypto import hmac_sign
from cinderleaf.functions.text import strip
from cinderleaf.operators.ordered import CHUNK_ROWS, dense_index, lag_in, over_chunks

FIELDS = ["timestamp", "client_ip", "endpoint", "threat_level", "message"]


def write_audit_chain(events: DataFrame, stream: str, order: list[str], key: bytes) -> DataFrame:
    """Adds `signature`, each signed over the row's fields and the stream's previous signature.

    A chain is sequential by definition, so a stream is signed by one task. Rows pass through it in
    sorted Arrow batches with only the last signature held.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, rules.ROOT_SIGNATURE
        for pdf in batches:
            signatures = []
            for owner, *values in zip(pdf[stream], *(pdf[f] for f in FIELDS)):
                if owner != current:
                    current, last = owner, rules.ROOT_SIGNATURE
                payload = " ".join([*values, last]).encode()
                last = hmac.new(key, payload, hashlib.sha256).hexdigest()
                signatures.append(last)
            pdf["signature"] = signatures
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    rows = events.repartition(stream).sortWithinPartitions(stream, *order)
    return rows.mapInPandas(sign, f"{schema}, signature string")


def audit_line(separator: str = " | "):
    """Text of one log line."""
    return F.concat_ws(separator, *FIELDS, "signature")


def parse_audit_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Splits log lines into fields; blank lines are dropped, short lines keep null fields."""
    clean = lines.withColumn("_line", strip(F.col(text))).where("_line <> ''")
    parts = F.split("_line", r" \| ", -1)
    full = F.size(parts) >= 6
    fields = [F.when(full, F.get(parts, F.lit(i))).alias(n) for i, n in enumerate([*FIELDS, "signature"])]
    return clean.select(*lines.columns, *fields)


def check_audit_lines(
    lines: DataFrame, key: bytes, stream: str = "stream", line: str = "line", text: str = "text",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Parsed lines with `ok`: the signature fits the fields and the previous stored signature."""
    return _checked(lines, key, stream, line, text, chunk_rows).drop("_i")


def _checked(lines: DataFrame, key: bytes, stream: str, line: str, text: str, chunk_rows: int) -> DataFrame:
    """`check_audit_lines` with the dense index `_i` of the parsed lines."""
    parsed = dense_index(parse_audit_lines(lines, text), [stream, line], "_i")
    chained = over_chunks(
        parsed,
        "_i",
        1,
        lambda w: {
            "_before": lag_in([stream], "signature", 1, w),
            "_first": lag_in([stream], "_i", 1, w).isNull(),
        },
        chunk_rows,
    )
    before = F.when(F.col("_first"), F.lit(rules.ROOT_SIGNATURE)).otherwise(F.col("_before"))
    expected = hmac_sign(F.concat(F.concat_ws(" ", *FIELDS), F.lit(" "), before), key)
    ok = F.coalesce(F.col("signature") == expected, F.lit(False))
    return chained.withColumn("ok", ok).drop("_before", "_first")


def verify_audit_chain(
    lines: DataFrame, key: bytes, stream: str = "stream", line: str = "line", text: str = "text"
) -> DataFrame:
    """Per stream: intact flag, length of the valid prefix and the first bad line (-1 for none)."""
    checked = _checked(lines, key, stream, line, text, CHUNK_ROWS)
    # the index is dense within a stream, so the first bad one tells how many lines come before it
    bad = F.min(F.when(~F.col("ok"), F.struct("_i", F.col(line).alias("line"))))
    found = checked.groupBy(stream).agg(bad.alias("_bad"), F.min("_i").alias("_start"), F.max("_i").alias("_end"))
    return found.select(
        stream,
        F.col("_bad").isNull().alias("is_intact"),
        (F.coalesce("_bad._i", F.col("_end") + 1) - F.col("_start")).alias("valid_rows"),
        F.coalesce("_bad.line", F.lit(-1)).alias("tampered_line"),
    )


def valid_prefix(
    lines: DataFrame, key: bytes, stream: str = "stream", line: str = "line", text: str = "text"
) -> DataFrame:
    """Parsed lines before the first bad line of their stream."""
    checked = check_audit_lines(lines, key, stream, line, text)
    bad = checked.where("NOT ok").groupBy(stream).agg(F.min(line).alias("_bad"))
    good = checked.join(bad, stream, "left").where(F.col("_bad").isNull() | (F.col(line) < F.col("_bad")))
    return good.drop("_bad", "ok", text)


def audit_page(log: DataFrame, line: str, page: int = 1, limit: int = 20) -> DataFrame:
    """One page of the log, newest first."""
    return log.orderBy(F.col(line).desc()).offset((page - 1) * limit).limit(limit)


def alert_stream(log: DataFrame, level: str = "threat_level") -> DataFrame:
    """Rows at an alerting level; works on tables and on streams."""
    return log.where(F.col(level).isin(rules.ALERT_LEVELS))


def audit_summary(events: DataFrame, passed: str = "passed", by: list[str] | None = None) -> DataFrame:
    """Counts of all, blocked and passed events, overall or per group."""
    ok = F.col(passed).cast("boolean")
    return events.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        F.count_if(~ok).alias("blocked"),
        F.count_if(ok).alias("passed"),
    )


def log_tail(log: DataFrame, line: str, n: int = 400) -> DataFrame:
    """The last `n` lines in order."""
    return log.orderBy(F.col(line).desc()).limit(n).orderBy(line)


def keep_last_n(df: DataFrame, n: int, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """The newest `n` rows, overall or per key; each partition is cut to `n` before the shuffle."""
    newest = [F.col(o).desc() for o in order]
    if not keys:
        return df.orderBy(*newest).limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
