"""File name, upload and content screening as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderleaf.fixed import guard_rules as rules


def extension(filename: Column) -> Column:
    """Lower-cased last extension with its dot; empty for none or a leading-dot name."""
    base = F.regexp_extract(F.lower(filename), r"([^/]*)\z", 1)
    return F.regexp_extract(base, r"\A\.*[^.].*?(\.[^.]*)\z", 1)


def sanitize_filename(filename: Column) -> Column:
    base = F.regexp_extract(filename, r"([^/]*)\z", 1)
    return F.regexp_replace(base, r"[^a-zA-Z0-9._\-]", "")


def downloadable(filename: Column) -> Column:
    return ~extension(filename).isin(rules.WEIGHT_EXTENSIONS)


def screen_upload(
    filename: Column,
    size: Column,
    context: str = "default",
    max_bytes: int = rules.MAX_UPLOAD_BYTES,
) -> Column:
    """Struct (ok, reason): size, extension and traversal checks, in that order."""
    allowed = list(rules.DOCUMENT_EXTENSIONS)
    if context == "multimodal":
        allowed += rules.MEDIA_EXTENSIONS
    ext = extension(filename)
    listing = "['" + "', '".join(sorted(allowed)) + "']"
    unsupported = F.concat(
        F.lit("File extension '"), ext, F.lit(f"' is not supported. Whitelisted: {listing}")
    )
    traversal = filename.contains("..") | filename.contains("/") | filename.contains("\\")
    reason = (
        F.when(
            size > max_bytes,
            f"File size exceeds the maximum limit of {max_bytes // (1024 * 1024)}MB.",
        )
        .when(~ext.isin(allowed), unsupported)
        .when(traversal, "Path traversal characters detected in upload filename.")
        .otherwise("")
    )
    return F.struct((reason == "").alias("ok"), reason.alias("reason"))


def screen_content(content: Column, filename: Column) -> Column:
    """Struct (ok, reason) from the first 4,096 bytes of a file."""
    head = F.substring(content, 1, rules.HEAD_BYTES)
    digits = F.hex(head)
    ext = extension(filename)
    text = F.decode(head, "ISO-8859-1")
    packed = digits.startswith("504B0304") & ext.isin(rules.TEXT_EXTENSIONS)
    conflict = F.concat(
        F.lit("MIME Conflict: Compressed binary structure (PK) found in '"),
        ext,
        F.lit("' text file."),
    )
    reason = (
        F.when(
            F.position(F.lit("\x00"), text) > 0,
            "Malicious Content Blocked: Binary payload/null-bytes detected in file.",
        )
        .when(
            digits.startswith("4D5A"),
            "Malicious Content Blocked: Executable PE binary format detected.",
        )
        .when(
            digits.startswith("7F454C46"),
            "Malicious Content Blocked: Executable ELF format detected.",
        )
        .when(packed, conflict)
        .when(
            text.rlike("(?i)" + "|".join(rules.SCRIPT_PATTERNS)),
            "Malicious Content Blocked: HTML/Javascript script tag injections found.",
        )
        .otherwise("")
    )
    return F.struct((reason == "").alias("ok"), reason.alias("reason"))
