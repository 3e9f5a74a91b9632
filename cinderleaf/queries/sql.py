"""Fragments for the SQL statements of the registered queries."""

from __future__ import annotations

from cinderleaf.fixed import guard_rules as rules

BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def text(value: str) -> str:
    """A quoted SQL string."""
    return "'" + value.replace("'", "''") + "'"


def words(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '{BLANK}+'), lambda w: w <> '')"


def strip(col: str) -> str:
    return f"regexp_replace({col}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def squeeze(col: str) -> str:
    return f"trim(regexp_replace({col}, '{BLANK}+', ' ', 'g'))"


def matches(col: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({col}, {text(pattern)}, '{flags}')"


def any_match(col: str, patterns: list[str], flags: str = "i") -> str:
    return matches(col, "|".join(f"(?:{p})" for p in patterns), flags)


def replace(col: str, pattern: str, by: str) -> str:
    return f"regexp_replace({col}, {text(pattern)}, {text(by)}, 'g')"


def contains_any(col: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {text(p)})" for p in parts) + ")"


def quality(col: str) -> str:
    letters = f"length(regexp_replace({col}, '[^\\p{{L}}]+', '', 'g'))"
    n = f"length({col})"
    split = words(col)
    unique = f"(len(list_distinct({split}))::DOUBLE / len({split}))"
    return (
        f"CASE WHEN {n} < 50 OR {n} > 100000 THEN 0.0::DOUBLE "
        f"WHEN {letters}::DOUBLE / greatest({n}, 1) < 0.7 THEN 0.0::DOUBLE "
        f"WHEN len({split}) = 0 OR {unique} < 0.7 THEN 0.0::DOUBLE "
        f"ELSE least(1.0::DOUBLE, {unique} * ({letters}::DOUBLE / greatest({n}, 1))) END"
    )


def toxic_hits(col: str) -> str:
    return " + ".join(f"{matches(col, p)}::INT" for p in rules.TOXIC_PATTERNS)


def contains_pii(col: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {text(p)})" for _, p in rules.CORPUS_PII) + ")"


def redact_pii(col: str) -> str:
    for tag, pattern in rules.CORPUS_PII:
        col = replace(col, pattern, tag)
    return col


def _not_literal(word: str) -> str:
    """RE2 form of one or more characters that do not spell the word."""
    first, rest = word[0], word[1:]
    inner = _not_literal(rest) if rest else None
    other = f"[^{first}]"
    return f"(?:$|{other}|{first}{inner})" if inner else f"(?:$|{other})"


def hijack(col: str, assistant: str = "assistant") -> str:
    """The hijack patterns with their negative look-aheads spelled out."""
    patterns = []
    for p in rules.HIJACK_PATTERNS:
        if p.startswith(r"you\s+are\s+now"):
            p = r"you\s+are\s+now\s(?:\s|" + _not_literal(assistant) + ")"
        elif "(?!" in p:
            word = rf"(?:[b-z0-9_]|{assistant[0]}{_not_literal(assistant[1:])})"
            p = r"you\s+(?:will|shall|must)\s+(?:now\s+)?(?:be|act\s+as|pretend\s+to\s+be)\s+" + word
        patterns.append(p.replace("{assistant}", assistant))
    return any_match(col, patterns, "is")


def intent_score(col: str) -> str:
    low = f"lower({col})"
    weights = " + ".join(
        f"CASE WHEN {matches(low, p, 'c')} THEN {w} ELSE 0 END" for p, w in rules.THREAT_WEIGHTS
    )
    return (
        f"CASE WHEN {any_match(low, rules.HARMFUL_PATTERNS)} THEN {rules.HARMFUL_SCORE} "
        f"ELSE CASE WHEN {hijack(low)} THEN {rules.HIJACK_WEIGHT} ELSE 0 END + {weights} END"
    )


def intent_status(col: str, score: str) -> str:
    tiers = " ".join(f"WHEN {score} >= {n} THEN '{s}'" for n, s in rules.INTENT_TIERS)
    harmful = any_match(f"lower({col})", rules.HARMFUL_PATTERNS)
    return f"CASE WHEN {harmful} THEN 'HARMFUL_CONTENT' {tiers} ELSE 'SAFE' END"


def severity(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{s}' THEN {i}" for i, s in enumerate(rules.SEVERITY)) + " ELSE 0 END"


def fraction(*parts: str) -> str:
    """A draw in [0, 1) from the MD5 of the joined parts."""
    joined = "concat_ws(':', " + ", ".join(parts) + ")"
    return f"(('0x' || substr(md5({joined}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def extension(col: str) -> str:
    base = f"regexp_extract(lower({col}), '([^/]*)$', 1)"
    return f"regexp_extract({base}, '^\\.*[^.].*?(\\.[^.]*)$', 1)"


def hmac(message: str, key: bytes) -> str:
    """Hex HMAC-SHA256 of a text expression."""
    block = key.ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in block).hex()
    outer = bytes(b ^ 0x5C for b in block).hex()
    body = f"sha256(unhex('{inner}') || encode({message}))"
    return f"sha256(unhex('{outer}') || unhex({body}))"
