"""Queries over texts, prompts, files and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderleaf.fixed import guard_rules as rules
from cinderleaf.functions import crypto, guard, redact, screen, tokens
from cinderleaf.functions import text as tx
from cinderleaf.operators import catalog
from cinderleaf.operators.audit import alert_stream
from cinderleaf.operators.sequence import with_intent
from cinderleaf.plans.corpus import quality_report
from cinderleaf.queries import sql as q
from cinderleaf.queries.registry import query
from cinderleaf.queries.views import cte, table, view

KEY = b"audit-key-for-tests"
LIST_IPS = ["10.0.0.1", "10.0.0.3"]


def documents(spark, sf):
    return table(spark, sf, "documents")


@query(
    "corpus_quality_report",
    f"""WITH d AS (SELECT lang, ({q.quality('text')}) >= 0.5 AS q, ({q.toxic_hits('text')}) = 0 AS s,
 length({q.redact_pii('text')}) AS n FROM documents)
SELECT lang, count(*) AS docs, count(*) FILTER (WHERE q) AS quality_ok, count(*) FILTER (WHERE s) AS safe,
 count(*) FILTER (WHERE q AND s) AS kept, CAST(sum(CASE WHEN q AND s THEN n ELSE 0 END) AS BIGINT) AS kept_chars
FROM d GROUP BY lang""",
)
def corpus_quality_report(spark, sf):
    return quality_report(documents(spark, sf), "lang")


@query(
    "quality_score",
    f"SELECT doc_id, round({q.quality('text')}, 6) AS score, ({q.quality('text')}) >= 0.5 AS passes FROM documents",
)
def quality_score(spark, sf):
    docs = documents(spark, sf).select("doc_id", tx.quality_score(F.col("text")).alias("_s"))
    return docs.select("doc_id", F.round("_s", 6).alias("score"), (F.col("_s") >= rules.QUALITY_PASS).alias("passes"))


@query(
    "toxicity_score",
    f"""SELECT page_id, least(1.0, ({q.toxic_hits('html')}) * 0.5)::DOUBLE AS score,
 ({q.toxic_hits('html')}) = 0 AS passes FROM pages""",
)
def toxicity_score(spark, sf):
    html = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id", tx.toxicity_score(html).alias("score"), tx.passes_toxicity(html).alias("passes")
    )


@query("contains_pii", f"SELECT doc_id, {q.contains_pii('text')} AS pii FROM documents")
def contains_pii(spark, sf):
    return documents(spark, sf).select("doc_id", redact.contains_pii(F.col("text")).alias("pii"))


@query("redact_pii", f"SELECT doc_id, {q.redact_pii('text')} AS text FROM documents")
def redact_pii(spark, sf):
    return documents(spark, sf).select("doc_id", redact.redact_pii(F.col("text")).alias("text"))


@query("scrub_pii")
def scrub_pii(spark, sf):
    return documents(spark, sf).select("doc_id", redact.scrub_pii(F.col("text")).alias("text"))


@query("sanitize_credentials")
def sanitize_credentials(spark, sf):
    return documents(spark, sf).select("doc_id", redact.sanitize_credentials(F.col("text")).alias("text"))


@query("sanitize_nested")
def sanitize_nested(spark, sf):
    nested = documents(spark, sf).select(
        "doc_id",
        F.struct(F.array("text").alias("parts"), F.create_map(F.lit("source"), F.col("source")).alias("meta")).alias(
            "record"
        ),
    )
    out = redact.sanitize_nested(nested)
    return out.select("doc_id", F.col("record.parts")[0].alias("text"), F.col("record.meta")["source"].alias("source"))


def _guest(col: str) -> str:
    col = q.replace(col, rules.EMAIL, "[REDACTED_EMAIL]")
    col = q.replace(col, rules.LOCAL_PHONE, "[REDACTED_PHONE]")
    col = q.replace(col, f"{rules.OLD_NIC}|{rules.NEW_NIC}", "[REDACTED_NIC]")
    col = q.replace(col, rules.SK_KEY, "[REDACTED_API_KEY]")
    return q.replace(col, rules.AIZA_KEY, "[REDACTED_GOOGLE_KEY]")


@query("scrub_guest_text", f"SELECT doc_id, {_guest('text')} AS text FROM documents")
def scrub_guest_text(spark, sf):
    return documents(spark, sf).select("doc_id", redact.scrub_guest_text(F.col("text")).alias("text"))


@query(
    "redact_output",
    f"""WITH d AS (SELECT doc_id, text, ({q.toxic_hits('text')}) = 0 AND NOT {q.contains_pii('text')} AS clean,
 {q.redact_pii('text')} AS hidden FROM documents)
SELECT doc_id, CASE WHEN clean THEN hidden ELSE text END AS text,
 clean AND NOT regexp_matches(hidden, {q.text(rules.OUTPUT_SECRET)}) AS ok FROM d""",
)
def redact_output(spark, sf):
    out = documents(spark, sf).select("doc_id", redact.redact_output(F.col("text")).alias("o"))
    return out.select("doc_id", "o.text", "o.ok")


@query("normalize_security")
def normalize_security(spark, sf):
    return documents(spark, sf).select("doc_id", tx.normalize_security(F.col("text")).alias("text"))


@query("normalize_whitespace", f"SELECT doc_id, {q.squeeze('text')} AS text FROM documents")
def normalize_whitespace(spark, sf):
    return documents(spark, sf).select("doc_id", tx.normalize_whitespace(F.col("text"), compose=False).alias("text"))


@query(
    "safe_float",
    r"""SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '[-+]?\d*\.\d+|\d+') AS DOUBLE), 0.0::DOUBLE) AS value
FROM events""",
)
def safe_float(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.safe_float(F.col("props")).alias("value"))


# --- prompts ------------------------------------------------------------------------------------


@query("prompt_length_ok", "SELECT doc_id, length(text) <= 8000 AS ok FROM documents")
def prompt_length_ok(spark, sf):
    return documents(spark, sf).select("doc_id", guard.prompt_length_ok(F.col("text")).alias("ok"))


_INJECTION = [p.replace("{assistant}", "assistant") for p in rules.INJECTION_PATTERNS]


@query(
    "detect_injection",
    f"{cte('prompts')} SELECT prompt_id, {q.any_match('text', _INJECTION, 'is')} AS injection FROM prompts",
)
def detect_injection(spark, sf):
    return view(spark, sf, "prompts").select(
        "prompt_id", guard.detect_injection(F.col("text")).alias("injection")
    )


@query("persona_hijack", f"{cte('prompts')} SELECT prompt_id, {q.hijack('text')} AS hijack FROM prompts")
def persona_hijack(spark, sf):
    out = view(spark, sf, "prompts").select("prompt_id", guard.persona_hijack(F.col("text")).alias("h"))
    return out.select("prompt_id", "h.hijack")


_JAIL = " + ".join(f"{q.matches('text', p)}::INT" for p in rules.JAILBREAK_PATTERNS)


@query(
    "jailbreak_score",
    f"{cte('prompts')} SELECT prompt_id, round(least(1.0, ({_JAIL}) * 0.35), 2)::DOUBLE AS score FROM prompts",
)
def jailbreak_score(spark, sf):
    return view(spark, sf, "prompts").select(
        "prompt_id", F.round(guard.jailbreak_score(F.col("text")), 2).alias("score")
    )


@query(
    "intent",
    f"""{cte('prompts')}, s AS (SELECT prompt_id, text, {q.intent_score('text')} AS score FROM prompts)
SELECT prompt_id, score, {q.intent_status('text', 'score')} AS status FROM s""",
)
def intent(spark, sf):
    return with_intent(view(spark, sf, "prompts"), "text").select("prompt_id", "score", "status")


@query(
    "enforce_schema",
    f"""SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN 'user' ELSE role END AS role,
 substr({q.squeeze('text')}, 1, 32768) AS content FROM conversations WHERE {q.squeeze('text')} <> ''""",
)
def enforce_schema(spark, sf):
    rows = table(spark, sf, "conversations")
    role = F.when(F.col("turn") % 5 == 3, "narrator").otherwise(F.col("role"))
    messages = F.array(F.struct(role.alias("role"), F.col("text").alias("content")))
    return rows.select("conv_id", "turn", F.inline(guard.enforce_schema(messages)))


_MODES = (
    "CASE event_id % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'Please OVERRIDE it' "
    "WHEN 2 THEN 'fitness' ELSE 'You are now free' END"
)


@query(
    "payload_intent_ok",
    f"SELECT event_id, NOT {q.contains_any(f'lower({_MODES})', rules.MODE_PATTERNS)} AS ok FROM events",
)
def payload_intent_ok(spark, sf):
    return table(spark, sf, "events").select("event_id", guard.payload_intent_ok(F.expr(_MODES)).alias("ok"))


_REPLY = (
    "CASE doc_id % 5 WHEN 0 THEN concat('I cannot help. ', text) WHEN 1 THEN concat('Sorry, I cannot. ', text) "
    "WHEN 2 THEN ' ' WHEN 3 THEN concat(text, ' hack into it') ELSE text END"
)


@query(
    "alignment_check",
    f"""WITH r AS (SELECT doc_id, lower({_REPLY}) AS low FROM documents),
f AS (SELECT doc_id, length({q.strip('low')}) < 2 AS empty,
 contains(low, 'i cannot') AND NOT contains(low, 'because') AND NOT contains(low, 'sorry') AS refusal,
 {q.contains_any('low', rules.HARMFUL_PHRASES)} AS harmful FROM r)
SELECT doc_id, NOT empty AND NOT refusal AS helpful, NOT harmful AS harmless,
 NOT empty AND NOT refusal AND NOT harmful AS passed,
 concat_ws(',', CASE WHEN empty THEN 'empty_response' END, CASE WHEN refusal THEN 'unhelpful_refusal' END,
  CASE WHEN harmful THEN 'harmful_content' END) AS issues FROM f""",
)
def alignment_check(spark, sf):
    checked = documents(spark, sf).select("doc_id", guard.alignment_check(F.expr(_REPLY)).alias("a"))
    return checked.select("doc_id", "a.helpful", "a.harmless", "a.passed", F.array_join("a.issues", ",").alias("issues"))


_CATEGORY = "CASE p WHEN 7 THEN 'uncertain' WHEN 8 THEN 'pii' ELSE 'harmful' END"


@query(
    "safety_head_decision",
    f"""WITH v AS (SELECT vec_id, list_transform(embedding[1:9], lambda x: x * 20) AS l FROM embeddings),
t AS (SELECT vec_id, list_max(l) AS m, least(list_position(l, list_max(l)), 8) AS p FROM v)
SELECT vec_id, CASE WHEN 1.0 / (1.0 + exp(-m::DOUBLE)) > 0.7 THEN {_CATEGORY} END AS category FROM t""",
)
def safety_head_decision(spark, sf):
    logits = F.transform(F.slice("embedding", 1, 9), lambda x: x * F.lit(20).cast("float"))
    return table(spark, sf, "embeddings").select("vec_id", guard.safety_head_decision(logits).alias("category"))


_REASON = "CASE event_id % 6 WHEN 0 THEN 'jailbreak' WHEN 1 THEN 'harmful' WHEN 2 THEN 'pii' WHEN 3 THEN 'uncertain' ELSE 'other' END"
_REFUSAL = "CASE r " + " ".join(f"WHEN {q.text(k)} THEN {q.text(v)}" for k, v in rules.REFUSALS.items())
_REFUSAL += f" ELSE {q.text(rules.REFUSALS['default'])} END"


@query(
    "refusal_text",
    f"""WITH e AS (SELECT event_id, event_type, {_REASON} AS r FROM events)
SELECT event_id, concat({_REFUSAL}, CASE WHEN event_id % 2 = 0 THEN
 concat(chr(10), chr(10), 'I can help with:', chr(10), '- ', event_type) ELSE '' END) AS text FROM e""",
)
def refusal_text(spark, sf):
    none = F.array().cast("array<string>")
    options = F.when(F.col("event_id") % 2 == 0, F.array("event_type")).otherwise(none)
    return table(spark, sf, "events").select(
        "event_id", guard.refusal_text(F.expr(_REASON), options).alias("text")
    )


@query(
    "image_allowed",
    """SELECT page_id, sha256(html) NOT IN
 ('0000000000000000000000000000000000000000000000000000000000000000') AND (page_id % 10) / 10.0::DOUBLE < 0.5 AS ok
FROM pages""",
)
def image_allowed(spark, sf):
    content = F.col("html").cast("binary")
    score = (F.col("page_id") % 10) / F.lit(10.0)
    return table(spark, sf, "pages").select("page_id", guard.image_allowed(content, score, ["0" * 64]).alias("ok"))


@query(
    "fingerprint",
    f"{cte('requests')} SELECT event_id, substr(sha256(concat(client_ip, ':', nonce)), 1, 16) AS print FROM requests",
)
def fingerprint(spark, sf):
    return view(spark, sf, "requests").select(
        "event_id", guard.fingerprint(F.col("client_ip"), F.col("nonce")).alias("print")
    )


# --- keys and payloads -----------------------------------------------------------------------------


@query("hmac_sign", f"SELECT doc_id, {q.hmac('text', KEY)} AS signature FROM documents")
def hmac_sign(spark, sf):
    return documents(spark, sf).select("doc_id", crypto.hmac_sign(F.col("text"), KEY).alias("signature"))


@query(
    "hmac_verify",
    f"SELECT event_id, event_id % 3 <> 0 AS ok FROM events",
)
def hmac_verify(spark, sf):
    signed = table(spark, sf, "events").withColumn("sig", crypto.hmac_sign(F.col("props"), KEY))
    sent = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("0"), F.substring("sig", 1, 63))).otherwise(F.col("sig"))
    sent = F.when(F.col("event_id") % 3 == 0, F.reverse(sent)).otherwise(sent)
    return signed.select("event_id", crypto.hmac_verify(F.col("props"), sent, KEY).alias("ok"))


@query("aes_gcm_round_trip", "SELECT doc_id, text AS opened, NULL::VARCHAR AS wrong_key FROM documents")
def aes_gcm_round_trip(spark, sf):
    sealed = documents(spark, sf).select("doc_id", crypto.aes_gcm_seal(F.col("text"), b"k" * 32).alias("s"))
    return sealed.select(
        "doc_id",
        crypto.aes_gcm_open(F.col("s"), b"k" * 32).alias("opened"),
        crypto.aes_gcm_open(F.col("s"), b"x" * 32).alias("wrong_key"),
    )


@query(
    "decode_payload",
    "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL ELSE html END AS html FROM pages",
)
def decode_payload(spark, sf):
    coded = F.base64(F.col("html").cast("binary"))
    sent = (
        F.when(F.col("page_id") % 5 == 0, "not*base64!")
        .when(F.col("page_id") % 2 == 0, F.concat(F.lit("data:text/html;base64,"), coded))
        .otherwise(coded)
    )
    return table(spark, sf, "pages").select("page_id", crypto.decode_payload(sent).cast("string").alias("html"))


# --- files -------------------------------------------------------------------------------------------


@query(
    "sanitize_filename",
    f"""{cte('files')} SELECT page_id, regexp_replace(regexp_extract(filename, '([^/]*)$', 1), '[^a-zA-Z0-9._\\-]', '', 'g')
 AS filename FROM files""",
)
def sanitize_filename(spark, sf):
    return view(spark, sf, "files").select("page_id", screen.sanitize_filename(F.col("filename")).alias("filename"))


_MODEL_FILE = (
    "concat('m', CAST(page_id AS STRING), CASE page_id % 4 WHEN 0 THEN '.bin' WHEN 1 THEN '.json' "
    "WHEN 2 THEN '.v1.GGUF' ELSE '' END)"
)
_WEIGHTS = ", ".join(q.text(e) for e in rules.WEIGHT_EXTENSIONS)


@query("downloadable", f"SELECT page_id, {q.extension(_MODEL_FILE)} NOT IN ({_WEIGHTS}) AS ok FROM pages")
def downloadable(spark, sf):
    return table(spark, sf, "pages").select("page_id", screen.downloadable(F.expr(_MODEL_FILE)).alias("ok"))


_ALLOWED = ", ".join(q.text(e) for e in rules.DOCUMENT_EXTENSIONS)
_LISTING = "[" + ", ".join(f"''{e}''" for e in sorted(rules.DOCUMENT_EXTENSIONS)) + "]"


@query(
    "screen_upload",
    f"""{cte('files')}, s AS (SELECT page_id, filename, size * 40000 AS size, {q.extension('filename')} AS ext FROM files),
r AS (SELECT page_id, CASE WHEN size > {rules.MAX_UPLOAD_BYTES} THEN 'File size exceeds the maximum limit of 50MB.'
 WHEN ext NOT IN ({_ALLOWED}) THEN concat('File extension ''', ext, ''' is not supported. Whitelisted: {_LISTING}')
 WHEN contains(filename, '..') OR contains(filename, '/') OR contains(filename, chr(92))
 THEN 'Path traversal characters detected in upload filename.' ELSE '' END AS reason FROM s)
SELECT page_id, reason = '' AS ok, reason FROM r""",
)
def screen_upload(spark, sf):
    out = view(spark, sf, "files").select(
        "page_id", screen.screen_upload(F.col("filename"), F.col("size").cast("long") * 40000).alias("s")
    )
    return out.select("page_id", "s.ok", "s.reason")


def _hex(word: str) -> str:
    return "".join(f"({ch.lower().encode().hex()}|{ch.upper().encode().hex()})" for ch in word)


_END = "($|[0-2][0-9A-F]|3[A-F]|40|5[B-E]|60|7[B-F]|[89A-F][0-9A-F])"
_SPACES = "(09|0A|0B|0C|0D|20)*"
_TAGS = "|".join(
    [
        _hex("<script") + _END,
        _hex("javascript:"),
        _hex("<iframe") + _END,
        _hex("onload") + _SPACES + _hex("="),
    ]
).upper()


@query(
    "screen_content",
    f"""WITH h AS (SELECT page_id, substr(hex(encode(CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '<script|<iframe|onload|javascript:', '', 'gi')
 WHEN page_id % 7 = 0 THEN concat('MZ', html) ELSE html END)), 1, 8192) AS x FROM pages),
r AS (SELECT page_id, CASE WHEN regexp_matches(x, '^(..)*?00') THEN 'Malicious Content Blocked: Binary payload/null-bytes detected in file.'
 WHEN starts_with(x, '4D5A') THEN 'Malicious Content Blocked: Executable PE binary format detected.'
 WHEN regexp_matches(x, '^(..)*?({_TAGS})') THEN 'Malicious Content Blocked: HTML/Javascript script tag injections found.'
 ELSE '' END AS reason FROM h)
SELECT page_id, reason = '' AS ok, reason FROM r""",
)
def screen_content(spark, sf):
    html = (
        F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "(?i)<script|<iframe|onload|javascript:", ""))
        .when(F.col("page_id") % 7 == 0, F.concat(F.lit("MZ"), "html"))
        .otherwise(F.col("html"))
    )
    out = table(spark, sf, "pages").select(
        "page_id", screen.screen_content(html.cast("binary"), F.lit("page.csv")).alias("s")
    )
    return out.select("page_id", "s.ok", "s.reason")


# --- events ----------------------------------------------------------------------------------------------


@query(
    "allowlisted",
    f"{cte('requests')} SELECT event_id, client_ip, client_ip IN ('10.0.0.1', '10.0.0.3') AS allowed FROM requests",
)
def allowlisted(spark, sf):
    ips = spark.createDataFrame([(ip,) for ip in LIST_IPS], "client_ip string")
    marked = catalog.allowlisted(view(spark, sf, "requests"), ips, "client_ip", flag=True)
    return marked.select("event_id", "client_ip", "allowed")


@query(
    "alert_rows",
    f"{cte('audit')} SELECT event_id, threat_level, message FROM audit WHERE threat_level IN ('HIGH', 'CRITICAL')",
)
def alert_rows(spark, sf):
    return alert_stream(view(spark, sf, "audit")).select("event_id", "threat_level", "message")


# --- tokens and chat layouts ---------------------------------------------------------------------------------


@query(
    "encode_bytes",
    f"""SELECT doc_id, array_to_string(list_concat(list_transform(string_split({q.squeeze('text')}, ''),
 lambda c: unicode(c) % 256 + 17), [12]), ',') AS ids FROM documents""",
)
def encode_bytes(spark, sf):
    ids = tokens.encode_bytes(F.col("text"), eos=True)
    return documents(spark, sf).select("doc_id", F.array_join(ids, ",").alias("ids"))


@query(
    "decode_bytes",
    f"""SELECT doc_id, array_to_string(list_transform(string_split({q.squeeze('text')}, ''), lambda c: chr((unicode(c) % 256)::INTEGER)), '') AS text
FROM documents""",
)
def decode_bytes(spark, sf):
    coded = documents(spark, sf).select("doc_id", tokens.encode_bytes(F.col("text")).alias("ids"))
    return coded.select("doc_id", tokens.decode_bytes(F.col("ids")).alias("text"))


@query(
    "multimodal_sequence",
    f"""SELECT conv_id, turn, array_to_string(list_concat([15, 15, 15], list_concat(list_transform(string_split({q.squeeze('text')}, ''), lambda c: unicode(c) % 256 + 17),
 [16, 16, 118, 127, 117])), ',') AS ids FROM conversations""",
)
def multimodal_sequence(spark, sf):
    text = F.concat(F.lit("<image>"), F.col("text"), F.lit(" <audio> end"))
    ids = tokens.multimodal_sequence(text, F.lit(3), F.lit(2))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(ids, ",").alias("ids"))


def _chats(spark, sf):
    rows = table(spark, sf, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return rows.groupBy("conv_id").agg(turns.alias("messages"))


@query(
    "chat_template",
    """SELECT conv_id, string_agg(concat('<|', role, '|>', chr(10), text), chr(10) ORDER BY turn)
 || chr(10) || '<|assistant|>' || chr(10) AS prompt FROM conversations
WHERE role IN ('system', 'user', 'assistant', 'tool') GROUP BY conv_id""",
)
def chat_template(spark, sf):
    return _chats(spark, sf).select("conv_id", tokens.chat_template(F.col("messages")).alias("prompt"))


@query(
    "history_prompt",
    """SELECT conv_id, string_agg(concat('[', upper(role), ']', chr(10), text, chr(10), chr(10)), '' ORDER BY turn)
 || '[ASSISTANT]' || chr(10) AS prompt FROM conversations GROUP BY conv_id""",
)
def history_prompt(spark, sf):
    return _chats(spark, sf).select("conv_id", tokens.history_prompt(F.col("messages")).alias("prompt"))


_CHATML = (
    "concat('<|im_start|>system', chr(10), 'Be brief', '<|im_end|>', chr(10), '<|im_start|>user', chr(10), prompt, "
    "'<|im_end|>', chr(10), '<|im_start|>assistant', chr(10), chosen, '<|im_end|>')"
)


@query(
    "render_format",
    f"""{cte('pairs')}, t AS (SELECT pair_id, {_CHATML} AS text FROM pairs),
n AS (SELECT pair_id, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM t)
SELECT pair_id, text, tokens, CAST(least(100, floor(tokens / 2048.0::DOUBLE * 100 + 0.5)) AS BIGINT) AS percent FROM n""",
)
def render_format(spark, sf):
    shown = tokens.render_format(F.lit("Be brief"), F.col("prompt"), F.col("chosen"), "chatml")
    return view(spark, sf, "pairs").select("pair_id", shown.alias("r")).select("pair_id", "r.*")


@query(
    "eval_prompts",
    """SELECT item_id, concat(text, chr(10), 'A) a', chr(10), 'B) b', chr(10), 'C) c', chr(10), 'D) d', chr(10), 'Answer:') AS mmlu,
 concat(text, chr(10)) AS gsm8k, concat('<image> ', text, chr(10), 'Answer:') AS mmmu,
 concat('<audio> ', text, chr(10), 'Answer:') AS air_bench, text AS truthfulqa FROM benchmark""",
)
def eval_prompts(spark, sf):
    choices = F.array(*[F.lit(c) for c in "abcd"])
    names = ["mmlu", "gsm8k", "mmmu", "air_bench", "truthfulqa"]
    return table(spark, sf, "benchmark").select(
        "item_id", *[tokens.eval_prompt(n, F.col("text"), choices).alias(n) for n in names]
    )
