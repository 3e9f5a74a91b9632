"""Patterns, word lists and limits of the text, safety and security rules.

Patterns are written for `rlike` / `regexp_replace`; `{assistant}` is the assistant's own name.
"""

# --- fixed values: corpus rules -------------------------------------------------------------
SHINGLE_WORDS = 5
NEAR_DUPLICATE_FIFTHS = 4  # Jaccard >= 4/5, compared in integers
QUALITY_MIN_CHARS = 50
QUALITY_MAX_CHARS = 100_000
QUALITY_MIN_ALPHA = 0.7
QUALITY_MIN_UNIQUE = 0.7
QUALITY_PASS = 0.5
TOXIC_HIT = 0.5
TOXIC_LIMIT = 0.3
TOXIC_PATTERNS = [
    r"\b(child\s*(porn|abuse|sexual))\b",
    r"\b(terrorist\s*attack\s*how\s*to)\b",
    r"\b(make\s*a\s*bomb)\b",
]

# --- fixed values: personal data ------------------------------------------------------------
CORPUS_PII = [
    ("[REDACTED_EMAIL]", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("[REDACTED_PHONE]", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    ("[REDACTED_SSN]", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("[REDACTED_CREDIT_CARD]", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
]
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
LOCAL_PHONE = r"(?:\+94|0|0094)?\s*(?:[1-9]\d|7\d)\s*\d{3}\s*\d{4}\b"
ANY_PHONE = LOCAL_PHONE + r"|(?:\+?\d{1,3}[\s-]?)?\(?\d{2,4}\)?[\s-]?\d{3,4}[\s-]?\d{3,4}\b"
PHONE_DIGITS = (8, 15)
OLD_NIC = r"\b\d{9}[vVxX]\b"
NEW_NIC = r"\b(?:19|20)\d{10}\b"
CARD = r"\b(?:\d{4}[-\s]?){3}\d{4}\b|\b\d{13,19}\b"
CARD_DIGITS = [13, 14, 15, 16, 19]
GPS = (
    r"\b[-+]?(?:90(?:\.0+)?|[1-8]?\d\.\d{3,})\s*,\s*"
    r"[-+]?(?:180(?:\.0+)?|1[0-7]\d\.\d{3,}|[1-9]?\d\.\d{3,})\b"
)
KEY_VALUE_SECRET = (
    r"(?i)(api[-_]?key|secret[-_]?key|auth[-_]?token|password|passwd|bearer|token)"
    r"(?:\s*[:=]\s*[\"'\x08]?)\s*([a-zA-Z0-9_\-\.~]{16,})[\"'\x08]?"
)
TOKEN_SHAPE = (
    r"\b(?:xox[bpa]-[0-9]{12}-[0-9]{12}-[a-zA-Z0-9]{24}|AIzaSy[a-zA-Z0-9_\-]{33}"
    r"|[a-zA-Z0-9]{40}|[a-zA-Z0-9]{32})\b"
)
SK_KEY = r"(sk-[a-zA-Z0-9]{48})"
AIZA_KEY = r"(AIza[0-9A-Za-z_-]{35})"
OUTPUT_SECRET = r"(?i)(sk-[a-zA-Z0-9]{20,}|api[_-]?key\s*[:=]\s*\S+)"

# --- fixed values: look-alike letters and invisible marks ------------------------------------
INVISIBLE_MARKS = "\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\ufeff"
LOOKALIKES = [
    ("асеорхуѕіјԁոԝ", "aceopxysijdnw"),
    ("αβεικνορτυχ", "abeikvoptux"),
    ("ΑΒΕΗΙΚΜΝΟΡΤΥΧ", "ABEHIKMNOPTYX"),
    ("օոսա", "onua"),
]

# --- fixed values: prompt rules ---------------------------------------------------------------
MAX_PROMPT_TOKENS = 2000
CHARS_PER_TOKEN = 4
MAX_MESSAGE_CHARS = 32_768
INJECTION_PATTERNS = [
    r"ignore\s+(?:previous|the|all)\s+instructions?",
    r"ignore\s+the\s+directions?",
    r"system\s+prompt",
    r"bypass\s+(?:safety|filters?|rules?|restrictions?)",
    r"jailbreak",
    r"you\s+must\s+now\s+act\s+as",
    r"ignore\s+the\s+rules?",
    r"reveal\s+your\s+(?:password|instructions?|system\s+prompt|secrets?)",
    r"dan\s+mode",
    r"do\s+anything\s+now",
    r"forget\s+you\s+are\s+{assistant}",
    r"act\s+as\s+a\s+different\s+(?:ai|model|assistant)",
    r"pretend\s+(?:you\s+are|to\s+be)",
    r"disregard\s+(?:previous|all|the)\s+instructions?",
    r"enable\s+developer\s+mode",
    r"simulation\s+mode",
    r"override\s+(?:your|all)?\s*(?:safety|guidelines?|constraints?|rules?)",
    r"you\s+have\s+no\s+restrictions?",
    r"ignore\s+your\s+(?:training|guidelines?|programming)",
    r"hypothetically\s+speaking,?\s+(?:if|how|what)",
    r"in\s+a\s+fictional\s+world\s+where\s+(?:ai|you)\s+(?:have\s+no|can)",
    r"respond\s+as\s+if\s+you\s+(?:were|have|had)\s+no\s+(?:filter|restriction|rule)",
    r"your\s+true\s+self\s+(?:is|has)\s+no\s+limits?",
]
HIJACK_PATTERNS = [
    r"you\s+are\s+now\s+(?!{assistant})",
    r"forget\s+you\s+are\s+{assistant}",
    r"act\s+as\s+a\s+different\s+(?:ai|model|assistant)",
    r"do\s+anything\s+now",
    r"your\s+name\s+is\s+\w+",
    r"roleplay\s+as\s+(?:an?\s+)?(?:unrestricted|unfiltered|uncensored|evil|jailbroken)\s+ai",
    r"from\s+now\s+on\s+(?:you\s+are|you're|call\s+yourself)\s+(?:called\s+)?\w+",
    r"you\s+(?:will|shall|must)\s+(?:now\s+)?(?:be|act\s+as|pretend\s+to\s+be)\s+(?:a\s+)?(?!{assistant})\w+",
    r"forget\s+(?:all\s+)?(?:your|the)?\s*(?:previous|prior|past)?\s*(?:instructions?|rules?|guidelines?|training)",
    r"switch\s+to\s+(?:developer|admin|god|root|unrestricted)\s+mode",
    r"(?:i|we)\s+(?:give|grant)\s+you\s+(?:full\s+)?(?:permission|access|authority)\s+to",
]
REINFORCEMENT = "[System Alert: Persona reinforcement active. Maintain identity as {assistant}.]\n"
JAILBREAK_HIT = 0.35
JAILBREAK_PATTERNS = [
    r"ignore (all )?(previous|prior) instructions",
    r"you are now (DAN|jailbroken|unrestricted)",
    r"pretend you have no (rules|restrictions|guidelines)",
    r"developer mode enabled",
    r"bypass (safety|content) (filter|policy)",
]
HARMFUL_PATTERNS = [
    r"\b(?:explosive|bomb|ied|pipe\s+bomb|grenade|bioweapon|nerve\s+agent)\b",
    r"\b(?:how\s+to\s+(?:make|build|create|synthesize)\s+(?:bomb|weapon|poison|drug))\b",
    r"\b(?:child\s+(?:abuse|porn|exploit)|csam|pedophil)\b",
    r"\b(?:self.?harm|suicide\s+method|kill\s+myself|how\s+to\s+die)\b",
    r"\b(?:racial\s+slur|hate\s+speech|ethnic\s+cleansing|genocide\s+(?:support|promote))\b",
    r"\b(?:sexual\s+assault|rape\s+(?:guide|how|method)|drug\s+rape)\b",
    r"\b(?:human\s+trafficking|sell\s+(?:people|humans)|sex\s+slave)\b",
    r"\b(?:doxx(?:ing)?|deanonymize|expose\s+personal\s+(?:info|address|location))\b",
]
HARMFUL_SCORE = 100
HIJACK_WEIGHT = 30
THREAT_WEIGHTS = [
    (r"\b(?:dan|jailbreak|devmode|bypass|override)\b", 40),
    (r"\bignore\b.*\binstructions\b", 35),
    (r"\bsystem\s+prompt\b", 30),
    (r"\b(?:hack|ddos|malware|steal|bypass\s+auth|sql\s+injection|xss|phish)\b", 45),
    (r"\byou\s+are\s+now\s+a\b", 25),
    (r"\bact\s+as\b", 20),
    (r"pretend\s+(?:you\s+are|to\s+be)", 30),
    (r"disregard\s+(?:previous|all|the)\s+instructions?", 35),
    (r"from\s+now\s+on\s+(?:you\s+are|you're|call\s+yourself)", 30),
    (r"enable\s+developer\s+mode", 40),
    (r"simulation\s+mode", 25),
]
INTENT_TIERS = [(60, "INJECTION_ATTEMPT"), (40, "JAILBREAK"), (20, "SUSPICIOUS")]
SEVERITY = ["SAFE", "SUSPICIOUS", "JAILBREAK", "INJECTION_ATTEMPT", "HARMFUL_CONTENT"]
BLOCKING_INTENTS = ["INJECTION_ATTEMPT", "JAILBREAK"]
MODE_PATTERNS = [
    "ignore all previous",
    "forget everything",
    "system prompt",
    "you are now",
    "bypass",
    "override",
]

# --- fixed values: multi-turn, rate, replay and session limits (milliseconds) -----------------
TURN_WINDOW = 5
SESSION_IDLE_MS = 1_800_000
RATE_LIMIT = 10
RATE_WINDOW_MS = 60_000
BURST_LIMIT = 20
BURST_WINDOW_MS = 5_000
BLOCK_MS = 300_000
ADMIT_LIMIT = 30
THROTTLE_MS = 1_500
NONCE_MS = 300_000

# --- fixed values: refusals and alignment -----------------------------------------------------
REFUSALS = {
    "default": "<|refuse|> I'm not able to help with that request. "
    "I can help with safe, constructive topics instead.",
    "jailbreak": "<|refuse|> I can't override my safety guidelines. Please ask a different question.",
    "harmful": "<|refuse|> I won't provide information that could cause harm. "
    "If you're in crisis, please contact local emergency services.",
    "pii": "<|refuse|> I detected sensitive personal information in this request. "
    "Please remove PII and try again.",
    "uncertain": "<|uncertain|> I'm not confident enough to answer accurately. "
    "Could you provide more context or rephrase your question?",
}
SAFETY_CATEGORIES = [
    "harmful", "harmful", "harmful", "harmful", "harmful", "harmful", "uncertain", "pii",
]
SAFETY_THRESHOLD = 0.7
HARMFUL_PHRASES = ["kill yourself", "how to make a bomb", "hack into"]

# --- fixed values: file screening --------------------------------------------------------------
MAX_UPLOAD_BYTES = 52_428_800
DOCUMENT_EXTENSIONS = [".csv", ".json", ".jsonl", ".txt", ".md", ".pdf"]
MEDIA_EXTENSIONS = [".mp4", ".webm", ".mov", ".avi", ".wav", ".mp3", ".ogg", ".m4a", ".flac"]
TEXT_EXTENSIONS = [".csv", ".txt", ".md", ".json", ".jsonl"]
WEIGHT_EXTENSIONS = [".bin", ".safetensors", ".pt", ".pth", ".ckpt", ".gguf"]
SCRIPT_PATTERNS = [r"<script\b", r"javascript:", r"<iframe\b", r"onload\s*="]
HEAD_BYTES = 4096

# --- fixed values: data-leak view ----------------------------------------------------------------
PRIVATE_COLUMNS = ["_raw", "owner_id", "internal_notes", "created_by"]
POSITION_COLUMNS = ["lat", "lng", "latitude", "longitude"]

# --- fixed values: audit log ------------------------------------------------------------------------
ROOT_SIGNATURE = "0" * 64
ALERT_LEVELS = ["HIGH", "CRITICAL"]
