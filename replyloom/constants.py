"""Fixed values that decide results: vocabularies, thresholds and output wording.

Every value here is data, not logic. Operators take them as defaults, so a caller can
pass another taxonomy, lexicon or threshold.
"""

from __future__ import annotations

# --- fixed values: intent labels -------------------------------------------------
TAXONOMY = (
    "account_access",
    "billing_refund",
    "product_defect",
    "order_delivery",
    "service_outage",
    "safety_incident",
    "complaint_escalation",
    "general_inquiry",
    "feedback_praise",
    "other",
)
OTHER = "other"
SAFETY = "safety_incident"

# --- fixed values: rule vocabulary, in priority order (first match wins) -------------
LEXICON = (
    ("account_access", ("password", "login", "log in", "locked out", "can't sign in", "2fa")),
    ("billing_refund", ("refund", "charged", "charge", "billing", "payment", "money back", "fare",
                        "cancellation fee")),
    ("safety_incident", ("assault", "accident", "unsafe", "harass", "police", "injur", "threat",
                         "crashed", "sexually")),
    ("product_defect", ("broken", "defective", "doesn't work", "not working", "bug", "glitch")),
    ("order_delivery", ("delivery", "shipped", "shipping", "package", "tracking", "order",
                        "driver not", "still waiting")),
    ("service_outage", ("down", "outage", "can't connect", "not loading", "offline")),
    ("complaint_escalation", ("unacceptable", "manager", "furious", "worst", "disgusted",
                              "lawsuit", "ridiculous", "pathetic", "never again")),
    ("feedback_praise", ("thank you", "thanks", "great job", "love", "awesome")),
)

# --- fixed values: emergency words checked before any model is asked ---------------
SAFETY_TRIGGERS = ("police", "emergency", "assault", "911", "ambulance")

# --- fixed values: decision table -------------------------------------------------
HIGH_RISK_INTENTS = ("billing_refund", "complaint_escalation", "account_access", "safety_incident")
NEVER_DRAFT_INTENTS = ("safety_incident",)
MIN_CONFIDENCE = 0.75
MIN_SIMILARITY = 0.55

# --- fixed values: text filters ---------------------------------------------------
MAX_FOREIGN_RATIO = 0.3
MIN_TEXT_CHARS = 3

# --- fixed values: retrieval, sampling and report sizes -----------------------------
TOP_K = 3
FIRST_STAGE_K = 20
RERANK_TOP_K = 5
HOLDOUT_TRAIN_SHARE = 0.7
MIN_TRAIN_ROWS = 5
SAMPLE_SIZE = 200
OUTLIER_SHARE = 0.15
BRAND_LIST_SIZE = 40
CONFUSION_LIST_SIZE = 12
TFIDF_VOCABULARY = 5000
DEFAULT_ENCODER = "Qwen/Qwen3-Embedding-0.6B"

# --- fixed values: wording that appears in output columns ---------------------------
RATIONALE_SAFETY = "safety emergency rule match"
RATIONALE_KEYWORD = "keyword match"
SOURCE_SAFETY = "safety_rule"
SOURCE_KEYWORD = "keyword"
SOURCE_FALLBACK = "llm_fallback"
UNPARSEABLE_PREFIX = "unparseable: "
UNPARSEABLE_CHARS = 80
METHOD_TWO_STAGE = "embedding+rerank"
METHOD_ONE_STAGE = "embedding_only"
METHOD_SKIPPED = "skipped"
REASON_HIGH_RISK = ("high-risk intent (", ") always routed to a human")
REASON_CONFIDENCE = ("low classifier confidence (", " < ", ")")
REASON_SIMILARITY = (
    "no closely similar past resolution found (top similarity ",
    " < ",
    "), reply may not be well grounded",
)
REASON_AUTO = "high-confidence intent, low-risk category, well-grounded reply"
REASON_NEVER_DRAFT = ("intent '", "' is never auto-drafted, routed directly to a human agent")
