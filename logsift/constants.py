"""Fixed values that results depend on: lists, grids, thresholds, patterns."""

import numpy as np

# ---- fixed values: sampling, splits and folds --------------------------------
WINDOW_SIZE = 20
SLIDING_SIZE, SLIDING_STRIDE = 10, 5
SUPPORT_SIZES = (60, 300, 600)
STUDY_SEEDS = (7, 21, 42, 84, 123)
BACKTEST_FOLDS = (
    ("fold_1", 0.40, 0.60, 0.70),
    ("fold_2", 0.50, 0.70, 0.80),
    ("fold_3", 0.60, 0.80, 1.00),
)

# ---- fixed values: retrieval --------------------------------------------------
TOP_K = 3
KNOWLEDGE_TOP_K = 4
DEPLOYED_SEMANTIC_WEIGHT = 0.75
DEPLOYED_MINIMUM_SCORE = 0.05
INVESTIGATION_SEMANTIC_WEIGHT = 0.70
MINIMUM_HYPOTHESIS_EVIDENCE = 0.26

# ---- fixed values: calibration grids ------------------------------------------
REPORT_THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)
# exact doubles, floating drift included (the grid holds 0.20000000000000004)
F1_GRID = tuple(float(v) for v in np.arange(0.10, 0.91, 0.05))
FINE_GRID = tuple(float(v) for v in np.linspace(0.05, 0.95, 91))
SCORE_QUANTILES = tuple(float(v) for v in np.linspace(0.05, 0.95, 100))
HYBRID_WEIGHTS = (0.00, 0.25, 0.50, 0.60, 0.75, 1.00)
HYBRID_THRESHOLDS = (
    0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50,
    0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95,
)
VOTE_THRESHOLDS = (
    0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 0.97, 0.98, 0.99,
)
CONFIDENCE_GRID = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
SIMILARITY_GRID = (
    0.00, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35,
    0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70,
)
SIMILARITY_QUANTILES = (0.10, 0.20, 0.30, 0.40, 0.50)
MAX_UNSAFE_RATE = 0.05
OOD_RATE = 0.05
FAMILYWISE_CONFIDENCE = 0.95
MIN_AUTOMATED = 100
# source weights of the two-classifier blend
BLEND_WEIGHTS = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
INVESTIGATION_WEIGHTS = (0.40, 0.55, 0.70, 0.85)
INVESTIGATION_EVIDENCE = (0.20, 0.26, 0.32, 0.38)
LATENCY_BUCKETS = (0.01, 0.05, 0.10, 0.25, 0.50, 1.0, 2.5, 5.0)

# ---- fixed values: word lists -------------------------------------------------
EVIDENCE_STOP_WORDS = (
    "a", "an", "and", "at", "for", "from", "in", "of", "on",
    "the", "to", "with", "is", "was", "info",
)
COMMON_KEYWORDS = (
    "after", "api", "application", "check", "error", "failure", "for", "from",
    "incident", "investigation", "service", "the", "with",
)
ROOT_CAUSES = {
    "database_connection_pool_exhaustion": (
        "database", "connection", "pool", "timeout", "refused",
    ),
    "dns_or_network_failure": ("dns", "host", "network", "upstream", "reset"),
    "recent_deployment_regression": (
        "deployment", "release", "exception", "validation", "rollback",
    ),
}
DEPLOYMENT_CAUSE = "recent_deployment_regression"
CAUSE_EVIDENCE_KEYWORDS = {
    "database": ("db", "postgres", "query"),
    "network": ("packet", "dns", "upstream"),
    "application": ("exception", "handler", "version"),
}
ERROR_WORDS = "error|fatal|exception|timeout|failed|refused"
# Common English function words; a caller may pass another list.
ENGLISH_STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at",
    "be", "because", "been", "before", "being", "between", "both", "but", "by",
    "can", "could", "did", "do", "does", "during", "each", "for", "from", "had",
    "has", "have", "he", "her", "his", "how", "i", "if", "in", "into", "is",
    "it", "its", "may", "more", "most", "no", "nor", "not", "of", "on", "or",
    "our", "out", "over", "she", "should", "so", "some", "such", "than", "that",
    "the", "their", "them", "then", "there", "these", "they", "this", "those",
    "through", "to", "under", "until", "up", "very", "was", "we", "were", "what",
    "when", "where", "which", "while", "who", "why", "will", "with", "would",
    "you", "your",
)

# ---- fixed values: decisions ---------------------------------------------------
LIKELY_ANOMALY = "LIKELY_ANOMALY"
LIKELY_NORMAL = "LIKELY_NORMAL"
NEEDS_REVIEW = "NEEDS_HUMAN_REVIEW"
ENGINEER_REVIEW = "ENGINEER_REVIEW_REQUIRED"
ANALYZED = "ANALYZED"
HUMAN_APPROVAL = "HUMAN_APPROVAL_REQUIRED"

# ---- fixed values: character classes -------------------------------------------
# Whitespace and word characters of Unicode text, spelled out so that the JVM's regex
# engine gives the same result whatever its version or flags. Digits are ASCII.
WS_OTHER = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0       "
    "         　"
)
WS_CHARACTERS = " " + WS_OTHER
_OTHER = (
    r"\t\n\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS = f"[ {_OTHER}]"
# runs of whitespace other than one plain space
WS_RUN = f"[{_OTHER}][ {_OTHER}]*| [ {_OTHER}]+"
WORD = r"[\p{L}\p{N}_]"
WORD_END = r"(?![\p{L}\p{N}_])"
