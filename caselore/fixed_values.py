"""Values that decide results and therefore have to stay exactly as they are.

Everything else in the package is free to change; these word lists, thresholds,
patterns, bucket limits and sentence formats are the contract.
"""

# --- fixed values: columns ---
LABELS = ["complaint_type", "descriptor", "descriptor_2"]
REQUIRED = ["unique_key", "created_date", "closed_date", *LABELS, "resolution_description"]
MAX_BATCH = 50_000

# --- fixed values: missing text ---
MISSING_TOKENS = ["", "n/a", "na", "nan", "none", "null"]
# Exact spellings a CSV reader with default settings turns into null.
CSV_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                 "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# --- fixed values: white space ---
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
               "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# --- fixed values: tiers and support ---
FAST_SHARE, FAST_CASES, LIGHT_SHARE = 0.9, 30, 0.5
SUPPORT_BUCKETS = [("n>=100", 100), ("30<=n<100", 30), ("5<=n<30", 5), ("n<5", 0)]

# --- fixed values: vectors and search ---
SLOT_BITS = 4
SLOTS = 16
EMBED_DIM = 64
RETRIEVAL_PREFIX = "Represent this sentence for searching relevant passages: "
PREFIX_MODELS = ["BAAI/bge-small-en-v1.5", "BAAI/bge-base-en-v1.5", "BAAI/bge-large-en-v1.5"]
GATE = 0.74
BORDERLINE_MARGIN = 0.03
ALPHAS = [0.0, 0.01, 0.02, 0.04]
RECALL_KS = [1, 3, 5, 10]
THRESHOLDS = [round(0.50 + 0.02 * i, 2) for i in range(18)]
COVERAGE_MIN_SHARE = 0.05

# --- fixed values: text patterns ---
CITATION = r"\[?\b[PR]\d+\b\]?"
NUMBER = r"\d+(?:\.\d+)?"
PREDICTION = r"(?i)\b(will|won't|going to)\b"
COMPLAINT_MIN, COMPLAINT_MAX = 5, 2000
TRUNCATED_AT = 499
OPENING_MAX_WORDS = 35
REMAINDER_MIN = 0.02

# --- fixed values: sentences ---
NO_DURATION = "nan hours"
CUT_NOTE = " [text cut off in the source data]"
REMAINDER_TEXT = "Other recorded resolutions (not listed individually)."
EMERGENCY_NOTE = ("If there is immediate danger to life or safety, tell the customer to call 911. "
                  "(Standard desk policy, not drawn from historical tickets.)")
DEGRADED_NOTE = ("Degraded mode: AI drafting is unavailable; showing historical statistics only. "
                 "Category is the nearest match and was not verified.")
P_EMPTY = "empty text"
P_UNCITED = "no citation"
P_PREDICTS = "predicts the future (will / going to); describe what past tickets recorded instead"
P_NO_OPENING = "empty opening"
P_BAD_OPENING = "opening must be one short sentence with no numbers"
FEEDBACK_HEAD = "\n\nYour previous answer broke these rules. Fix them:\n"

# --- fixed values: monitoring ---
LATENCY_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0]
COSINE_BUCKETS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.74, 0.8, 0.85, 0.9, 0.95]

# Alert rules - signal, comparison, limit, window, and how long the condition must have held.
ALERT_RULES = {
    "high_abstain_rate": ("abstain_rate", ">", 0.25, "30 minutes", 30),
    "top_similarity_drift": ("median_top_score", "<", 0.72, "1 hour", 60),
    "degraded_mode": ("degraded", ">", 0, "10 minutes", 10),
    "retries_rising": ("retry_rate", ">", 0.25, "1 hour", 60),
    "slow_answers": ("p95_latency", ">", 10, "10 minutes", 15),
    "errors_present": ("errors", ">", 0, "5 minutes", 5),
}

ABSTAIN_REASONS = ["low_similarity", "llm_no_matching_candidate"]
REPORT_STAGES = ["retrieve", "parse", "generate"]

# The sentences of sources, templates, notes and prompts; {} takes a value.
PATTERN_LINE = ('[P{}] Past closed tickets of type "{}": {} tickets; median time to close {}; 90% of tickets closed within {}. '
                "Share of tickets by recorded resolution: {}.")
OUTCOME_LINE = '[{}] Recorded resolution: "{}"'
OUTCOME_SHARE = "{} of tickets: {}"
SUMMARY = "{} of {} past tickets of this type ended with the same recorded resolution."
STEP_RESOLVED = "Tell the customer how these cases were resolved: {}"
STEP_TIMES = "Set expectations: the median time to close was {}, and 90% of tickets closed within {}."
BORDERLINE_NOTE = ("Borderline match (similarity {}, threshold {}): check that the category fits before relying on this guidance.")
LITTLE_NOTE = "Low evidence: this ticket type has only {} closed tickets, so the shares and times above are unreliable."
SEVERE_NOTE = "High severity ({}/5): prioritise this ticket."
SELECTION_PROMPT = 'Complaint:\n"""\n{}\n"""\n\nCandidates:\n{}'
DRAFT_PROMPT = 'Customer complaint:\n"""\n{}\n"""\n\nDetected: {} / {}; severity {}/5; sentiment {}.\n\nSOURCES:\n{}'
JUDGE_PROMPT = "SOURCES:\n{}\n\nCLAIMS:\n{}"
EXAMPLE_PROMPT = "Problem category (hidden from the resident): {}\nWrite {} different complaints."

# Limits and labels of the profile's bins.
DIVERSITY = ([0, 1, 3, 5, 10, None],
             ["1 resolution", "2-3 resolutions", "4-5 resolutions", "6-10 resolutions", "11+ resolutions"])
SHARE_EDGES = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
SHARE_LABELS = ["very_diverse", "diverse", "moderate", "near_det", "deterministic"]
