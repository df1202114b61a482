"""Fixed values that must equal the behaviour being reproduced.

These are data, not logic: word lists, character sets and policy numbers.
"""

# ---- fixed values: English stopwords removed by the text cleaner (39 words) ----
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "is", "it", "its", "this", "that", "with", "as", "by", "from",
    "was", "are", "be", "been", "have", "has", "had", "not", "do", "did",
    "will", "would", "could", "should", "may", "might", "shall", "can",
)

# ---- fixed values: suspicious URL keywords, one 0/1 feature each (19) ----
PHISH_KEYWORDS = (
    "login", "secure", "verify", "update", "confirm",
    "account", "bank", "ebay", "paypal", "free",
    "bonus", "winner", "click", "here", "now",
    "alert", "warning", "urgent", "immediate",
)

# ---- fixed values: special characters counted by the 5-feature URL vectors ----
SPECIAL_CHARS_V0 = "-_?=&%./"
SPECIAL_CHARS_V2 = "-_?=&%./@!~"

# ---- fixed values: single characters counted by URL features 2..13, in order ----
COUNTED_CHARS = (".", "-", "_", "/", "?", "=", "&", "@", "!", "~", ",", "%")

# ---- fixed values: label vocabulary -> 0/1 (lower-cased, stripped) ----
LABEL_WORDS = {
    "phishing email": 1, "phishing": 1, "spam": 1, "1": 1,
    "safe email": 0, "legit": 0, "ham": 0, "safe": 0, "legitimate": 0, "0": 0,
}
# Older single-file loader: words that count as phishing / legit (no strip).
LABEL_WORDS_V1 = {
    "phishing email": "phishing", "spam": "phishing", "phishing": "phishing", "1": "phishing",
    "ham": "legit", "safe": "legit", "legit": "legit", "0": "legit",
}
URL_LABEL_WORDS = {"0": 0, "1": 1, "legit": 0, "phishing": 1}
LABEL_COLUMN_NAMES = ("label", "labels", "class", "type", "category")
FEATURE_TABLE_DROP = ("filename", "url", "domain", "tld", "title")

# ---- fixed values: policy and calibration numbers ----
ALPHA = 0.005             # FPR ceiling used by threshold calibration
DELTA_BLOCK = 0.10        # tau_block = min(1, tau_cal + DELTA_BLOCK)
FUSION_WEIGHTS = (1 / 3, 1 / 3, 1 / 3)   # semantic, textual, lexical
V0_QUARANTINE = 0.85
V0_MIRROR = 0.50
N_FOLDS = 4
CAL_SHARE = 0.20
SEED = 42
TLD_BUCKETS = 500
VOCAB_MAX = 30000
VOCAB_MIN_FREQ = 3
SEQ_LEN = 256
PAD_ID = 0
UNK_ID = 1
TFIDF_MAX_TERMS = 8000
LR_C = 1.0
LR_MAX_ITER = 1000

# ---- fixed values: enforcement text of each action of the three-tier policy ----
ACTIONS = {
    "BLOCK": "quarantine_via_simulated_southbound_API",
    "MONITOR": "mirror_to_analysis_vlan_tag_for_review",
    "ALLOW": "deliver_without_intervention",
}
