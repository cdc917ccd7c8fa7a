"""Constants of the analyses and the dimension of models."""

# Fixed values the results depend on.
ALPHA = 0.05
POWER = 0.80
ITEM_SD = 1.5
GATE_AUC = 0.7936
GATE_SHIFT, GATE_ITEMS, GATE_R = 0.10, 542, 0.8
SAMPLES = 50
TEMPERATURE = 0.8
EDIT_ALPHA = 0.05
MAX_TOKENS = 100
PEAKEDNESS_THRESHOLD = 0.01
HOLM_MULTIPLIER = 3.3393
NGRAM = 13
COVERAGE = 0.8
TRIAGE_HIGH, TRIAGE_LOW = 0.9, 0.6
MIN_K = 20.0
CONTEXT_TOKENS = 30
STALE_SECONDS = 600
DATASETS = ("lcb_pre", "lcb_post", "humaneval", "mbppplus")
PRIMARY_DETECTORS = ("cdd", "perplexity", "mink_prob")
DETECTORS = ("cdd", "perplexity", "mink_prob", "completion_perplexity", "completion_mink_prob")
LABELS = {"A": "FI", "B": "NI", "C": "SL", "D": "U"}
COVERAGE_STATES = ("not_searched", "search_complete_no_candidates", "search_complete_with_candidates")
