"""Thresholds of the analytics. They decide which cohorts, signals and neighbours exist."""

MIN_COHORT_SIZE = 5
# Cases of the own type from which a cohort too small to stand is still told of.
THIN_SAME_TYPE = 3
CONFIDENCE_MEDIUM = 12
CONFIDENCE_HIGH = 25
MIN_SUPPORT = 0.6
MIN_LIFT = 1.5
TOP_SIGNALS = 12
MIN_TIMED_MEMBERS = 3
TOP_PEERS = 8
MIN_SIMILARITY = 0.18
TOP_NEIGHBOURS = 8
SIGNAL_SHARE = 0.55
SEMANTIC_SHARE = 0.45
SEMANTIC_REASON = 0.7
LIMITATION_MONTHS = 84
LIMITATION_WARNING = 12
