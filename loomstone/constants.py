"""Fixed values of the evidence store: vocabularies, thresholds and caps."""

# The vocabularies below must be spelt exactly so.
STATUSES = ("active", "dormant", "superseded", "retracted")
RELATIONS = ("depends_on", "specializes", "explains", "contradicts", "applies_when")
SYMMETRIC = ("contradicts", "co_derived")
OUTCOMES = ("confirmed", "contradicted", "stale")
DREAM_STOPWORDS = "the a an in on at to for of and or is was are with my i we it do did that this from not".split()
CLUSTER_STOPWORDS = (
    "and are but can for from had has have into its not per than that the them then they this was were with you your all any its out via when which who why will".split()
)

SUPPORT_CAP = 0.99
CLIQUE_LEAST, CLIQUE_MOST = 2, 8
REPORT_CONTAINMENT, WRITE_CONTAINMENT = 0.85, 0.60
DREAM_JACCARD, DREAM_CAP = 0.4, 12
CLUSTER_BLOCK = 0.30
PRIOR_STRENGTH, ADMITTED_OUTCOMES = 2, 3
CONTRADICTIONS_TO_DORMANT = 2
DORMANT_DAYS, DORMANT_BELOW = 45, 0.95
CLAIM_CHARS, MESSAGE_CHARS, DIGEST_CHARS, DIGEST_MESSAGES, DIGEST_TOTAL = 300, 4000, 700, 500, 250_000
MEMORY_CAP = 9000
CONTEXT_SEEDS, CONTEXT_HOPS, CONTEXT_BUDGET = 12, 1, 1200
RETENTION_DAYS, RETENTION_COUNT, RETENTION_HOURS = 30, 1000, 24
PAGE = 500
BM25_K1, BM25_B = 1.2, 0.75
#: The instant that queries call "now": results must not depend on the clock.
NOW = "2024-03-01T00:00:00Z"
EPOCH = "2024-01-01 00:00:00"
