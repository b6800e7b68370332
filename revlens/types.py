"""Column names, schemas and the fixed values results must agree on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced; do not reorder).
# ---------------------------------------------------------------------------
SENTIMENTS = ["positive", "negative", "neutral"]
URGENCIES = ["critical", "medium", "low"]
EMOTIONS = ["happy", "angry", "frustrated", "disappointed", "confused", "satisfied", "surprised", "neutral"]
CONFIDENCES = ["high", "medium", "low"]
GENERAL_CATEGORY = "General Experience"
NO_SECONDARY = "—"
ALERT_EVENTS = ["critical_spike", "sentiment_drop", "new_top_issue"]
CRITICAL_SPIKE_PCT = 20.0
SENTIMENT_DROP_POINTS = 10.0
BATCH_SIZE = 15
MIN_REVIEWS = 5
MIN_REVIEW_LENGTH = 3
NEAR_DUP_THRESHOLD = 0.90
RELEVANCE_FLOOR = 0.45
CLUSTER_DISTANCE_THRESHOLD = 0.45
MIN_REVIEWS_FOR_THEMES = 15
MIN_CATEGORY_SIZE_FOR_THEMES = 4
MIN_THEME_SIZE = 2
MIN_BENCHMARK_COMPANIES = 5
SESSION_TTL_HOURS = 48
SCORE_BUCKETS = ["0-25", "26-50", "51-75", "76-100"]
ASPECT_ICONS = {"positive": "🟢", "negative": "🔴", "neutral": "🟡"}
ASPECT_ICON_UNKNOWN = "⚪"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
ASPECT = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("sentiment", T.StringType()),
])

# Raw classifier record, as parsed from JSON before checks: ``id`` stays a
# string so that "7" and 7.0 can be accepted explicitly (lax integer rule).
RAW_RECORD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("primary_category", T.StringType()),
    T.StructField("secondary_category", T.StringType()),
    T.StructField("aspects", T.ArrayType(ASPECT)),
    T.StructField("urgency", T.StringType()),
    T.StructField("emotion", T.StringType()),
    T.StructField("core_issue", T.StringType()),
    T.StructField("confidence", T.StringType()),
])
RAW_RESPONSE = T.StructType([T.StructField("results", T.ArrayType(RAW_RECORD))])

# The central fact table (one row per classified review).
FACT_COLUMNS = [
    "session_id", "user_id", "industry", "created_at", "review_id", "review",
    "sentiment", "primary_category", "secondary_category", "urgency", "emotion",
    "core_issue", "confidence",
]

SOLUTION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("industry", T.StringType()),
    T.StructField("issue_type", T.StringType()),
    T.StructField("problem", T.StringType()),
    T.StructField("solution", T.StringType()),
    T.StructField("impact", T.StringType()),
    T.StructField("effort", T.StringType()),
    T.StructField("timeframe", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])
