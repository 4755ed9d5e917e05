"""Fixed values. Results are only right when these are exactly as written here."""

# Sentinel that movie files use for "this movie has no genre".
NO_GENRE = "(no genres listed)"

# Accepted rating range, inclusive on both ends.
RATING_MIN = 0.5
RATING_MAX = 5.0

# Interaction event types and how much each counts.
EVENT_WEIGHTS = {
    "RATING_GIVEN": 5.0,
    "MOVIE_VIEWED": 3.0,
    "ADDED_TO_WATCHLIST": 2.0,
    "MOVIE_CLICKED": 1.0,
    "SEARCHED_FOR_MOVIE": 0.5,
    "UNKNOWN": 0.0,
}

# Recommendations asked for by the heaviest event, and the weight that earns them.
RECS_AT_FULL_WEIGHT = 5
FULL_WEIGHT = 5.0
# An event of this weight leaves a similarity score unscaled; scaling is clamped.
NEUTRAL_WEIGHT = 2.5
MULTIPLIER_MIN = 0.5
MULTIPLIER_MAX = 2.0
SCORE_MAX = 5.0

# Tag sentiment vocabularies, matched as lower-case substrings.
POSITIVE_WORDS = (
    "good", "great", "excellent", "amazing", "awesome",
    "fantastic", "wonderful", "brilliant", "outstanding", "perfect",
)
NEGATIVE_WORDS = (
    "bad", "terrible", "awful", "horrible", "worst",
    "boring", "stupid", "disappointing", "waste", "sucks",
)

# Analytics document types: (type, category, description).
ANALYTICS_TYPES = (
    ("DATA_COMPLETENESS", "Data Quality", "Tracks completeness and integrity of rating data"),
    ("DATA_FRESHNESS", "Data Quality", "Monitors freshness and recency of rating data"),
    ("DATA_QUALITY", "Data Quality", "Comprehensive data quality metrics"),
    ("USER_ACTIVITY", "User Behavior", "Tracks user rating patterns and activity levels"),
    ("USER_ENGAGEMENT", "User Behavior", "Measures user engagement depth and interaction quality"),
    ("USER_SEGMENTATION", "User Behavior", "Segments users based on rating behavior patterns"),
    ("MOVIE_POPULARITY", "Content Analytics", "Tracks movie popularity and rating frequency"),
    ("CONTENT_PERFORMANCE", "Content Analytics", "Analyzes overall content performance metrics"),
    ("RATING_DISTRIBUTION", "Content Analytics", "Analyzes distribution of rating values"),
    ("GENRE_DISTRIBUTION", "Content Analytics", "Tracks genre preferences and distribution patterns"),
    ("TEMPORAL_TRENDS", "Content Analytics", "Identifies temporal trends and seasonal patterns"),
    ("PROCESSING_PERFORMANCE", "System Performance", "Monitors batch processing performance metrics"),
    ("USER_SATISFACTION", "Business Metrics", "Tracks user satisfaction with recommendations"),
)

# What each collector stores: (collector, document id prefix, type, description).
DOCUMENTS = (
    ("DATA_QUALITY", "data_quality", "DATA_QUALITY",
     "Comprehensive data quality analytics including completeness, freshness, and consistency"),
    ("USER_ACTIVITY", "user_activity", "USER_ACTIVITY",
     "Comprehensive user activity, engagement, and segmentation analytics"),
    ("DATA_FRESHNESS", "data_freshness", "DATA_FRESHNESS",
     "Data freshness and recency analytics"),
    ("CONTENT_ANALYTICS", "content_analytics_popularity", "MOVIE_POPULARITY",
     "Movie popularity analytics including top movies and tag insights"),
    ("CONTENT_ANALYTICS", "content_analytics_genre", "GENRE_DISTRIBUTION",
     "Genre distribution and preference analytics"),
    ("CONTENT_ANALYTICS", "content_analytics_performance", "CONTENT_PERFORMANCE",
     "Content performance analytics including ratings variability and polarization"),
    ("USER_ENGAGEMENT", "user_engagement", "USER_ENGAGEMENT",
     "User engagement depth and interaction pattern analytics"),
    ("RATING_DISTRIBUTION", "rating_distribution", "RATING_DISTRIBUTION",
     "Rating distribution analytics showing rating patterns and user preferences"),
    ("USER_SEGMENTATION", "user_segmentation", "USER_SEGMENTATION",
     "User segmentation and behavior pattern analytics"),
    ("TEMPORAL_TRENDS", "temporal_trends", "TEMPORAL_TRENDS",
     "Temporal trends and seasonal pattern analytics"),
    ("TAG_ANALYTICS", "user_perspective_tags", "USER_ENGAGEMENT",
     "User perspective analytics through tags showing how users perceive and describe movies"),
    ("SYSTEM_PERFORMANCE", "processing_performance", "PROCESSING_PERFORMANCE",
     "Batch processing performance and efficiency analytics"),
)
# The genre document of a run without movie metadata.
GENRE_FALLBACK_PREFIX = "content_analytics_genre_fallback"
GENRE_FALLBACK_TEXT = "Genre distribution analytics (fallback due to missing movie data)"
NO_MOVIES_NOTE = "Movies metadata not available - genre analysis limited"
NO_TAGS_NOTE = "Tags data not available for user perspective analysis"

# Recommendation wording by share of valid rows: (share must exceed, text).
QUALITY_ADVICE = (
    (0.95, "Excellent data quality - optimal performance expected"),
    (0.90, "Good data quality - minor performance impact"),
    (0.80, "Fair data quality - moderate performance impact"),
)
QUALITY_ADVICE_OTHERWISE = "Poor data quality - significant performance impact"

# Chart labels.
MONTH_LABELS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
# Day 1 of the week is Sunday.
WEEKDAY_LABELS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
CHART_YEARS = (1995, 2023)

# Stored vector layout: one key per entity, little-endian 4-byte floats.
VECTOR_KEY_PREFIX = "vector"
FLOAT_BYTES = 4

DAY_SECONDS = 86400
