"""Formats, patterns and names that results depend on."""

# Unicode white space as str.split() and str.strip() see it.
# Written for use inside a character class; Java and RE2 read it alike.
WHITE = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# A term is a run of at least two word characters.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Text layouts.
ENVELOPE_FORMAT = "\nDocument: %s\nWord Count: %s\n\n%s\n"
TOPIC_LINE_FORMAT = "- %s: %s (Importance: %s)"
THEME_LINE_FORMAT = "- %s: %s (%s)"
SEARCH_FORMAT = "Find articles and content related to %s. Focus on: %s"
CLUSTER_ID_FORMAT = "cluster_%s"
CLUSTER_NAME_FALLBACK = "Cluster %s"
THEME_FALLBACK = "Unknown theme"

# Separators and defaults of merged topics and weighted themes.
NAME_SEPARATOR = " / "
DESCRIPTION_SEPARATOR = " | "
DEFAULT_IMPORTANCE = 5.0
DEFAULT_STRENGTH = 5.0

# Labels stored in result rows.
EXTRACTION_METHOD = "gpt-4"
CLUSTERING_METHOD = "k-means"
STAGE1_DESCRIPTION = "Within-article topic clustering"
STAGE2_DESCRIPTION = "Cross-article theme clustering"

# Error classes.
JSON_PARSE_FAILED = "json_parse_failed"
NOT_AN_OBJECT = "not_an_object"
BAD_TOPIC = "bad_topic"
BAD_THEME = "bad_theme"
NO_TOPICS = "no_topics"
NO_THEMES = "no_themes"
NO_ARTICLES = "no_articles"
NO_VALID_ARTICLES = "no_valid_articles"
TOO_FEW_ARTICLES = "Insufficient articles with themes for clustering"

# Field names and types of the JSON answers.
TOPIC_TYPE = (
    "STRUCT<name: STRING, description: STRING, key_phrases: ARRAY<STRING>, "
    "importance: DOUBLE, supporting_quotes: ARRAY<STRING>>"
)
THEME_TYPE = (
    "STRUCT<name: STRING, description: STRING, related_topics: ARRAY<STRING>, "
    "strength: DOUBLE, coverage: STRING>"
)
TOPICS_ANSWER = f"topics ARRAY<{TOPIC_TYPE}>"
THEMES_ANSWER = f"themes ARRAY<{THEME_TYPE}>"
CLUSTER_ANSWER = (
    "cluster_name STRING, main_theme STRING, common_patterns ARRAY<STRING>, "
    "distinguishing_features ARRAY<STRING>, cluster_summary STRING"
)
