"""Schemas of the stored tables."""

from __future__ import annotations

FEEDBACK_RECORD = "text string, title string, source string, propaganda_label string, statement_type string, attribution_label string, verified boolean, reliability_score double, date string"
RAW_ARTICLE = "url string, title string, content string, source_name string, published_at timestamp, scraped_at timestamp, reliability_score double, language string"
FEED_ENTRY = "feed string, pos int, link string, guid string, title string, summary string, description string, published string, updated string, created string, source_title string"
ARTICLES = (
    "id bigint, url string, source_name string, title string, content string, title_clean string, content_clean string, persons array<string>, organizations array<string>, locations array<string>, misc array<string>, cluster_id bigint, "
    "reliability_score double, neutrality_score double, attribution_score double, propaganda_label string, statement_type string, attribution_label string, verified boolean, published_at timestamp, scraped_at timestamp, language string, is_processed boolean, word_count int"
)
CLUSTERS = "id bigint, query string, summary string, created_at timestamp"
SUMMARY_RECORD = "article string, summary string"

CARD = ["id", "title", "source_name", "published_at", "reliability_score", "verified"]
FEED = [*CARD, "propaganda_label", "statement_type", "attribution_label"]
DETAILS = [*FEED, "url", "content", "persons", "organizations", "locations", "misc", "cluster_id", "neutrality_score", "attribution_score", "scraped_at", "language", "word_count"]
