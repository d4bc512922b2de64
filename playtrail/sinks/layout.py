"""Names of the tables under an output directory."""

# Table names.
PARSED = "streaming_history_parsed.parquet"
REJECTS = "rejects"
STATISTICS = "parsing_statistics.json"
ENRICHED = "enriched_streaming_data.parquet"
SUMMARY = "summary_statistics.json"
INSIGHTS = "key_insights.json"
