"""Sentences and headings of the insights and of the report, as format strings."""

# Sentences of the insights.
PEAK_DAY = "Peak listening day: %d with %.1f hours"
FAVORITE_SEASON = "Favorite listening season: %s"
PEAK_TIME = "Peak listening time: %s"
SESSION_LENGTH = "Average session duration: %.1f minutes"
BINGES = "Binge listening sessions: %d (%.1f%%)"
TOP_PLATFORM = "Most used platform: %s"
EFFICIENCY = "Overall listening efficiency: %.1f%%"
SKIP_RATE = "Overall skip rate: %.1f%%"

# The five headline sentences.
HEADLINE_TIME = "Total Listening Time: %.1f hours"
HEADLINE_ARTIST = "Top Artist: %s (%.1f hours)"
HEADLINE_PEAK = "Peak Listening Time: %s"
HEADLINE_SEASON = "Favorite Season: %s"
HEADLINE_EFFICIENCY = "Average Listening Efficiency: %.1f%%"

# Headings and lines of the report.
BASICS = "BASIC STATISTICS:"
BASIC_HOURS = "- Total Listening Hours: %.1f"
BASIC_TRACKS = "- Total Tracks Played: %,d"
BASIC_ARTISTS = "- Unique Artists: %,d"
TYPES = "CONTENT TYPE BREAKDOWN:"
TOP_ARTISTS = "TOP {n} ARTISTS:"
PLATFORMS = "PLATFORM USAGE:"
SHARE = "- %s: %,d tracks (%.1f%%)"
RANKED_ARTIST = "%d. %s: %.1f hours"

#: Above the report.
TITLE = ("Play history report", "===================")
