"""Judged rankings, their measures, preferences and summaries."""
