"""Structured Streaming forms of scoring, alerting, dispatch, counters and handoff."""
