"""Operators over streams: lifecycles folded as events arrive, counts by time window."""
