"""Streams: counts over event time, and verdicts that come in one by one."""
