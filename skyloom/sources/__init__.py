"""Recordings, logs and instrument files as tables."""
