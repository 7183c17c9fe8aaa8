"""Streaming of tidewheel."""
