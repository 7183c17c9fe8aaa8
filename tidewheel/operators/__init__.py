"""Operators of tidewheel."""
