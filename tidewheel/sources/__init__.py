"""Sources of tidewheel."""
