"""Plans of tidewheel."""
