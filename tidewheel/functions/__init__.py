"""Functions of tidewheel."""
