"""streaming of lorekeep."""
