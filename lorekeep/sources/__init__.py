"""sources of lorekeep."""
