"""operators of lorekeep."""
