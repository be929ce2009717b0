"""functions of lorekeep."""
