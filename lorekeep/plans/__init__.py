"""plans of lorekeep."""
