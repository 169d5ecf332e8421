"""Sources: directory trees, logs and parsers."""
