"""Where words, bills and frames come from."""
