"""Keyed state over streams of frames."""
