"""Frames of tracked probes as streams."""
