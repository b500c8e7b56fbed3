"""Detectors: operators put together."""
