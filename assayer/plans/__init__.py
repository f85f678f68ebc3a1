"""Composed plans: the score fold, detectors, sinks and the query catalog."""
