"""Whole plans: the crawl to its fix-point, manifests and reports."""
