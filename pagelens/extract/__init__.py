"""Extractors: one document in, many references out. Plain kernels with wrappers for columns and SQL."""
