"""Scalar functions: URL algebra, binary content, text. Column expressions that stay in the JVM."""
