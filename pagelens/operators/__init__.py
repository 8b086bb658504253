"""Operators on tables of pages, images, files and requests."""
