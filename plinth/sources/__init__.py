"""Feeds, seeds, web pages and PDF documents as DataFrames."""
