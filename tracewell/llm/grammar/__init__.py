"""Recognizers of source languages."""
