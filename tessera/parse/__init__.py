"""Markup to rows: Markdown, TeX and HTML parsers, and their DataFrame wrappers."""
