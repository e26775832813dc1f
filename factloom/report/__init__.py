"""Findings as JSON lines, one JSON document, SARIF, HTML and text."""
