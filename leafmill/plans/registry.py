"""The queries of the document operators and their SQL."""

from __future__ import annotations

from leafmill.plans import html, lines, packages, sheets  # noqa: F401  each adds its queries

QUERIES, ORACLES = html.QUERIES, html.ORACLES
