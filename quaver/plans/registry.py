"""Named queries over the driver tables, and the SQL that gives the same rows."""

from __future__ import annotations

from quaver.plans import editing, signals, texts, timing, versions, words

QUERIES = texts.QUERIES | timing.QUERIES | words.QUERIES | signals.QUERIES | editing.QUERIES | versions.QUERIES
SQL = texts.SQL | timing.SQL | words.SQL | signals.SQL | editing.SQL | versions.SQL
