"""Every query over the tables of a folder, with DuckDB SQL of the same name."""

from __future__ import annotations

from folio.plans import corpus, reports, style, training

QUERIES = corpus.QUERIES | style.QUERIES | training.QUERIES | reports.QUERIES
ORACLES = corpus.ORACLES | style.ORACLES | training.ORACLES | reports.ORACLES
