"""All registered jobs: name -> (spark, sf_dir) -> DataFrame, and the same in SQL where SQL can say it."""

from __future__ import annotations

from marketlens.plans import forecasts, inventory, retention, reviews

_ALL = retention.JOBS | inventory.JOBS | reviews.JOBS | forecasts.JOBS

QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLE_SQL = {name: text for name, (_, text) in _ALL.items() if text}
