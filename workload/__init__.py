"""Registered queries over the given tables, each with its SQL twin where one exists."""

from workload import (
    w_adhoc, w_basics, w_categorical, w_files, w_models, w_plots, w_reports, w_search, w_stats,
)

REGISTRIES = [
    m.R for m in (w_basics, w_stats, w_categorical, w_plots, w_adhoc, w_models, w_search, w_reports, w_files)
]
