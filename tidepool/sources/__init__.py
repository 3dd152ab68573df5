"""Sources and sinks: file dispatch, missing-value normalisation, history tables."""

from tidepool.sources.io import (  # noqa: F401
    read_table, write_table, append_history, normalize_missing, read_history,
)
