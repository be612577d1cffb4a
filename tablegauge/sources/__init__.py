"""Reading tables and writing results."""

from tablegauge.sources.results import (
    GROUPS,
    RESULT_LABELS,
    append_metrics,
    long_metrics,
    metrics_of,
    read_results,
    result_path,
    with_result_labels,
    write_results,
)
from tablegauge.sources.tables import (
    check_table_names,
    datasets_in,
    load_tables,
    preview,
    tables_in,
)
from tablegauge.sources.work import settle, use_checkpoint_folder

__all__ = [
    "GROUPS",
    "RESULT_LABELS",
    "append_metrics",
    "check_table_names",
    "datasets_in",
    "load_tables",
    "long_metrics",
    "metrics_of",
    "preview",
    "read_results",
    "result_path",
    "settle",
    "tables_in",
    "use_checkpoint_folder",
    "with_result_labels",
    "write_results",
]
