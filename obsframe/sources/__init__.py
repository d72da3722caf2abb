"""Readers and writers for observations, imports, families and reports."""

from obsframe.sources.readers import (
    family_dimensions,
    order_violations,
    pad_codes,
    read_family_master,
    read_import,
    read_observations,
)
from obsframe.sources.writers import (
    append_new,
    apply_changes,
    canonical_json,
    delete_rows,
    new_rows,
    write_observations,
    write_report,
)

__all__ = [
    "append_new", "apply_changes", "canonical_json", "delete_rows",
    "family_dimensions", "new_rows", "order_violations", "pad_codes",
    "read_family_master", "read_import", "read_observations",
    "write_observations", "write_report",
]
