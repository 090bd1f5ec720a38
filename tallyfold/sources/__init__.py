"""Readers and writers."""

from .tables import (  # noqa: F401
    kept,
    load,
    read_checked,
    read_csv,
    rejected,
    store_bucketed,
    with_names,
    write,
    write_partitioned,
)
