"""Scans with explicit schemas, sinks, and small artefact hand-off."""

from featmart.sources.tables import (  # noqa: F401
    SCHEMAS, table_path, load, read_csv, read_csv_checked, infer_types, limit_rows, write_table, write_scores, save_json, load_json, save_vectors, load_vectors,
    split_by_label,
)
