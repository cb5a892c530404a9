"""Readers, writers and the Parquet result store."""
from modelscout.sources.scratch import materialize, scratch_path
from modelscout.sources.store import ResultStore
from modelscout.sources.tables import read_table, write_table

__all__ = ["ResultStore", "materialize", "read_table", "scratch_path", "write_table"]
