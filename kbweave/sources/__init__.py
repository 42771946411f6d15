from kbweave.sources.tables import TABLES, load_table
from kbweave.sources.files import (append_kb, assert_schema, read_entries_json,
                                   read_text_files, write_entries_json,
                                   write_markdown)

__all__ = ["TABLES", "load_table", "append_kb", "assert_schema", "read_entries_json",
           "read_text_files", "write_entries_json", "write_markdown"]
