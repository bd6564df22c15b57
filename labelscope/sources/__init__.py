from labelscope.sources.io import (has_column, read_csv, read_history, read_table, write_csv,
                                   write_json, write_table, write_text)

__all__ = ["has_column", "read_csv", "read_history", "read_table", "write_csv", "write_json",
           "write_table", "write_text"]
