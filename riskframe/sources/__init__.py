from riskframe.sources.readers import (DRIVER_TABLES, nan_to_null, optional_source,
                                      read_any, read_json_records, read_table, scan_csv,
                                      skipped_files, tolerant, union_sources)
from riskframe.sources.sinks import write_csv, write_json, write_parquet, write_text_report

__all__ = ["DRIVER_TABLES", "nan_to_null", "optional_source", "read_any", "read_json_records",
           "read_table", "scan_csv", "skipped_files", "tolerant", "union_sources", "write_csv", "write_json",
           "write_parquet", "write_text_report"]
