"""Sources (driver Parquet tables -> ``sales``) and sinks."""

from .sales import (ROLES, Roles, clean_sales, dedup_keep_first, load_sales, read_table,
                    sales_dirty, sales_raw)

__all__ = ["ROLES", "Roles", "clean_sales", "dedup_keep_first", "load_sales", "read_table",
           "sales_dirty", "sales_raw"]
