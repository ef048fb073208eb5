"""Sources and sinks."""

from .archive import read_panel, read_panel_table, verify_archive, write_panel_archive

__all__ = ["read_panel", "read_panel_table", "verify_archive", "write_panel_archive"]
