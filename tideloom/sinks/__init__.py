from .catalog import register_external, register_table
from .objects import write_objects
from .storage import Storage
from .table import TableSpec, VersionedTable

__all__ = ["Storage", "TableSpec", "VersionedTable", "register_external", "register_table", "write_objects"]
