"""Directory-backed tables of immutable Parquet fragments."""

from .catalog import Catalog, Fragment
from .config import WriteConfig, codec
from .table import Reader, Writer

__all__ = ["Catalog", "Fragment", "Reader", "WriteConfig", "Writer", "codec"]
