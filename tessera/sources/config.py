"""Write presets and codecs as Parquet writer options."""

from __future__ import annotations

from dataclasses import dataclass

LEVELS = {"zstd": 22, "lz4": 16, "none": 0}


def codec(name: str, level: int | None = None) -> dict[str, str]:
    """Parquet options of a codec: zstd (levels to 22), lz4 (to 16, the level is only checked) or none."""
    if name not in LEVELS:
        raise ValueError(f"unknown codec: {name}")
    if level is not None and not 0 <= level <= LEVELS[name]:
        raise ValueError(f"{name} has levels 0 to {LEVELS[name]}")
    options = {"compression": {"none": "uncompressed", "lz4": "lz4_raw"}.get(name, name)}
    if name == "zstd" and level:
        options["parquet.compression.codec.zstd.level"] = str(level)
    return options


@dataclass(frozen=True)
class WriteConfig:
    """Sizes of pages (the zones that page indexes prune), fragments and buffers."""

    row_block_size: int = 8192
    block_size_minimum: int = 1 << 20
    dictionary: bool = True
    dictionary_threshold: float = 0.01
    max_buffer_rows: int = 100_000
    target_fragment_size: int = 128 << 20
    compression: str = "zstd"
    level: int | None = None

    @classmethod
    def time_series(cls) -> "WriteConfig":
        return cls(65_536, 4 << 20, False, 0.001, 500_000, 256 << 20)

    @classmethod
    def vectors(cls) -> "WriteConfig":
        return cls(4096, 4 << 20, False, 0.0, 50_000, 64 << 20)

    def options(self) -> dict[str, str]:
        """Writer options; a page ends after ``row_block_size`` rows, so its index entry is one zone."""
        return {
            "parquet.page.row.count.limit": str(self.row_block_size),
            "parquet.page.size.row.check.min": "1",
            "parquet.enable.dictionary": str(self.dictionary).lower(),
            "parquet.block.size": str(max(self.target_fragment_size, self.block_size_minimum)),
            **codec(self.compression, self.level),
        }
