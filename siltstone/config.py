"""Engine settings with their checks, and presets."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

KIB, MIB = 1 << 10, 1 << 20


@dataclass(frozen=True)
class EngineConfig:
    """Sizes in bytes, times in milliseconds.

    ``target_file_bytes`` sets the files of a run, ``memtable_bytes`` the mutations that a buffered
    writer holds before it commits, ``max_immutable`` the commits of level 0 (in multiples of
    ``l0_files``) at which writers compact before they go on, ``cache_bytes`` and ``cache_shards`` the
    run cache, ``wal_segment_bytes`` the log's segments and ``compaction_interval_ms`` a scheduler's
    pause. Sync modes are accepted for compatibility: a commit is durable once its manifest file exists.
    """

    memtable_bytes: int = 64 * MIB
    cache_bytes: int = 256 * MIB
    block_bytes: int = 4 * KIB
    max_levels: int = 7
    level_multiplier: int = 10
    l1_max_bytes: int = 256 * MIB
    bloom_fpp: float = 0.01
    sync_writes: bool = False
    wal_sync: str = "ASYNC"
    wal_corruption: str = "LENIENT"
    compaction_interval_ms: int = 1000
    max_immutable: int = 4
    target_file_bytes: int = 64 * MIB
    wal_segment_bytes: int = 64 * MIB
    cache_shards: int = 16
    verify_checksums: bool = True
    l0_files: int = 4

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, bool) or isinstance(value, str):
                continue
            if value <= 0:
                raise ValueError(f"{f.name} must be positive")
        if not 0 < self.bloom_fpp < 1:
            raise ValueError("bloom_fpp must lie between 0 and 1")
        if self.wal_sync not in ("SYNC", "ASYNC"):
            raise ValueError("wal_sync is SYNC or ASYNC")
        if self.wal_corruption not in ("LENIENT", "STRICT"):
            raise ValueError("wal_corruption is LENIENT or STRICT")
        if self.sync_writes and self.wal_sync == "ASYNC":
            raise ValueError("sync_writes needs wal_sync SYNC")

    def with_(self, **changes) -> EngineConfig:
        return replace(self, **changes)

    def spark_read_options(self) -> dict[str, str]:
        """Whether page checksums are held against the pages."""
        return {"parquet.page.verify-checksum.enabled": str(self.verify_checksums).lower()}

    def spark_write_options(self) -> dict[str, str]:
        """Parquet options that stand for block size and bloom filters on the key, sized by the keys of the file."""
        return {
            "parquet.bloom.filter.enabled#key": "true",
            "parquet.bloom.filter.fpp#key": str(self.bloom_fpp),
            "parquet.bloom.filter.adaptive.enabled": "true",
            "parquet.page.size": str(max(self.block_bytes, 64 * KIB)),
            "parquet.page.write-checksum.enabled": str(self.verify_checksums).lower(),
        }


PRESETS = {
    "default": EngineConfig(),
    "dev": EngineConfig(memtable_bytes=MIB, cache_bytes=16 * MIB, max_levels=4, l1_max_bytes=16 * MIB, compaction_interval_ms=250, max_immutable=2, target_file_bytes=MIB, wal_segment_bytes=MIB, cache_shards=4),
    "high-throughput": EngineConfig(memtable_bytes=128 * MIB, l1_max_bytes=512 * MIB, bloom_fpp=0.02, compaction_interval_ms=500, max_immutable=8, target_file_bytes=128 * MIB, wal_segment_bytes=128 * MIB, cache_shards=32),
    "low-latency": EngineConfig(cache_bytes=512 * MIB, bloom_fpp=0.005, sync_writes=True, wal_sync="SYNC"),
}
