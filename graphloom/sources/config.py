"""Run configuration: ``key=value`` lines after a schema line, strict and complete."""

from __future__ import annotations

import os
import re
import stat
from dataclasses import dataclass, field

from ..errors import ConfigError
from ..functions.thresholds import RankConfig
from ..operators.tasks import TaskLimits

MOST_BYTES = 65_536
SCHEMA = re.compile(r"schema=[a-z][a-z0-9]*-run-config-v1")
_FLOAT = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE]-?(0|[1-9][0-9]*))?")
_UNSIGNED = re.compile(r"0|[1-9][0-9]*")

# All keys with their defaults.
DEFAULTS: dict[str, int | float] = {
    "preprocess.non_bulk_reserve_bytes": 33554432,
    "preprocess.input_chunk_bytes": 1048576,
    "preprocess.phase_fd_budget": 64,
    "preprocess.disk_reserve_bytes": 1073741824,
    "preprocess.edge_slice_size": 8192,
    "preprocess.max_task_edges": 262144,
    "preprocess.max_task_vertices": 4096,
    "preprocess.endpoint_ids_per_run": 1048576,
    "preprocess.run_writer_buffer_bytes": 65536,
    "preprocess.vertex_merge_fan_in": 32,
    "preprocess.vertex_merge_reader_buffer_bytes": 65536,
    "preprocess.vertex_merge_writer_buffer_bytes": 65536,
    "preprocess.vertex_merge_crc_chunk_bytes": 65536,
    "preprocess.raw_edges_per_run": 1048576,
    "preprocess.compact_reader_buffer_bytes": 65536,
    "preprocess.compact_writer_buffer_bytes": 65536,
    "preprocess.compact_crc_chunk_bytes": 65536,
    "preprocess.edge_merge_fan_in": 32,
    "preprocess.edge_merge_reader_buffer_bytes": 65536,
    "preprocess.edge_merge_writer_buffer_bytes": 65536,
    "preprocess.edge_merge_crc_chunk_bytes": 65536,
    "preprocess.edge_batch_records": 8192,
    "preprocess.graph_validation_chunk_bytes": 65536,
    "analyze.record_batch_records": 8192,
    "analyze.validation_chunk_bytes": 65536,
    "analyze.runtime_reserve_bytes": 33554432,
    "parallel.worker_count": 64,
    "parallel.worker_stack_bytes": 1048576,
    "parallel.worker_guard_bytes": 4096,
    "parallel.worker_count_batch_records": 8192,
    "parallel.worker_source_batch_records": 8192,
    "parallel.scheduler_window_records": 64,
    "pagerank.alpha": 0.85,
    "pagerank.eta": 1e-8,
    "pagerank.max_iterations": 200,
}


@dataclass
class RunConfig:
    """All keys; those of ranks and tasks have an effect, ``spark_conf`` maps what Spark has a setting for, and the rest
    (buffers, descriptors, stacks) is accepted for old files and has none."""

    values: dict[str, int | float] = field(default_factory=lambda: dict(DEFAULTS))

    @property
    def rank(self) -> RankConfig:
        v = self.values
        return RankConfig(v["pagerank.alpha"], v["pagerank.eta"], v["pagerank.max_iterations"])

    @property
    def tasks(self) -> TaskLimits:
        v = self.values
        return TaskLimits(v["preprocess.edge_slice_size"], v["preprocess.max_task_edges"], v["preprocess.max_task_vertices"])

    @property
    def spark_conf(self) -> dict[str, str]:
        v = self.values
        return {"spark.default.parallelism": str(max(1, v["parallel.worker_count"])), "spark.sql.execution.arrow.maxRecordsPerBatch": str(max(1, v["analyze.record_batch_records"]))}


def parse_config(data: bytes) -> RunConfig:
    if len(data) > MOST_BYTES:
        raise ConfigError(f"file exceeds {MOST_BYTES} bytes")
    if any(b > 0x7E or b < 0x20 and b != 0x0A for b in data):
        raise ConfigError("file must be printable ASCII with LF line ends")
    if not data.endswith(b"\n"):
        raise ConfigError("file must end with LF")
    config, seen, begun = RunConfig(), set(), False
    for line in data.decode().split("\n")[:-1]:
        if not line or line.startswith("#"):
            continue
        if not begun:
            if not SCHEMA.fullmatch(line):
                raise ConfigError("first semantic line must be the schema line")
            begun = True
            continue
        key, mark, value = line.partition("=")
        if not mark or not key or not value or "=" in value or " " in line:
            raise ConfigError("expected one nonempty key=value pair")
        if key == "schema":
            raise ConfigError("schema is repeated")
        if key not in DEFAULTS:
            raise ConfigError(f"unknown key {key}")
        if key in seen:
            raise ConfigError(f"key is repeated: {key}")
        seen.add(key)
        config.values[key] = _value(key, value)
    if not begun:
        raise ConfigError("schema line is missing")
    _validate(config)
    return config


def _value(key: str, text: str) -> int | float:
    if isinstance(DEFAULTS[key], float):
        if not _FLOAT.fullmatch(text):
            raise ConfigError(f"{key}: expected a canonical decimal number")
        return float(text)
    if not _UNSIGNED.fullmatch(text) or int(text) >= 1 << 64:
        raise ConfigError(f"{key}: expected a canonical unsigned integer")
    return int(text)


def _validate(config: RunConfig) -> None:
    zeros = [config.values[k] == 0 for k in DEFAULTS if k.startswith("parallel.")]
    if any(zeros) and not all(zeros):
        raise ConfigError("parallel.* must be all zero or all positive")
    try:
        config.rank, config.tasks  # noqa: B018  their own checks
    except ValueError as e:
        raise ConfigError(str(e)) from None


def load_config(path: str = "config/main.conf") -> RunConfig:
    """The file's configuration, or the defaults where there is no file."""
    try:
        found = os.lstat(path)
    except FileNotFoundError:
        return RunConfig()
    if not stat.S_ISREG(found.st_mode):
        raise ConfigError(f"not a regular file: {path}")
    try:
        with open(path, "rb") as f:
            return parse_config(f.read(MOST_BYTES + 1))
    except OSError as e:
        raise ConfigError(str(e)) from None
