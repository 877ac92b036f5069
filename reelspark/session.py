"""Session factory and the engine's settings."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConfig:
    """Defaults that hold where the caller or the cluster sets nothing else."""

    app_name: str = "reelspark"
    master: str | None = None
    shuffle_partitions: int = 8
    extra: dict[str, str] = field(default_factory=dict)


def get_session(config: EngineConfig = EngineConfig()) -> SparkSession:
    """A session with AQE on and UTC times; an existing session is reused."""
    builder = (
        SparkSession.builder.appName(config.app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(config.shuffle_partitions))
        .config("spark.ui.enabled", "false")
    )
    if config.master:
        builder = builder.master(config.master)
    for key, value in config.extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's if it names one. A session on one machine without
    one gets a folder of its own; on a cluster that folder would not be shared, so it must be named."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    own = spark.sparkContext.getCheckpointDir()
    if named:
        if not own:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="reelspark-")
        spark.sparkContext.setCheckpointDir(own)
    return own
