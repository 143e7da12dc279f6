"""Sessions and the folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

#: Object-store settings and the environment variables that may set them. There are no default credentials.
OBJECT_STORE = {
    "endpoint": "S3_ENDPOINT",
    "access.key": "S3_ACCESS_KEY",
    "secret.key": "S3_SECRET_KEY",
    "path.style.access": "S3_PATH_STYLE",
    "connection.ssl.enabled": "S3_SSL",
    "connection.maximum": "S3_CONNECTIONS",
    "threads.max": "S3_THREADS",
    "readahead.range": "S3_READAHEAD",
    "fast.upload": "S3_FAST_UPLOAD",
    "endpoint.region": "S3_REGION",
    "impl": "S3_IMPL",
    "aws.credentials.provider": "S3_CREDENTIALS_PROVIDER",
    "buffer.dir": "S3_BUFFER_DIR",
    "experimental.input.fadvise": "S3_INPUT_POLICY",
}

#: Settings of the process and the variables that may set them; a submit command's own settings come first.
LAUNCH = {
    "spark.driver.memory": "STARFOLD_DRIVER_MEMORY",
    "spark.executor.memory": "STARFOLD_EXECUTOR_MEMORY",
    "spark.executor.cores": "STARFOLD_EXECUTOR_CORES",
    "spark.local.dir": "STARFOLD_SCRATCH",
}

_made: list[tuple[SparkSession, str]] = []


def object_store_conf(env: dict[str, str] | None = None) -> dict[str, str]:
    env = dict(os.environ) if env is None else env
    return {f"spark.hadoop.fs.s3a.{key}": env[name] for key, name in OBJECT_STORE.items() if env.get(name)}


def launch_conf(env: dict[str, str] | None = None) -> dict[str, str]:
    env = dict(os.environ) if env is None else env
    return {key: env[name] for key, name in LAUNCH.items() if env.get(name)}


def make_session(app: str = "starfold", master: str | None = None, shuffle_partitions: int | None = None, adaptive: bool = True, auto_broadcast: bool = True, **conf: str) -> SparkSession:
    """A session in UTC. The master comes from the argument, else from SPARK_MASTER, else from the submit command."""
    master = master or os.environ.get("SPARK_MASTER")
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", str(adaptive).lower())
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if not auto_broadcast:
        builder = builder.config("spark.sql.autoBroadcastJoinThreshold", "-1")
    for key, value in (launch_conf() | object_store_conf() | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package also where PYTHONPATH doesn't name it."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="starfold-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001, PERF203  the session may be over
            pass
