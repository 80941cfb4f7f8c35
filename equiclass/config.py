"""Defaults shared by the operators.

Every limit here bounds something that is sent to all executors or kept on the
driver; past the limit the operators switch to a shuffled, checkpointed path.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Largest class table (one row per class) that is collected and broadcast, in rows and in
# (approximate) bytes of class values.
MAX_LOCAL_CLASSES = 50_000
MAX_LOCAL_BYTES = 64 * 1024 * 1024
# Largest lazily computed lookup (e.g. per-class hash-bucket offsets) that is broadcast.
MAX_BROADCAST_ROWS = 2_000_000
# Rows per hash bucket when ranking inside a class: classes up to this size are sorted
# whole; bigger ones are cut into 16^d buckets of at most about this many rows.
RANK_BUCKET_ROWS = 65_536
# Rows copied at least this many times are spread over more tasks before expanding ...
HEAVY_COPIES = 8
# ... when their total output exceeds this many rows (one task's worth of output).
ROWS_PER_TASK = 1_000_000
# Largest number of copies of one input row produced inside one task.
COPY_CHUNK = 100_000
# Rows per side of one neighbour-search tile. A class of more than BLOCK_SIDE tiles a side is cut
# into BLOCK_SIDE blocks a side instead, or into more once these hold BLOCK_ROWS rows: every row
# is sent to all opposite blocks, so their number must not grow with small tiles.
TILE_ROWS = 1024
BLOCK_SIDE = 8
BLOCK_ROWS = 16_384
# Internal column prefix; operators never return such columns.
P = "_ec_"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the session's checkpoint folder; only a local session may get a temporary one."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote (Connect) session has no SparkContext here
        if conf_dir:
            return conf_dir
        raise RuntimeError("spark.checkpoint.dir is not set: point it at a shared folder")
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="equiclass-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set: point it at a folder shared by the cluster"
    )
