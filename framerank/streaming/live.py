"""Streaming counterparts: progress of a run, resource samples, and segments of frames as they arrive."""

from __future__ import annotations

import socket
import subprocess
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Log marks, and the stage and percentage they stand for.
STAGES = {"[STEP 1]": 25, "[STEP 2]": 50, "[STEP 3]": 75, "[STEP 4]": 90, "[DONE]": 100}


def progress(line: str | Column) -> Column:
    """Struct (stage, progress) of a log line; null stage for a line without a mark."""
    line = F.col(line) if isinstance(line, str) else line
    stage, done = F.lit(None).cast("string"), F.lit(None).cast("int")
    for mark, percent in reversed(STAGES.items()):
        has = line.contains(mark)
        stage, done = F.when(has, "Complete" if percent == 100 else mark).otherwise(stage), F.when(has, percent).otherwise(done)
    return F.struct(stage.alias("stage"), done.alias("progress"))


class ProgressListener(StreamingQueryListener):
    """Hands (rows, batch, seconds) of each micro-batch to a function, for pushing to clients."""

    def __init__(self, push: Callable[[dict], None]):
        self.push = push

    def onQueryStarted(self, event) -> None:
        self.push({"stage": "Started", "query": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.push({"stage": "Running", "batch": p.batchId, "rows": p.numInputRows, "seconds": p.batchDuration / 1000})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.push({"stage": "Error" if event.exception else "Complete"})


def samples(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """A clock to hang resource samples on: (timestamp, value), one row a second."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


#: The processor times, busy and all, that this process read last.
_before = (0, 0)


def _cpu_percent() -> float:
    """Share of processor time in use on this machine since the last call, since its start at first."""
    global _before
    times = [int(x) for x in open("/proc/stat").readline().split()[1:9]]
    now = (sum(times) - times[3] - times[4], sum(times))
    busy, total = now[0] - _before[0], now[1] - _before[1]
    _before = now
    return 100.0 * busy / total if total > 0 else 0.0


def _used_mib() -> float:
    kib = {k: int(v.split()[0]) for k, v in (line.split(":") for line in open("/proc/meminfo"))}
    return (kib["MemTotal"] - kib["MemAvailable"]) / 1024


def _gpu() -> tuple[float, float]:
    """Utilisation in percent and memory in MiB of the first card; zeros without one."""
    asked = ["nvidia-smi", "--query-gpu=utilization.gpu,memory.used", "--format=csv,noheader,nounits"]
    try:
        first = subprocess.run(asked, capture_output=True, text=True, timeout=5, check=True).stdout.splitlines()[0]
        share, used = first.split(",")
        return float(share), float(used)
    except (OSError, ValueError, IndexError, subprocess.SubprocessError):
        return 0.0, 0.0


_SAMPLE = "host string, cpu_pct double, used_mib double, gpu_pct double, gpu_mib double"


def with_resources(clock: DataFrame) -> DataFrame:
    """A clock (samples()) with what the machine that handles a tick is using: host, cpu_pct (all cores, 0 to 100),
    used_mib, gpu_pct, gpu_mib. Ticks of one batch on one machine share a reading. Where /proc isn't found the readings are null."""

    @F.arrow_udf(T.StructType.fromDDL(_SAMPLE))
    def read(ticks: pa.Array) -> pa.Array:
        try:
            found = dict(zip(("cpu_pct", "used_mib"), (_cpu_percent(), _used_mib())))
        except OSError:
            found = {}
        one = {"host": socket.gethostname(), **found, **dict(zip(("gpu_pct", "gpu_mib"), _gpu()))}
        return pa.array([one] * len(ticks), pa.struct([("host", pa.string()), *((c, pa.float64()) for c in ("cpu_pct", "used_mib", "gpu_pct", "gpu_mib"))]))

    return clock.withColumn("__use", read.asNondeterministic()(F.col("timestamp"))).select(*clock.columns, "__use.*")


class Expiring:
    """A value that is made anew once it is older than `seconds`."""

    def __init__(self, make: Callable[[], object], seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.make, self.seconds, self.clock, self.made, self.value = make, seconds, clock, None, None

    def get(self) -> object:
        if self.made is None or self.clock() - self.made > self.seconds:
            self.value, self.made = self.make(), self.clock()
        return self.value


_RUN = "clip_id string, pred_label string, num_frames long, start_index long, end_index long"


def live_segments(frames: DataFrame, min_length: int = 3, delay: str = "10 seconds") -> DataFrame:
    """Class runs of a stream (clip_id, frame_idx, pred_label, ts): a run is given out once the clip's label changes, or
    when the watermark passes the clip's last frame. Frames of a clip must arrive in order within the delay; the state
    of a clip is its open run only."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        label, n, start, end = state.get if state.exists else (None, 0, -1, -1)
        done = []
        if state.hasTimedOut:
            state.remove()
            if n >= min_length:
                yield pd.DataFrame([(key[0], label, n, start, end)], columns=["clip_id", "pred_label", "num_frames", "start_index", "end_index"])
            return
        latest = 0
        for f in pd.concat(list(batches)).sort_values(["frame_idx"], kind="stable").itertuples():
            latest = max(latest, int(f.ts.timestamp() * 1000))
            if f.pred_label == label:
                n, end = n + 1, int(f.frame_idx)
            else:
                if n >= min_length:
                    done.append((key[0], label, n, start, end))
                label, n, start, end = f.pred_label, 1, int(f.frame_idx), int(f.frame_idx)
        state.update((label, n, start, end))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1000)
        if done:
            yield pd.DataFrame(done, columns=["clip_id", "pred_label", "num_frames", "start_index", "end_index"])

    timed = frames.withWatermark("ts", delay)
    return timed.groupBy("clip_id").applyInPandasWithState(advance, _RUN, "label string, n long, start long, end long", "append", GroupStateTimeout.EventTimeTimeout)
