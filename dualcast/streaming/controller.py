"""The adaptive controller on a stream of scored rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dualcast.operators.control import decision_log, route_adaptive

STATE_SCHEMA = (
    "batch_id long, dataset_id string, controller string, step long, bias double, simple long, rows long, "
    "late_rows long"
)


class StreamController:
    """Routes closed steps batch by batch; a step closes when one more than ``lateness`` steps later arrives.

    Only one number per controller is carried between steps. The rows of a step are counted by all
    tasks and never gathered in a state store: the state and the rows of open steps live in tables
    under ``folder``, one directory per micro-batch, so a replayed batch overwrites its own output.
    Rows of a step that is already closed are late; they are counted and not routed.
    """

    def __init__(self, folder: str, settings: DataFrame, score: str = "score", step: str = "step", lateness: int = 0):
        self.folder, self.settings, self.score, self.step, self.lateness = folder, settings, score, step, lateness

    def _path(self, name: str, batch_id: int) -> str:
        return f"{self.folder}/{name}/batch_id={batch_id}"

    def _previous(self, spark: SparkSession, batch_id: int) -> list:
        """One row per controller, also of those that have closed no step yet (step -1)."""
        if batch_id == 0:
            known = self.settings.select("dataset_id", "controller").distinct().collect()
            return [Row(dataset_id=k["dataset_id"], controller=k["controller"], step=-1, bias=0.0, simple=0, rows=0, late_rows=0) for k in known]
        return spark.read.schema(STATE_SCHEMA).parquet(self._path("state", batch_id - 1)).collect()

    def process(self, batch: DataFrame, batch_id: int, flush: bool = False) -> None:
        spark = batch.sparkSession
        states = self._previous(spark, batch_id)
        closed = {}
        for s in states:
            closed[s["dataset_id"]] = max(closed.get(s["dataset_id"], -1), s["step"])
        rows = batch
        if batch_id > 0:  # whether or not a step has been closed so far
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(self._path("open", batch_id - 1)))
        rows = rows.cache()
        done = spark.createDataFrame(list(closed.items()) or [("", -1)], "dataset_id string, _closed long")
        marked = rows.join(done, "dataset_id", "left").withColumn("_closed", F.coalesce("_closed", F.lit(-1).cast("bigint")))
        late = {r["dataset_id"]: r["n"] for r in marked.where(F.col(self.step) <= F.col("_closed")).groupBy("dataset_id").agg(
            F.count(F.lit(1)).alias("n")).collect()}
        fresh = marked.where(F.col(self.step) > F.col("_closed")).drop("_closed")
        newest = fresh.groupBy("dataset_id").agg(F.max(self.step).alias("_newest"))
        staged = fresh.join(newest, "dataset_id")
        closes = F.lit(flush) | (F.col(self.step) < F.col("_newest") - self.lateness)
        ready, waiting = staged.where(closes).drop("_newest"), staged.where(~closes).drop("_newest")
        start = {
            (s["dataset_id"], s["controller"]): {"step": s["step"] + 1, "bias": s["bias"], "simple": s["simple"], "rows": s["rows"]}
            for s in states if s["step"] >= 0
        }
        trace = route_adaptive(ready, self.settings, self.score, self.step, start=start)
        trace.write.mode("overwrite").parquet(self._path("trace", batch_id))
        trace = spark.read.parquet(self._path("trace", batch_id))
        decision_log(ready, trace, self.score, self.step).write.mode("overwrite").parquet(self._path("decisions", batch_id))
        waiting.write.mode("overwrite").parquet(self._path("open", batch_id))
        last = trace.groupBy("dataset_id", "controller").agg(F.max_by(F.struct(
            "step", "bias_after", "cumulative_simple_count", "cumulative_rows"), "step").alias("s")).collect()
        kept = {(s["dataset_id"], s["controller"]): (s["step"], s["bias"], s["simple"], s["rows"], s["late_rows"]) for s in states}
        for r in last:
            old = kept.get((r["dataset_id"], r["controller"]))
            kept[(r["dataset_id"], r["controller"])] = (*r["s"], old[4] if old else 0)
        out = [(batch_id, d, c, s, b, n, t, l + late.get(d, 0)) for (d, c), (s, b, n, t, l) in kept.items()]
        spark.createDataFrame(out, STATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(self._path("state", batch_id))
        rows.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(lambda df, i: self.process(df, i))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        )

    def last_batch(self, spark: SparkSession) -> int:
        """The newest batch with a state, -1 before the first."""
        try:
            newest = spark.read.schema(STATE_SCHEMA).parquet(f"{self.folder}/state").agg(F.max("batch_id")).first()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1
        return -1 if newest is None else newest

    def finish(self, spark: SparkSession, schema, batch_id: int | None = None) -> None:
        """Close the steps that are still open after the stream has ended."""
        batch_id = self.last_batch(spark) + 1 if batch_id is None else batch_id
        self.process(spark.createDataFrame([], schema), batch_id, flush=True)

    def decisions(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/decisions")

    def trace(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/trace")
