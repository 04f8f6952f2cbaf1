"""A journal in files, with a manifest of what each file holds: tails are read from the files that have them.

The manifest has a row for each file and execution in it, with the first and last sequence.  Files are laid out by execution and
sequence, so it has about as many rows as executions and files together.  Joined with where the checkpoints stand, it names the
files that a recovery must open; the others are neither listed nor read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlight import schemas as S
from foldlight.operators import checkpoints, fold
from foldlight.sources import journal

MANIFEST = "file string, execution_id string, first_sequence long, last_sequence long, n_events long"


class JournalFiles:
    """The journal at `path`: `events` holds its files, `manifest` what they hold.  One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.events_path, self.manifest_path = spark, f"{path.rstrip('/')}/events", f"{path.rstrip('/')}/manifest"

    def manifest(self) -> DataFrame:
        if not journal.has_rows(self.spark, self.manifest_path):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(self.manifest_path)

    def append(self, events: DataFrame) -> None:
        """Writes stored-form events as further files and adds them to the manifest.

        A writer that ends between the two leaves files that the next append adds: files count once the manifest has them.
        """
        journal.write_events(events, self.events_path, "append")
        self.catalogue()

    def catalogue(self) -> None:
        """Adds the files that the manifest lacks; two columns of them are read."""
        stored = self.spark.read.schema(S.EVENTS).parquet(self.events_path)
        known = {r["file"] for r in self.manifest().select("file").distinct().collect()}  # names of files, as Spark's own listing has them
        new = [f for f in stored.inputFiles() if f not in known]
        if new:
            rows = self.spark.read.schema(S.EVENTS).parquet(*new).select(F.input_file_name().alias("file"), "execution_id", "sequence")
            bounds = rows.groupBy("file", "execution_id").agg(F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.count("*").alias("n_events"))
            bounds.repartitionByRange("execution_id").write.mode("append").parquet(self.manifest_path)

    def files_after(self, offsets: DataFrame) -> list[str]:
        """The files with an event after its execution's offset; offsets: (execution_id, after), 0 for executions without one."""
        rows = self.manifest().join(offsets.select("execution_id", "after"), "execution_id", "left").where("last_sequence > coalesce(after, 0)")
        return sorted(r["file"] for r in rows.select("file").distinct().collect())

    def tail(self, offsets: DataFrame) -> DataFrame:
        """Decoded events after the offsets, from the files that have any."""
        files = self.files_after(offsets)
        if not files:
            return journal.decode(self.spark.createDataFrame([], S.EVENTS))
        later = self.spark.read.schema(S.EVENTS).parquet(*files).join(offsets.select("execution_id", "after"), "execution_id", "left").where("sequence > coalesce(after, 0)").drop("after")
        return journal.decode(later)

    def last_sequences(self) -> DataFrame:
        """(execution_id, last_sequence), from the manifest alone."""
        return self.manifest().groupBy("execution_id").agg(F.max("last_sequence").alias("last_sequence"))

    def recover(self, snapshot: checkpoints.Snapshot) -> checkpoints.States:
        """States from a snapshot and the files with later events; refuses a snapshot that is ahead of the journal."""
        ahead = snapshot.at.join(self.last_sequences(), "execution_id", "left").where("sequence > coalesce(last_sequence, 0)").limit(1).collect()
        if ahead:
            raise ValueError(f"snapshot ahead of journal: {ahead[0].asDict()}")
        return checkpoints.recover_after(self.tail(snapshot.at.withColumnRenamed("sequence", "after")), snapshot)

    def fold(self) -> checkpoints.States:
        """States from all files."""
        events = journal.decode(self.spark.read.schema(S.EVENTS).parquet(self.events_path))
        calls = fold.fold_calls(events)
        return checkpoints.States(calls, fold.fold_attempts(events), fold.finish_executions(fold.partial_executions(events), calls))
