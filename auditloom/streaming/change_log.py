"""Tables that streams update: a log of changes by micro-batch, which a replayed batch leaves as it is."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from auditloom.operators import store

#: Which kit a form without a name asks for.
DEFAULT_FORM = "amazon-visibility-kit"  # a fixed value


class ChangeLog:
    """Changes below `path`, a folder that all machines share: `log/batch=N` has those of micro-batch N, `snapshot/upto=N` the rows that all up
    to N leave. Readers take the last snapshot that is complete and the batches after it.

    A row's key is `key`; `order` is the order within a batch. `kept` columns keep their last value that isn't null, `overwritten` ones take
    the last change's value, null or not. Only rows that an insert has made are there: changes of an unknown key, and those before
    its insert, leave nothing. inserts says which rows are inserts (a boolean column); a second insert of a key is no change at all."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, order: str, kept: list[str], overwritten: list[str], inserts: str = "is_insert"):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.order, self.kept, self.overwritten, self.inserts = key, order, kept, overwritten, inserts

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _complete(self, below: str) -> list[int]:
        """The numbers of the folders there whose writing has ended."""
        files, path = self._files()
        top = path(f"{self.path}/{below}")
        if not files.exists(top):
            return []
        names = [s.getPath().getName() for s in files.listStatus(top) if s.isDirectory()]
        return sorted(int(n.partition("=")[2]) for n in names if files.exists(path(f"{self.path}/{below}/{n}/_SUCCESS")))

    def append(self, batch: DataFrame, number: int) -> bool:
        """Writes a micro-batch once; False where it, or a snapshot that holds it, is there already. A write that was cut off is replaced."""
        snapshots = self._complete("snapshot")
        if number in self._complete("log") or snapshots and number <= snapshots[-1]:
            return False
        batch.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/log/batch={number}")
        return True

    def _changes(self) -> DataFrame:
        """All changes with _place, the order over all batches."""
        snapshots = self._complete("snapshot")
        last = snapshots[-1] if snapshots else -1
        made = self.spark.createDataFrame([], self.schema).withColumn("_batch", F.lit(-1).cast("bigint"))
        if snapshots:
            made = self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshot/upto={last}").withColumn("_batch", F.lit(last).cast("bigint"))
        for number in (n for n in self._complete("log") if n > last):
            made = made.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.path}/log/batch={number}").withColumn("_batch", F.lit(number).cast("bigint")))
        return made.withColumn("_place", F.struct("_batch", self.order, ~F.col(self.inserts))).drop("_batch")

    def rows(self) -> DataFrame:
        """The table now: (key, kept and overwritten columns)."""
        changes = self._changes()
        first = changes.where(self.inserts).groupBy(self.key).agg(F.min("_place").alias("_first"))
        held = changes.join(first, self.key).where((F.col("_place") == F.col("_first")) | ((F.col("_place") > F.col("_first")) & ~F.col(self.inserts)))
        return store.fold_changes(held, self.key, "_place", self.kept, self.overwritten)

    def compact(self) -> None:
        """One snapshot in place of the batches so far; the folders that it replaces stay until drop_old()."""
        done = self._complete("log")
        if not done or done[-1] in self._complete("snapshot"):
            return
        last = self.schema[self.order]
        now = self.rows().withColumns({self.order: F.lit(None).cast(last.dataType), self.inserts: F.lit(True)})
        now.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/snapshot/upto={done[-1]}")

    def drop_old(self) -> None:
        """Removes what the last snapshot replaces; for a time when nobody reads the older ones."""
        files, path = self._files()
        snapshots = self._complete("snapshot")
        for below, name, numbers in (("log", "batch", self._complete("log")), ("snapshot", "upto", snapshots[:-1])):
            for number in numbers if snapshots else []:
                if number <= snapshots[-1]:
                    files.delete(path(f"{self.path}/{below}/{name}={number}"), True)

    def writer(self, changes: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A stream into the log. A batch that is run again after a failure has the same number and changes nothing."""
        return changes.writeStream.foreachBatch(lambda batch, number: (self.append(batch, number), None)[1]).option("checkpointLocation", checkpoint)


def form_jobs(events: DataFrame, body: str = "body") -> DataFrame:
    """Jobs from form events in JSON: (id, status, kit_type, payload). The kit is the form's name, else the usual one's; the payload is the
    event as it came. Events without an id or that are no JSON objects are left out. Works on streams too."""
    told = F.from_json(body, "id string, form_name string")
    rows = events.select(told.alias("e"), F.col(body).alias("payload")).where(F.col("e.id").isNotNull() & (F.col("e.id") != ""))
    name = F.when(F.col("e.form_name") != "", F.col("e.form_name"))
    return rows.select(F.col("e.id").alias("id"), F.lit("received").alias("status"), F.coalesce(name, F.lit(DEFAULT_FORM)).alias("kit_type"), "payload")
