"""A store of payloads under their SHA-256, as a table in buckets of the hash.

Stored payloads stay where they are: puts compare hashes, sweeps read hashes, ages and sizes, and references travel to the bucket
that holds their payload.  A new payload moves once, to its bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import shared_dir

REFERENCE = r"^sha256:([0-9a-f]{64})$"
ANY_REFERENCE = r"sha256:([0-9a-f]{64})"


class ArtifactStore:
    """A table (sha256, payload, size, age) in `buckets` of its hash, by default as many as the session's shuffles have; a new one, in the shared folder, without a name."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.buckets = spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = name or f"artifacts_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark).rstrip('/')}/{self.name}"
        if not spark.catalog.tableExists(self.name):
            empty = spark.createDataFrame([], "sha256 string, payload string, size long, age long")
            self._write(empty, "errorifexists")

    def _write(self, rows: DataFrame, mode: str) -> None:
        writer = rows.select("sha256", "payload", "size", "age").write.format("parquet").bucketBy(self.buckets, "sha256").sortBy("sha256")
        writer.option("path", self.path).mode(mode).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _to_buckets(self, rows: DataFrame) -> DataFrame:
        """Rows dealt as the table's buckets are, so that joins with it leave the table in place."""
        return rows.repartition(self.buckets, "sha256")

    def put(self, values: DataFrame) -> DataFrame:
        """Stores payloads (payload, age) that aren't there yet, of equal ones that of the least age; gives values with ref 'sha256:<hash>', null for null."""
        hashed = values.withColumn("sha256", F.sha2("payload", 256))
        new = self._to_buckets(hashed.filter("payload is not null").select("sha256", "payload", F.col("age").cast("long").alias("age")))
        each = new.groupBy("sha256").agg(F.min(F.struct("age", "payload")).alias("x")).select("sha256", "x.payload", F.octet_length("x.payload").cast("long").alias("size"), "x.age")
        self._write(each.join(self.table().select("sha256"), "sha256", "left_anti"), "append")
        self.spark.catalog.refreshTable(self.name)
        return hashed.withColumn("ref", F.concat(F.lit("sha256:"), "sha256")).drop("sha256")

    def resolve(self, values: DataFrame, value: str = "value") -> DataFrame:
        """values with resolved: the payload of a reference (null if it isn't stored), any other value itself; only references move."""
        is_ref = F.coalesce(F.rlike(value, F.lit(REFERENCE)), F.lit(False))
        refs = self._to_buckets(values.filter(is_ref).withColumn("sha256", F.regexp_extract(value, REFERENCE, 1)))
        found = refs.hint("merge").join(self.table().select("sha256", F.col("payload").alias("resolved")), "sha256", "left").drop("sha256")
        return found.unionByName(values.filter(~is_ref).withColumn("resolved", F.col(value)))

    def live(self, values: DataFrame, value: str = "value") -> DataFrame:
        """(sha256) of all references inside the values, each once."""
        return self._to_buckets(values.select(F.explode(F.regexp_extract_all(value, F.lit(ANY_REFERENCE), F.lit(1))).alias("sha256"))).distinct()

    def orphans(self, values: DataFrame, least_age: int) -> DataFrame:
        """(sha256, size, age, eligible) of what no value refers to; eligible: older than least_age.  Payloads aren't read."""
        stored = self.table().select("sha256", "size", "age")
        return stored.hint("merge").join(self.live(values), "sha256", "left_anti").withColumn("eligible", F.col("age") > least_age)

    def report(self, values: DataFrame, least_age: int) -> DataFrame:
        """(scanned, live, orphan_total, eligible, bytes) of a sweep that would be made now."""
        marked = self.table().select("sha256", "size", "age").hint("merge").join(self.live(values).withColumn("used", F.lit(True)), "sha256", "left")
        orphan = F.col("used").isNull()
        eligible = orphan & (F.col("age") > least_age)
        return marked.agg(
            F.count("*").alias("scanned"), F.count_if(~orphan).alias("live"), F.count_if(orphan).alias("orphan_total"), F.count_if(eligible).alias("eligible"),
            F.coalesce(F.sum(F.when(eligible, F.col("size"))), F.lit(0)).alias("bytes"),
        )

    def sweep(self, values: DataFrame, least_age: int) -> "ArtifactStore":
        """A store without the eligible orphans; the old one stays until drop()."""
        kept = ArtifactStore(self.spark, buckets=self.buckets)
        gone = self.orphans(values, least_age).filter("eligible").select("sha256")
        kept._write(self.table().hint("merge").join(gone, "sha256", "left_anti"), "append")
        self.spark.catalog.refreshTable(kept.name)
        return kept

    def drop(self) -> None:
        """Removes the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
