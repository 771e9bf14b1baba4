"""Ingest of a folder as a stream that tells its progress: outcomes of files, and the event log made from them.

A micro-batch writes what became of each of its files, and from that table its lines of the log. Both go to a folder named for the batch and
replace what is there, so that a batch which is run again after a loss writes the same and counts nothing twice.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.text import content_hash
from ..sources.readers import documents

INGESTED, DUPLICATE, FAILED, UNSUPPORTED = "ingested", "skipped_duplicate", "error", "unsupported"

#: What events carry beside their time, name and path; each event only some of it.
CARRIED = {
    "status": "string", "error": "string", "document_kind": "string", "client_name": "string", "source_type": "string", "text_chars": "long", "content_hash": "string", "is_client_related": "boolean", "confidence": "double",
    "key_findings": "long", "recommendations": "long", "project_key": "string", "project_name": "string", "force_reingest": "boolean",
    "total_files": "long", "succeeded": "long", "failed": "long",
}
EVENT = ", ".join(["event string", "closes boolean", *(f"{c} {kind}" for c, kind in CARRIED.items())])


def outcomes(rows: DataFrame, known: DataFrame | None = None, force: bool = False) -> DataFrame:
    """``rows`` (source_path, text, error, more) with what becomes of them and what is found in them.

    A row whose path and content are in ``known`` (source_path, content_hash), or in an equal row here that comes first, is ``skipped_duplicate``, unless
    ``force``; one with an error is ``error`` or ``unsupported``; any other is ``ingested``. Only ingested ones are classified and
    extracted; of the others those columns are null. A null text is empty.
    """
    r = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("content_hash", F.when(F.col("error").isNull(), content_hash(F.col("text"))))
    again = F.lit(False)
    if not force:
        # Files with an error have no hash; their own path keeps them apart.
        r = r.withColumn("__n", F.row_number().over(Window.partitionBy("source_path", "content_hash").orderBy(F.col("error").isNull().desc())))
        again = F.col("__n") > 1
        if known is not None:
            r = r.join(known.select("source_path", "content_hash").distinct().withColumn("__known", F.lit(True)), ["source_path", "content_hash"], "left")
            again = again | F.col("__known").isNotNull()
    status = F.when(F.col("error") == "unsupported", UNSUPPORTED).when(F.col("error").isNotNull(), FAILED).when(again, DUPLICATE).otherwise(INGESTED)
    r = r.withColumn("status", status).drop("__n", "__known")
    new = F.when(F.col("status") == INGESTED, F.col("text"))
    r = r.withColumn("c", F.when(new.isNotNull(), extract.classify(new, F.col("source_path")))).withColumn("e", F.when(new.isNotNull(), extract.extract(new)))
    r = r.withColumn("p", F.when(new.isNotNull(), extract.infer_project(F.col("e"), F.col("source_path"))))
    counted = lambda c: F.size(F.coalesce(F.col(c), F.array())).cast("long")
    return r.select(
        *rows.columns, "content_hash", "status", "c.document_kind", "c.is_client_related", "c.confidence", "e.client_name", "p.project_key", "p.project_name",
        F.when(new.isNotNull(), counted("e.findings")).alias("key_findings"), F.when(new.isNotNull(), counted("e.recommendations")).alias("recommendations"), F.length("text").cast("long").alias("text_chars"),
    )


def _event(name: str, when: Column, carried: dict[str, Column], closes: bool = False) -> Column:
    cells = [carried.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in CARRIED.items()]
    return F.when(when, F.struct(F.lit(name).alias("event"), F.lit(closes).alias("closes"), *cells))


def progress_events(rows: DataFrame, force: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The events of each row of ``outcomes`` in their order: ``n`` from 0, event, path, what it carries, and ``keep``.

    A file is started, read unless it failed, then skipped, or classified, extracted, assigned to a project and saved; it ends as completed (skipped ones too), failed or
    unsupported. ``closes`` marks what happens when the batch is written. One pass, no shuffle.
    """
    status, own = F.col("status"), lambda *cs: {c: F.col(c) for c in cs}
    new, dup, failed, refused = (status == s for s in (INGESTED, DUPLICATE, FAILED, UNSUPPORTED))
    steps = F.array(
        _event("file_started", ~refused, {"force_reingest": F.lit(force)}),
        _event("file_read", new | dup, own("source_type", "text_chars")),
        _event("file_skipped_duplicate", dup, own("content_hash"), True),
        _event("classification_completed", new, own("document_kind", "is_client_related", "confidence")),
        _event("extraction_completed", new, own("key_findings", "recommendations")),
        _event("project_resolution_completed", new, own("project_key", "project_name")),
        _event("document_record_saved", new, {}, True),
        _event("report_version_saved", new, {}, True),
        _event("file_completed", new | dup, own("status", "document_kind", "client_name"), True),
        _event("file_error", failed, own("status", "error"), True),
        _event("file_unsupported", refused, own("status", "error"), True),
    )
    told = rows.select(F.col("source_path").alias("path"), *keep, F.posexplode(F.filter(steps.cast(f"array<struct<{EVENT.replace(' ', ':').replace(',:', ',')}>>"), lambda e: e.isNotNull())).alias("n", "e"))
    return told.select("path", *keep, F.col("n").cast("long").alias("n"), "e.*")


def folder_events(rows: DataFrame, force: bool = False) -> DataFrame:
    """Two events about all rows of ``outcomes``: files found, and how many did well; skipped ones did."""
    well = F.col("status").isin(INGESTED, DUPLICATE)
    n = rows.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(well).alias("succeeded"), F.count_if(~well).alias("failed"))
    true = F.lit(True)
    both = F.array(_event("directory_scanned", true, {"total_files": F.col("total_files"), "force_reingest": F.lit(force)}), _event("directory_completed", true, {c: F.col(c) for c in ("total_files", "succeeded", "failed")}, True))
    return n.select(F.posexplode(both).alias("n", "e")).select(F.lit(None).cast("string").alias("path"), F.col("n").cast("long").alias("n"), "e.*")


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def stored_outcomes(spark: SparkSession, stored: str) -> DataFrame:
    """All batches' outcomes with their ``batch``; those with status ``ingested`` are the documents, the others the list of failures and repeats."""
    return spark.read.parquet(stored)


def logged_ingest(stored: str, log: str, force: bool = False):
    """A ``foreachBatch`` sink for document rows: outcomes under ``stored``, JSON lines under ``log``, each batch in its own folder.

    Known contents are those that batches with smaller numbers ingested. ``ts`` is the time when the batch began, or when it was written for what happens then.
    ``event_log(spark, log + "/*")`` reads the log.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        began = datetime.now(timezone.utc)
        known = None
        if number and _there(spark, stored):
            known = spark.read.schema("source_path string, content_hash string, status string, batch long").parquet(stored).where((F.col("batch") < number) & (F.col("status") == INGESTED))
        folder = f"{stored}/batch={number}"
        outcomes(batch, known, force).write.mode("overwrite").parquet(folder)
        done = datetime.now(timezone.utc)
        rows = spark.read.parquet(folder)
        events = reduce(DataFrame.unionByName, [progress_events(rows, force), folder_events(rows, force)])
        # In words of their own, since a log line has text for a time.
        ts = F.when(F.col("closes"), done.isoformat()).otherwise(began.isoformat())
        events.select(ts.alias("ts"), "event", "path", *CARRIED).write.mode("overwrite").json(f"{log}/batch={number}")

    return write


def folder_rows(spark: SparkSession, path: str) -> DataFrame:
    """Document rows of files as they come in, repeats and failures included."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return documents(files)
