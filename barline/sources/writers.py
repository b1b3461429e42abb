"""Sinks and table maintenance on Parquet (S8-S14, write side of M1-M6)."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.operators import merge
from barline.session import work_dir

BAR_PARTITIONS, BAR_SORT = ["frequency", "year"], ["ticker", "ts"]


def _spread(df: DataFrame, partition: Sequence[str], sort: Sequence[str]) -> DataFrame:
    """Range-shuffle by partition and sort columns: few files per partition, yet a
    partition that holds much of the data is still split over many tasks."""
    cols = [*partition, *sort]
    return df.repartitionByRange(*cols).sortWithinPartitions(*cols) if cols else df


def write_append(df: DataFrame, path: str, partition: Sequence[str] = (), sort: Sequence[str] = ()) -> None:
    _spread(df, partition, sort).write.mode("append").partitionBy(*partition).parquet(path)


def write_truncate(df: DataFrame, path: str, partition: Sequence[str] = (), sort: Sequence[str] = ()) -> None:
    (_spread(df, partition, sort).write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy(*partition).parquet(path))


def write_bars(df: DataFrame, path: str) -> None:
    """Bars by frequency (canonical names) and year, sorted by ticker and time inside each file."""
    write_append(merge.canonical_rows(df).withColumn("year", F.year("ts")), path, BAR_PARTITIONS, BAR_SORT)


def export_parquet_csv(df: DataFrame, base: str) -> None:
    """The same rows as snappy Parquet and as CSV with eight decimals."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").option(
        "compression", "snappy").parquet(f"{base}/parquet")
    fixed = {f.name: F.format_string("%.8f", f.name) for f in df.schema
             if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    fixed = {n: F.when(F.col(n).isNotNull(), c) for n, c in fixed.items()}
    df.withColumns(fixed).write.mode("overwrite").option("header", True).csv(f"{base}/csv")


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """Partition columns of a stored table, outermost first, as its folders name them."""
    here, names = spark._jvm.org.apache.hadoop.fs.Path(path), []
    system = here.getFileSystem(spark._jsc.hadoopConfiguration())
    while True:
        inner = [s.getPath() for s in system.listStatus(here) if s.isDirectory() and "=" in s.getPath().getName()]
        if not inner:
            return names
        here = inner[0]
        names.append(here.getName().split("=", 1)[0])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table whose partition values are whole numbers, dates or text.

    Left to itself the reader takes the frequency ``1d`` for the number 1.0."""
    parts, found = partition_columns(spark, path), spark.read.parquet(path)
    plain = (T.IntegerType, T.LongType, T.DateType, T.StringType)
    fields = [T.StructField(f.name, T.StringType()) if f.name in parts and not isinstance(f.dataType, plain) else f
              for f in found.schema]
    return found if fields == found.schema.fields else spark.read.schema(T.StructType(fields)).parquet(path)


def _any_of(partition: Sequence[str], rows: Sequence[tuple]) -> Column:
    """Whether a row lies in one of the partitions; literals only, so that the scan opens no others."""
    groups: dict[tuple, list] = {}
    for row in rows:
        groups.setdefault(row[:-1], []).append(row[-1])
    test = F.lit(False)
    for head, values in groups.items():
        known = [v for v in values if v is not None]
        inner = F.col(partition[-1]).isin(known) if known else F.lit(False)
        if len(known) < len(values):
            inner = inner | F.col(partition[-1]).isNull()
        for name, value in zip(partition, head):
            inner = F.col(name).eqNullSafe(F.lit(value)) & inner
        test = test | inner
    return test


def rewrite_partitions(spark: SparkSession, path: str, touched: DataFrame, partition: str | Sequence[str],
                       change: Callable[[DataFrame], DataFrame], sort: Sequence[str] = ()) -> None:
    """Replace the partitions named in ``touched`` by ``change`` of their rows.

    ``partition`` has to name all partition columns of the table. Only touched partitions are read and replaced;
    the driver holds their values and folders, one entry a partition. The new rows are written aside first: a
    failed attempt leaves the table as it was and can be run again. Missing partition values are values.
    """
    parts = [partition] if isinstance(partition, str) else list(partition)
    layout = partition_columns(spark, path)
    if parts != layout:
        raise ValueError(f"the table is partitioned by {layout}, not by {parts}")
    current = read_table(spark, path)
    named = touched.select(*[F.col(c).cast(current.schema[c].dataType).alias(c) for c in parts]).distinct()
    values = [tuple(row) for row in named.toLocalIterator()]
    if not values:
        return
    hit = current.where(_any_of(parts, values))
    folders = hit.select(*parts, F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")).distinct()
    before = {tuple(row[:-1]): row[-1] for row in folders.toLocalIterator()}
    aside = work_dir(spark, "rewrite")
    change(hit).select(*current.columns).write.partitionBy(*parts).parquet(aside)
    # The schema is given because removing every row leaves no files to infer it from.
    ready = spark.read.schema(current.schema).parquet(aside)
    filled = {tuple(row) for row in ready.select(*parts).distinct().toLocalIterator()}
    if not filled <= set(values):
        raise ValueError(f"changed rows lie outside the touched partitions: {filled - set(values)}")
    (_spread(ready, parts if sort else [], sort).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*parts).parquet(path))
    # A dynamic overwrite leaves partitions alone that got no rows: drop those folders.
    for row, folder in before.items():
        if row not in filled:
            _delete_partition(spark, path, folder)
    delete_folder(spark, aside)


def _delete_partition(spark: SparkSession, path: str, folder: str) -> None:
    """Delete a partition's folder (given as a URI) and the folders above it that hold nothing else."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    target, root = path_of(spark._jvm.java.net.URI(folder)), path_of(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    root = system.makeQualified(root)
    system.delete(target, True)
    above = system.makeQualified(target.getParent())
    while not above.equals(root) and len(system.listStatus(above)) == 0:
        system.delete(above, False)
        above = above.getParent()


def delete_folder(spark: SparkSession, folder: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def change_rows(spark: SparkSession, path: str, test: Column, change: Callable[[DataFrame], DataFrame],
                sort: Sequence[str] = ()) -> None:
    """Apply ``change`` to the partitions of a stored table that hold rows for which ``test`` is true.

    With ``merge.delete_where`` a delete or purge, with ``merge.null_out_columns`` an update."""
    hit = read_table(spark, path).where(test)
    rewrite_partitions(spark, path, hit, partition_columns(spark, path), change, sort)


MERGES = {"upsert": merge.merge_upsert, "coalesce": merge.merge_coalesce, "insert": merge.merge_insert_only}


def merge_into(spark: SparkSession, path: str, staging: str, mode: str, keys: Sequence[str] = tuple(merge.KEY)) -> None:
    """Merge the table at ``staging`` into the bars at ``path`` (see ``write_bars``) and leave staging empty.

    ``mode`` is ``upsert``, ``coalesce`` or ``insert``; keys staged several times count once. Only partitions with
    staged rows are rewritten. Staging is emptied last, so a failed attempt can be run again."""
    held = spark.read.parquet(staging)
    staged = merge.canonical_rows(held).withColumn("year", F.year("ts"))
    rewrite_partitions(spark, path, staged, BAR_PARTITIONS, lambda stored: MERGES[mode](stored, staged, keys), BAR_SORT)
    (spark.createDataFrame([], held.schema).write.mode("overwrite").option("partitionOverwriteMode", "static")
     .parquet(staging))


def load_lineage(df: DataFrame, query_id: str, group: str, topics: Sequence[str], frequency: str) -> DataFrame:
    """One metadata row describing a load of sentiment rows."""
    return df.agg(
        F.min(F.to_date("ts")).alias("start_date"), F.max(F.to_date("ts")).alias("end_date"),
        F.count("*").alias("num_rows"), F.sum("num_articles").alias("num_articles"),
    ).select(
        F.lit(query_id).alias("query_id"), F.lit(group).alias("topic_group_id"),
        F.current_timestamp().alias("load_timestamp"), "start_date", "end_date",
        F.array(*[F.lit(t) for t in topics]).alias("topics"), "num_rows", "num_articles",
        F.lit(frequency).alias("frequency"))


def write_articles(articles: DataFrame, path: str) -> None:
    """Articles by day (``dt``), sorted by time; a busy day spreads over several files."""
    rows = articles.withColumn("dt", F.to_date("ts"))
    _spread(rows, ["dt"], ["ts", "article_id"]).write.mode("overwrite").partitionBy("dt").parquet(path)


_FILE = "file string, split string, n_rows long, checksum decimal(38,0)"


def _files(sequences: DataFrame) -> DataFrame:
    """Rows and an order-free checksum of the content of every file; no file passes through one task's memory."""
    content = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(sequences.columns)))
    name = F.regexp_extract(F.input_file_name(), "([^/]+)$", 1)
    return sequences.select(name.alias("file"), "split", content.cast("decimal(38,0)").alias("hash")).groupBy("file", "split").agg(
        F.count("*").alias("n_rows"), F.sum("hash").cast("decimal(38,0)").alias("checksum"))


def write_dataset(spark: SparkSession, samples: DataFrame, base: str, kind: str, version: str,
                  features: Sequence[str], lookback: int, horizons: Sequence[int], scaler: DataFrame | None = None) -> DataFrame:
    """Sequences under ``base/kind/version`` by split, the scaler beside them, a list of files with rows and checksums,
    and a manifest counted from the files.

    The manifest is taken away first and written last: a folder without one is no dataset. ``scaler`` is a table of
    ``feature``, ``mean``, ``std``.
    """
    from barline.operators.features import dataset_metadata

    folder = f"{base}/{kind}/{version}"
    delete_folder(spark, f"{folder}/manifest")
    samples.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/sequences")
    if scaler is not None:
        scaler.select("feature", F.col("mean").cast("double"), F.col("std").cast("double")).write.mode("overwrite").parquet(f"{folder}/scaler")
    written = spark.read.parquet(f"{folder}/sequences")
    _files(written).write.mode("overwrite").json(f"{folder}/files")
    manifest = dataset_metadata(written, features, lookback, horizons).withColumn("dataset", F.lit(f"{kind}/{version}"))
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def read_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Sequences, scaler (if one was written) and manifest of a dataset, after its files were checked.

    A missing manifest, a missing or added file, and a file with other rows than were written are errors.
    """
    def there(name: str) -> bool:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
        return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)

    if not there("manifest"):
        raise ValueError(f"{folder} has no manifest: it was not written to the end")
    sequences = spark.read.parquet(f"{folder}/sequences")
    listed = spark.read.schema(_FILE).json(f"{folder}/files")
    wrong = _files(sequences).join(listed.withColumnsRenamed({"n_rows": "rows", "checksum": "sum"}), ["file", "split"], "full").where(
        "n_rows IS NULL OR rows IS NULL OR n_rows <> rows OR checksum <> sum")
    found = [r["file"] for r in wrong.select("file").limit(10).collect()]
    if found:
        raise ValueError(f"files of {folder} differ from its list: {', '.join(found)}")
    scaler = spark.read.parquet(f"{folder}/scaler") if there("scaler") else None
    return sequences, scaler, spark.read.json(f"{folder}/manifest")


def append_lineage(spark: SparkSession, path: str, row: DataFrame, config: Mapping[str, object], notes: str | None = None) -> None:
    """Append a load's row to the metadata table at ``path`` with its notes and its configuration as JSON text."""
    told = row.withColumns({"notes": F.lit(notes).cast("string"), "config": F.lit(json.dumps(config, sort_keys=True))})
    told.coalesce(1).write.mode("append").partitionBy("topic_group_id").parquet(path)


def delete_group(spark: SparkSession, sentiment: str, metadata: str, group: str) -> None:
    """Remove a topic group from the sentiment table and from the metadata that tells of its loads."""
    for path in (sentiment, metadata):
        change_rows(spark, path, F.col("topic_group_id") == group, lambda df: df.where(F.col("topic_group_id") != group))
