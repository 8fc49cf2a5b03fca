"""Tables the stages hand to one another, and report sinks."""

from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.calendar import Bounds


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether the job that wrote ``path`` committed: Spark leaves its mark last.

    A table of which single partitions are replaced bears no mark.
    """
    return exists(spark, f"{path}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that is not needed any more; one that is not there is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise_once(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Write each raw table as parquet unless a complete copy is there already; read the copies."""
    out = {}
    for name, df in tables.items():
        path = f"{folder}/{name}"
        if not is_complete(df.sparkSession, path):
            df.write.mode("overwrite").parquet(path)
        out[name] = df.sparkSession.read.parquet(path)
    return out


def write_periods(df: DataFrame, path: str, period: str) -> None:
    """Period table in one folder per year; only the years written are replaced.

    The rows of a year are gathered first, in as many tasks as their size asks for, so
    that folders hold few files.
    """
    part = "period_year"
    (
        df.withColumn(part, F.year(period))
        .hint("rebalance", F.col(part))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(part)
        .parquet(path)
    )


def read_periods(spark: SparkSession, path: str, bounds: Bounds | None = None) -> tuple[DataFrame, str]:
    """Period table and the name of its period column (``date`` before ``month``).

    With ``bounds`` only the folders of their years are read.
    """
    df = spark.read.parquet(path)
    name = next((c for c in ("date", "month") if c in df.columns), None)
    if name is None:
        raise ValueError(f"no period column in {path}")
    if bounds is not None:
        if bounds.start is not None:
            df = df.where(F.col("period_year") >= F.lit(bounds.start.year))
        if bounds.before is not None:
            df = df.where(F.col("period_year") <= F.lit(bounds.before.year))
        df = bounds.keep(df, name)
    return df.drop("period_year").withColumn(name, F.to_date(name)), name


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report (leaderboard, metrics, metadata) as JSON lines; panels may have long ones."""
    df.write.mode("overwrite").json(path)


def write_cutoff(df: DataFrame, path: str, cutoff: str) -> None:
    """Add one version, named by its data cutoff; a rerun replaces that version only."""
    (
        df.withColumn("cutoff", F.lit(cutoff).cast("date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("cutoff")
        .parquet(path)
    )


def read_cutoff(spark: SparkSession, path: str, cutoff: str | None = None) -> DataFrame:
    """One version, or the newest one; only its folder is read."""
    df = spark.read.parquet(path)
    if cutoff is None:
        cutoff = df.agg(F.max("cutoff")).first()[0]  # a partition column: no data is read for it
    return df.where(F.col("cutoff") == F.lit(cutoff).cast("date"))


def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
