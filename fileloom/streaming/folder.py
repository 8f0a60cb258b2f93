"""Folders as streams: files that arrive are converted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fileloom.functions import formats, paths
from fileloom.operators import content

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, from_filter: str = "auto", per_trigger: int = 1000) -> DataFrame:
    """A stream of input_path, content, from_format of files with an allowed extension."""
    rows = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    path = F.regexp_replace("path", "^file:/*", "/")
    ext = paths.extension(path)
    return rows.filter(formats.extension_allowed(ext, F.lit(from_filter))).select(path.alias("input_path"), "content", formats.parse_format(ext).alias("from_format"))


def convert_arriving(stream: DataFrame, target: str, root: str, output_dir: str, checkpoint: str, **options) -> StreamingQuery:
    """Convert what is there and stop; run again for what has come since. The checkpoint knows which files are done."""

    def each(batch: DataFrame, number: int) -> None:
        goal = F.lit(target)
        planned = batch.select("input_path", "content", "from_format", goal.alias("to_format"), formats.converter(F.col("from_format"), goal).alias("converter"), paths.batch_output(F.col("input_path"), F.lit(root), F.lit(output_dir), goal).alias("output_path"))
        content.convert_files(planned, content.Settings(**options)).drop("output_files").write.mode("overwrite").parquet(f"{checkpoint}/tasks/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
