"""Distance matrices, partitions, parameters, and result tables as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Columns of a square csv.
MOST_COLUMNS = 5000
PART = "struct<alpha:double,distances:array<array<double>>,frequencies:array<double>,model:string,name:string,rates:array<double>,variances:array<array<double>>>"
PARAMETERS = f"filename string, likelihood double, ml_tree string, ms_tree string, nj_tree string, sse double, partitions map<string,{PART}>"


def read_distances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, labels) of a square csv whose first column is the index; gz and bz2 by suffix."""
    table = spark.read.option("header", True).option("inferSchema", False).csv(path)
    index, names = table.columns[0], table.columns[1:]
    labels = spark.createDataFrame(list(enumerate(names)), "i long, name string")
    long = table.unpivot([index], names, "to", "d").select(F.col(f"`{index}`").alias("of"), "to", F.col("d").cast("double"))
    of = labels.select(F.col("i"), F.col("name").alias("of"))
    to = labels.select(F.col("i").alias("j"), F.col("name").alias("to"))
    return long.join(of, "of").join(to, "to").where("i < j").select("i", "j", "d"), labels


def write_distances(square: DataFrame, labels: DataFrame, path: str) -> None:
    """A square csv with the names as header and index; columns in order of i. At most ``MOST_COLUMNS`` names."""
    names = [r["name"] for r in labels.orderBy("i").limit(MOST_COLUMNS + 1).collect()]
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns: write the edge list as Parquet")
    named = square.join(labels, "i").withColumnRenamed("name", "of").join(labels.select(F.col("i").alias("j"), F.col("name").alias("to")), "j")
    wide = named.groupBy("i", "of").pivot("to", names).agg(F.first("d")).orderBy("i").drop("i").withColumnRenamed("of", "_index")
    wide.coalesce(1).write.option("header", True).csv(path)


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """(elem, label) of one comma-separated line; canonical labels come from ``partition.canonical``."""
    return spark.read.text(path).select(F.posexplode(F.split(F.trim("value"), ",")).alias("elem", "label")).select(F.col("elem").cast("long"), F.trim("label").alias("label"))


def partition_line(part: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("elem", "grp")))
    return part.agg(F.array_join(F.transform(rows, lambda r: r["grp"].cast("string")), ",").alias("value"))


def write_partition(part: DataFrame, path: str) -> None:
    partition_line(part).coalesce(1).write.text(path)


def parameters_from_json(text: Column) -> Column:
    """A struct of one JSON document; unknown keys are ignored, partition keys become integers."""
    s = F.from_json(text, PARAMETERS)
    keep = [s[n].alias(n) for n in ("filename", "likelihood", "ml_tree", "ms_tree", "nj_tree", "sse")]
    return F.struct(*keep, F.transform_keys(s["partitions"], lambda k, _: k.cast("int")).alias("partitions"))


def parameters_to_json(parameters: Column) -> Column:
    return F.to_json(parameters, {"pretty": "true", "ignoreNullFields": "false"})


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(locus, parameters) of the .json files of a directory, compressed or not."""
    from sylvan.functions.scalars import strip_extensions

    files = spark.read.option("pathGlobFilter", "*.json*").text(path, wholetext=True)
    return files.select(strip_extensions(F.col("_metadata.file_path")).alias("locus"), parameters_from_json(F.col("value")).alias("parameters"))


def write_parameters(loci: DataFrame, path: str, compress: bool = False) -> None:
    out = loci.select("locus", parameters_to_json(F.col("parameters")).alias("value"))
    out.write.partitionBy("locus").option("compression", "gzip" if compress else "none").text(path)


def write_results(results: DataFrame, path: str) -> None:
    """Tab-separated with a header, as score and membership tables are."""
    results.coalesce(1).write.option("sep", "\t").option("header", True).csv(path)
