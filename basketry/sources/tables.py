"""Writers and readers of the tables that pass between stages."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.runtime import cut, delete_scratch, require_columns
from basketry.sources.events import dense_index

PREDICTIONS = ["user_id", "item_id", "score", "rank"]


def write_predictions(df: DataFrame, path: str) -> None:
    """Persist ranked predictions ``(user_id, item_id, score, rank)``."""
    require_columns(df, *PREDICTIONS)
    df.select(
        "user_id", "item_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank")
    ).write.mode("overwrite").parquet(path)


def write_submission(df: DataFrame, path: str) -> None:
    """CSV ``user_id,item_id`` with header, users together and in rank order within each part file."""
    require_columns(df, "user_id", "item_id", "rank")
    (
        df.repartitionByRange("user_id")
        .sortWithinPartitions("user_id", "rank")
        .select("user_id", "item_id")
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )


def write_evidence(df: DataFrame, path: str) -> None:
    """One JSON document per user."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_evidence(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_interactions_tsv(df: DataFrame, path: str, types: dict[str, str]) -> None:
    """TSV whose header carries the field types, e.g. ``user_id:token``."""
    require_columns(df, *types)
    renamed = df.select(*[F.col(name).alias(f"{name}:{kind}") for name, kind in types.items()])
    renamed.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_interactions_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Read such a TSV back; ``float`` fields become doubles, all others stay text."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    out = []
    for name in raw.columns:
        field, _, kind = name.partition(":")
        column = F.col(f"`{name}`")
        out.append((column.cast("double") if kind == "float" else column).alias(field))
    return raw.select(*out)


def write_features(df: DataFrame, path: str) -> None:
    """Feature table as part files by user; what was there before is replaced."""
    df.repartition("user_id").write.mode("overwrite").parquet(path)


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def save_mappings(users: DataFrame, items: DataFrame, directory: str) -> None:
    users.write.mode("overwrite").parquet(f"{directory}/users")
    items.write.mode("overwrite").parquet(f"{directory}/items")


def load_mappings(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{directory}/users"), spark.read.parquet(f"{directory}/items")


def get_or_build_mappings(df: DataFrame, directory: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Id maps of the log: read from ``directory`` when both are complete there, else built and saved."""
    spark = df.sparkSession
    complete = all(_path_exists(spark, f"{directory}/{kind}/_SUCCESS") for kind in ("users", "items"))
    if force or not complete:
        save_mappings(dense_index(df, "user_id", "user_idx"), dense_index(df, "item_id", "item_idx"), directory)
    return load_mappings(spark, directory)


def save_profiles(df: DataFrame, path: str, key: str = "user_id", buckets: int = 32) -> None:
    """Write profiles by key. Rows already stored under other keys stay, those under the same key are replaced.

    Rows lie in buckets by the hash of their key, and only buckets with a new row are written again, into a folder of their own. A
    manifest, numbered one above the last, says which folder holds each bucket; it is created only if it is not there, so of two writers
    that began from the same state one fails with ``FileExistsError`` and has changed nothing. Folders that the last two manifests do not
    name are removed, so readers of the state before this one can finish. ``buckets`` counts for the first write only.
    """
    spark = df.sparkSession
    number, manifest = _manifest(spark, path)
    buckets = manifest["buckets"] if manifest else buckets
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    rows = cut(df.withColumn(BUCKET, place))
    # As many rows as there are buckets at most.
    touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
    before = {int(b): folder for b, folder in manifest["folders"].items()} if manifest else {}
    old = [f"{path}/{before[b]}/{BUCKET}={b}" for b in touched if b in before]
    if old:
        stored = spark.read.schema(df.schema).parquet(*old).withColumn(BUCKET, place)
        rows = rows.unionByName(stored.join(rows.select(key).distinct(), key, "left_anti"))
    folder = f"data-{uuid.uuid4().hex}"
    rows.write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    folders = before | dict.fromkeys(touched, folder)
    text = json.dumps({"buckets": buckets, "folders": folders, "schema": df.schema.json()})
    try:
        _create(spark, f"{path}/{_manifest_name(number + 1)}", text)
    except FileExistsError:
        delete_scratch(spark, f"{path}/{folder}")
        raise
    _remove_unnamed(spark, path, set(folders.values()) | set(before.values()), number)


BUCKET = "profile_bucket"


def _manifest_name(number: int) -> str:
    return f"manifest-{number:010d}.json"


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _create(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not be there yet."""
    fs, target = _file_system(spark, path)
    try:
        stream = fs.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception):
            raise FileExistsError(f"{path} was written by somebody else") from error
        raise
    stream.write(bytearray(text.encode()))
    stream.close()


def _listed(spark: SparkSession, pattern: str) -> list:
    fs, target = _file_system(spark, pattern)
    return sorted(status.getPath().getName() for status in fs.globStatus(target) or [])


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """Number and content of the newest manifest; -1 and None if there is none."""
    names = _listed(spark, f"{path}/manifest-*.json")
    if not names:
        return -1, None
    raw = spark.read.format("binaryFile").load(f"{path}/{names[-1]}").first()["content"]
    return int(names[-1].removeprefix("manifest-").removesuffix(".json")), json.loads(bytes(raw))


def _remove_unnamed(spark: SparkSession, path: str, named: set[str], previous: int) -> None:
    """Remove manifests older than the previous one and the data folders that only they named.

    Folders are taken from those manifests, not from a listing: one that another writer has not committed yet stays.
    """
    for name in _listed(spark, f"{path}/manifest-*.json"):
        if name < _manifest_name(previous):
            raw = spark.read.format("binaryFile").load(f"{path}/{name}").first()["content"]
            for folder in set(json.loads(bytes(raw))["folders"].values()) - named:
                delete_scratch(spark, f"{path}/{folder}")
            delete_scratch(spark, f"{path}/{name}")


def _buckets_of(spark: SparkSession, path: str, wanted: Callable[[int], set[int]] | None = None) -> DataFrame:
    _, manifest = _manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no profiles under {path}")
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    chosen = None if wanted is None else wanted(manifest["buckets"])
    paths = [f"{path}/{folder}/{BUCKET}={b}" for b, folder in manifest["folders"].items() if chosen is None or int(b) in chosen]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    return _buckets_of(spark, path)


def load_profile(spark: SparkSession, path: str, user: object, key: str = "user_id") -> DataFrame:
    """Profile of one user: only its bucket is read, and the filter reaches the parquet scan."""

    def bucket(n: int) -> set[int]:
        return {spark.range(1).select(F.pmod(F.xxhash64(F.lit(user).cast("string")), F.lit(n)).cast("int")).first()[0]}

    return _buckets_of(spark, path, bucket).filter(F.col(key) == F.lit(user))


def write_catalog(df: DataFrame, path: str) -> None:
    """Item catalog, recency pool or per-user lists as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
