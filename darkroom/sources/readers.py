"""Readers with fixed schemas."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.functions import fixed

# The store's six tables.
STORE = {
    "users": "id string, external_id string, created_at timestamp",
    "images": "sha256 string, user_id string, width int, height int, content_type string, "
    "byte_size bigint, created_at timestamp",
    "jobs": "id string, user_id string, state string, spec string, idempotency_key string, "
    "result_sha256 string, error string, created_at timestamp, updated_at timestamp",
    "job_steps": "id bigint, job_id string, state string, detail string, progress double, at timestamp",
    "artifacts": "id string, job_id string, sha256 string, kind string, created_at timestamp",
    "cost_ledger": "id bigint, user_id string, job_id string, provider string, operation string, "
    "units int, cents double, at timestamp",
}

INSTRUCTION = (
    "instruction string, op string, target string, content string, colour string, why string, split string"
)
CASE_RESULT = (
    "id string, prompt string, op string, status string, seconds double, passes string, "
    "kept_passes int, cost double, bbox_iou double, mask_source string, detail string, signature string"
)
RUN_RESULT = "peak_rss_mb double, cold_load_s string, warm_p50_s double"


def read_nested_parquet(
    spark: SparkSession, path: str, columns: Sequence[str | Column], limit: int | None = None
) -> DataFrame:
    """Only the named columns or nested fields are read; reading stops at ``limit`` rows."""
    rows = spark.read.parquet(path).select(*columns)
    return rows if limit is None else rows.limit(limit)


def read_labelled_jsonl(spark: SparkSession, path: str, schema: str = INSTRUCTION) -> DataFrame:
    """JSON Lines; blank lines are skipped, missing keys are null, ``split`` defaults to holdout."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("split", F.coalesce("split", F.lit("holdout")))


def read_report(
    spark: SparkSession, path: str, schema: str = CASE_RESULT,
    exclude_ops: Collection[str] = fixed.REMOTE_OPS, one_line: bool = False,
) -> DataFrame:
    """JSON arrays of results, one row per element, operations that cannot repeat left out.

    ``one_line`` reads files with an array per line, which Spark can split; otherwise each file
    is one array. Of the rows left with one ``id`` the last stays, by file name and place in the
    file; rows without an id count as one id.
    """
    read = spark.read.schema(schema).option("multiLine", not one_line).json(path)
    # Slices of a file are ordered by where they start, and generated ids rise within a slice.
    placed = read.select(
        F.struct(*read.columns).alias("row"),
        F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        ).alias("at"),
    ).where(F.col("row.op").isNull() | ~F.col("row.op").isin(*exclude_ops))
    return placed.groupBy("row.id").agg(F.max_by("row", "at").alias("row")).select("row.*")


def collate_results(
    spark: SparkSession, path: str, models: Mapping[str, str], pipelines: Mapping[str, str],
    budget_mb: float = fixed.SLOT_MB, remote: str = "remote", schema: str = RUN_RESULT,
    one_line: bool = False,
) -> DataFrame:
    """One row per known run: group, label, peak, cold and warm times, and the budget verdict.

    ``models`` and ``pipelines`` give each known run its label. A run is named by its ``run=``
    folder, else by its file. Only single models are judged, and a remote run has no budget.
    """
    file = F.col("_metadata.file_path")
    folder = F.regexp_extract(file, r"/run=([^/]+)/", 1)
    run = F.when(folder != "", folder).otherwise(F.regexp_extract(file, r"([^/]+)\.json$", 1))
    # The path names the run, so the folder is not read as a column.
    reader = spark.read.schema(schema).option("multiLine", not one_line).option("recursiveFileLookup", True)
    rows = reader.json(path).select(run.alias("run"), "*")
    labels = F.create_map(*[F.lit(x) for kv in {**models, **pipelines}.items() for x in kv])
    peak = F.coalesce("peak_rss_mb", F.lit(0.0))
    verdict = (
        F.when(F.col("run") == remote, "n/a (remote)")
        .when(~F.col("run").isin(*models), "—")
        .when(peak <= budget_mb, "fits")
        .otherwise("OVER")
    )
    return rows.where(F.col("run").isin(*models, *pipelines)).select(
        F.when(F.col("run").isin(*models), "model").otherwise("pipeline").alias("kind"),
        "run", labels[F.col("run")].alias("label"), peak.alias("peak_rss_mb"), "cold_load_s",
        "warm_p50_s", verdict.alias("verdict"),
    )


def scan_objects(
    spark: SparkSession, root: str, name: str = "[0-9a-f]{64}", packed: bool = False
) -> DataFrame:
    """digest, size, modified_at of every stored object, without reading a byte of content.

    Names of another shape are writes in progress or not ours, and are left out. ``packed`` lists
    a store as ``writers.put_objects`` writes it, where a file holds many objects: only the digest
    and size columns are read, and an object is as old as its file.
    """
    if packed:
        stored = spark.read.schema("digest string, size bigint").parquet(root)
        return stored.select(
            "digest", "size", F.col("_metadata.file_modification_time").alias("modified_at")
        ).where(F.col("digest").rlike(f"^{name}$"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    stem = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(
        stem.alias("digest"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at")
    ).where(F.col("digest").rlike(f"^{name}$"))


#: The key of each store table, and whether it is a number.
STORE_KEYS = {
    "users": ("id", False), "images": ("sha256", False), "jobs": ("id", False), "job_steps": ("id", True),
    "artifacts": ("id", False), "cost_ledger": ("id", True),
}
#: Rows that one task reads from a database.
ROWS_PER_READ = 500_000


def key_ranges(column: str, parts: int) -> list[str]:
    """SQL conditions that part a text key into ``parts`` ranges; every row meets exactly one of them.

    Keys of the store are digests and random ids in hexadecimal digits, so cuts at even steps of
    the first four digits give even ranges.
    """
    cuts = sorted({format(k * 65536 // parts, "04x") for k in range(1, parts)})
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= '{a}' AND {column} < '{b}'" for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [f"{column} < '{cuts[0]}' OR {column} IS NULL", *inner, f"{column} >= '{cuts[-1]}'"]


def read_degree(rows: int, per_read: int = ROWS_PER_READ) -> int:
    """Tasks that read a table of ``rows`` rows; text keys can be cut into 65 536 ranges."""
    return max(1, min(-(-rows // per_read), 65_536))


def load_store(
    spark: SparkSession, location: str, properties: Mapping[str, str] | None = None,
    per_read: int = ROWS_PER_READ,
) -> dict[str, DataFrame]:
    """The six tables, from a folder of parquet or from a database URL.

    From a database each table is read by as many tasks as its row count asks for, in ranges of
    its key: numbered tables by id, the others by the leading digits of their text keys.
    """
    if not location.startswith("jdbc:"):
        return {
            name: spark.read.schema(schema).parquet(f"{location}/{name}")
            for name, schema in STORE.items()
        }
    given = dict(properties or {})
    tables = {}
    for name, (key, numbered) in STORE_KEYS.items():
        asked = f"SELECT COUNT(*) AS n, MIN({key}) AS low, MAX({key}) AS high FROM {name}"
        size = spark.read.format("jdbc").options(url=location, query=asked, **given).load().first()
        parts = read_degree(int(size["n"]), per_read)
        options = {**given, "customSchema": STORE[name]}
        if parts == 1:
            tables[name] = spark.read.jdbc(location, name, properties=options)
        elif numbered:
            tables[name] = spark.read.jdbc(
                location, name, column=key, lowerBound=size["low"], upperBound=size["high"], numPartitions=parts,
                properties=options,
            )
        else:
            tables[name] = spark.read.jdbc(location, name, predicates=key_ranges(key, parts), properties=options)
    return tables
