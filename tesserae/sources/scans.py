"""The scans table: reports in, flat rows appended by project, the latest scan and the one before it out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.sources.keyed import KeyedTable

# The tables of projects and their scans. A scan's project must exist; scans are partitioned by project and read newest first.
PROJECTS = "id string not null, name string not null, repo_url string, created_at timestamp not null"
SCANS = (
    "id string not null, project_id string not null, scanned_at timestamp not null, node_count int not null, edge_count int not null, role_refinement_passes int not null, layer_entropy double, cycle_entropy double, "
    "persistence_entropy double, security_entropy double, total_entropy double, maturity double, maturity_level string, confidence double, invariant_violation_count int not null, skipped_invariants array<string> not null, report string not null"
)
_VALUE = "struct<value:double>"
_REPORT = (
    f"graph struct<nodes:array<struct<id:string>>,edges:array<struct<relation:string>>>, roleRefinementPasses double, layerEntropy {_VALUE}, cycleEntropy {_VALUE}, persistenceEntropy {_VALUE}, securityEntropy {_VALUE}, "
    "totalEntropy double, maturity double, maturityLevel string, confidence double, invariants map<string,struct<holds:boolean>>, skippedInvariants array<string>"
)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """JSON reports, one document per file: (path, report)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("report"))


def summarised(reports: DataFrame) -> DataFrame:
    """reports (with a column report) with the flat columns of SCANS, as the report itself states them, and readable.

    readable is false where the text isn't a report: such a row has no counts, and its columns are null.
    """
    r = F.from_json("report", _REPORT)
    rows = reports.withColumn("_r", r)
    of = lambda name: F.col(f"_r.{name}")
    broken = F.size(F.filter(F.map_values(F.coalesce(of("invariants"), F.create_map().cast("map<string,struct<holds:boolean>>"))), lambda i: ~i["holds"]))
    readable = F.coalesce(of("graph.nodes").isNotNull() & of("graph.edges").isNotNull() & of("roleRefinementPasses").isNotNull(), F.lit(False))
    when = lambda c: F.when(F.col("readable"), c)
    rows = rows.withColumn("readable", readable)
    return rows.select(
        *reports.columns, "readable", when(F.size(of("graph.nodes"))).alias("node_count"), when(F.size(of("graph.edges"))).alias("edge_count"), of("roleRefinementPasses").cast("int").alias("role_refinement_passes"),
        *[of(f"{d}Entropy.value").alias(f"{d}_entropy") for d in ("layer", "cycle", "persistence", "security")], of("totalEntropy").alias("total_entropy"), of("maturity").alias("maturity"), of("maturityLevel").alias("maturity_level"),
        of("confidence").alias("confidence"), when(broken).alias("invariant_violation_count"), when(F.coalesce(of("skippedInvariants"), F.array().cast("array<string>"))).alias("skipped_invariants"),
    )


def project_table(path: str) -> KeyedTable:
    return KeyedTable(f"{path}/projects", PROJECTS, "id", "pmod(crc32(id), 8)")


def scan_table(path: str) -> KeyedTable:
    """Scans by project; a project's scans are a partition, so reading one project reads nothing else."""
    return KeyedTable(f"{path}/scans", SCANS, "id", "project_id", (("project_id", project_table(path)),))


def put_project(spark: SparkSession, path: str, id_: str, name: str, repo_url: str | None = None) -> None:
    """A project by its id: a new name and address replace the old ones, the time of its creation stays."""
    table = project_table(path)
    old = table.read(spark).where(F.col("id") == id_).select("id", F.col("created_at").alias("since"))
    row = spark.createDataFrame([(id_, name, repo_url)], "id string, name string, repo_url string").join(old, "id", "left")
    row = row.select("id", "name", "repo_url", F.coalesce("since", F.current_timestamp()).alias("created_at"))
    table.merge(row, f"put-{uuid.uuid4().hex}")


def push(reports: DataFrame, project_id: str, path: str, scanned_at: str | None = None) -> DataFrame:
    """The readable reports as new rows of SCANS in the table at path, whose project must be there; returns the reports that aren't readable.

    A scan's id follows from its project, its time if one is given, and its report: pushing again what was pushed leaves one row, the first.
    """
    rows = summarised(reports)
    columns = [c.split()[0] for c in SCANS.split(", ")]
    digest = F.sha2(F.concat_ws("/", F.lit(project_id), F.lit(scanned_at), "report"), 256)
    id_ = F.regexp_replace(F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    at = F.lit(scanned_at).cast("timestamp") if scanned_at else F.current_timestamp()
    scans = rows.where("readable").withColumns({"id": id_, "project_id": F.lit(project_id), "scanned_at": at}).dropDuplicates(["id"])
    scan_table(path).merge(scans.select(*columns), f"push-{uuid.uuid4().hex}", replace=False)
    return rows.where("not readable").select(*reports.columns)


def append(rows: DataFrame, path: str) -> None:
    """Rows of scans, partitioned by project so that reading one project reads nothing else."""
    rows.write.mode("append").partitionBy("project_id").parquet(path)


def upsert(projects: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """projects with rows put in by key; a row replaces the one it meets."""
    return projects.join(rows.select(key), key, "left_anti").unionByName(rows)


def projects(table: DataFrame) -> DataFrame:
    return table.orderBy("name")


def of_project(table: DataFrame, project_id: str) -> DataFrame:
    """A project's scans, the newest first."""
    return table.where(F.col("project_id") == project_id).orderBy(F.desc("scanned_at"))


def latest(table: DataFrame) -> DataFrame:
    """The newest scan of each project, by partial aggregation instead of a window over all scans."""
    best = table.groupBy("project_id").agg(F.max_by(F.struct(*[c for c in table.columns if c != "project_id"]), "scanned_at").alias("r"))
    return best.select("project_id", "r.*")


def with_previous(table: DataFrame) -> DataFrame:
    """Each scan with previous_scan, when the project was scanned before it: the natural baseline."""
    return table.withColumn("previous_scan", F.lag("scanned_at").over(Window.partitionBy("project_id").orderBy("scanned_at")))
