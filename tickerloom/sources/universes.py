"""Named universes on shared storage: immutable versions behind a commit log.

A save writes a fresh version directory first and appends one row to the commit log
only when that succeeded. Readers follow the log, so a refresh may read the universe it
replaces, a lost executor costs a retry, and an abandoned write is never seen. One writer
per universe at a time.

Layout: ``commits/`` (the log), ``universes/dbname=/version=/`` (rows) and
``evaluations/dbname=/version=/`` (the evaluation a version was made from).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom import schemas
from tickerloom.functions.text import PORTFOLIO_NAME

COMMIT_SCHEMA = "dbname STRING, version BIGINT"

#: New tickers of version v are numbered from v * SEQ_STRIDE, after all older ones.
SEQ_STRIDE = 1 << 32


class UnknownUniverse(LookupError):
    """No universe of this name has been saved."""


class UniverseStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMIT_SCHEMA).json(f"{self.root}/commits")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMIT_SCHEMA)

    def _version_path(self, kind: str, dbname: str, version: int) -> str:
        return f"{self.root}/{kind}/dbname={dbname}/version={version}"

    def version(self, dbname: str) -> int | None:
        """Latest saved version of a universe, or None."""
        row = (
            self._commits()
            .where(F.col("dbname") == dbname)
            .agg(F.max("version").alias("version"))
            .first()
        )
        return row["version"]

    def next_version(self, dbname: str) -> int:
        return (self.version(dbname) or 0) + 1

    def exists(self, dbname: str) -> bool:
        return self.version(dbname) is not None

    def names(self) -> DataFrame:
        """Every universe with its latest version and whether it is a portfolio."""
        return (
            self._commits()
            .groupBy("dbname")
            .agg(F.max("version").alias("version"))
            .withColumn("is_portfolio", F.col("dbname").rlike(PORTFOLIO_NAME))
        )

    def latest(self, dbname: str) -> int:
        """Latest saved version of a universe that must exist."""
        version = self.version(dbname)
        if version is None:
            raise UnknownUniverse(dbname)
        return version

    def load(self, dbname: str, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the latest; empty if it was saved empty."""
        version = self.latest(dbname) if version is None else version
        return self.spark.read.schema(schemas.UNIVERSE).parquet(
            self._version_path("universes", dbname, version)
        )

    def stage_evaluation(
        self, evaluated: DataFrame, dbname: str, version: int | None = None
    ) -> DataFrame:
        """Write the evaluation for a version, by default the next, and return it as a table.

        The rows, the rejects and the counts of a run then share one computation.
        """
        version = self.next_version(dbname) if version is None else version
        path = self._version_path("evaluations", dbname, version)
        evaluated.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schemas.EVALUATION).parquet(path)

    def evaluation(self, dbname: str) -> DataFrame:
        """The evaluation the latest version was made from; empty if it needed none."""
        path = self._version_path("evaluations", dbname, self.latest(dbname))
        try:
            return self.spark.read.schema(schemas.EVALUATION).parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schemas.EVALUATION)

    def save(self, rows: DataFrame, dbname: str, version: int | None = None) -> int:
        """Replace a universe by ``rows`` and return the new version, by default the next."""
        version = self.next_version(dbname) if version is None else version
        columns = [
            F.col(field.name).cast(field.dataType).alias(field.name)
            for field in schemas.UNIVERSE.fields
        ]
        rows.select(*columns).write.mode("overwrite").parquet(
            self._version_path("universes", dbname, version)
        )
        commit = self.spark.createDataFrame([(dbname, version)], COMMIT_SCHEMA)
        commit.coalesce(1).write.mode("append").json(f"{self.root}/commits")
        return version

    def vacuum(self, dbname: str, keep: int = 1) -> list[int]:
        """Delete all but the last ``keep`` versions of a universe; returns those deleted.

        Readers of an old version fail from then on, so this is for the one writer to call.
        """
        if keep < 1:
            raise ValueError("the latest version must stay")
        log = self._commits().where(F.col("dbname") == dbname).select("version").distinct()
        old = [r["version"] for r in log.where(F.col("version") <= self.latest(dbname) - keep).collect()]
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        deleted = set()
        for version in old:
            for kind in ("universes", "evaluations"):
                path = jvm.org.apache.hadoop.fs.Path(self._version_path(kind, dbname, version))
                if path.getFileSystem(conf).delete(path, True):
                    deleted.add(version)
        return sorted(deleted)
