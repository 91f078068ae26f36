"""Table descriptions, CSV / Parquet scans and sinks, shape reporting."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class TableSpec:
    """What a table is: its DDL (or None to infer), separator and column roles."""

    name: str
    ddl: str | None = None
    delimiter: str = ","
    discrete: tuple[str, ...] = field(default_factory=tuple)
    continuous: tuple[str, ...] = field(default_factory=tuple)
    target: tuple[str, ...] = field(default_factory=tuple)

    @property
    def useful(self) -> list[str]:
        """Discrete, then continuous, then target columns (that order matters downstream)."""
        return [*self.discrete, *self.continuous, *self.target]

    @property
    def schema(self) -> StructType | None:
        return StructType.fromDDL(self.ddl) if self.ddl else None


def read_csv(spark: SparkSession, path: str, spec: TableSpec | None = None, *,
             sep: str | None = None, mode: str = "DROPMALFORMED",
             ignore_leading_blanks: bool = False, ignore_trailing_blanks: bool = False,
             min_partitions: int | None = None) -> DataFrame:
    """CSV scan with a header; declared schema if the spec has one, inference otherwise.

    Spark's own ``DROPMALFORMED`` parses only the columns an action needs, so which rows survive
    depends on the action.  Here each line is parsed as a whole (``from_csv``) and dropped when it
    does not fit the schema: every action sees the same rows, without a copy of the table.  The
    header is the first line; lines equal to it (one per file) and blank lines go.  As in Spark's
    default, a quoted line break ends the record.  ``.gz`` files are one task each, hence the
    optional ``min_partitions`` repartition.
    """
    options = {"sep": sep if sep is not None else (spec.delimiter if spec else ","),
               "ignoreLeadingWhiteSpace": str(ignore_leading_blanks).lower(),
               "ignoreTrailingWhiteSpace": str(ignore_trailing_blanks).lower()}
    reader = spark.read.option("header", True).options(**options)
    schema = spec.schema if spec else None
    if mode.upper() != "DROPMALFORMED":
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        df = reader.option("mode", mode).csv(path)
        return _spread(df, min_partitions)
    if schema is None:
        schema = reader.option("inferSchema", True).csv(path).schema
    lines = spark.read.text(path)
    header = lines.first()
    bad = "_malformed"
    while bad in schema.names:
        bad += "_"
    parsed = F.from_csv("value", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", `{bad}` string",
                        {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    rows = _spread(lines, min_partitions).where((F.col("value") != F.lit(header[0] if header else "")) & (F.trim("value") != ""))
    return rows.select(parsed.alias("r")).where(F.col(f"r.`{bad}`").isNull()).select(*[F.col(f"r.`{n}`") for n in schema.names])


def _spread(df: DataFrame, min_partitions: int | None) -> DataFrame:
    return df.repartition(min_partitions) if min_partitions and df.rdd.getNumPartitions() < min_partitions else df


def write_csv(df: DataFrame, path: str, sep: str = ";", compression: str | None = None,
              mode: str = "overwrite") -> str:
    """CSV sink with a header and no index column (A6); optional gzip (A4)."""
    writer = df.write.mode(mode).option("sep", sep).option("header", True)
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)
    return path


def select_roles(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Keep the useful columns of a spec, in role order (A5)."""
    return df.select(*[F.col(f"`{c}`") for c in spec.useful])


def table_shape(df: DataFrame) -> DataFrame:
    """Rows, columns and column list as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).cast("int").alias("n_cols"),
        F.lit(",".join(df.columns)).alias("column_names"),
    )


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
