"""Writing with the registry's rules: good and broken rows parted, and counted, in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from fleetspark.operators.quality import CHECKS, REFERENCES, REQUIRED, UNIQUE_KEYS
from fleetspark.schemas import table_schema
from fleetspark.session import work_dir
from fleetspark.sources.registry import conform

RULES, GOOD = "broken_rules", "is_good"


def row_rules(name: str) -> dict[str, Column]:
    """Rule -> condition that a row breaks it, for rules that a row alone can break: CHECKs and NOT NULLs."""
    rules = {rule: F.coalesce(~holds(), F.lit(False)) for rule, holds in CHECKS.get(name, {}).items()}
    return rules | {f"not_null_{c}": F.col(c).isNull() for c in REQUIRED.get(name, [])}


@dataclass
class Written:
    """A written table: where its parts lie, and rows and broken rules as counted on the way."""

    spark: SparkSession
    folder: str
    name: str
    counts: dict[str, int]

    def _part(self, good: bool) -> DataFrame:
        schema = table_schema(self.name).add(RULES, ArrayType(StringType())).add(GOOD, BooleanType())
        rows = self.spark.read.schema(schema).parquet(self.folder).where(F.col(GOOD) == good).drop(GOOD)
        return rows.drop(RULES) if good else rows

    def good(self) -> DataFrame:
        return self._part(True)

    def rejected(self) -> DataFrame:
        """Broken rows with the names of the rules they break."""
        return self._part(False)


def write_checked(df: DataFrame, root: str, name: str, parents: dict[str, DataFrame] | None = None) -> Written:
    """Write a registry table below ``root``, one folder for good rows and one for broken ones.

    A row breaks a CHECK, a NOT NULL or, where ``parents`` has the table it refers to, a foreign key;
    a null result of a CHECK and a null reference pass.  With ``parents`` holding the table itself
    (what is stored already), rows with one of its unique keys are broken too, and so are all but
    one of the rows that bring the same key.  The table is read once; the counts are observed while
    its rows are written.
    """
    parents = parents or {}
    rows, rules = conform(df, name), row_rules(name)
    fields = rows.columns
    for child, column, parent, key in REFERENCES:
        if child == name and parent in parents and parent != name:
            mark = f"_has_{column}"
            known = parents[parent].select(F.col(key).alias(f"_key_{column}"), F.lit(True).alias(mark)).distinct()
            rows = rows.join(known, F.col(column) == F.col(f"_key_{column}"), "left")
            rules[f"foreign_key_{column}"] = F.col(column).isNotNull() & F.col(mark).isNull()
    unique = [columns for table, columns in UNIQUE_KEYS if table == name and name in parents]
    if unique:
        # Equal rows are told apart by a number, which must be the same wherever it is read.
        path = work_dir(df.sparkSession, "checked")
        rows.withColumn("_row", F.struct(F.xxhash64(F.to_json(F.struct(*fields))).alias("h"), F.monotonically_increasing_id().alias("i"))).write.parquet(path)
        rows = df.sparkSession.read.parquet(path)
    for columns in unique:
        label = "_".join(columns)
        stored = parents[name].dropna(subset=columns).select(*columns).distinct().withColumn(f"_stored_{label}", F.lit(True))
        # Partly aggregated before the shuffle, so a key with very many rows sends one per partition.
        firsts = rows.dropna(subset=columns).groupBy(*columns).agg(F.min("_row").alias(f"_first_{label}"))
        rows = rows.join(stored, columns, "left").join(firsts, columns, "left")
        later = F.coalesce(F.col("_row") != F.col(f"_first_{label}"), F.lit(False))
        rules[f"unique_{label}"] = F.col(f"_stored_{label}").isNotNull() | later
    broken = F.array_compact(F.array(*[F.when(condition, rule) for rule, condition in rules.items()])) if rules else F.array().cast("array<string>")
    rows = rows.select(*fields, broken.alias(RULES)).withColumn(GOOD, F.size(RULES) == 0)
    observation = Observation()
    counted = [F.count("*").alias("rows"), F.count_if(GOOD).alias("good"), *[F.count_if(F.array_contains(RULES, rule)).alias(rule) for rule in rules]]
    folder = f"{root.rstrip('/')}/{name}"
    rows.observe(observation, *counted).write.partitionBy(GOOD).parquet(folder)
    return Written(df.sparkSession, folder, name, dict(observation.get))
