"""Tables that can be changed: each statement writes a new version in Parquet, and readers keep the one they opened."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import storage


@dataclass
class Rules:
    """Constraints and defaults by column; ``identity`` numbers rows from 1, ``computed`` holds SQL of other columns."""

    primary_key: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    default: dict[str, str] = field(default_factory=dict)
    computed: dict[str, str] = field(default_factory=dict)
    identity: str | None = None


class Table:
    """Rows under ``path/v<N>``; the largest N that has been committed is the table."""

    def __init__(self, spark: SparkSession, path: str, schema, rules: Rules | None = None):
        self.spark, self.path, self.schema, self.rules, self.version = spark, path.rstrip("/"), schema, rules or Rules(), -1

    @classmethod
    def create(cls, spark: SparkSession, path: str, df: DataFrame, rules: Rules | None = None) -> "Table":
        t = cls(spark, path, df.schema, rules)
        t._commit(t._filled(df, 0))
        return t

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{self.version}")

    def _commit(self, df: DataFrame) -> None:
        df = df.select(*[F.col(f"`{c.name}`").cast(c.dataType).alias(c.name) for c in self.schema])
        to = f"{self.path}/v{self.version + 1}"
        df.write.mode("overwrite").parquet(to)
        written = self.spark.read.schema(self.schema).parquet(to)
        self._check(written)
        self.version += 1

    def _check(self, df: DataFrame) -> None:
        """Constraints hold for the whole new version, or it isn't committed."""
        needed = {*self.rules.not_null, *self.rules.primary_key}
        if needed and df.where(" OR ".join(f"`{c}` IS NULL" for c in sorted(needed))).take(1):
            raise ValueError("a null in a column that forbids it")
        if self.rules.primary_key and df.groupBy(*self.rules.primary_key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
            raise ValueError("a primary key occurs twice")

    def _filled(self, df: DataFrame, last: int) -> DataFrame:
        for c in self.schema:
            if c.name not in df.columns:
                value = F.expr(self.rules.default[c.name]) if c.name in self.rules.default else F.lit(None)
                df = df.withColumn(c.name, value.cast(c.dataType))
        if self.rules.identity:
            key = self.rules.identity
            df = storage.stored(df.withColumn("__i", F.monotonically_increasing_id()), "identity")
            # dense numbers: rows of each partition are numbered after the counts of those before
            parts = df.groupBy(F.shiftright("__i", 33).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("low")).orderBy("p").collect()
            at, firsts = last, []
            for r in parts:
                firsts.append((r["p"], at + 1))
                at += r["n"]
            starts = F.broadcast(self.spark.createDataFrame(firsts, "__p long, __first long"))  # one row per partition
            local = F.col("__i") - F.shiftleft(F.col("__p"), 33)
            df = df.withColumn("__p", F.shiftright("__i", 33)).join(starts, "__p").withColumn(key, F.coalesce(F.col(key), F.col("__first") + local)).drop("__i", "__p", "__first")
        for k, text in self.rules.computed.items():
            df = df.withColumn(k, F.expr(text))
        return df

    def insert(self, df: DataFrame) -> DataFrame:
        """Append rows; returns them as they were stored (RETURNING)."""
        last = self.read().agg(F.max(self.rules.identity)).first()[0] or 0 if self.rules.identity else 0
        new = storage.stored(self._filled(df, last).select(*self.schema.names), "insert")
        self._commit(self.read().unionByName(new))
        return new

    def update(self, where: str, **changes: Column | str) -> DataFrame:
        """Set columns of the rows where the predicate holds; returns them after the change."""
        hit = F.coalesce(F.expr(where), F.lit(False))
        values = {k: v if isinstance(v, Column) else F.expr(str(v)) for k, v in changes.items()}
        rows = self.read().withColumn("__hit", hit)
        rows = rows.withColumns({k: F.when(F.col("__hit"), v).otherwise(F.col(k)).cast(self.schema[k].dataType) for k, v in values.items()})
        for k, text in self.rules.computed.items():
            rows = rows.withColumn(k, F.expr(text))
        rows = storage.stored(rows, "update")
        self._commit(rows.drop("__hit"))
        return rows.where("__hit").drop("__hit")

    def update_from(self, source: DataFrame, key: str, **changes: str) -> DataFrame:
        """UPDATE ... FROM by an equal key; of several matches the one with the largest values holds."""
        names = {k: f"__{k}" for k in changes}
        best = source.groupBy(key).agg(F.max(F.struct(*[F.expr(v).alias(names[k]) for k, v in changes.items()])).alias("__new"), F.lit(True).alias("__hit"))
        rows = self.read().join(best, key, "left")
        rows = rows.withColumns({k: F.when(F.col("__hit"), F.col(f"__new.{names[k]}")).otherwise(F.col(k)).cast(self.schema[k].dataType) for k in changes})
        rows = storage.stored(rows.withColumn("__hit", F.coalesce("__hit", F.lit(False))).drop("__new"), "update")
        self._commit(rows.drop("__hit"))
        return rows.where("__hit").drop("__hit").select(*self.schema.names)

    def delete(self, where: str) -> DataFrame:
        """Remove the rows where the predicate holds; returns them as they were."""
        hit = F.coalesce(F.expr(where), F.lit(False))
        old = self.read()
        self._commit(old.where(~hit))
        return old.where(hit)

    def add_column(self, name: str, kind: str, default: str | None = None, computed: str | None = None) -> None:
        rows = self.read().withColumn(name, F.expr(computed or default or "NULL").cast(kind))
        if computed:
            self.rules.computed[name] = computed
        elif default:
            self.rules.default[name] = default
        self.schema = rows.schema
        self._commit(rows)

    def drop_column(self, name: str) -> None:
        if any(name in (k, *json.dumps(v).replace('"', " ").split()) for k, v in self.rules.computed.items() if k != name):
            raise ValueError(f"a computed column uses {name}")
        rows = self.read().drop(name)
        self.rules.computed.pop(name, None)
        self.rules.default.pop(name, None)
        self.schema = rows.schema
        self._commit(rows)

    def drop(self) -> None:
        files, p = storage.hadoop(self.spark, self.path)
        files.delete(p, True)
