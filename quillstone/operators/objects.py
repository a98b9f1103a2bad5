"""Objects over tables: a typed query builder, links between object types, and changes to objects.

Every step only builds a DataFrame, so Catalyst pushes filters and columns to the scan and plans the joins.
Choices where engines differ: LIKE is case-sensitive (use ILIKE), nulls come first in ascending order, an unknown
operator raises, OFFSET works without LIMIT.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPERATORS = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(*v) if len(v) else F.lit(False),
    "$nin": lambda c, v: ~c.isin(*v) if len(v) else F.lit(True),
    "$like": lambda c, v: c.like(v),
    "$ilike": lambda c, v: c.ilike(v),
    "$null": lambda c, v: c.isNull() if v in (None, True) else c.isNotNull(),
    "$notnull": lambda c, v: c.isNotNull(),
    "$between": lambda c, v: c.between(v[0], v[1]),
}


def predicate(column: str, operator: str, value: object) -> Column:
    name = operator if operator.startswith("$") else "$" + operator.lower().replace(" ", "")
    if name not in OPERATORS:
        raise ValueError(f"no operator {operator}; there are {sorted(OPERATORS)}")
    return OPERATORS[name](F.col(column), value)


@dataclass(frozen=True)
class Link:
    """source.column = target.column; many rows of source to one of target."""

    name: str
    source: str
    column: str
    target: str
    target_column: str


@dataclass(frozen=True)
class ObjectQuery:
    """An immutable query over one object type."""

    types: ObjectTypes
    type_id: str
    df: DataFrame
    order: tuple = ()
    count_limit: int | None = None
    skip: int = 0
    columns: tuple[str, ...] = ()
    links: tuple[str, ...] = ()

    def select(self, *columns: str) -> ObjectQuery:
        return replace(self, columns=columns)

    def filter(self, conditions: Mapping | Column | list) -> ObjectQuery:
        """A mapping of column to value or {operator: value}, a condition, or a list of either; all must hold."""
        if isinstance(conditions, Column):
            return replace(self, df=self.df.where(conditions))
        if isinstance(conditions, list):
            return reduce(lambda q, c: q.filter(c), conditions, self)
        tests = []
        for column, value in conditions.items():
            pairs = value.items() if isinstance(value, Mapping) else [("$eq", value)]
            tests += [predicate(column, op, v) for op, v in pairs]
        return replace(self, df=self.df.where(reduce(lambda a, b: a & b, tests))) if tests else self

    def where(self, column: str, operator: str, value: object = None) -> ObjectQuery:
        return replace(self, df=self.df.where(predicate(column, operator, value)))

    def order_by(self, column: str, desc: bool = False) -> ObjectQuery:
        return replace(self, order=(*self.order, F.col(column).desc_nulls_last() if desc else F.col(column).asc_nulls_first()))

    def limit(self, n: int) -> ObjectQuery:
        return replace(self, count_limit=n)

    def offset(self, n: int) -> ObjectQuery:
        return replace(self, skip=n)

    def page(self, number: int, size: int = 100) -> ObjectQuery:
        if number < 1:
            raise ValueError("pages are counted from 1")
        return self.offset((number - 1) * size).limit(size)

    def include(self, *names: str) -> ObjectQuery:
        return replace(self, links=(*self.links, *names))

    def execute(self) -> DataFrame:
        df = self.df.orderBy(*self.order) if self.order else self.df
        df = df.offset(self.skip) if self.skip else df
        df = df.limit(self.count_limit) if self.count_limit is not None else df
        for name in self.links:
            df = self.types.attach(df, self.type_id, name)
        if self.order and self.links:
            df = df.orderBy(*self.order)
        return df.select(*self.columns, *self.links) if self.columns else df

    def count(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("n"))

    def exists(self) -> bool:
        return not self.df.limit(1).isEmpty()

    def first(self) -> DataFrame:
        return self.limit(1).execute()

    def to_json(self) -> DataFrame:
        return self.execute().select(F.to_json(F.struct("*")).alias("value"))


@dataclass
class ObjectTypes:
    """Object types (a table and its key) and the links between them."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    keys: dict[str, str] = field(default_factory=dict)
    links: dict[tuple[str, str], Link] = field(default_factory=dict)

    def add_type(self, type_id: str, df: DataFrame, key: str) -> ObjectTypes:
        self.tables[type_id], self.keys[type_id] = df, key
        return self

    def add_link(self, link: Link) -> ObjectTypes:
        for side in (link.source, link.target):
            if side not in self.tables:
                raise KeyError(f"no object type {side}")
        self.links[link.source, link.name] = link
        return self

    def query(self, type_id: str) -> ObjectQuery:
        return ObjectQuery(self, type_id, self.tables[type_id])

    def get_by_id(self, type_id: str, value: object) -> DataFrame:
        return self.tables[type_id].where(F.col(self.keys[type_id]) == value).limit(1)

    def outgoing(self, rows: DataFrame, type_id: str, name: str) -> DataFrame:
        """The objects that rows point to, one for each row that points to one; columns of both."""
        link = self.links[type_id, name]
        return rows.join(self.tables[link.target], F.col(link.column) == F.col(link.target_column))

    def incoming(self, rows: DataFrame, link: Link) -> DataFrame:
        """Target rows with the number of source objects that point to them and these as a sorted list of keys."""
        key = self.keys[link.source]
        grouped = self.tables[link.source].groupBy(F.col(link.column).alias("_to")).agg(F.array_sort(F.collect_list(key)).alias("linked"))
        return rows.join(grouped, F.col(link.target_column) == F.col("_to"), "left").drop("_to").withColumn("n_linked", F.when(F.col("linked").isNull(), 0).otherwise(F.size("linked")).cast("long"))

    def attach(self, rows: DataFrame, type_id: str, name: str) -> DataFrame:
        """rows with a struct column of the linked object, null where there is none."""
        link = self.links[type_id, name]
        target = self.tables[link.target]
        packed = target.select(F.col(link.target_column).alias("_key"), F.struct(*target.columns).alias(name))
        return rows.join(packed, F.col(link.column) == F.col("_key"), "left").drop("_key")

    def derive(self, type_id: str, link: Link, name: str, aggregate: Column) -> DataFrame:
        """The type's table with a property computed over the objects that link to it, as in SUM(orders.amount)."""
        found = self.tables[link.source].groupBy(F.col(link.column).alias("_to")).agg(aggregate.alias(name))
        return self.tables[type_id].join(found, F.col(link.target_column) == F.col("_to"), "left").drop("_to")

    # Changes return the table as it would be; nothing is written until the result is.

    def create(self, type_id: str, rows: DataFrame) -> DataFrame:
        key = self.keys[type_id]
        fresh = rows.join(self.tables[type_id].select(key), key, "left_anti")
        return self.tables[type_id].unionByName(fresh, allowMissingColumns=True)

    def update(self, type_id: str, condition: Column, values: Mapping[str, Column]) -> DataFrame:
        return self.tables[type_id].withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})

    def delete(self, type_id: str, condition: Column) -> DataFrame:
        return self.tables[type_id].where(~F.coalesce(condition, F.lit(False)))


def equality_filter(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Null-safe equality on every column."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]).eqNullSafe(F.lit(kv[1]))), filters.items(), df)
