"""Declarative reads over related tables: filters, nested selects, paging, grouping.

A read is a nested dict; it becomes one DataFrame plan. Relation filters at the top level are semi and anti joins, inside OR and
NOT they are existence flags, so Catalyst sees joins and pushes the scalar parts to the scans. Null and sort rules are
those of SQL and of Postgres: comparisons drop nulls, ascending order puts nulls last and descending order first.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class UnsupportedQuery(ValueError):
    """Raised for what cannot be answered exactly."""


#: Stands for a condition that was not given; None means IS NULL.
UNSET = object()


@dataclass(frozen=True)
class Relation:
    target: str
    many: bool
    local: str
    foreign: str


@dataclass
class Model:
    name: str
    rows: DataFrame
    key: list[str]
    relations: dict[str, Relation] = field(default_factory=dict)
    private: bool = False


class Catalog:
    def __init__(self, *models: Model):
        self.models = {m.name: m for m in models}

    def __getitem__(self, name: str) -> Model:
        if name not in self.models or self.models[name].private:
            raise UnsupportedQuery(f"no public table {name}")
        return self.models[name]


def _scalar(col: Column, cond, kind: str) -> Column:
    """The condition on one column; every comparison is null, hence false in a filter, for a null value."""
    if cond is None:
        return col.isNull()
    if not isinstance(cond, dict):
        _same_kind(kind, cond)
        return col == cond
    mode = cond.get("mode", "default")
    if mode not in ("default", "insensitive"):
        raise UnsupportedQuery(f"unknown mode {mode!r}")
    fold = mode == "insensitive"
    if fold:
        col = F.lower(col)

    def lit(x):
        _same_kind(kind, x)
        return F.lit(x.lower() if fold and isinstance(x, str) else x)

    parts = []
    for op, value in cond.items():
        if op == "mode" or value is UNSET:
            continue
        if op == "equals":
            parts.append(col.isNull() if value is None else col == lit(value))
        elif op == "not":
            if value is None:
                parts.append(col.isNotNull())
            elif isinstance(value, dict):
                parts.append(~_scalar(col, {"mode": mode, **value}, kind) & col.isNotNull())
            else:
                parts.append(col != lit(value))
        elif op == "in":
            parts.append(col.isin([lit(v) for v in value]) if value else F.lit(False))
        elif op == "notIn":
            parts.append(~col.isin([lit(v) for v in value]) if value else col.isNotNull())
        elif op in ("lt", "lte", "gt", "gte"):
            v = lit(value)
            parts.append({"lt": col < v, "lte": col <= v, "gt": col > v, "gte": col >= v}[op])
        elif op in ("contains", "startsWith", "endsWith"):
            # the needle is literal: no LIKE wildcards
            parts.append({"contains": col.contains, "startsWith": col.startswith, "endsWith": col.endswith}[op](lit(value)))
        elif op == "has":
            parts.append(F.array_contains(col, value))
        else:
            raise UnsupportedQuery(f"unknown operator {op}")
    return reduce(Column.__and__, parts, F.lit(True))


def _same_kind(kind: str, value) -> None:
    """Numbers, texts and booleans are never compared with one another."""
    number = kind in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.startswith("decimal")
    ok = {bool: kind == "boolean", int: number, float: number, str: kind in ("string", "date", "timestamp", "timestamp_ntz")}
    if not ok.get(type(value), True):
        raise UnsupportedQuery(f"cannot compare {kind} with {value!r}")


class Read:
    def __init__(self, catalog: Catalog):
        self.catalog, self.flags = catalog, 0

    def _related(self, model: Model, name: str) -> tuple[Relation, Model]:
        rel = model.relations[name]
        return rel, self.catalog[rel.target]

    def _keys(self, rel: Relation, target: Model, where, negate: bool = False) -> DataFrame:
        """Keys of related rows that satisfy `where`, or with negate those that do not (null counts as not)."""
        df, cond = self._condition(target.rows, target, where or {})
        cond = ~F.coalesce(cond, F.lit(False)) if negate else cond
        return df.where(cond).select(F.col(rel.foreign).alias("__k")).where("__k is not null").distinct()

    def _flag(self, df: DataFrame, rel: Relation, keys: DataFrame) -> tuple[DataFrame, Column]:
        self.flags += 1
        name = f"__f{self.flags}"
        marked = keys.withColumnRenamed("__k", name + "k").withColumn(name, F.lit(True))
        df = df.join(marked, F.col(rel.local) == F.col(name + "k"), "left").drop(name + "k")
        return df, F.coalesce(F.col(name), F.lit(False))

    def _relation(self, df: DataFrame, model: Model, name: str, cond) -> tuple[DataFrame, Column]:
        rel, target = self._related(model, name)
        if rel.many:
            out = F.lit(True)
            for mode, where in cond.items():
                if mode not in ("some", "none", "every"):
                    raise UnsupportedQuery(f"unknown relation filter {mode}")
                df, hit = self._flag(df, rel, self._keys(rel, target, where, negate=mode == "every"))
                out = out & (hit if mode == "some" else ~hit)
            return df, out
        where, negate = (cond["isNot"], True) if isinstance(cond, dict) and "isNot" in cond else (cond.get("is", cond) if isinstance(cond, dict) else cond, False)
        df, hit = self._flag(df, rel, self._keys(rel, target, where))
        if where is None:
            hit = ~hit
        return df, ~hit if negate else hit

    def _condition(self, df: DataFrame, model: Model, where: dict) -> tuple[DataFrame, Column]:
        kinds, out = dict(model.rows.dtypes), F.lit(True)
        for name, cond in where.items():
            if cond is UNSET:
                continue
            if name in ("AND", "OR", "NOT"):
                each = []
                for part in cond if isinstance(cond, list) else [cond]:
                    df, c = self._condition(df, model, part)
                    each.append(c)
                if name == "AND":
                    out = out & reduce(Column.__and__, each, F.lit(True))
                elif name == "OR":
                    out = out & reduce(Column.__or__, each, F.lit(False))
                else:
                    out = out & reduce(Column.__and__, [~c for c in each], F.lit(True))
            elif name in model.relations:
                df, c = self._relation(df, model, name, cond)
                out = out & c
            elif name in kinds:
                out = out & _scalar(F.col(name), cond, kinds[name])
            elif name == "_".join(model.key) and isinstance(cond, dict):
                df, c = self._condition(df, model, cond)
                out = out & c
            else:
                raise UnsupportedQuery(f"unknown field {name}")
        return df, out

    def filtered(self, model: Model, where: dict | None) -> DataFrame:
        """Rows that satisfy `where`. Top-level relation filters are semi or anti joins."""
        df, rest = model.rows, {}
        for name, cond in (where or {}).items():
            if name in model.relations and model.relations[name].many and isinstance(cond, dict) and set(cond) <= {"some", "none", "every"}:
                rel, target = self._related(model, name)
                for mode, inner in cond.items():
                    keys = self._keys(rel, target, inner, negate=mode == "every")
                    df = df.join(keys, F.col(rel.local) == F.col("__k"), "left_semi" if mode == "some" else "left_anti")
            else:
                rest[name] = cond
        df, cond = self._condition(df, model, rest)
        return df.where(cond).select(model.rows.columns)

    def _order(self, df: DataFrame, model: Model, order_by) -> tuple[DataFrame, list[Column]]:
        out, used = [], set()
        for entry in order_by if isinstance(order_by, list) else [order_by] if order_by else []:
            for name, way in entry.items():
                if name in model.relations:
                    rel, target = self._related(model, name)
                    if rel.many:
                        raise UnsupportedQuery("order by a to-many relation")
                    ((inner, way),) = way.items()
                    self.flags += 1
                    tag = f"__o{self.flags}"
                    other = target.rows.select(F.col(rel.foreign).alias(tag + "k"), F.col(inner).alias(tag))
                    df = df.join(other, F.col(rel.local) == F.col(tag + "k"), "left").drop(tag + "k")
                    col = F.col(tag)
                else:
                    used.add(name)
                    col = F.col(name)
                way = way if isinstance(way, dict) else {"sort": way}
                down = way["sort"] == "desc"
                first = way.get("nulls", "first" if down else "last") == "first"
                out.append((col.desc_nulls_first() if first else col.desc_nulls_last()) if down else (col.asc_nulls_first() if first else col.asc_nulls_last()))
        # the key breaks the ties that are left
        return df, out + [F.col(k).asc_nulls_last() for k in model.key if k not in used]

    def _ranked(self, df: DataFrame, order: list[Column], by: list[str], distinct, skip: int, take: int | None, rank: str) -> DataFrame:
        """Within each `by`: one row for each `distinct`, numbered from 1 in order, then skip and take."""
        if distinct:
            names = [distinct] if isinstance(distinct, str) else list(distinct)
            df = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by, *names).orderBy(*order))).where(F.col(rank) == 1)
        df = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        return df.where((F.col(rank) > skip) & (F.col(rank) <= skip + take if take is not None else F.lit(True)))

    def _project(self, df: DataFrame, model: Model, select: dict | None, include: dict | None) -> tuple[DataFrame, list[Column]]:
        scalars = [c for c in model.rows.columns if not select or select.get(c)]
        out = [F.col(c) for c in scalars]
        for name, spec in {**(select or {}), **(include or {})}.items():
            if name == "_count":
                for rel_name, inner in spec.get("select", spec).items():
                    rel, target = self._related(model, rel_name)
                    rows = self.filtered(target, inner.get("where") if isinstance(inner, dict) else None)
                    self.flags += 1
                    tag = f"__c{self.flags}"
                    counts = rows.groupBy(F.col(rel.foreign).alias(tag + "k")).agg(F.count("*").alias(tag))
                    df = df.join(counts, F.col(rel.local) == F.col(tag + "k"), "left").drop(tag + "k")
                    out.append(F.coalesce(F.col(tag), F.lit(0)).alias(f"{rel_name}_count"))
            elif name in model.relations and spec:
                spec = spec if isinstance(spec, dict) else {}
                rel, target = self._related(model, name)
                rows = self.filtered(target, spec.get("where"))
                rows, order = self._order(rows, target, spec.get("orderBy"))
                skip, take = spec.get("skip", 0), spec.get("take")
                _paging(skip, take)
                self.flags += 1
                tag = f"__n{self.flags}"
                if rel.many:
                    rows = self._ranked(rows, order, [rel.foreign], spec.get("distinct"), skip, take, tag + "r")
                rows, inner = self._project(rows, target, spec.get("select"), spec.get("include"))
                if rel.many:
                    lists = rows.select(F.col(rel.foreign).alias(tag + "k"), F.struct(F.col(tag + "r"), F.struct(*inner).alias("v")).alias("s")).groupBy(tag + "k").agg(F.sort_array(F.collect_list("s")).alias(tag))
                    df = df.join(lists, F.col(rel.local) == F.col(tag + "k"), "left").drop(tag + "k")
                    kind = lists.schema[tag].dataType.elementType["v"].dataType
                    out.append(F.coalesce(F.transform(F.col(tag), lambda s: s["v"]), F.array().cast(f"array<{kind.simpleString()}>")).alias(name))
                else:
                    one = rows.select(F.col(rel.foreign).alias(tag + "k"), F.struct(*inner).alias(tag))
                    df = df.join(one, F.col(rel.local) == F.col(tag + "k"), "left").drop(tag + "k")
                    out.append(F.col(tag).alias(name))
            elif name not in model.rows.columns and spec:
                raise UnsupportedQuery(f"unknown field {name}")
        return df, out

    def find_many(self, model: str, where=None, select=None, include=None, order_by=None, distinct=None, skip: int = 0, take: int | None = None, **other) -> DataFrame:
        if other:
            raise UnsupportedQuery(f"unknown arguments {sorted(other)}")
        _paging(skip, take)
        m = self.catalog[model]
        df, order = self._order(self.filtered(m, where), m, order_by)
        if distinct:
            names = [distinct] if isinstance(distinct, str) else list(distinct)
            df = df.withColumn("__d", F.row_number().over(Window.partitionBy(*names).orderBy(*order))).where("__d = 1").drop("__d")
        if take is None:
            df, out = self._project(df, m, select, include)
            df = df.orderBy(*order) if order_by or skip else df
            return (df.offset(skip) if skip else df).select(*out)
        # The joins of the projection keep no order, and a second sort by the same columns is dropped by adaptive execution, which takes
        # the page's order for the join's. So the rows of the page, one sorted partition, are numbered, and sorted by that at the end.
        page = df.orderBy(*order).offset(skip).limit(take).withColumn("__at", F.monotonically_increasing_id())
        df, out = self._project(page, m, select, include)
        return df.orderBy("__at").select(*out)

    def find_unique(self, model: str, where: dict, **args) -> DataFrame:
        return self.find_many(model, where, take=1, **args)

    def count(self, model: str, where=None) -> DataFrame:
        return self.filtered(self.catalog[model], where).agg(F.count("*").alias("count"))

    def _measures(self, measures: dict) -> list[Column]:
        out = []
        for kind, fields in measures.items():
            make = {"_min": F.min, "_max": F.max, "_sum": F.sum, "_avg": F.avg, "_count": F.count}.get(kind)
            if make is None:
                raise UnsupportedQuery(f"unknown aggregate {kind}")
            for f in ["_all"] if fields is True else fields:
                out.append(F.count("*").alias("count_all") if f == "_all" else make(f).alias(f"{kind[1:]}_{f}"))
        return out

    def aggregate(self, model: str, measures: dict, where=None, order_by=None, skip: int = 0, take: int | None = None) -> DataFrame:
        """Aggregates over the page that where, order, skip and take leave. Nulls are passed over; no rows give null, and 0 for counts."""
        return (self.find_many(model, where, order_by=order_by, skip=skip, take=take) if skip or take is not None else self.filtered(self.catalog[model], where)).agg(*self._measures(measures))

    def group_by(self, model: str, by: list[str], measures: dict, where=None, having: Column | None = None, order_by=None, skip: int = 0, take: int | None = None) -> DataFrame:
        """Grouped aggregates; null is a group. order_by names keys or measures, as in the result."""
        _paging(skip, take)
        df = self.filtered(self.catalog[model], where).groupBy(*by).agg(*self._measures(measures))
        df = df.where(having) if having is not None else df
        if order_by or skip or take is not None:
            result = Model("", df, by)
            df = df.orderBy(*self._order(df, result, order_by)[1])
            df = df.offset(skip) if skip else df
            df = df.limit(take) if take is not None else df
        return df


def _paging(skip, take) -> None:
    if skip < 0 or (take is not None and take < 0):
        raise UnsupportedQuery("negative paging")
