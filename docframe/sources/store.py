"""Tables as copy-on-write parquet snapshots, with constraints, DML, views and transactions.

A table's state is a pointer to a snapshot folder.  A statement builds the whole
next snapshot declaratively, validates it, writes it once and then moves the
pointer, so that a failed statement changes nothing.  A transaction is a saved
map of pointers.  Validation is by aggregates over the candidate snapshot.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.operators.relational import rownum


class ConstraintError(ValueError):
    """A statement would leave a table invalid."""


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str
    on_delete: str = "restrict"
    on_update: str = "restrict"


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    where: str | None = None
    path: str | None = None


@dataclass(frozen=True)
class Trigger:
    """``action(event, old, new)`` gets the changed rows as DataFrames; it may raise, or change other tables."""

    name: str
    event: str
    timing: str
    action: Callable
    columns: tuple[str, ...] = ()
    when: str | None = None


@dataclass(frozen=True)
class Table:
    schema: T.StructType
    path: str | None = None
    primary_key: str | None = None
    unique: tuple[tuple[str, ...], ...] = ()
    not_null: tuple[str, ...] = ()
    checks: tuple[str, ...] = ()
    defaults: dict = field(default_factory=dict)
    autoincrement: str | None = None
    auto_guid: str | None = None
    foreign_keys: tuple[ForeignKey, ...] = ()
    indexes: tuple[Index, ...] = ()
    triggers: tuple[Trigger, ...] = ()


MAX_CASCADE = 32


class Database:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.tables: dict[str, Table] = {}
        self.views: dict[str, Callable[[], DataFrame]] = {}
        self.view_sql: dict[str, str] = {}
        self.materialized: dict[str, Callable[[], DataFrame]] = {}
        self._saved: list[tuple[str | None, dict[str, Table]]] = []
        self._depth = 0

    # Reading.
    def read(self, name: str) -> DataFrame:
        if name in self.views:
            return self.views[name]()
        t = self.tables[name]
        return self.spark.createDataFrame([], t.schema) if t.path is None else self.spark.read.schema(t.schema).parquet(t.path)

    def register(self) -> None:
        """Make all tables and views temp views, for spark.sql."""
        for name in [*self.tables, *self.views]:
            self.read(name).createOrReplaceTempView(name)

    def sql(self, text: str, args: dict | None = None) -> DataFrame:
        self.register()
        return self.spark.sql(text, args=args or {})

    # Definitions.
    def create_table(self, name: str, schema: str | T.StructType, **options) -> None:
        if name in self.tables or name in self.views:
            raise ValueError(f"{name} exists")
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        if len(set(schema.names)) < len(schema.names):
            raise ValueError("duplicate columns")
        self.tables[name] = Table(T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]), **options)

    def create_table_as(self, name: str, df: DataFrame, **options) -> int:
        self.create_table(name, df.schema, **options)
        return self._store({name: df})

    def drop_table(self, name: str, cascade: bool = False) -> None:
        children = [c for c, t in self.tables.items() if c != name and any(f.parent == name for f in t.foreign_keys)]
        if children and not cascade:
            raise ConstraintError(f"{name} is referenced by {children}")
        for c in children:
            self.tables[c] = replace(self.tables[c], foreign_keys=tuple(f for f in self.tables[c].foreign_keys if f.parent != name))
        del self.tables[name]

    def truncate(self, name: str, cascade: bool = False) -> None:
        children = [c for c, t in self.tables.items() if any(f.parent == name for f in t.foreign_keys)]
        if children and not cascade:
            raise ConstraintError(f"{name} is referenced by {children}")
        for t in [name, *[c for c in children if c != name]]:
            self.tables[t] = replace(self.tables[t], path=None)

    def rename_table(self, old: str, new: str) -> None:
        self.tables[new] = self.tables.pop(old)
        for c, t in self.tables.items():
            self.tables[c] = replace(t, foreign_keys=tuple(replace(f, parent=new) if f.parent == old else f for f in t.foreign_keys))

    def add_column(self, name: str, column: str, kind: str, default=None, not_null: bool = False) -> None:
        if not_null and default is None:
            raise ValueError("NOT NULL needs a default")
        t, df = self.tables[name], self.read(name)
        wide = df.withColumn(column, F.lit(default).cast(kind))
        self.tables[name] = replace(t, schema=T.StructType([*t.schema, T.StructField(column, wide.schema[column].dataType)]), defaults=t.defaults | ({column: default} if default is not None else {}), not_null=(*t.not_null, column) if not_null else t.not_null)
        if t.path is not None:
            self._store({name: wide}, check=False)

    def drop_column(self, name: str, column: str) -> None:
        t = self.tables[name]
        used = column == t.primary_key or any(column in c for c in t.checks) or any(f.column == column for f in t.foreign_keys) or any(column in i.columns or column in (i.where or "") for i in t.indexes)
        if used:
            raise ConstraintError(f"{column} is in use")
        df = self.read(name).drop(column)
        self.tables[name] = replace(t, schema=df.schema)
        if t.path is not None:
            self._store({name: df}, check=False)

    def rename_column(self, name: str, old: str, new: str) -> None:
        t = self.tables[name]
        if new in t.schema.names:
            raise ValueError(f"{new} exists")
        df = self.read(name).withColumnRenamed(old, new)
        sub = lambda xs: tuple(new if x == old else x for x in xs)
        self.tables[name] = replace(t, schema=df.schema, primary_key=new if t.primary_key == old else t.primary_key, not_null=sub(t.not_null), unique=tuple(map(sub, t.unique)))
        if t.path is not None:
            self._store({name: df}, check=False)

    def create_index(self, table: str, index: Index) -> None:
        t = replace(self.tables[table], indexes=(*self.tables[table].indexes, index))
        self._check(table, t, self.read(table))
        self.tables[table] = t

    def create_trigger(self, table: str, trigger: Trigger) -> None:
        self.tables[table] = replace(self.tables[table], triggers=(*self.tables[table].triggers, trigger))

    def create_view(self, name: str, body: Callable[[], DataFrame], sql: str = "", replace_: bool = False) -> None:
        if name in self.tables or name in self.views and not replace_:
            raise ValueError(f"{name} exists")
        body()  # must be valid now
        self.views[name], self.view_sql[name] = body, sql

    def drop_view(self, name: str) -> None:
        del self.views[name], self.view_sql[name]

    def create_materialized_view(self, name: str, body: Callable[[], DataFrame]) -> None:
        df = body()
        if not _deterministic(df):
            raise ValueError("a materialized view must be deterministic")
        self.materialized[name] = body
        self.create_table_as(name, df)

    def refresh(self, name: str) -> int:
        return self._store({name: self.materialized[name]()}, views=True)

    # Changes.
    def insert(self, name: str, rows: DataFrame, on_conflict: str = "error", target: tuple[str, ...] | None = None, update: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
        """Insert rows given in order; returns what was inserted.

        ``on_conflict`` is error, ignore, replace or update.  For update, ``update``
        and ``where`` refer to the old row as ``old`` and to the candidate as ``new``;
        a key that comes more than once in a batch is refused.
        """
        t, old = self.tables[name], self.read(name)
        new = self._filled(t, old, rows)
        keys = [k for k in [(t.primary_key,) if t.primary_key else None, *t.unique, *[i.columns for i in t.indexes if i.unique and not i.where]] if k]
        keys = [target] if target else keys
        new = self._kept(new.withColumn("_pos", F.monotonically_increasing_id()), f"candidates-{name}")
        self._fire(name, "insert", "before", None, new.drop("_pos"))
        if on_conflict == "error" or not keys:
            fresh, rest, gone = new, old, None
        elif on_conflict == "ignore":
            fresh = new
            for k in keys:
                fresh = fresh.join(old.select(*k), list(k), "left_anti")
                fresh = _first(fresh, k, F.col("_pos").asc())
            rest, gone = old, None
        elif on_conflict == "replace":
            fresh = reduce(lambda df, k: _first(df, k, F.col("_pos").desc()), keys, new)
            rest = reduce(lambda df, k: df.join(fresh.select(*k), list(k), "left_anti"), keys, old)
            gone = old.exceptAll(rest)
        elif on_conflict == "update":
            if len(keys) != 1:
                raise ValueError("DO UPDATE needs a target")
            k = keys[0]
            if new.where(_no_null(k)).groupBy(*k).count().where("count > 1").limit(1).count():
                raise ConstraintError("a key is updated twice in one statement")
            o, n = old.alias("old"), new.alias("new")
            pair = reduce(lambda a, b: a & b, [F.col(f"old.{c}") == F.col(f"new.{c}") for c in k])
            hit = F.col("new._pos").isNotNull() & (where if where is not None else F.lit(True))
            hit = F.coalesce(hit, F.lit(False))
            rest = o.join(n, pair, "left").select(*[(F.when(hit, (update or {})[c]).otherwise(F.col(f"old.{c}")) if c in (update or {}) else F.col(f"old.{c}")).cast(t.schema[c].dataType).alias(c) for c in t.schema.names])
            fresh, gone = new.join(old.select(*k), list(k), "left_anti"), None
        else:
            raise ValueError(on_conflict)
        added = fresh.select(*t.schema.names)
        self._store({name: rest.select(*t.schema.names).unionByName(added)}, lost={name: gone} if gone is not None else None)
        self._fire(name, "insert", "after", None, added)
        return added

    def update(self, name: str, sets: dict[str, Column], where: Column | None = None, source: DataFrame | None = None, order: list[Column] | None = None) -> DataFrame:
        """Set columns from the rows before the update; of several source matches the first by ``order`` counts.

        Columns of the target are ``t``'s where a source (``s``) is given.  Returns the rows after the update.
        """
        t, old = self.tables[name], self.read(name)
        hit = F.coalesce(where if where is not None else F.lit(True), F.lit(False))
        names = t.schema.names
        if source is None:
            after = old.select(*[(F.when(hit, sets[c]).otherwise(F.col(c)) if c in sets else F.col(c)).cast(t.schema[c].dataType).alias(c) for c in names], hit.alias("_hit"), F.struct(*names).alias("_old"))
        else:
            marked = self._kept(old.withColumn("_rid", F.monotonically_increasing_id()), f"numbered-{name}")
            s = source.select(F.struct(*source.columns).alias("_s"))
            pairs = marked.alias("t").join(source.alias("s"), hit).select("t._rid", *[sets[c].alias(f"_set_{c}") for c in sets], *[o.alias(f"_o{i}") for i, o in enumerate(order or [])])
            del s
            one = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("_rid").orderBy(*[f"_o{i}" for i in range(len(order or []))] or [f"_set_{c}" for c in sets]))).where("_n = 1")
            after = marked.join(one.withColumn("_m", F.lit(True)), "_rid", "left").select(*[(F.when(F.col("_m"), F.col(f"_set_{c}")).otherwise(F.col(c)) if c in sets else F.col(c)).cast(t.schema[c].dataType).alias(c) for c in names], F.coalesce("_m", F.lit(False)).alias("_hit"), F.struct(*names).alias("_old"))
        after = self._kept(after, f"after-{name}")
        changed = after.where("_hit")
        self._fire(name, "update", "before", changed.select("_old.*"), changed.select(*names), tuple(sets))
        deltas = self._parent_changes(name, changed, sets)
        self._store({name: after.select(*names)} | deltas)
        self._fire(name, "update", "after", changed.select("_old.*"), changed.select(*names), tuple(sets))
        return changed.select(*names)

    def delete(self, name: str, where: Column | None = None, source: DataFrame | None = None) -> DataFrame:
        """Delete rows (with a source ``s``: rows ``t`` that meet it); returns them."""
        old = self.read(name)
        hit = F.coalesce(where if where is not None else F.lit(True), F.lit(False))
        if source is None:
            marked = old.withColumn("_hit", hit)
        else:
            numbered = self._kept(old.withColumn("_rid", F.monotonically_increasing_id()), f"numbered-{name}")
            gone = numbered.alias("t").join(source.alias("s"), hit, "left_semi").select("_rid").withColumn("_g", F.lit(True))
            marked = numbered.join(gone, "_rid", "left").withColumn("_hit", F.coalesce("_g", F.lit(False)))
        marked = self._kept(marked.select(*old.columns, "_hit"), f"marked-{name}")
        gone, rest = marked.where("_hit").drop("_hit"), marked.where("NOT _hit").drop("_hit")
        self._fire(name, "delete", "before", gone, None)
        self._store({name: rest}, lost={name: gone})
        self._fire(name, "delete", "after", gone, None)
        return gone

    def merge(self, name: str, source: DataFrame, on: Column, update: dict[str, Column] | None = None, insert: dict[str, Column] | None = None) -> int:
        """One MATCHED UPDATE and one NOT MATCHED INSERT arm; the target is ``t``, the source ``s``."""
        t = self.tables[name]
        names = t.schema.names
        target = self._kept(self.read(name).withColumn("_rid", F.monotonically_increasing_id()), f"target-{name}")
        given = self._kept(source.withColumn("_sid", F.monotonically_increasing_id()), f"source-{name}")
        a, b = target.alias("t"), given.alias("s")
        pairs = a.join(b, on)
        if update is not None and pairs.groupBy("t._rid").count().where("count > 1").limit(1).count():
            raise ConstraintError("a target row matches several source rows")
        result = target.select(*names)
        if update is not None:
            hits = pairs.select("t._rid", *[v.alias(f"_set_{c}") for c, v in update.items()], F.lit(True).alias("_m"))
            result = target.join(hits, "_rid", "left").select(*[(F.when(F.col("_m"), F.col(f"_set_{c}")).otherwise(F.col(c)) if c in update else F.col(c)).cast(t.schema[c].dataType).alias(c) for c in names])
        if insert is not None:
            lonely = b.join(pairs.select(F.col("s._sid").alias("_used")), F.col("s._sid") == F.col("_used"), "left_anti")
            result = result.unionByName(self._filled(t, target.select(*names), lonely.select(*[v.alias(c) for c, v in insert.items()])))
        return self._store({name: result})

    # Transactions.
    def begin(self) -> None:
        self._saved.append((None, dict(self.tables)))

    def savepoint(self, name: str) -> None:
        self._saved.append((name, dict(self.tables)))

    def rollback(self, to: str | None = None) -> None:
        while self._saved:
            name, tables = self._saved.pop()
            if to is None and self._saved:
                continue
            if name == to:
                self.tables = tables
                return
        raise ValueError("nothing to roll back to")

    def commit(self) -> None:
        self._saved.clear()

    # The dictionary.
    def schema_tables(self) -> DataFrame:
        rows = [(n, "BASE TABLE") for n in self.tables] + [(n, "VIEW") for n in self.views]
        return self.spark.createDataFrame(sorted(rows), "table_name string, table_type string")

    def schema_columns(self) -> DataFrame:
        rows = [(n, f.name, i + 1, "GUID" if t.auto_guid == f.name else "ANY") for n, t in self.tables.items() for i, f in enumerate(t.schema)]
        return self.spark.createDataFrame(sorted(rows), "table_name string, column_name string, ordinal_position int, data_type string")

    def schema_indexes(self) -> DataFrame:
        rows = [(i.name, n, ",".join(i.columns), i.unique) for n, t in self.tables.items() for i in t.indexes]
        return self.spark.createDataFrame(sorted(rows), "index_name string, table_name string, columns string, is_unique boolean")

    def master(self) -> DataFrame:
        rows = [("table", n, n, f"CREATE TABLE {n} ({t.schema.simpleString()[7:-1]})") for n, t in self.tables.items()]
        rows += [("view", n, n, s) for n, s in self.view_sql.items()]
        rows += [("index", i.name, n, f"CREATE {'UNIQUE ' * i.unique}INDEX {i.name} ON {n} ({', '.join(i.columns)})") for n, t in self.tables.items() for i in t.indexes]
        return self.spark.createDataFrame(rows, "type string, name string, tbl_name string, sql string")

    def dump(self, path: str) -> None:
        """All tables as parquet, parents first, and the definitions as JSON."""
        done: list[str] = []
        while len(done) < len(self.tables):
            ready = [n for n, t in self.tables.items() if n not in done and all(f.parent in (*done, n) for f in t.foreign_keys)]
            done += sorted(ready) or sorted(set(self.tables) - set(done))
        for n in done:
            self.read(n).write.parquet(f"{path}/{n}")
        text = json.dumps([{"name": n, "schema": self.tables[n].schema.jsonValue(), "primary_key": self.tables[n].primary_key} for n in done])
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/_catalog")

    # Inside.
    def _path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        path = self._path(f"_{name}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _filled(self, t: Table, old: DataFrame, rows: DataFrame) -> DataFrame:
        """Columns in order; defaults for columns that are left out, then keys that count on."""
        extra = set(rows.columns) - set(t.schema.names)
        if extra:
            raise ValueError(f"unknown columns {sorted(extra)}")
        out = {}
        for f in t.schema:
            value = F.col(f.name) if f.name in rows.columns else t.defaults.get(f.name)
            out[f.name] = (value if isinstance(value, Column) else F.lit(value)).cast(f.dataType)
        if t.auto_guid:
            from docframe.functions.document import newid

            out[t.auto_guid] = F.coalesce(out[t.auto_guid], newid())
        filled = rows.select(*[v.alias(c) for c, v in out.items()])
        if t.autoincrement:
            k = t.autoincrement
            start = max(old.agg(F.coalesce(F.max(k), F.lit(0))).first()[0], filled.agg(F.coalesce(F.max(k), F.lit(0))).first()[0])
            numbered = self._kept(filled.withColumn("_pos", F.monotonically_increasing_id()), "numbered")
            wanting = rownum(numbered.where(F.col(k).isNull()), F.col("_pos"), name="_n").withColumn(k, F.lit(start) + F.col("_n")).drop("_n")
            filled = numbered.where(F.col(k).isNotNull()).unionByName(wanting.withColumn(k, F.col(k).cast(t.schema[k].dataType))).orderBy("_pos").drop("_pos")
        return filled

    def _check(self, name: str, t: Table, df: DataFrame) -> None:
        tests = {f"NOT NULL {c}": F.col(c).isNull() for c in {*t.not_null, *([t.primary_key] if t.primary_key else [])}}
        tests |= {f"CHECK {c}": ~F.coalesce(F.expr(c), F.lit(True)) for c in t.checks}
        if tests:
            row = df.agg(*[F.count_if(v).alias(f"c{i}") for i, v in enumerate(tests.values())]).first()
            broken = [k for k, n in zip(tests, row, strict=True) if n]
            if broken:
                raise ConstraintError(f"{name}: {', '.join(broken)}")
        keys = [((t.primary_key,), None, None)] if t.primary_key else []
        keys += [(u, None, None) for u in t.unique] + [(i.columns, i.where, i.path) for i in t.indexes if i.unique]
        for columns, where, path in keys:
            part = df.where(where) if where else df
            part = part.where(_no_null(columns))
            by = [F.get_json_object(columns[0], path)] if path else list(columns)
            if part.groupBy(*by).count().where("count > 1").limit(1).count():
                raise ConstraintError(f"{name}: duplicate {', '.join(columns)}")

    def _store(self, states: dict[str, DataFrame], lost: dict[str, DataFrame | None] | None = None, check: bool = True, views: bool = False) -> int:
        """Write the next snapshots, extend them by what foreign keys ask for, validate, and move the pointers."""
        if not views and any(n in self.materialized and self.tables[n].path is not None for n in states):
            raise ValueError("a materialized view is changed by REFRESH only")
        paths: dict[str, str] = {}

        def put(name: str, df: DataFrame) -> DataFrame:
            paths[name] = self._path(name)
            df.select(*self.tables[name].schema.names).write.parquet(paths[name])
            return self.spark.read.schema(self.tables[name].schema).parquet(paths[name])

        now = {n: put(n, df) for n, df in states.items()}
        wave = {n: g for n, g in (lost or {}).items() if g is not None}
        for _ in range(MAX_CASCADE):
            following: dict[str, DataFrame] = {}
            for parent, gone in wave.items():
                for child, t in sorted(self.tables.items()):
                    for fk in t.foreign_keys:
                        if fk.parent != parent or fk.on_delete == "restrict":
                            continue
                        left = now.get(parent, None)
                        left = self.read(parent) if left is None else left
                        keys = gone.select(F.col(fk.parent_column).alias("_k")).where("_k IS NOT NULL").distinct().join(left.select(F.col(fk.parent_column).alias("_k")), "_k", "left_anti")
                        rows = now[child] if child in now else self.read(child)
                        hit = rows.join(keys, rows[fk.column] == keys["_k"], "left_semi")
                        if not hit.limit(1).count():
                            continue
                        rest = rows.join(keys, rows[fk.column] == keys["_k"], "left_anti")
                        if fk.on_delete == "cascade":
                            hit = self._kept(hit, f"cascade-{child}")
                            following[child] = following[child].unionByName(hit) if child in following else hit
                            now[child] = put(child, rest)
                        else:
                            value = t.defaults.get(fk.column) if fk.on_delete == "set default" else None
                            now[child] = put(child, rest.unionByName(hit.withColumn(fk.column, F.lit(value).cast(t.schema[fk.column].dataType))))
            wave = following
            if not wave:
                break
        else:
            raise ConstraintError("foreign key actions did not settle")
        if check:
            for n, df in now.items():
                self._check(n, self.tables[n], df)
            self._check_references(now)
        for n, path in paths.items():
            self.tables[n] = replace(self.tables[n], path=path)
        return sum(df.count() for n, df in now.items() if n in states)

    def _check_references(self, now: dict[str, DataFrame]) -> None:
        """Foreign keys hold on the statement's final state; null passes."""
        for child, t in self.tables.items():
            for fk in t.foreign_keys:
                if child not in now and fk.parent not in now:
                    continue
                rows = now[child] if child in now else self.read(child)
                parents = (now[fk.parent] if fk.parent in now else self.read(fk.parent)).select(F.col(fk.parent_column).alias("_k"))
                if rows.where(F.col(fk.column).isNotNull()).join(parents, F.col(fk.column) == F.col("_k"), "left_anti").limit(1).count():
                    raise ConstraintError(f"{child}.{fk.column} has no parent in {fk.parent}")

    def _parent_changes(self, parent: str, changed: DataFrame, sets: dict) -> dict[str, DataFrame]:
        """ON UPDATE actions of the children whose parent key is set."""
        out: dict[str, DataFrame] = {}
        for child, t in sorted(self.tables.items()):
            for fk in t.foreign_keys:
                if fk.parent != parent or fk.parent_column not in sets or fk.on_update == "restrict" or child == parent:
                    continue
                moves = changed.select(F.col(f"_old.{fk.parent_column}").alias("_from"), F.col(fk.parent_column).alias("_to")).where("_from IS NOT NULL AND NOT (_from <=> _to)").distinct()
                if moves.groupBy("_from").count().where("count > 1").limit(1).count():
                    raise ConstraintError("one key changes to several values")
                rows = out.get(child, self.read(child))
                value = {"cascade": F.col("_to"), "set null": F.lit(None), "set default": F.lit(t.defaults.get(fk.column))}[fk.on_update]
                joined = rows.join(moves, rows[fk.column] == moves["_from"], "left")
                out[child] = joined.select(*[(F.when(F.col("_from").isNotNull(), value).otherwise(F.col(c)) if c == fk.column else F.col(c)).cast(t.schema[c].dataType).alias(c) for c in t.schema.names])
        return out

    def _fire(self, name: str, event: str, timing: str, old: DataFrame | None, new: DataFrame | None, columns: tuple[str, ...] = ()) -> None:
        for trigger in self.tables[name].triggers:
            if (trigger.event, trigger.timing) != (event, timing) or (trigger.columns and not set(trigger.columns) & set(columns)):
                continue
            if self._depth >= 16:
                raise RuntimeError("triggers nest too deep")
            self._depth += 1
            try:
                narrow = lambda df: df.where(trigger.when) if df is not None and trigger.when else df  # noqa: B023, E731
                trigger.action(self, narrow(old), narrow(new))
            finally:
                self._depth -= 1


def _no_null(columns) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _first(df: DataFrame, key: tuple[str, ...], order: Column) -> DataFrame:
    """One row of each key; rows with a null in the key don't conflict."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    return numbered.where((F.col("_n") == 1) | ~_no_null(key)).drop("_n")


def _deterministic(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().analyzed().toString().lower()
    return not any(f"{name}(" in plan for name in ("rand", "randn", "uuid", "current_timestamp", "now", "current_date", "shuffle"))
