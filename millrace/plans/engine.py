"""A SQL front end over the store: queries, DML with RETURNING and ON CONFLICT, DDL and sequences.

Queries are handed to Spark as text in its dialect. Statements that change rows are queries
over the table's parts and the files and places of its rows: conditions, subqueries and joins
are planned as any other, only parts that hold changed rows are written anew, once, and the
new state is checked against the constraints and committed at once, so that a failed
statement changes nothing. Only counts, part names and sequence bases reach the driver.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.plans import text, types
from millrace.sources.store import Column, Store, Table

@dataclass
class Result:
    tag: str
    df: DataFrame | None = None


class Engine:
    def __init__(self, spark: SparkSession, root: str | None):
        """root: the folder of the engine's tables; None for queries over attached tables alone."""
        self.spark, self.store = spark, Store(spark, root)
        self.attached: dict[str, DataFrame] = {}

    def attach(self, name: str, df: DataFrame) -> None:
        """Let queries read a DataFrame under a name."""
        self.attached[name.lower()] = df

    # Entry points

    def sql(self, statement: str, args: dict | None = None) -> Result:
        """Run one statement; several in one text are refused."""
        found = text.statements(statement)
        if len(found) != 1:
            raise ValueError("syntax error: exactly one statement is expected")
        ts = found[0]
        word = ts[0].lower()
        run = {
            "insert": self._insert, "update": self._update, "delete": self._delete, "truncate": self._truncate, "create": self._create, "drop": self._drop, "alter": self._alter,
            "set": lambda ts: Result("SET"), "show": lambda ts: Result("SHOW"), "begin": lambda ts: Result("BEGIN"), "commit": lambda ts: Result("COMMIT"), "rollback": lambda ts: Result("ROLLBACK"),
            "vacuum": lambda ts: (self.store.vacuum(), Result("VACUUM"))[1],
        }.get(word)
        if run:
            return run(ts)
        if word in ("select", "with", "values", "(", "table"):
            df = self.query(ts, args)
            return Result("SELECT", df)
        raise ValueError(f"unsupported statement: {ts[0]}")

    def kind(self, statement: str) -> str:
        """What kind of statement a text is."""
        ts = text.statements(statement)[0]
        return " ".join(ts[: 2 if text.is_word(ts[0], "create", "drop", "alter") else 1]).upper()

    def parse(self, statement: str) -> str:
        """A statement's kind and, for a query, its tree as Spark reads it, else its tokens; as JSON."""
        ts = text.statements(statement)[0]
        out: dict = {"kind": self.kind(statement)}
        if text.is_word(ts[0], "select", "with", "values", "("):
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text.to_spark(ts))
            out["tree"] = plan.treeString().splitlines()
        else:
            out["tokens"] = ts
        return json.dumps(out)

    def query(self, ts: list[str], args: dict | None = None) -> DataFrame:
        body = self._spark_text(ts)
        return types.resolve(lambda t: self.spark.sql(t, args=args) if args else self.spark.sql(t), body)

    def _spark_text(self, ts: list[str]) -> str:
        """Tokens as Spark SQL, with a view for each table they name."""
        ts, frames = self._sequences(ts), {}
        for i, t in enumerate(ts):
            # a dotted table name is two tokens around a dot
            full = f"{t}.{ts[i + 2]}" if i + 2 < len(ts) and ts[i + 1] == "." else t
            for name in (full, t):
                key = Store.key(name.lower())
                if i and ts[i - 1] == ".":
                    continue
                if key in self.store.tables:
                    frames[key] = self.store.read(self.store.tables[key])
                elif key.startswith("public.") and key[7:] in self.attached:
                    frames[key] = self.attached[key[7:]]
        for key, df in frames.items():
            df.createOrReplaceTempView(key.split(".")[1] if key.startswith("public.") else key.replace(".", "__"))
        body = text.to_spark(ts, lambda sub: types.standalone(self.spark, re.sub(r"\bpublic\.(\w+)", r"\1", sub)))
        body = re.sub(r"\bpublic\.(\w+)", r"\1", body)
        for key in frames:
            if not key.startswith("public."):
                body = re.sub(rf"\b{re.escape(key)}\b", key.replace(".", "__"), body)
        return body

    def _run(self, body: str, **frames: DataFrame) -> DataFrame:
        """Spark SQL over frames that stand in braces in the text."""
        for k, df in frames.items():
            name = f"__{k}_{uuid.uuid4().hex}"
            df.createOrReplaceTempView(name)
            body = body.replace(f"{{{k}}}", name)
        return types.resolve(self.spark.sql, body)

    def _sequences(self, ts: list[str]) -> list[str]:
        """nextval, currval and setval calls with constant arguments to their values."""
        out, i = [], 0
        while i < len(ts):
            if text.is_word(ts[i], "nextval", "currval", "setval") and i + 1 < len(ts) and ts[i + 1] == "(":
                end = text.close(ts, i + 1)
                args = [text.join(a) for a in text.split(ts[i + 2 : end])]
                name, word = args[0].strip("'"), ts[i].lower()
                value = self.store.reserve(name, 1) if word == "nextval" else self.store.sequence(name)["last"] if word == "currval" else self.store.setval(name, int(args[1]))
                out.append(f"{value}L")
                i = end + 1
            else:
                out.append(ts[i])
                i += 1
        return out

    # Rows

    @staticmethod
    def _name(ts: list[str], at: int) -> tuple[str, int]:
        """A possibly dotted name and the index after it."""
        name, at = ts[at].strip('"').lower(), at + 1
        while at + 1 < len(ts) and ts[at] == ".":
            name, at = f"{name}.{ts[at + 1].lower()}", at + 2
        return name, at

    def _returning(self, ts: list[str]) -> tuple[list[str], list[str] | None]:
        at = text.find(ts, "returning")
        return (ts[:at], ts[at + 1 :]) if at < len(ts) else (ts, None)

    def _project(self, df: DataFrame, items: list[str] | None, alias: str) -> DataFrame | None:
        if items is None:
            return None
        return self._run(f"select {self._spark_text(items)} from {{rows}} as {alias}", rows=df)

    def _numbered(self, table: Table, df: DataFrame) -> DataFrame:
        """df with the next values in its sequence columns that are marked unset, dense and in row order."""
        wanted = [c for c in table.columns if c.sequence and f"__unset_{c.name}" in df.columns]
        if not wanted:
            return df
        _, at = self._staged(df.withColumn("__at", F.monotonically_increasing_id()))
        part = F.shiftright("__at", 33)
        counts = sorted(tuple(r) for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
        starts, total = [], 0
        for p, n in counts:
            starts.append((p, total))
            total += n
        if not total:
            return at.drop("__at", *[f"__unset_{c.name}" for c in wanted])
        begins = self.spark.createDataFrame(starts, "__p long, __start long")
        at = at.join(F.broadcast(begins), part == F.col("__p"))
        place = F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)
        for c in wanted:
            s = self.store.sequence(c.sequence)
            step, first = s["step"], self.store.reserve(c.sequence, total)
            at = at.withColumn(c.name, F.when(F.col(f"__unset_{c.name}"), F.lit(first) + place * step).otherwise(F.col(c.name)).cast(c.type))
        return at.drop("__at", "__p", "__start", *[f"__unset_{c.name}" for c in wanted])

    def _fill(self, table: Table, given: DataFrame, names: list[str]) -> DataFrame:
        """All columns of the table from the given ones, defaults and sequences."""
        given = given.toDF(*[f"__{n}" for n in names])
        out = []
        for c in table.columns:
            if c.name in names:
                out.append(self._cast(F.col(f"__{c.name}"), given.schema[f"__{c.name}"].dataType.simpleString(), c.type).alias(c.name))
            elif c.sequence:
                out += [F.lit(None).cast(c.type).alias(c.name), F.lit(True).alias(f"__unset_{c.name}")]
            else:
                out.append(F.lit(c.default).cast(c.type).alias(c.name))
        return self._numbered(table, given.select(*out))

    @staticmethod
    def _cast(x, have: str, want: str):
        return vectors.parse(x) if want == "array<float>" and have == "string" else x.cast(want)

    def _check_nulls(self, table: Table, rows: DataFrame) -> None:
        wrong = [c.name for c in table.columns if not c.nullable]
        for name in wrong and rows.select(*[F.max(F.col(n).isNull()).alias(n) for n in wrong]).first().asDict().items() or ():
            if name[1]:
                raise ValueError(f'null value in column "{name[0]}" violates not-null constraint')

    def _check_unique(self, table: Table, rows: DataFrame, others: DataFrame | None = None) -> None:
        """No key stands twice in the rows, or in them and in the others, which are known to be unique among themselves."""
        for key in table.keys:
            whole = rows.dropna(subset=key)
            twice = not whole.groupBy(*key).count().filter("count > 1").isEmpty()
            if twice or others is not None and not whole.join(others.select(*key), key, "left_semi").isEmpty():
                raise ValueError(f"duplicate key value violates unique constraint ({', '.join(key)})")

    def _commit(self, table: Table, parts: list[str]) -> None:
        table.parts = parts
        self.store.commit()

    def _staged(self, df: DataFrame) -> tuple[str, DataFrame]:
        """Rows written once, so that what is checked, stored and returned is the same."""
        part = self.store.write(df)
        return part, self.spark.read.schema(df.schema).parquet(part)

    def _insert(self, ts: list[str]) -> Result:
        name, at = self._name(ts, 2)
        table = self.store.get(name)
        names = table.names
        if ts[at] == "(":
            end = text.close(ts, at)
            names = [p[0].strip('"').lower() for p in text.split(ts[at + 1 : end])]
            at = end + 1
            for n in names:
                table.column(n)
        ts, items = self._returning(ts[at:])
        conflict = text.find(ts, "on")
        while conflict < len(ts) and not text.is_word(ts[conflict + 1], "conflict"):
            conflict = text.find(ts, "on", start=conflict + 1)
        body, action = ts[:conflict], ts[conflict + 2 :]
        if text.is_word(body[0], "default"):
            rows = self._fill(table, self.spark.range(1).select(), [])
        elif text.is_word(body[0], "values"):
            rows = self._values(table, names, text.split(body[1:]))
        else:
            given = self.query(body)
            rows = self._fill(table, given, names[: len(given.columns)])
        if action:
            _, rows = self._staged(rows.withColumn("__n", F.monotonically_increasing_id()))
            self._check_nulls(table, rows)
            return self._upsert(table, rows, action, items)
        part, rows = self._staged(rows)
        self._check_nulls(table, rows)
        self._check_unique(table, rows, self.store.read(table) if table.parts else None)
        self._commit(table, [*table.parts, part])
        return Result(f"INSERT 0 {rows.count()}", self._project(rows, items, name.split(".")[-1]))

    def _values(self, table: Table, names: list[str], tuples: list[list[str]]) -> DataFrame:
        rows = [text.split(t[1:-1]) for t in tuples]
        for n in names:
            table.column(n)
        if len(rows) > 1 and not any(len(c) == 1 and text.is_word(c[0], "default") for r in rows for c in r):
            # the rows as one inline table, in the types their columns have
            given = names[: len(rows[0])]
            cells = [", ".join(self._assigned(c, table.column(n)) for n, c in zip(given, r, strict=True)) for r in rows]
            return self._fill(table, self._run(f"select * from values {', '.join(f'({c})' for c in cells)} as t({', '.join(given)})"), given)
        out = None
        for r in rows:
            cells = {n: c for n, c in zip(names, r, strict=False) if not (len(c) == 1 and text.is_word(c[0], "default"))}
            given = self._run("select " + (", ".join(f"{self._assigned(c, table.column(n))} as {n}" for n, c in cells.items()) or "1 as __none"))
            row = self._fill(table, given if cells else given.select(), list(cells))
            out = row if out is None else out.unionByName(row)
        return out

    def _assigned(self, ts: list[str], column: Column) -> str:
        """A value's tokens as Spark SQL, in the type of the column that takes it."""
        if column.type == "array<float>" and len(ts) == 1 and ts[0].startswith("'"):
            return text.vector(ts)
        return f"cast(({self._spark_text(ts)}) as {column.type})"

    def _scan(self, table: Table) -> DataFrame:
        """The table's rows, and of each the part, file and place it stands at."""
        df = self.store.read(table)
        if not table.parts:
            return df.withColumns({"__part": F.lit(""), "__file": F.lit(""), "__row": F.lit(0).cast("long")})
        part = F.regexp_extract("_metadata.file_path", "/parts/([0-9a-f]+)/", 1)
        return df.select("*", part.alias("__part"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))

    @staticmethod
    def _parts(rows: DataFrame) -> set[str]:
        """Names of the parts that rows of _scan() stand in."""
        return {r[0] for r in rows.select("__part").distinct().collect()}

    @staticmethod
    def _split(table: Table, touched: set[str]) -> tuple[list[str], list[str]]:
        """The table's parts: those touched, and the rest."""
        return [p for p in table.parts if p.rsplit("/", 1)[-1] in touched], [p for p in table.parts if p.rsplit("/", 1)[-1] not in touched]

    def _others(self, table: Table, parts: list[str]) -> DataFrame | None:
        return self.store.read(Table(table.name, table.columns, parts=parts)) if parts else None

    def _upsert(self, table: Table, rows: DataFrame, action: list[str], items: list[str] | None) -> Result:
        keys, name = table.keys, table.name.split(".")[-1]
        if action[0] == "(":
            end = text.close(action, 0)
            target = [p[0].strip('"').lower() for p in text.split(action[1:end])]
            if sorted(target) not in [sorted(k) for k in keys]:
                raise ValueError("there is no unique or exclusion constraint matching the ON CONFLICT specification")
            keys, action = [target], action[end + 1 :]
        old = self.store.read(table)
        if text.is_word(action[1], "nothing"):
            fresh = rows
            for key in keys:  # a null in a key never conflicts
                whole = F.lit(True)
                for k in key:
                    whole = whole & F.col(k).isNotNull()
                first = F.row_number().over(Window.partitionBy(*key).orderBy("__n"))
                fresh = fresh.withColumn("__first", first).filter((F.col("__first") == 1) | ~whole).drop("__first").join(old.select(*key), key, "left_anti")
            new_part, fresh = self._staged(fresh.select(*table.names))
            self._check_unique(table, fresh, old)
            self._commit(table, [*table.parts, new_part])
            return Result(f"INSERT 0 {fresh.count()}", self._project(fresh, items, name))
        if len(keys) != 1:
            raise ValueError("ON CONFLICT DO UPDATE requires inference specification")
        key = keys[0]
        if not rows.dropna(subset=key).groupBy(*key).count().filter("count > 1").isEmpty():
            raise ValueError("ON CONFLICT DO UPDATE command cannot affect row a second time")
        where = text.find(action, "where")
        sets = {p[0].strip('"').lower(): self._qualified(p[2:], table, name) for p in text.split(action[3:where])}
        match = " and ".join(f"{name}.{k} = excluded.{k}" for k in key)
        condition = self._spark_text(self._qualified(action[where + 1 :], table, name)) if where < len(action) else "true"
        scan = self._scan(table)
        touched, rest = self._split(table, self._parts(scan.join(rows.select(*key), key, "left_semi")))
        scan = scan.filter(F.col("__part").isin([p.rsplit("/", 1)[-1] for p in touched]))
        hit = f"(excluded.{key[0]} is not null and coalesce(({condition}), false))"
        state = [f"case when {hit} then {self._assigned(sets[c.name], c)} else {name}.{c.name} end as {c.name}" if c.name in sets else f"{name}.{c.name}" for c in table.columns]
        kept = self._run(f"select {', '.join(state)}, {hit} as __hit from {{old}} as {name} left join {{rows}} as excluded on {match}", old=scan, rows=rows)
        added = rows.join(old.select(*key), key, "left_anti").select(*table.names).withColumn("__hit", F.lit(True))
        new_part, new = self._staged(kept.unionByName(added))
        self._check_nulls(table, new)
        self._check_unique(table, new, self._others(table, rest))
        self._commit(table, [*rest, new_part])
        changed = new.filter("__hit").drop("__hit")
        return Result(f"INSERT 0 {changed.count()}", self._project(changed, items, name))

    @staticmethod
    def _qualified(ts: list[str], table: Table, name: str) -> list[str]:
        """Bare column names are the target row's."""
        out = []
        for i, t in enumerate(ts):
            bare = t.lower() in table.names and (not i or ts[i - 1] != ".") and not (i + 1 < len(ts) and ts[i + 1] in (".", "("))
            out += [name, ".", t] if bare else [t]
        return out

    def _update(self, ts: list[str]) -> Result:
        ts, items = self._returning(ts)
        name, at = self._name(ts, 1)
        table = self.store.get(name)
        alias = name.split(".")[-1]
        if not text.is_word(ts[at], "set"):
            alias = ts[at + 1] if text.is_word(ts[at], "as") else ts[at]
            at += 2 if text.is_word(ts[at], "as") else 1
        frm, where = text.find(ts, "from", start=at), text.find(ts, "where", start=at)
        sets = {p[0].strip('"').lower(): p[2:] for p in text.split(ts[at + 1 : min(frm, where)])}
        new = {n: self._assigned(v, table.column(n)) for n, v in sets.items()}
        scan, condition = self._scan(table), self._spark_text(ts[where + 1 :]) if where < len(ts) else "true"
        if frm < len(ts):
            # the first partner of each row says what it becomes; the condition's equalities are the join's keys
            cells = ", ".join(f"{e} as __new_{n}" for n, e in new.items())
            joined = self._run(f"select {alias}.__part, {alias}.__file as __f, {alias}.__row as __r, {cells} from {{rows}} as {alias}, {self._spark_text(ts[frm + 1 : where])} where {condition}", rows=scan)
            _, one = self._staged(joined.dropDuplicates(["__f", "__r"]))
            touched, rest = self._split(table, self._parts(one))
            old = scan.filter(F.col("__part").isin([p.rsplit("/", 1)[-1] for p in touched]))
            both = old.join(one.drop("__part"), F.expr("__file = __f and __row = __r"), "left")
            hit = F.col("__f").isNotNull()
            state = both.select(*[F.when(hit, F.col(f"__new_{n}")).otherwise(F.col(n)).alias(n) if n in new else F.col(n) for n in table.names], hit.alias("__hit"))
        else:
            touched, rest = self._split(table, self._parts(self._run(f"select __part from {{rows}} as {alias} where {condition}", rows=scan)))
            old = scan.filter(F.col("__part").isin([p.rsplit("/", 1)[-1] for p in touched]))
            cells = ", ".join(f"case when __hit then {new[n]} else {alias}.{n} end as {n}" if n in new else f"{alias}.{n}" for n in table.names)
            state = self._run(f"select {cells}, __hit from (select *, coalesce(({condition}), false) as __hit from {{rows}} as {alias}) as {alias}", rows=old)
        if not touched:
            return Result("UPDATE 0", self._project(self.store.read(table).limit(0), items, alias))
        part, state = self._staged(state)
        changed = state.filter("__hit").drop("__hit")
        self._check_nulls(table, changed)
        self._check_unique(table, state, self._others(table, rest))
        n = changed.count()
        self._commit(table, [*rest, part])
        return Result(f"UPDATE {n}", self._project(changed, items, alias))

    def _delete(self, ts: list[str]) -> Result:
        ts, items = self._returning(ts)
        name, at = self._name(ts, 2)
        table = self.store.get(name)
        using, where = text.find(ts, "using", start=at), text.find(ts, "where", start=at)
        alias = name.split(".")[-1] if at >= min(using, where) else ts[min(using, where) - 1]
        scan, condition = self._scan(table), self._spark_text(ts[where + 1 :]) if where < len(ts) else "true"
        more = f", {self._spark_text(ts[using + 1 : where])}" if using < len(ts) else ""
        # the rows that go, by file and place; the parts that hold none of them stay as they are
        gone = self._run(f"select {alias}.__part, {alias}.__file, {alias}.__row from {{rows}} as {alias}{more} where {condition}", rows=scan)
        _, gone = self._staged(gone.distinct())
        touched, rest = self._split(table, self._parts(gone))
        old = scan.filter(F.col("__part").isin([p.rsplit("/", 1)[-1] for p in touched]))
        went = old.join(gone, ["__file", "__row"], "left_semi").select(*table.names)
        n = gone.count()
        kept = [self.store.write(old.join(gone, ["__file", "__row"], "left_anti").select(*table.names))] if touched else []
        self._commit(table, [*rest, *kept])
        return Result(f"DELETE {n}", self._project(went, items, alias))

    def _truncate(self, ts: list[str]) -> Result:
        names = text.split(ts[2 if text.is_word(ts[1], "table") else 1 :])
        tables = [self.store.get(self._name(n, 0)[0]) for n in names]
        for t in tables:
            t.parts = []
        self.store.commit()
        return Result("TRUNCATE TABLE")

    # Definitions

    def _create(self, ts: list[str]) -> Result:
        if not text.is_word(ts[1], "table"):
            raise ValueError(f"unsupported statement: CREATE {ts[1].upper()}")
        at = 2
        lenient = text.is_word(ts[at], "if")
        name, at = self._name(ts, at + 3 * lenient)
        key = Store.key(name)
        if key in self.store.tables:
            if lenient:
                return Result("CREATE TABLE")
            raise ValueError(f'relation "{name}" already exists')
        if text.is_word(ts[at], "as"):
            df = self.query(ts[at + 1 :])
            part, df = self._staged(df)
            self.store.tables[key] = Table(key, [Column(f.name, f.dataType.simpleString()) for f in df.schema], [], [part])
            self.store.commit()
            return Result(f"SELECT {df.count()}")
        columns, primary, uniques = [], [], []
        for p in text.split(ts[at + 1 : text.close(ts, at)]):
            if text.is_word(p[0], "constraint"):
                p = p[2:]
            if text.is_word(p[0], "primary"):
                primary = [x[0].lower() for x in text.split(p[3:-1])]
            elif text.is_word(p[0], "unique"):
                names = [x[0].lower() for x in text.split(p[2:-1])]
                uniques.append(names)
            elif not text.is_word(p[0], "check", "foreign"):
                column, is_key = self._column(key, p)
                columns.append(column)
                primary += [column.name] if is_key else []
        table = Table(key, columns, primary, uniques=uniques)
        for n in primary:
            table.column(n).nullable = False
        for n in (n for names in uniques for n in names):
            table.column(n)
        for c in columns:
            if c.sequence:
                self.store.create_sequence(c.sequence)
        self.store.tables[key] = table
        self.store.commit()
        return Result("CREATE TABLE")

    def _column(self, table: str, p: list[str]) -> tuple[Column, bool]:
        declared = p[1].lower()
        c = Column(p[0].strip('"').lower(), text.TYPES.get(declared, "string"))
        if declared in ("serial", "bigserial"):
            c.sequence, c.nullable = f"{table}_{c.name}_seq", False
        rest = [t.lower() for t in p[2:]]
        if "not" in rest and rest[rest.index("not") + 1] == "null":
            c.nullable = False
        c.unique = "unique" in rest
        if "default" in rest:
            value = p[2 + rest.index("default") + 1 :]
            if "nextval" in rest:
                c.sequence = value[2].strip("'").lower()
            elif len(value) > 1 and value[1] == "(":
                raise ValueError("a default must be a literal")
            else:
                end = next((i for i, t in enumerate(value) if text.is_word(t, "not", "unique", "primary", "null") and i), len(value))
                c.default = self.query(["select", *value[:end]]).first()[0]
        return c, "primary" in rest

    def _drop(self, ts: list[str]) -> Result:
        lenient = text.is_word(ts[2], "if")
        for n in text.split(ts[4 if lenient else 2 :]):
            key = Store.key(self._name(n, 0)[0])
            if key not in self.store.tables and not lenient:
                raise ValueError(f'table "{n[0]}" does not exist')
            table = self.store.tables.pop(key, None)
            for c in table.columns if table else ():
                self.store.sequences.pop(c.sequence, None)
        self.store.commit()
        return Result("DROP TABLE")

    def _rewritten(self, table: Table, change) -> list[str]:
        """The table's rows after a change of columns, as parts; the table is as it was until they are written."""
        return [self.store.write(change(self.store.read(table)))] if table.parts else []

    def _alter(self, ts: list[str]) -> Result:
        name, at = self._name(ts, 2)
        table = self.store.get(name)
        words = [t.lower() for t in ts[at:]]
        if words[:2] == ["rename", "to"]:
            new = Store.key(words[2])
            if new in self.store.tables:
                raise ValueError(f'relation "{words[2]}" already exists')
            self.store.tables[new] = self.store.tables.pop(table.name)
            table.name = new
        elif words[0] == "rename":
            old, new = [w for w in words[1:] if w not in ("column", "to")]
            c = table.column(old)
            if new in table.names:
                raise ValueError(f'column "{new}" of relation "{table.name}" already exists')
            parts = self._rewritten(table, lambda df: df.withColumnRenamed(old, new))
            c.name = new
            table.primary_key = [new if k == old else k for k in table.primary_key]
            table.uniques = [[new if k == old else k for k in u] for u in table.uniques]
            table.parts = parts
        elif words[0] == "add":
            c, _ = self._column(table.name, ts[at + 1 + (words[1] == "column") :])
            if c.name in table.names:
                raise ValueError(f'column "{c.name}" of relation "{table.name}" already exists')
            parts = self._rewritten(table, lambda df: df.withColumn(c.name, F.lit(c.default).cast(c.type)))
            table.columns.append(c)
            table.parts = parts
        elif words[0] == "drop":
            c = table.column(words[1 + (words[1] == "column")])
            parts = self._rewritten(table, lambda df: df.drop(c.name))
            table.columns.remove(c)
            # a key goes with any of its columns
            table.primary_key = [] if c.name in table.primary_key else table.primary_key
            table.uniques = [u for u in table.uniques if c.name not in u]
            table.parts = parts
        else:
            raise ValueError("unsupported ALTER TABLE action")
        self.store.commit()
        return Result("ALTER TABLE")
