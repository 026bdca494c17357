"""Versioned silver tables on any shared file system with an atomic rename.

Every write goes to a folder of its own. A version is one log file that names, per table, the folder of
each part (a date of orders, a bucket of ids elsewhere) and the rows added since; it is published by
a rename that fails if that version exists. So readers see whole versions, an interrupted
save leaves nothing behind but unused folders, and of two writers one takes the next number.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from restomart.functions.sql_guard import require_read_only
from restomart.operators import quality
from restomart.session import shared_path
from restomart.sources.silver import SCHEMAS, TABLE_NAMES, Silver, ddl

ORDER_DATE = "order_date"
BUCKET = "bucket"
BUCKETS = 16
NO_PART = "__HIVE_DEFAULT_PARTITION__"
# kind: table (one per table and version), part (a folder takes its place) or delta (rows that go before).
ENTRY = ("version bigint, table_name string, kind string, part string, folder string, generated_at timestamp, "
         "row_count bigint, replaces boolean, merged_until bigint, keys array<string>, stream string, batch_id bigint")


class LoadRejected(ValueError):
    """Rows that break the rules of silver; ``counts`` has (table, rule, column, violations)."""

    def __init__(self, counts: list[tuple[str, str, str, int]]):
        self.counts = counts
        lines = [f"{t}: {rule} {column}: {n} rows" for t, rule, column, n in counts]
        super().__init__("rows break the rules of silver:\n" + "\n".join(lines))


@dataclass
class StoredTable:
    version: int = 0  # of the last change
    row_count: int | None = None  # without the rows added by batches
    parts: dict[str, str] = field(default_factory=dict)
    deltas: list[tuple[int, str, list[str]]] = field(default_factory=list)  # version, folder, keys


@dataclass
class State:
    version: int
    tables: dict[str, StoredTable]
    batches: dict[str, int]  # last batch of each stream


class SilverStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Log ---------------------------------------------------------------------------------------

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _entries(self) -> DataFrame:
        path, files = self._path("_log")
        if not files.exists(path):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).json(f"{self.root}/_log")

    def log(self) -> DataFrame:
        """One row per table and version: version, table_name, generated_at, row_count (null until added
        rows are merged)."""
        return self._entries().filter("kind = 'table'").select("version", "table_name", "generated_at", "row_count")

    def state(self) -> State:
        """The live folders of every table; the log is reduced in Spark, one row per part comes back."""
        entries = self._entries()
        heads = entries.filter("kind = 'table'").groupBy("table_name").agg(
            F.max("version").alias("last"), F.max_by("row_count", F.when(F.col("row_count").isNotNull(), F.col("version"))).alias("rows"),
            F.max(F.when(F.col("replaces"), F.col("version"))).alias("since"),
            F.max("merged_until").alias("merged"))
        whole = entries.join(heads, "table_name").filter(
            F.col("version") >= F.coalesce("since", F.lit(0))).filter(
            (F.col("kind") != "delta") | (F.col("version") > F.coalesce("merged", F.lit(0))))
        live = whole.groupBy("table_name", "kind", F.when(F.col("kind") == "delta", F.col("folder")).otherwise(
            F.col("part")).alias("place")).agg(
            F.max("version").alias("version"), F.max_by("folder", "version").alias("folder"),
            F.max_by("keys", "version").alias("keys"), F.first("last").alias("last"), F.first("rows").alias("rows"))
        found: dict[str, StoredTable] = {}
        for r in live.collect():
            t = found.setdefault(r.table_name, StoredTable(r["last"], r["rows"]))
            if r.kind == "part" and r.folder:
                t.parts[r.place] = r.folder
            elif r.kind == "delta":
                t.deltas.append((r.version, r.folder, r["keys"]))
        batches = entries.filter("stream is not null").groupBy("stream").agg(F.max("batch_id").alias("b")).collect()
        return State(max([t.version for t in found.values()], default=0), found, {r.stream: r.b for r in batches})

    def current(self) -> dict[str, int]:
        """Version of the last change of every table."""
        return {n: t.version for n, t in self.state().tables.items()}

    def _publish(self, version: int, entries: list[dict]) -> bool:
        """False if another writer took this version; the rename must not replace a file."""
        stamp = dt.datetime.now(dt.timezone.utc).isoformat()
        text = "\n".join(json.dumps({**e, "version": version, "generated_at": stamp}) for e in entries)
        draft, files = self._path(f"_log/.{uuid.uuid4().hex}")
        final, _ = self._path(f"_log/{version:012d}.json")
        out = files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.spark.sparkContext
        rename = context._jvm.org.apache.hadoop.fs.Options.Rename
        options = context._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                draft.toUri() if draft.toUri().getScheme() else files.getUri(),
                context._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Py4JJavaError:
            if not files.exists(final):
                raise
            files.delete(draft, False)
            return False
        return True

    def _commit(self, build: Callable[[State], list[dict]], depends: bool) -> int:
        """Publish what ``build`` wrote as the next version. If another writer was first, it is built
        again only if it depends on a table that the other one changed."""
        state = self.state()
        entries = build(state)
        while entries and not self._publish(state.version + 1, entries):
            seen, state = state, self.state()
            touched = {e["table_name"] for e in entries}
            old = {n: t.version for n, t in seen.tables.items() if n in touched}
            if depends and old != {n: t.version for n, t in state.tables.items() if n in touched}:
                entries = build(state)
        return state.version + 1 if entries else state.version

    # Reading -----------------------------------------------------------------------------------

    def read(self, table: str) -> DataFrame:
        found = self.state().tables
        if table not in found:
            raise LookupError(f"{table} was never saved")
        return self._open(table, found[table])

    def silver(self) -> Silver:
        return Silver(**{n: self._open(n, t) for n, t in self.state().tables.items() if n in TABLE_NAMES})

    def _base(self, table: str, parts: dict[str, str]) -> DataFrame:
        part, kind = (ORDER_DATE, "date") if table == "orders" else (BUCKET, "int")
        schema = f"{ddl(table)}, {part} {kind}"
        if not parts:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{folder}/{p}" for p, folder in sorted(parts.items())]
        # The folder of the write becomes a column too, so that parts of several writes are one scan.
        base = self.spark.read.schema(f"{schema}, write string").option("basePath", f"{self.root}/{table}").parquet(*paths)
        return base.drop("write")

    def _open(self, table: str, stored: StoredTable) -> DataFrame:
        if stored.deltas and not stored.parts:
            added, _ = self._added(table, stored)
            return with_part(added, table) if table == "orders" else added
        base = self._base(table, stored.parts)
        if stored.deltas:
            added, keys = self._added(table, stored)
            base = base.join(added.select(*keys), keys, "left_anti").unionByName(
                with_part(added, table).select(*base.columns))
        return base if table == "orders" else base.drop(BUCKET)

    def _once(self, df: DataFrame, keys: list[str], latest: str | None) -> DataFrame:
        """One row per key. Only keys are shuffled to find those that come again; rows of a single key stay where they are."""
        names = [f"_key_{k}" for k in keys]
        counted = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias("_n"))
        again = self._staged(counted.filter("_n > 1").drop("_n"))
        if again.isEmpty():
            return df
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
        return df.join(again, same, "left_anti").unionByName(
            latest_per_key(df.join(again, same, "left_semi"), keys, latest))

    def _added(self, table: str, stored: StoredTable) -> tuple[DataFrame, list[str]]:
        """The newest added row of each key, and the keys. A batch holds a key once, so its number decides, and
        each column is picked by itself: those that nobody asks for are neither read nor shuffled."""
        keys, parts = stored.deltas[0][2], []
        for version, folder, _ in stored.deltas:
            parts.append(self.spark.read.schema(ddl(table)).parquet(f"{self.root}/{folder}").withColumn(
                "_version", F.lit(version)))
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        if any(by != keys for _, _, by in stored.deltas):
            return latest_per_key(rows, keys, "_version").drop("_version"), keys
        columns = [c for c in rows.columns if c not in (*keys, "_version")]
        return rows.groupBy(*keys).agg(*[F.max_by(c, "_version").alias(c) for c in columns]).select(*SCHEMAS[table]), keys

    # Writing -----------------------------------------------------------------------------------

    def _folder(self, table: str) -> str:
        return f"{table}/write={uuid.uuid4().hex}"

    def _write(self, table: str, df: DataFrame, metrics: dict[str, Column]) -> tuple[str, list[str], dict]:
        """Write ``df`` by parts into a new folder: (folder, parts, metrics taken on the way)."""
        folder, seen = self._folder(table), Observation()
        part = ORDER_DATE if table == "orders" else BUCKET
        # Rebalancing splits hot parts; the metrics are taken after it, in the writing tasks.
        out = with_part(df, table).hint("rebalance", part).observe(seen, *[c.alias(n) for n, c in metrics.items()])
        out.select(*SCHEMAS[table], part).write.partitionBy(part).parquet(f"{self.root}/{folder}")
        path, files = self._path(folder)
        names = [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()]
        return folder, names, seen.get

    def _replaced(self, table: str, df: DataFrame, metrics: dict[str, Column] | None = None) -> tuple[list[dict], dict]:
        folder, parts, seen = self._write(table, df, {"rows": F.count(F.lit(1)), **(metrics or {})})
        head = {"table_name": table, "kind": "table", "row_count": seen["rows"], "replaces": True}
        return [head] + [{"table_name": table, "kind": "part", "part": p, "folder": folder} for p in parts], seen

    def save(self, tables: dict[str, DataFrame]) -> int:
        """Store full tables as the next version, parents first."""
        ordered = [n for n in TABLE_NAMES if n in tables] + [n for n in tables if n not in TABLE_NAMES]
        return self._commit(lambda _: [e for n in ordered for e in self._replaced(n, tables[n])[0]], depends=False)

    def _merged(self, table: str, stored: StoredTable, incoming: DataFrame, keys: list[str],
                metrics: dict[str, Column] | None = None) -> tuple[list[dict], dict]:
        """Rewrite the parts that hold keys of ``incoming`` or that its rows go to; the others keep their files.
        ``incoming`` is read twice, so it should be stored."""
        stamped, part = with_part(incoming, table), ORDER_DATE if table == "orders" else BUCKET
        base = self._base(table, stored.parts)
        wanted = stamped.select(part)
        if part == ORDER_DATE:  # an order may have moved to another date
            wanted = wanted.unionByName(base.join(incoming.select(*keys), keys, "left_semi").select(part))
        names = {f"{part}={NO_PART if r[0] is None else r[0]}" for r in wanted.distinct().collect()}
        old = self._base(table, {p: f for p, f in stored.parts.items() if p in names}).drop(part)
        rest = [c for c in SCHEMAS[table] if c not in keys]
        extra = [c for c in incoming.columns if c not in SCHEMAS[table]]
        one = old.select(*keys, F.struct(*rest).alias("_old"))
        two = incoming.select(*keys, F.struct(*rest).alias("_new"), *extra)
        both = one.join(two, keys, "full").select(
            *keys, F.coalesce("_new", "_old").alias("_row"), (F.col("_old").isNull()).alias("_added"), *extra)
        folder, written, seen = self._write(
            table, both.select(*keys, "_row.*", "_added", *extra), {"added": F.count_if("_added"), **(metrics or {})})
        total = None if stored.row_count is None else stored.row_count + seen["added"]
        head = {"table_name": table, "kind": "table", "row_count": total, "replaces": False}
        gone = sorted((names & set(stored.parts)) - set(written))
        return [head] + [{"table_name": table, "kind": "part", "part": p, "folder": folder} for p in written] + [
            {"table_name": table, "kind": "part", "part": p} for p in gone], seen

    def upsert(self, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None,
               latest: str | None = None) -> int:
        """Replace rows with equal keys, keep the others, add new ones. Only the parts that the keys touch
        are rewritten."""
        def build(state: State) -> list[dict]:
            out = []
            for name, df in tables.items():
                by = (keys or {}).get(name, ["id"])
                incoming = latest_per_key(df, by, latest).select(*SCHEMAS[name])
                stored = state.tables.get(name)
                if stored is None:
                    out += self._replaced(name, incoming)[0]
                else:
                    out += self._merged(name, self._settled(name, stored, out), self._staged(incoming), by)[0]
            return out
        return self._commit(build, depends=True)

    def _staged(self, df: DataFrame) -> DataFrame:
        """``df`` written to the scratch folder, so that a merge computes it once."""
        path = shared_path(self.spark, "incoming")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _settled(self, table: str, stored: StoredTable, entries: list[dict]) -> StoredTable:
        """``stored`` with its added rows merged; the entries of that go to ``entries``."""
        if not stored.deltas:
            return stored
        added, keys = self._added(table, stored)
        merged, _ = self._merged(table, stored, added, keys)
        merged[0]["merged_until"] = max(v for v, _, _ in stored.deltas)
        entries += merged
        parts = dict(stored.parts)
        for e in merged[1:]:
            if "folder" in e:
                parts[e["part"]] = e["folder"]
            else:
                parts.pop(e["part"], None)
        return StoredTable(stored.version, merged[0]["row_count"], parts)

    def append(self, table: str, df: DataFrame, keys: list[str], stream: str, batch_id: int,
               latest: str | None = None) -> int:
        """Add the rows of one batch; they go before stored rows of equal keys until ``compact`` merges
        them. What is written follows the batch, not the table. A batch that is already in the log
        (a replay) changes nothing."""
        def build(state: State) -> list[dict]:
            if state.batches.get(stream, -1) >= batch_id:
                return []
            folder = self._folder(table).replace("/write=", "/added=")
            self._once(df, keys, latest).select(*SCHEMAS[table]).write.option("compression", "zstd").parquet(
                f"{self.root}/{folder}")
            return [{"table_name": table, "kind": "table", "row_count": None, "replaces": False},
                    {"table_name": table, "kind": "delta", "folder": folder, "keys": keys, "stream": stream,
                     "batch_id": batch_id}]
        return self._commit(build, depends=False)

    def compact(self, table: str) -> int:
        """Merge the rows added by batches into the parts that they touch."""
        def build(state: State) -> list[dict]:
            entries: list[dict] = []
            self._settled(table, state.tables[table], entries)
            return entries
        return self._commit(build, depends=True)

    def load(self, silver: Silver, clean: bool = False, enforce: bool = False) -> int:
        """``clean`` forgets what was there, else rows are merged by id. Either way a row that comes
        twice in one load is stored once.

        With ``enforce`` (as the load job does), codes, required values, keys and references are counted while
        the rows are written; a load that breaks one stops with ``LoadRejected`` before its version is published.
        """
        def build(state: State) -> list[dict]:
            entries, broken, parents = [], [], {}
            for name, df in silver.tables().items():
                stored = None if clean else state.tables.get(name)
                incoming = latest_per_key(df, ["id"], None).select(*SCHEMAS[name])
                rules: dict[str, Column] = {}
                if enforce:
                    incoming, rules = with_rule_marks(incoming, name, parents)
                if stored is None:
                    found, seen = self._replaced(name, incoming, rules)
                else:
                    found, seen = self._merged(name, self._settled(name, stored, entries), self._staged(incoming), ["id"], rules)
                broken += [(name, *rule.split("|"), seen[rule]) for rule in rules if seen[rule]]
                entries += found
                written = {e["part"]: e["folder"] for e in found if e.get("kind") == "part" and "folder" in e}
                parents[name] = self._base(name, {**(stored.parts if stored else {}), **written}).select("id")
            if broken:
                for folder in {e["folder"] for e in entries if "folder" in e}:
                    path, files = self._path(folder)
                    files.delete(path, True)  # written by this load and named nowhere
                raise LoadRejected(broken)
            return entries
        return self._commit(build, depends=True)


def with_part(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the column that its stored folders are named by."""
    if table == "orders":
        return df.withColumn(ORDER_DATE, F.to_date("created_at"))
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(BUCKETS)).cast("int"))


def with_rule_marks(df: DataFrame, table: str, parents: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with a mark per rule of codes, required values, references and natural keys, and the counts
    of the marks as aggregates. Rows stored before carry no marks, so only new rows are judged."""
    marks = {name: F.coalesce(broken, F.lit(False)) for name, broken in quality.row_rules(table).items()}
    for child, column, parent in quality.REFERENCES:
        if child == table and parent in parents:
            key = f"_{column}_id"
            df = df.join(parents[parent].select(F.col("id").alias(key)), F.col(column) == F.col(key), "left")
            marks[f"reference|{column}"] = F.col(key).isNull() & F.col(column).isNotNull()
    for keys in quality.KEYS.get(table, []):
        if keys != ["id"]:  # one row per id is kept before
            again, same = "_again_" + "_".join(keys), F.lit(True)
            copies = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(
                (F.count(F.lit(1)) > 1).alias(again)).filter(again)
            for k in keys:
                same = same & (F.col(k) == F.col(f"_key_{k}"))
            df = df.join(copies, same, "left").drop(*[f"_key_{k}" for k in keys])
            marks[f"unique|{', '.join(keys)}"] = F.coalesce(again, F.lit(False))
    named = {rule: f"_rule_{i}" for i, rule in enumerate(marks)}
    marked = df.select(*SCHEMAS[table], *[c.alias(named[rule]) for rule, c in marks.items()])
    return marked, {rule: F.count_if(mark) for rule, mark in named.items()}


def latest_per_key(df: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row per key, the last by ``order``; rows without an order value come first, and rows of
    equal order are told apart by a hash of their contents, so every run picks the same one."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    # A struct is never null, so a key of which no row has an order value keeps a row too.
    place = F.struct(*([F.col(order).alias("at")] if order else []),
                     F.xxhash64(*[F.col(c) for c in rest]).alias("tie"))
    pick = F.max_by(row, place)
    out = df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*")
    return out.select(*df.columns)


def load_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of all tables in one job."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out


def query(spark: SparkSession, sql: str) -> DataFrame:
    """Run a read-only statement over the registered tables and marts."""
    require_read_only(sql)
    return spark.sql(sql)
