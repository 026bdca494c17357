"""Schema validation of records: every violation with its path, not just the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from restomart.sources.export_specs import RECORDS
from restomart.sources.exports import CORRUPT, Exports, read_exports, read_records

PROBLEM = "struct<path: string, message: string>"
# Type names in messages.
TYPE_NAMES = {"string": "string", "bigint": "number", "boolean": "boolean"}


def _problem(path: Column, message: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(message).alias("message"))).cast(
        f"array<{PROBLEM}>")


def _none() -> Column:
    return F.array().cast(f"array<{PROBLEM}>")


def _step(path: Column, name) -> Column:
    return F.concat(path, F.lit("."), name if isinstance(name, Column) else F.lit(name))


def _problems(value: Column, spec, path: Column) -> Column:
    if isinstance(spec, dict):
        inner = [_problems(value[k], v, _step(path, k)) for k, v in spec.items() if k != "?"]
        missing = _none() if "?" in spec else _problem(path, "expected object")
        return F.when(value.isNull(), missing).otherwise(F.concat(*inner))
    if isinstance(spec, list):
        missing = _none() if "?" in spec[1:] else _problem(path, "expected array")
        each = F.flatten(F.transform(
            value, lambda x, i: _problems(x, spec[0], _step(path, i.cast("string")))))
        return F.when(value.isNull(), missing).otherwise(each)
    kind, _, literal = spec.partition("=")
    if literal:
        return F.when(~value.eqNullSafe(F.lit(literal)),
                      _problem(path, f"expected {literal}")).otherwise(_none())
    if kind.endswith("?"):
        return _none()
    return F.when(value.isNull(), _problem(path, f"expected {TYPE_NAMES[kind]}")).otherwise(_none())


def record_problems(spec: dict) -> Column:
    """Array of (path, message) of one record held in top-level columns."""
    return F.concat(*[_problems(F.col(k), v, F.lit(k)) for k, v in spec.items()])


def _with_unparsed(df: DataFrame, problems: Column) -> Column:
    """A line that did not parse as declared has that problem if no other shows it."""
    if CORRUPT not in df.columns:
        return problems
    return F.when(F.col(CORRUPT).isNotNull() & (F.size(problems) == 0),
                  _problem(F.lit(""), "does not parse as declared")).otherwise(problems)


def problems_of(df: DataFrame, kind: str) -> Column:
    """Array of (path, message) of each record of a declared kind."""
    return _with_unparsed(df, record_problems(RECORDS[kind][0]))


def validate_records(df: DataFrame, spec: dict) -> DataFrame:
    """(file, record, path, message), one row per violation. ``df`` has file and seq."""
    found = df.withColumn("_problems", _with_unparsed(df, record_problems(spec)))
    return (found.select("file", F.col("seq.position").alias("record"),
                         F.explode("_problems").alias("p"))
            .select("file", "record", "p.path", "p.message"))


class InvalidExports(ValueError):
    """Exports that do not fit their declaration; ``counts`` has (file, path, message, violations)."""

    def __init__(self, counts: list):
        self.counts = counts
        lines = [f"{c['file']}: {c['path'] or 'document'}: {c['message']} ({c['violations']}x)" for c in counts]
        super().__init__("exports are not valid:\n" + "\n".join(lines))


def checked_exports(spark: SparkSession, toast: str, doordash: str, square: str,
                    layout: str = "document", show: int = 50) -> Exports:
    """The exports, or ``InvalidExports`` with the most frequent violations of all files.

    A field that does not fit its type would be read as null and a broken document as nothing, so
    nothing may be normalized before this passes.
    """
    paths = {"toast_orders": toast, "doordash_orders": doordash} | {
        f"square_{n}": f"{square}/{n}.json" for n in ("locations", "catalog", "orders", "payments")}
    found = validate_exports(spark, paths, layout).groupBy("file", "path", "message").agg(
        F.count(F.lit(1)).alias("violations")).orderBy(F.desc("violations"), "file", "path").limit(show).collect()
    if found:
        raise InvalidExports(found)
    return read_exports(spark, toast, doordash, square, layout)


def validate_exports(spark: SparkSession, paths: dict[str, str],
                     layout: str = "document") -> DataFrame:
    """All violations of all files together; ``paths`` maps record kinds to locations."""
    out = None
    for kind, path in paths.items():
        found = validate_records(
            read_records(spark, kind, path, layout, keep_corrupt=True), RECORDS[kind][0])
        out = found if out is None else out.unionByName(found)
    return out
