"""Result frames shaped for charts and tables; decisions come from the schema, not from row one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restomart.fixed_values import CHART_TYPES, TIME_AXIS_NAMES, TIME_AXIS_PARTS
from restomart.functions.text import header_label


@dataclass(frozen=True)
class ChartSpec:
    type: str
    x: str | None = None
    y: str | None = None
    columns: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class ColumnKinds:
    numeric: list[str]
    category: list[str]


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


# Fixed value: what reads as a number. A cast alone would also take 1d or 1f.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _reads_as_number(column: Column) -> Column:
    return (F.trim(column) == "") | F.trim(column).rlike(NUMBER)


def classify(df: DataFrame) -> ColumnKinds:
    """Number columns, and text columns whose every value reads as a number, are numeric."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    if texts:
        checks = df.agg(*[F.bool_and(_reads_as_number(_quoted(c))).alias(c) for c in texts]).first()
        numeric |= {c for c in texts if checks[c]}
    return ColumnKinds([c for c in df.columns if c in numeric],
                       [c for c in df.columns if c not in numeric])


def _first(names, default=None):
    return next(iter(names), default)


def choose_axes(columns: list[str], kinds: ColumnKinds, chart: str, empty: bool = False) -> ChartSpec:
    if chart not in CHART_TYPES:
        raise ValueError(f"unknown chart type {chart}")
    if empty or chart == "none":
        return ChartSpec(chart)
    if chart == "table":
        return ChartSpec(chart, columns=list(columns))
    if chart in ("radar", "radial"):
        return ChartSpec(chart, _first(kinds.category), _first(kinds.numeric))
    x = _first(kinds.category, _first(columns))
    if chart in ("line", "area"):
        clock = _first(c for c in kinds.numeric if c in TIME_AXIS_NAMES)
        dated = _first(c for c in kinds.category if any(p in c for p in TIME_AXIS_PARTS))
        x = clock or dated or x
    y = _first((c for c in kinds.numeric if c != x), _first(kinds.numeric))
    if y is None and chart in ("bar", "pie") and len(columns) > 1:
        y = columns[1]
    return ChartSpec(chart, x, y)


def chart_spec(df: DataFrame, chart: str) -> ChartSpec:
    if chart in ("none", "table"):
        return choose_axes(df.columns, ColumnKinds([], []), chart, df.isEmpty())
    return choose_axes(df.columns, classify(df), chart, df.isEmpty())


def format_values(df: DataFrame, kinds: ColumnKinds) -> DataFrame:
    """``*_cents`` become dollars under the shorter name; numeric texts become numbers."""
    out = []
    for f in df.schema.fields:
        c = _quoted(f.name)
        if f.name.endswith("_cents") and f.name in kinds.numeric:
            out.append((c.cast("double") / 100).alias(f.name.replace("_cents", "", 1)))
        elif f.name.endswith("_cents"):
            out.append(c.alias(f.name.replace("_cents", "", 1)))
        elif isinstance(f.dataType, T.StringType) and f.name in kinds.numeric:
            out.append(c.try_cast("double").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def format_for_chart(df: DataFrame, spec: ChartSpec, kinds: ColumnKinds) -> DataFrame:
    shaped = format_values(df, kinds)
    if spec.type == "pie" and spec.x and spec.y:
        renamed = lambda n: n.replace("_cents", "", 1) if n.endswith("_cents") else n
        extra = {}
        if spec.x != "name":
            extra["name"] = _quoted(renamed(spec.x))
        if spec.y != "value":
            extra["value"] = _quoted(renamed(spec.y))
        shaped = shaped.withColumns(extra)
    return shaped


def series(kinds: ColumnKinds, x: str | None, y: str | None) -> list[str]:
    """All numeric columns but x when there are several, else the chosen y."""
    found = [c for c in kinds.numeric if c != x]
    return found if len(found) > 1 else [y]


def wide_to_long(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Columns of a single wide row as (category, value) rows."""
    values = df.select(*[_quoted(c).cast("double").alias(c) for c in numeric])
    long = values.unpivot([], [f"`{c}`" for c in numeric], "category", "value")
    return long.withColumn("category", F.replace("category", F.lit("_"), F.lit(" ")))


def bar_frame(df: DataFrame, spec: ChartSpec, kinds: ColumnKinds) -> tuple[DataFrame, list[str]]:
    """(frame, series): one row with several numbers turns into rows."""
    if len(kinds.numeric) > 1 and len(df.take(2)) == 1:
        return wide_to_long(df, kinds.numeric), ["value"]
    return df, series(kinds, spec.x, spec.y)


def summary(df: DataFrame, order: list[str], rows: int = 10) -> dict:
    """Row count, columns and the first rows by an explicit order."""
    head = [r.asDict(recursive=True) for r in df.orderBy(*order).limit(rows).collect()]
    return {"row_count": df.count(), "columns": df.columns, "rows": head}


def display_text(df: DataFrame) -> DataFrame:
    """Every column as shown text, headed by its label."""
    out = []
    for f in df.schema.fields:
        c = _quoted(f.name)
        if isinstance(f.dataType, T.BooleanType):
            shown = F.when(c, "Yes").when(~c, "No")
        elif isinstance(f.dataType, T.NumericType):
            shown = F.expr(f"format_number(round(`{f.name}`, 3), '#,##0.###')")
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            shown = F.to_json(c)
        else:
            shown = c.cast("string")
        out.append(F.coalesce(shown, F.lit("-")).alias(f.name))
    return df.select(*out)


def header_labels(spark, names: list[str]) -> list[str]:
    rows = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    return [r.h for r in rows.select("i", header_label("n").alias("h")).orderBy("i").collect()]
