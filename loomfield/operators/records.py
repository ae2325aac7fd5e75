"""Record cleaning, validation, de-duplication, snapshots and merges as DataFrame transformations."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from loomfield.functions.scalar import is_falsy, normalize_record_url, null_string, record_key, strip_control

Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class FieldRule:
    type: str = "string"
    required: bool = False
    default: Any = None


def validate(df: DataFrame, schema: Mapping[str, FieldRule]) -> DataFrame:
    """Fields cast to their types; rows lacking a required field, or whose required field doesn't cast, go."""
    out = df
    for name, rule in schema.items():
        out = out.withColumn(name, F.col(name).try_cast(rule.type))
    needed = [F.col(n).isNotNull() for n, r in schema.items() if r.required]
    return out.where(reduce(lambda a, b: a & b, needed)) if needed else out


def coerce(df: DataFrame, schema: Mapping[str, FieldRule]) -> DataFrame:
    """Fields cast leniently: what doesn't cast, or is missing, becomes the default."""
    out = df
    for name, rule in schema.items():
        have = F.col(name).try_cast(rule.type) if name in df.columns else F.lit(None).cast(rule.type)
        out = out.withColumn(name, F.coalesce(have, F.lit(rule.default).cast(rule.type)))
    return out


def clean_strings(df: DataFrame, collapse_ws: bool = True) -> DataFrame:
    return df.select(*[strip_control(F.col(c), collapse_ws).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def null_falsy(df: DataFrame, *keep: str) -> DataFrame:
    """Falsy fields become null, as a table has no absent fields."""
    return df.select(*[F.col(c) if c in keep else F.when(~is_falsy(F.col(c), t), F.col(c)).alias(c) for c, t in df.dtypes])


def normalize_keys(df: DataFrame) -> DataFrame:
    """Lower-case names with underscores, private columns dropped, string values trimmed."""
    kept = [(c, t) for c, t in df.dtypes if not c.startswith("_")]
    return df.select(*[(F.trim(F.col(f"`{c}`")) if t == "string" else F.col(f"`{c}`")).alias(record_key(c)) for c, t in kept])


def compose(df: DataFrame, stages: Sequence[tuple[int, Stage]]) -> DataFrame:
    """Stages by priority; equal ones in the given order."""
    return reduce(lambda d, s: d.transform(s[1]), sorted(stages, key=lambda s: s[0]), df)


# ---- de-duplication


def first_wins(df: DataFrame, key: Column, seq: Sequence[Column]) -> DataFrame:
    """The first row by seq of each key; rows without a key all stay.  The first row is found by a partially
    aggregated minimum, so that a hot key doesn't meet in one sort: seq must identify a row."""
    tagged = df.withColumn("__key", key).withColumn("__seq", F.struct(*[c.alias(f"s{i}") for i, c in enumerate(seq)]))
    first = tagged.where("__key is not null").groupBy("__key").agg(F.min("__seq").alias("__seq"))
    kept = tagged.join(first, ["__key", "__seq"], "left_semi").unionByName(tagged.where("__key is null"))
    return kept.drop("__key", "__seq")


def record_hash(df: DataFrame, leave: Sequence[str] = ()) -> Column:
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c not in leave])))


def unique_records(df: DataFrame, url: str, seq: Sequence[Column], leave: Sequence[str] = ()) -> DataFrame:
    """One row per normalised url, or per content where the url is empty; the first stays."""
    normal = normalize_record_url(F.coalesce(F.col(url), F.lit("")))
    return first_wins(df, F.coalesce(F.nullif(normal, F.lit("")), record_hash(df, leave)), seq)


def merge(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def insert_or_ignore(table: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return table.unionByName(new.join(table.select(*key).distinct(), list(key), "left_anti"), allowMissingColumns=True)


def upsert(table: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return table.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def latest(df: DataFrame, key: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The last row of each key by ``by``, which must identify a row."""
    rest = [c for c in df.columns if c not in key]
    top = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("__r"))
    return top.select(*key, "__r.*").select(*df.columns)


# ---- snapshots


def new_items(new: DataFrame, old: DataFrame, key: str, changed: bool = False, leave: Sequence[str] = ()) -> DataFrame:
    """Rows of new whose key the snapshot lacks; with ``changed`` also those whose content differs.  Null is
    a key like others."""
    if changed:
        mark = lambda d: d.withColumn("__h", record_hash(d, leave))
        a, b = mark(new).alias("a"), mark(old).alias("b")
        same = F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")) & (F.col("a.__h") == F.col("b.__h"))
        return a.join(b, same, "left_anti").drop("__h")
    a, b = new.alias("a"), old.select(key).distinct().alias("b")
    return a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "left_anti")


# ---- export shapes


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Structs to columns a_b; lists of scalars joined by "; ", other lists as JSON; timestamps as ISO."""

    def columns(schema, path, name):
        out = []
        for f in schema.fields:
            at, to = f"{path}.`{f.name}`" if path else f"`{f.name}`", f"{name}{sep}{f.name}" if name else f.name
            kind = f.dataType.typeName()
            if kind == "struct":
                out += columns(f.dataType, at, to)
            elif kind == "array":
                inner = f.dataType.elementType.typeName()
                c = F.to_json(F.col(at)) if inner in ("struct", "array", "map") else F.array_join(F.transform(F.col(at), lambda x: x.cast("string")), "; ")
                out.append(c.alias(to))
            elif kind in ("map", "variant"):
                out.append(F.to_json(F.col(at)).alias(to))
            elif kind in ("timestamp", "timestamp_ntz"):
                out.append(F.date_format(F.col(at), "yyyy-MM-dd'T'HH:mm:ss").alias(to))
            else:
                out.append(F.col(at).alias(to))
        return out

    return df.select(*columns(df.schema, "", ""))


def export_columns(df: DataFrame, null_text: str = "") -> DataFrame:
    """All columns as strings in alphabetical order, nulls as null_text."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(null_text)).alias(c) for c in sorted(df.columns)])


def unwrap_response(df: DataFrame, body: str, keep: Sequence[str]) -> DataFrame:
    """REST bodies to items: a list's items, else those of the first of data, results, items, products that
    is a list, else the object itself."""
    v = F.try_parse_json(F.col(body))
    whole = F.try_variant_get(v, "$", "array<variant>")
    inner = [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("data", "results", "items", "products")]
    items = F.coalesce(whole, *inner, F.when(v.isNotNull(), F.array(v)))
    return df.select(*keep, F.posexplode(items).alias("pos", "__v")).select(*keep, "pos", F.to_json("__v").alias("item"))


def ensure(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """df with the named columns, null where it lacks them."""
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else (null_string() if t == "string" else F.lit(None).cast(t)).alias(c) for c, t in columns.items()])


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def map_rows(df: DataFrame, run: Callable[[dict], Iterable[dict] | dict | None], schema: str) -> DataFrame:
    """Rows that a user's function gives for each row: a dict, several, or none.  Rows go in Arrow batches, and
    what run() keeps is kept per worker; fields that it leaves out are null."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def batches(it):
        for b in it:
            out = []
            for row in b.to_pylist():
                got = run(row)
                out += [got] if isinstance(got, Mapping) else list(got or ())
            yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in arrow} for r in out], arrow)

    return df.mapInArrow(batches, schema)
