"""Tables in versions: data files are written once, a version is a list of them, and only one writer gets the next version.

A table is a folder: data/ holds files, manifests/ a list of files with the
bounds of key columns for each version, and versions/<number> names the list
and the schema. A version is there when its file in versions/ is, which is
made under a name that must not exist yet; of two writers the second finds it
taken and starts anew from the newer version. Readers see one version whole.
Lists of files go through the driver: a row of a few bytes for each data file.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import drop_tables, table_mark, written
from .dedup import mark_first

#: Rows that a data file has, about.
FILE_ROWS = 1_000_000
#: Ranges of new keys that files are held against before their keys are read.
RANGES = 64


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to be."""


@dataclass(frozen=True)
class Version:
    """A published version: its number, data files' list, schema and the columns whose bounds the list has."""

    number: int
    manifest: str
    schema: T.StructType
    bounds: tuple[str, ...]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def latest(spark: SparkSession, path: str) -> Version | None:
    """The newest version; None for a table that no one has written."""
    fs, p = _fs(spark, f"{path}/versions")
    if not fs.exists(p):
        return None
    numbers = [int(n) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.isdigit()]
    return at_version(spark, path, max(numbers)) if numbers else None


def at_version(spark: SparkSession, path: str, number: int) -> Version:
    said = json.loads(spark.read.text(f"{path}/versions/{number:020d}").first()[0])
    return Version(number, said["manifest"], T.StructType.fromJson(said["schema"]), tuple(said["bounds"]))


def _publish(spark: SparkSession, path: str, version: Version) -> None:
    """Makes a version under its number, or raises Conflict where it is there already."""
    fs, draft = _fs(spark, f"{path}/versions/.draft-{uuid.uuid4().hex}")
    _, final = _fs(spark, f"{path}/versions/{version.number:020d}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps({"manifest": version.manifest, "schema": version.schema.jsonValue(), "bounds": version.bounds}).encode()))
    out.close()
    jvm = spark._jvm
    try:
        if fs.getUri().getScheme() == "file":
            # A rename on a local disk replaces what is there; a link does not.
            where = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(where(final), where(draft))
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, final, options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            raise Conflict(f"version {version.number} of {path} is taken") from None
        raise
    finally:
        fs.delete(draft, False)


def _file_list(spark: SparkSession, path: str, version: Version) -> DataFrame:
    """(file, rows, low, high): low and high are structs of the least and greatest value of the bounded columns."""
    return spark.read.parquet(f"{path}/{version.manifest}")


def _rows_of(spark: SparkSession, path: str, schema: T.StructType, files: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in files]) if files else spark.createDataFrame([], schema)


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, low, high) of the newest version."""
    return _file_list(spark, path, latest(spark, path))


def rows_of_files(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """Rows of files of the newest version, and the __file of each."""
    name = F.concat(F.lit("data/"), F.substring_index("_metadata.file_path", "/", -2)).alias("__file")
    schema = latest(spark, path).schema
    if not files:
        return spark.createDataFrame([], schema).withColumn("__file", F.lit(None).cast("string"))
    return _rows_of(spark, path, schema, files).select(*[F.col(f"`{f.name}`") for f in schema.fields], name)


def _write_files(df: DataFrame, path: str, bounds: tuple[str, ...]) -> DataFrame:
    """Writes df below data/ and returns its part of a list of files."""
    spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    made = spark.read.schema(df.schema).parquet(f"{path}/{folder}")
    of = lambda f: F.struct(*[f(F.col(f"`{c}`")).alias(c) for c in bounds]) if bounds else F.struct(F.lit(None).cast("int").alias("none"))
    return made.groupBy(F.concat(F.lit(f"{folder}/"), F.col("_metadata.file_name")).alias("file")).agg(F.count("*").alias("rows"), of(F.min).alias("low"), of(F.max).alias("high"))


def _next(spark: SparkSession, path: str, base: Version | None, files: list[DataFrame], schema: T.StructType, bounds: tuple[str, ...]) -> Version:
    """Writes the list of files of the version after base and publishes it."""
    manifest = f"manifests/{uuid.uuid4().hex}"
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), files).coalesce(1).write.parquet(f"{path}/{manifest}")
    version = Version(0 if base is None else base.number + 1, manifest, schema, bounds)
    _publish(spark, path, version)
    return version


def overlapping(bounds: dict[str, tuple]) -> Column:
    """Whether a file (low, high) can have rows within all of the ranges (column: least, greatest; None is open)."""
    ok = F.lit(True)
    for c, (least, most) in bounds.items():
        if least is not None:
            ok = ok & (F.col(f"high.`{c}`") >= F.lit(least))
        if most is not None:
            ok = ok & (F.col(f"low.`{c}`") <= F.lit(most))
    return ok


def read(spark: SparkSession, path: str, box: dict[str, tuple] | None = None, number: int | None = None) -> DataFrame:
    """The newest version (or the one of a number), with a box only rows within its ranges (column: least, greatest), of whose files only those that can have some are read."""
    version = latest(spark, path) if number is None else at_version(spark, path, number)
    if version is None:
        raise FileNotFoundError(f"no table at {path}")
    files = _file_list(spark, path, version)
    box = box or {}
    known = {c: r for c, r in box.items() if c in version.bounds}
    out = _rows_of(spark, path, version.schema, [r["file"] for r in files.filter(overlapping(known)).select("file").collect()])
    for c, (least, most) in box.items():
        if least is not None:
            out = out.filter(F.col(f"`{c}`") >= F.lit(least))
        if most is not None:
            out = out.filter(F.col(f"`{c}`") <= F.lit(most))
    return out


def _merged_schema(a: T.StructType, b: T.StructType) -> T.StructType:
    names = {f.name for f in a.fields}
    return T.StructType([*a.fields, *[f for f in b.fields if f.name not in names]])


def _touched(spark: SparkSession, path: str, base: Version, keys: DataFrame, pk: list[str]) -> list[str]:
    """Files that have any of the keys: first those whose bounds meet a range of keys, then, of these, those whose key columns have one."""
    ranges = keys.repartitionByRange(RANGES, *pk).groupBy(F.spark_partition_id()).agg(F.min(pk[0]).alias("a"), F.max(pk[0]).alias("b")).collect()
    if not ranges:
        return []
    files = _file_list(spark, path, base)
    if pk[0] in base.bounds:
        files = files.filter(reduce(lambda a, b: a | b, [overlapping({pk[0]: (r["a"], r["b"])}) for r in ranges]))
    near = [r["file"] for r in files.select("file").collect()]
    if not near:
        return []
    held = _rows_of(spark, path, base.schema, near).select(*pk, F.concat(F.lit("data/"), F.substring_index("_metadata.file_path", "/", -2)).alias("__file"))
    return [r["__file"] for r in held.join(keys, pk, "left_semi").select("__file").distinct().collect()]


def upsert(new: DataFrame, path: str, pk: list[str], order: tuple[str, ...] = (), file_rows: int = FILE_ROWS, tries: int = 10) -> Version:
    """The next version of a table, in which rows of `new` stand for those of their keys.

    Only files that have one of the keys are written anew, without these rows
    and with the new ones; all others stay. Of new rows that share a key the
    first by `order` counts (then by the hash of the row). A row with a null in
    its key equals no other: it replaces none and stays beside the rest.
    A failure leaves the table as it was; where another writer was faster, all
    is done again over its version, `tries` times.
    """
    spark, mark = new.sparkSession, table_mark()
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in pk])
    first = mark_first(new.filter(whole), pk, [F.col(c) for c in order], "__first")
    # Computed once, however often it is tried.
    rows = written(first.filter("__first").drop("__first").unionByName(new.filter(~whole)), "upsert")
    keys, n = rows.filter(whole).select(*pk), rows.count()
    try:
        for _ in range(tries):
            base = latest(spark, path)
            bounds = tuple(dict.fromkeys([*pk, *(base.bounds if base else ())]))
            if base is None:
                parts, out, schema = [], rows, rows.schema
            else:
                files, touched = _file_list(spark, path, base), _touched(spark, path, base, keys, pk)
                parts = [files.filter(~F.col("file").isin(touched)) if touched else files]
                held = _rows_of(spark, path, base.schema, touched)
                out, schema = held.join(keys, pk, "left_anti").unionByName(rows, allowMissingColumns=True), _merged_schema(base.schema, rows.schema)
                n += files.filter(F.col("file").isin(touched)).agg(F.sum("rows")).first()[0] or 0 if touched else 0
            out = out.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields])
            dealt = out.repartitionByRange(max(1, -(-n // file_rows)), *pk).sortWithinPartitions(*pk)
            added = _write_files(dealt, path, bounds)
            try:
                return _next(spark, path, base, [*parts, added], schema, bounds)
            except Conflict:
                continue
        raise Conflict(f"{tries} tries to publish a version of {path} met other writers")
    finally:
        drop_tables(spark, mark)


def replace(df: DataFrame, path: str, base: Version | None, bounds: tuple[str, ...] = ()) -> Version:
    """df as the version after base; raises Conflict where that is there already."""
    return _next(df.sparkSession, path, base, [_write_files(df, path, bounds)], df.schema, bounds)


def append(df: DataFrame, path: str, bounds: tuple[str, ...] = (), tries: int = 10) -> Version:
    """The next version: the files there are and those of df."""
    spark = df.sparkSession
    for _ in range(tries):
        base = latest(spark, path)
        bounds = tuple(dict.fromkeys([*bounds, *(base.bounds if base else ())]))
        schema = df.schema if base is None else _merged_schema(base.schema, df.schema)
        have = df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)) for f in schema.fields])
        try:
            return _next(spark, path, base, [*([] if base is None else [_file_list(spark, path, base)]), _write_files(have, path, bounds)], schema, bounds)
        except Conflict:
            continue
    raise Conflict(f"{tries} tries to publish a version of {path} met other writers")


# ---- clustering ------------------------------------------------------------


def _number(c: str, kind: T.DataType) -> Column:
    """A number that rises with the value; of text with its first seven bytes."""
    col = F.col(f"`{c}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.conv(F.hex(F.rpad(F.substring(col.cast("binary"), 1, 7), 7, F.lit(b"\0"))), 16, 10).cast("double")
    return F.unix_micros(col.cast("timestamp")).cast("double") if isinstance(kind, (T.DateType, T.TimestampType)) else col.cast("double")


def interleaved(df: DataFrame, keys: list[str], bits: int = 6) -> Column:
    """The bits of the keys' places in turn, the highest first (Z order); a place is one of 2 ** bits ranges of about equal counts, nulls are in the first."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = df.agg(*[F.approx_percentile(_number(c, kinds[c]), F.array(*map(F.lit, shares)), 10_000).alias(f"b{k}") for k, c in enumerate(keys)]).first()

    def place(number: Column, bounds: list[float]) -> Column:
        return F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: number > b)), F.lit(0))

    places = [place(_number(c, kinds[c]), list(map(float, found[k] or []))) for k, c in enumerate(keys)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(p, bit).bitwiseAND(1).cast("long"), bit * len(keys) + k) for bit in range(bits) for k, p in enumerate(places)])


def cluster(spark: SparkSession, path: str, keys: list[str], file_rows: int = FILE_ROWS, tries: int = 10) -> Version:
    """The same rows as a next version in few files, near in the keys: by range of one key, in Z order of several. Readers of the version before go on."""
    for _ in range(tries):
        base = latest(spark, path)
        df = read(spark, path, number=base.number)
        bounds = tuple(dict.fromkeys([*keys, *base.bounds]))
        files = max(1, -(-(_file_list(spark, path, base).agg(F.sum("rows")).first()[0] or 0) // file_rows))
        if len(keys) == 1:
            dealt = df.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
        else:
            dealt = df.withColumn("__z", interleaved(df, keys)).repartitionByRange(files, "__z").sortWithinPartitions("__z").drop("__z")
        try:
            return replace(dealt, path, base, bounds)
        except Conflict:
            continue
    raise Conflict(f"{tries} tries to publish a version of {path} met other writers")


def vacuum(spark: SparkSession, path: str, keep: int = 5) -> list[str]:
    """Deletes data files that the last `keep` versions do not have, and the older versions; returns the files. Files of writers that have not published are left."""
    newest = latest(spark, path)
    if newest is None or newest.number < keep:
        return []
    fs, p = _fs(spark, f"{path}/versions")
    numbers = sorted(int(n) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.isdigit())
    old, kept = ([at_version(spark, path, n) for n in part] for part in (numbers[:-keep], numbers[-keep:]))
    if not old:
        return []
    union = lambda vs: reduce(DataFrame.union, [_file_list(spark, path, v).select("file") for v in vs])
    gone = [r["file"] for r in union(old).distinct().join(union(kept).distinct(), "file", "left_anti").collect()]
    for name in [*gone, *[v.manifest for v in old], *[f"versions/{v.number:020d}" for v in old]]:
        fs, p = _fs(spark, f"{path}/{name}")
        fs.delete(p, True)
    return sorted(gone)
