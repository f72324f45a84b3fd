"""The catalogue's rows: schema, derived columns, and rows of other shapes brought to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions import text as X

_TYPES = {"bigint": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _struct(fields: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(","))])


# The fields of an entry.
SCHEMA = _struct(
    "id bigint, path string, name string, extension string, size bigint, modified bigint, created bigint, changed bigint, modified_ns bigint, changed_ns bigint, is_dir boolean, is_symlink boolean, file_id bigint, parent_id bigint, volume_id string, flags bigint, properties string, content_indexed boolean"
)
CONTENT_SCHEMA = _struct("path string, body string, properties string")
#: Columns a generation stores ready-made.
DERIVED = {
    "folded_name": lambda: X.fold_column("name"),
    "folded_path": lambda: X.fold_column("path"),
    "search_name": lambda: X.fold_search_column("name"),
    "search_path": lambda: X.fold_search_column("path"),
    "stripped_name": lambda: X.stripped_column("name"),
    "stripped_path": lambda: X.stripped_column("path"),
    "search_extension": lambda: X.fold_search_column("extension"),
    "name_key": lambda: X.natural_key(X.fold_column("name")),
    "path_key": lambda: X.natural_key(X.fold_column("path")),
}


def parent_path(path: Column) -> Column:
    """What stands before the last '/', '/' itself for what lies directly below it, '' without any parent."""
    cut = F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)
    # Doubled and trailing slashes are rare; only they need patterns.
    bare = F.regexp_replace(F.regexp_replace(path, r"(?s)(?<=.)/+\z", ""), r"/+[^/]*\z", "")
    odd = F.when(path.rlike(r"\A/+\z"), "").when(bare == "", "/").otherwise(bare)
    return F.when(~path.contains("/"), "").when(path.endswith("/") | cut.endswith("/"), odd).when(cut == "", "/").otherwise(cut)


def derived(df: DataFrame, name: str) -> Column:
    """The stored column if there is one, else the expression."""
    return F.col(name) if name in df.columns else DERIVED[name]()


def prepare(files: DataFrame, content: DataFrame | None = None) -> DataFrame:
    """Rows ready to be stored: missing columns as nulls, derived columns, the text body where known, and whether the
    entry is accessible, if the rows tell. Of several bodies of one path the greatest (body, properties) counts."""
    df = files.select(*[(F.col(f.name) if f.name in files.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA], *[c for c in files.columns if c in ("body", "accessible")])
    if content is not None:
        c = content.groupBy("path").agg(F.max(F.struct("body", "properties")).alias("_c")).select("path", F.col("_c.body").alias("body"), F.col("_c.properties").alias("_props"))
        df = df.drop("body").join(c, "path", "left").withColumn("properties", F.coalesce("_props", "properties")).drop("_props")
    elif "body" not in df.columns:
        df = df.withColumn("body", F.lit(None).cast("string"))
    return df.withColumns({k: e() for k, e in DERIVED.items()}).withColumn("search_body", X.fold_search_column("body"))


def ancestors(path: Column) -> Column:
    """All folder paths above `path`, '/' not among them; empty where there are none."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
