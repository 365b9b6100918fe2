"""Tabular sources and sinks.

CSV is always read with an explicit schema (no inference pass over the
data), multi-line quoted fields allowed, and the NA tokens of the
reference's CSV reader mapped to null explicitly.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scriptorium.session import materialize

# --- FIXED VALUES: strings the reference's CSV reader turns into missing values
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

METADATA_SCHEMA = T.StructType([
    T.StructField("ID", T.LongType(), True),
    T.StructField("Abstract", T.StringType(), True),
    T.StructField("Affiliations", T.StringType(), True),
    T.StructField("Publication_Date", T.StringType(), True),
    T.StructField("label", T.StringType(), True),
])


def require_columns(df: DataFrame, cols: Iterable[str], what: str = "input") -> DataFrame:
    """Fail at plan-build time when a needed column is absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks required column(s): {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, key: str, what: str = "input") -> DataFrame:
    """Q-K6: fail if a key appears twice (only the key column is shuffled;
    the check stops at the first duplicate found)."""
    dup = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"{what} has duplicate {key} {dup[0][key]!r}: one row per id is required")
    return df


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """fail if ``df`` is empty (reads at most one row)."""
    if not df.limit(1).collect():
        raise ValueError(f"{what} is empty: nothing left to train on")
    return df


def na_to_null(df: DataFrame, cols: Sequence[str] | None = None,
               tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Map the NA tokens to null in string columns."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.select(*[F.when(F.col(c).isin(*tokens), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line (reads only the first line)."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             required: Sequence[str] = ()) -> DataFrame:
    """S3: header CSV with quoted multi-line fields; NA tokens → null.

    Columns are matched to ``schema`` by *name* (Spark's CSV reader would
    apply a given schema by position): the file's own columns are read with
    the types the schema gives them (string otherwise), then the schema's
    columns are selected, absent optional ones as null.  ``required``
    columns must be present in the file (P13).
    """
    head = csv_header(spark, path)
    require_columns_list(head, required, path)
    wanted = {f.name: f.dataType for f in schema.fields}
    file_schema = T.StructType([T.StructField(c, wanted.get(c, T.StringType()), True) for c in head])
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .option("mode", "PERMISSIVE").schema(file_schema).csv(path))
    df = na_to_null(df)
    return df.select(*[F.col(f"`{f.name}`") if f.name in head else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def require_columns_list(columns: Sequence[str], required: Sequence[str], what: str) -> None:
    missing = [c for c in required if c not in columns]
    if missing:
        raise ValueError(f"{what} lacks required column(s): {', '.join(missing)}")


def read_csv_stream(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int = 1,
                    required: Sequence[str] = ()) -> DataFrame:
    """S3 as a stream source: same options and NA handling, columns matched
    by name against the header of the files already landed."""
    head = csv_header(spark, path)
    require_columns_list(head, required, path)
    wanted = {f.name: f.dataType for f in schema.fields}
    file_schema = T.StructType([T.StructField(c, wanted.get(c, T.StringType()), True) for c in head])
    df = (spark.readStream.option("header", True).option("multiLine", True).option("escape", '"')
          .option("maxFilesPerTrigger", max_files_per_trigger).schema(file_schema).csv(path))
    df = na_to_null(df)
    return df.select(*[F.col(f"`{f.name}`") if f.name in head else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def typed_id(df: DataFrame, id_col: str, id_type: str) -> DataFrame:
    """Ids as read from text in the wanted type.  An id that is no number fails
    the query where numbers are wanted; it does not become null."""
    if id_type == "string":
        return df
    number = F.trim(F.col(id_col)).try_cast(id_type)
    told = F.concat(F.lit(f"{id_col} is not a number (read it with id_type='string'): "), F.col(id_col))
    checked = F.when(number.isNull() & F.col(id_col).isNotNull(), F.raise_error(told).cast(id_type)).otherwise(number)
    return df.withColumn(id_col, checked)


def read_metadata(spark: SparkSession, path: str, required: Sequence[str] = ("ID",), id_type: str = "bigint") -> DataFrame:
    """The metadata table with the columns the operators use (matched by
    name; ``required`` ones must be in the file).  ``id_type`` "string" takes
    ids of any form."""
    schema = T.StructType([T.StructField("ID", T.StringType(), True) if f.name == "ID" else f for f in METADATA_SCHEMA.fields])
    return typed_id(read_csv(spark, path, schema, required), "ID", id_type)


def read_wide_embeddings(spark: SparkSession, path: str, id_col: str = "ID", id_type: str = "bigint") -> DataFrame:
    """A CSV with an id column and one column per feature →
    ``id, embedding array<double>`` (column order preserved).  ``id_type``
    "string" takes ids of any form."""
    head = spark.read.option("header", True).csv(path).columns  # header only, no data pass
    if id_col not in head:
        raise ValueError(f"embedding file lacks the {id_col!r} column")
    schema = T.StructType([T.StructField(c, T.StringType() if c == id_col else T.DoubleType(), True)
                           for c in head])
    df = typed_id(spark.read.option("header", True).schema(schema).csv(path), id_col, id_type)
    feats = [c for c in head if c != id_col]
    return df.select(F.col(id_col).alias("id"), F.array(*[F.col(f"`{c}`") for c in feats]).alias("embedding"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K4: header CSV, no index column; quotes inside fields are doubled
    (RFC 4180, as the reader above and common CSV tools expect); white space
    around a field is kept."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def land_raw(df: DataFrame, path: str, batch_col: str = "batch", mode: str = "append") -> None:
    """K3: keep raw payloads as data, one folder per batch."""
    df.write.mode(mode).partitionBy(batch_col).parquet(path)


# --- compound cache (S6, K6) ------------------------------------------------------

CACHE_SCHEMA = T.StructType([
    T.StructField("term", T.StringType(), False),
    T.StructField("molecular_formula", T.StringType(), True),
    T.StructField("iupac_name", T.StringType(), True),
    T.StructField("chebi_class", T.StringType(), True),
])


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The lookup cache; an absent cache is an empty table."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], CACHE_SCHEMA)
        raise


_ANSWER = "struct<molecular_formula:string,iupac_name:string,chebi_class:string>"


def read_cache_json(spark: SparkSession, path: str) -> DataFrame:
    """S6 in the reference's own format: files of one JSON object each, name →
    answer.  A file that is no such object fails the read instead of losing
    its answers.  An object is parsed whole in one task, so a large cache
    should be many files (:func:`write_cache_json`)."""
    whole = spark.read.text(path, wholetext=True)
    answers = F.from_json("value", f"map<string,{_ANSWER}>", {"mode": "FAILFAST"})
    return whole.select(F.explode(answers).alias("term", "a")).select("term", "a.*")


def write_cache_json(cache: DataFrame, path: str, n_objects: int = 1, mode: str = "overwrite") -> None:
    """K6 in the reference's own format: ``n_objects`` files of one JSON object
    each (one is the reference's single file); a name must occur once."""
    answer = F.struct(*[F.col(f.name) for f in CACHE_SCHEMA.fields if f.name != "term"])
    part = F.pmod(F.xxhash64("term"), F.lit(max(n_objects, 1)))
    entries = F.map_from_entries(F.collect_list(F.struct("term", answer)))
    objects = cache.groupBy(part.alias("_part")).agg(entries.alias("_map")).select(F.to_json("_map").alias("value"))
    objects.write.mode(mode).option("maxRecordsPerFile", 1).text(path)


def append_cache(new_rows: DataFrame, cache: DataFrame, path: str) -> DataFrame:
    """K6: append answers for names the cache does not hold yet (once per
    run, not once per hit); returns the rows written."""
    fresh = new_rows.select(*[F.col(f.name).cast(f.dataType) for f in CACHE_SCHEMA.fields]) \
        .dropDuplicates(["term"]).join(cache.select("term"), "term", "left_anti")
    # fixed before the write: the anti-join would see the appended rows afterwards
    fresh = materialize(fresh)
    fresh.write.mode("append").parquet(path)
    return fresh
