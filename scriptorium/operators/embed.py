"""Record embeddings.

The reference embeds each text block with a transformer ([CLS] vector of the
last layer, at most 512 tokens, batches of 50).  The engine keeps that shape
with a pluggable model run by ``predict_batch_udf`` (Arrow batches, the model
loaded once per Python worker), and ships a default embedder written only in
SQL expressions: signed feature hashing of all word pieces of the whole text,
L2 normalised.  It needs no model files and stays inside whole-stage codegen.
(A transformer only sees its first 512 tokens; ``max_tokens`` reproduces that
limit when wanted, the default embeds the whole text.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from scriptorium.functions import fixed_values as fv
from scriptorium.functions.text import let, word_pieces

DEFAULT_DIM = 64


def _bucket(digest: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(dim))


def _minus(digest: Column) -> Column:
    return (F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") >= 8).cast("int")


def hash_embedding(text: Column, dim: int = DEFAULT_DIM, max_tokens: int | None = None) -> Column:
    """P19 default: sum of ±1 per token in bucket md5(token) mod dim, L2
    normalised (all zeros for a text without tokens).

    Tokens become odd numbers by bucket and sign and are sorted among one even
    mark per bucket and sign; the distances between marks are the counts.  So
    a token costs its share of a sort, whatever the dimension."""
    toks = word_pieces(text)
    if max_tokens is not None:
        toks = F.slice(toks, 1, max_tokens)
    digests = F.transform(toks, F.md5)  # one digest per token: bucket and sign
    codes = F.transform(digests, lambda h: (4 * _bucket(h, dim) + _minus(h) * 2 + 1).cast("int"))
    ordered = F.sort_array(F.concat(codes, F.sequence(F.lit(0), F.lit(4 * dim), F.lit(2))))
    marks = F.filter(F.transform(ordered, lambda x, i: F.when(x % 2 == 0, i)), lambda i: i.isNotNull())

    def sums(at: Column) -> Column:
        plus_less_minus = lambda i: 2 * F.get(at, 2 * i + 1) - F.get(at, 2 * i) - F.get(at, 2 * i + 2)
        return F.when(at.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: plus_less_minus(i).cast("double")))

    def unit(v: Column) -> Column:
        norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-300))
        return let(norm, lambda n: F.transform(v, lambda x: x / n))

    return let(let(marks, sums), unit)


def model_embedding(make_predict_fn: Callable, dim: int, batch_size: int = fv.BATCH_SIZE) -> Callable[[Column], Column]:
    """Wrap a user model as a column function.

    ``make_predict_fn()`` is called once per Python worker and must return
    ``predict(texts: np.ndarray) -> np.ndarray`` of shape (n, dim).
    """
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                            input_tensor_shapes=None)
    return lambda text: udf(text)


def embed(docs: DataFrame, id_col: str, text_col: str,
          embedder: Callable[[Column], Column] = hash_embedding) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), embedder(F.col(text_col)).alias("embedding"))


# --- keyed embedding store (K5, S7, J8) -----------------------------------------

STORE_SCHEMA = T.StructType([T.StructField("id", T.LongType(), False),
                             T.StructField("embedding", T.ArrayType(T.DoubleType()), True)])


def store_schema(id_type: str = "bigint") -> T.StructType:
    """The store's schema with ids of the records' own type."""
    key = T.StringType() if id_type == "string" else T.LongType()
    return T.StructType([T.StructField("id", key, False), STORE_SCHEMA["embedding"]])


def read_store(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The stored embeddings; an absent store is an empty table."""
    schema = store_schema(id_type)
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # missing path → nothing embedded yet
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def pending(docs: DataFrame, store: DataFrame, id_col: str) -> DataFrame:
    """Records without a stored embedding (by key, not by position)."""
    return docs.join(store.select(F.col("id").alias(id_col)), id_col, "left_anti")


def embed_increment(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, store_path: str,
                    embedder: Callable[[Column], Column] = hash_embedding) -> int:
    """T2 batch form: embed what the store lacks and append it (K5).

    Re-running after a failure embeds only what is still missing, so the
    append is idempotent at record level.  An id that occurs twice in one run
    is embedded once.  Ids are strings in the store if they are in ``docs``,
    else long.  Returns the number of rows added, counted while they are written.
    """
    id_type = "string" if dict(docs.dtypes)[id_col] == "string" else "bigint"
    todo = pending(docs, read_store(spark, store_path, id_type), id_col)
    added, out = _counted(_embedded(todo, id_col, text_col, id_type, embedder))
    out.write.mode("append").parquet(store_path)
    return added.get["n"]


def _embedded(todo: DataFrame, id_col: str, text_col: str, id_type: str, embedder) -> DataFrame:
    out = embed(todo.dropDuplicates([id_col]), id_col, text_col, embedder)
    return out.select(F.col("id").cast(id_type), F.col("embedding").cast("array<double>"))


def _counted(rows: DataFrame) -> tuple[Observation, DataFrame]:
    seen = Observation()
    return seen, rows.observe(seen, F.count(F.lit(1)).alias("n"))


def embed_increment_table(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, table: str,
                          embedder: Callable[[Column], Column] = hash_embedding, buckets: int = 64) -> int:
    """:func:`embed_increment` into a table bucketed and sorted by id.

    The first run creates the table.  Later ones meet its buckets where they
    lie: the records are dealt to the same buckets, and no row of the store
    moves to find out what is missing.  Choose ``buckets`` so that a bucket's ids
    suit one task; a table keeps the number it was created with.  A run that
    fails has added nothing, so it is repeated as it was.
    """
    id_type = "string" if dict(docs.dtypes)[id_col] == "string" else "bigint"
    held = spark.catalog.tableExists(table)
    todo = docs
    if held:
        spark.catalog.refreshTable(table)
        todo = pending(docs.withColumn(id_col, F.col(id_col).cast(id_type)), spark.table(table), id_col)
        buckets = _buckets(spark, table)
    added, out = _counted(_embedded(todo, id_col, text_col, id_type, embedder))
    # one file a bucket and run: rows are dealt as the buckets are
    dealt = out.repartition(buckets, "id")
    dealt.write.mode("append").format("parquet").bucketBy(buckets, "id").sortBy("id").saveAsTable(table)
    return added.get["n"]


def _buckets(spark: SparkSession, table: str) -> int:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
    return int(described["data_type"])
