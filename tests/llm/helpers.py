"""Small tables that every operator of the subpackage must take."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def documents(spark, texts, ids=None, partitions=3, **extra):
    """A documents table; ids from 0 unless given; extra constant string columns with any name."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))]
    df = spark.createDataFrame(rows, DOCS).repartition(partitions)
    from pyspark.sql import functions as F

    for name, value in {**extra, "a.dotted name": "clash"}.items():
        df = df.withColumn(name, F.lit(value))
    return df


def duck(sf_dir, sql):
    """Rows of a SQL text over the driver's tables, with the column names."""
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def same_rows(df, sf_dir, sql):
    names, expected = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    key = lambda rows: sorted(repr(tuple(r)) for r in rows)
    at = [names.index(c) for c in order]
    assert key(df.select(*order).collect()) == key([[r[i] for i in at] for r in expected])
