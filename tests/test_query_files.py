"""S3: query files in the order given, not by name or id."""

from pyspark.sql import functions as F

from quiver.sources.text import query_files, read_csv, write_csv


def test_files_and_rows_keep_their_order(spark, tmp_path):
    head = "id,vector,i32v,f32v,str\n"
    for name, ids in (("a", [9, 2, 30]), ("z", [7, 40, 1, 8]), ("m", [5])):
        (tmp_path / f"{name}.csv").write_text(head + "".join(f'{i},"[{i}.0,1.0]",{i},0.5,s{i}\n' for i in ids))
    files = [f"{tmp_path}/z.csv", f"file://{tmp_path}/a.csv", f"{tmp_path}/m.csv"]
    ids = lambda df: [r.id for r in df.orderBy("ordinal", "offset", "place").collect()]
    assert ids(query_files(spark, files)) == [7, 40, 1, 8, 9, 2, 30, 5]
    assert ids(query_files(spark, files, start_id=5)) == [7, 40, 8, 9, 30, 5]
    assert ids(query_files(spark, files, n=5)) == [7, 40, 1, 8, 9]
    assert ids(query_files(spark, [files[2], *files])) == [5, 7, 40, 1, 8, 9, 2, 30, 5]
    assert ids(query_files(spark, prefix=f"{tmp_path}/")) == [9, 2, 30, 5, 7, 40, 1, 8]


def test_a_file_of_many_splits_and_a_large_n(spark, tmp_path):
    rows = spark.range(3000).select((F.lit(2999) - F.col("id")).alias("id"), F.array(F.lit(1.0), F.col("id").cast("float")).cast("array<float>").alias("embed"),
                                    F.lit(1).alias("i32v"), F.lit(0.5).cast("float").alias("f32v"), F.lit("s").alias("strv"))
    write_csv(rows, f"{tmp_path}/q", chunks=1)  # one file, rising ids
    file = [str(p) for p in (tmp_path / "q").glob("part-*")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert read_csv(spark, file).rdd.getNumPartitions() > 4
        got = [r.id for r in query_files(spark, file, n=2500).orderBy("ordinal", "offset", "place").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(range(2500))
