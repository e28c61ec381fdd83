FOLDER = "/root/testdata/sf0.001"


def read(spark, name, folder=FOLDER):
    return spark.read.parquet(f"{folder}/{name}.parquet")
