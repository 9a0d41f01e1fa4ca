from pyspark.sql import functions as F

from folia.operators import text_layer
from folia.streaming import documents


def test_new_files_once(spark, tmp_path):
    folder = f"{tmp_path}/in"
    write = lambda i: spark.createDataFrame([(i, f"a b\nc{i}")], "doc_id long, text string").write.mode("append").parquet(folder)
    operator = lambda docs: text_layer.words(text_layer.lines(docs)).select("doc_id", F.col("word"))
    for k in (1, 2):
        write(k)
        documents.run_available(documents.stream_table(spark, folder), operator, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 3 * k
