from pyspark.sql import functions as F

from . import toxicity
from .query_brown import remainder
from .queries import query, table


@query("op8_toxicity_noisy_or")
def op8(spark, sf):
    docs = table(spark, sf, "documents")
    held = remainder(5) == 0
    model = toxicity.fit(docs, table(spark, sf, "labels"), ~held)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")
