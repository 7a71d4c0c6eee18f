from pyspark.sql import functions as F

from . import brown
from .queries import query, table


def remainder(n):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query("op1_brown_exchange")
def op1(spark, sf):
    held = F.coalesce(remainder(7) == 2, F.lit(False))
    rows, model = brown.score(table(spark, sf, "documents"), ~held)
    return rows.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
