from pyspark.sql import functions as F

from . import simhash
from .queries import query, table


@query("op9_simhash_anchor_points")
def op9(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
