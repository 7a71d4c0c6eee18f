from . import compression
from .queries import query, table


@query("op10_compression_bands")
def op10(spark, sf):
    return compression.judge(table(spark, sf, "documents"))
