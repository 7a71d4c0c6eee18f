from . import bpe
from .queries import query, table


@query("op7_bpe_distinct_words")
def op7(spark, sf):
    return bpe.digests(table(spark, sf, "documents"))
