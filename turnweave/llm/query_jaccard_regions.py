from . import jaccard_regions
from .queries import query, table


@query("op13_jaccard_regions")
def op13(spark, sf):
    return jaccard_regions.join(table(spark, sf, "documents"))
