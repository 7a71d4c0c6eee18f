from . import surrogates
from .queries import query, table


@query("op2_pii_surrogates")
def op2(spark, sf):
    return surrogates.replace(table(spark, sf, "documents").select("doc_id", "text"), surrogates.Surrogates(key="rotate me"))
