"""The pipeline's stages in turn against plain Python on the smallest documents and planted rows."""
import hashlib
import random

import corpus_pipeline as pipeline
from tests.llm.test_corpus_ops import without_copies
from tests.llm.test_text_ops import classes, contaminated, fingerprint, base
from turnweave.llm.bpe import tokenizer_path

SF = "/root/testdata/sf0.001"
rng = random.Random(3)


def test_stages_equal_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    small = [r for r in docs if len(r.text) < 2500][:70]
    rows = [tuple(r) for r in small]
    rows += [(10_000, rows[3][1], "en", "x", 1), (10_001, rows[4][1] + " end", "en", "x", 1), (10_002, None, None, None, None), (10_003, "", "en", "x", 0)]
    rows += [(10_004, items[0][1] + " " + items[1][1], "en", "x", 1), (10_005, "spam " * 300, "en", "x", 1), (rows[0])]
    df = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    results, current = [], df
    for number, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, current, SF)
        if number < len(pipeline.STAGES) - 1:
            assert out.columns == df.columns
        out.write.parquet(str(tmp_path / name))
        current = spark.read.schema(out.schema).parquet(str(tmp_path / name))
        results.append([tuple(r) for r in current.collect()])
    kept, deduped, grouped, clean, encoded = results
    # Quality rules: base rules are exact; the bands only reject more, and not the ordinary documents.
    assert all(not base(r[1])[5] for r in kept) and {r[0] for r in rows if not base(r[1])[5]} >= {r[0] for r in kept}
    assert 10_005 not in {r[0] for r in kept} and len(kept) > 60
    want = without_copies([(r[0], r[1]) for r in kept], 50)
    assert sorted((r[0], r[1]) for r in deduped) == sorted((r[0], want[r[0], r[1]][0]) for r in kept)
    comp = classes([(r[0], fingerprint(r[1])) for r in deduped])
    assert sorted(r[0] for r in grouped) == sorted(set(comp))
    assert sorted(r[0] for r in clean) == sorted(r[0] for r in grouped if not contaminated(r[1], items)[3])
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    expected = []
    for r in clean:
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids
        expected.append((r[0], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(encoded) == sorted(expected)


def test_stages_of_an_empty_table(spark):
    current = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        current = stage(spark, current, SF)
        assert current.count() == 0


def test_either_module_can_be_imported_first(tmp_path):
    """Also from another folder: the workers get the package from the session."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for first in ("corpus_pipeline", "__spark_entry__"):
        code = f"import sys; sys.path.insert(0, {repo!r}); import {first}, __spark_entry__ as e; assert 'pipeline' in e.queries()"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
