"""Filter audit, Merkle manifest and Jaccard regions against plain Python."""
import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave.llm import filter_audit, jaccard_regions, merkle

rng = random.Random(3)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- filter audit -------------------------------------------------------------
def masks_of(rows):
    out = []
    for i, text, lang in rows:
        t = text or ""
        words = t.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")
        words = [w for w in words if w]
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t),
                 i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)]
        out.append("".join(f for f, x in zip("ABCDE", fails) if x))
    return out


def audit_of(rows, labels):
    masks, out = masks_of(rows), {}
    parts = {lang or "" for _, _, lang in rows}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for part in parts:
        mine = [(m, i) for m, (i, _, lang) in zip(masks, rows) if (lang or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order):
                before = set(order[:step])
                gone = [i for m, i in mine if f in m and not before & set(m)]
                total[f] += len(gone)
                out[part, order, step + 1] = [
                    sum(not (before | {f}) & set(m) for m, _ in mine), len(gone), sum(f in m and bool(before & set(m)) for m, _ in mine),
                    sum(m == f for m, _ in mine), sum(i in good for i in gone), sum(i in toxic for i in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def audited(spark, tmp_path, rows, labels, files, spec=filter_audit.Audit()):
    for k in range(files):  # later files hold smaller ids, so earlier masks have to be retracted
        part = rows[k::files] if k % 2 else rows[k::files][::-1]
        docs = spark.createDataFrame([(i, t, l, 1) for i, t, l in part], "doc_id long, text string, lang string, mask int")
        docs.coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(spark, str(tmp_path / "docs"), marks, spec).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}


@pytest.mark.parametrize("batches, files", [(1, 1), (50, 5)])
def test_audit_equals_brute_force(spark, tmp_path, batches, files):
    long = " ".join(f"w{i}" for i in range(250))
    texts = ["", None, "a b", long, "Ab\vCd $", " ".join(["x"] * 300), long + " #", "  word"]
    rows = [(60 - i if i % 9 else None, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(60)]
    rows += [(7, long, "en"), (7, long, "de"), (7, long, "en"), (2, long, "en")]  # ties and repeated rows
    labels = [(i, i % 3 % 2, i % 2) for i in range(0, 61, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    got = audited(spark, tmp_path, rows, labels, files, filter_audit.Audit(batches=batches, texts_per_key=3))
    assert got == audit_of(rows, labels)


def test_audit_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "docs"))
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark, str(tmp_path / "docs"), marks).count() == 0


def test_smaller_ids_retract_earlier_masks():
    class State:
        exists, held = False, None

        @property
        def get(self):
            return self.held

        def update(self, value):
            self.exists, self.held = True, value

    import pandas as pd

    state, total = State(), {}
    for i in (9, 4, 6, 1):
        frame = pd.DataFrame([(0, b"d", i, "en", 2, 0, 1, False)])
        for change in filter_audit._update((0,), iter([frame]), state):
            for r in change.itertuples():
                total[r.mask] = total.get(r.mask, 0) + r.delta
            if i == 4:
                assert dict(zip(change["mask"], change["delta"])) == {2 | filter_audit.SAME: 1}
    assert {k: v for k, v in total.items() if v} == {2: 1, 2 | filter_audit.SAME: 3}


# --- Merkle manifest ------------------------------------------------------------
def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def climb(nodes):
    """(root, siblings of each node, turns of each node)."""
    path, turns, at = [[] for _ in nodes], [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            has = p ^ 1 < len(nodes)
            path[k].append(nodes[p ^ 1] if has else "")
            turns[k].append(("l" if p & 1 else "r") if has else "-")
        nodes = [sha("".join(nodes[j:j + 2])) for j in range(0, len(nodes), 2)]
        at = [p >> 1 for p in at]
    return nodes[0], path, turns


def merkle_of(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(enc(v) for v in (r[0], r[3], r[2], r[4], r[1])))
    changed = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([leaf(r) for r in sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for g, rs in groups.items()}
    root, tops, turns = climb([trees[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for j, r in enumerate(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            path, way = trees[g][1][j] + tops[k], trees[g][2][j] + turns[k]
            start = leaf((*r[:4], r[4] + 1)) if changed(r) and r[4] is not None else leaf(r)
            for s, w in zip(path, way):
                start = sha(s + start if w == "l" else start + s)
            out.append((r[0] is None, r[0] or 0, leaf(r), trees[g][0], root, sha("".join(path)), start, start == root))
    return sorted(out)


@pytest.mark.parametrize("n, height", [(1, 3), (2, 1), (9, 1), (37, 2), (300, 3), (300, 10)])
def test_manifest_equals_brute_force(spark, n, height):
    langs = ["en", "de", None, "", "é", "zz"]
    rows = [(rng.choice([None, i, i]), rng.choice(["x", None, "", "é1:"]), rng.choice(langs[:2] * 6 + langs), rng.choice([None, "s"]), rng.choice([None, i])) for i in range(n)]
    rows += rows[:3]
    df = spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", pos int").repartition(3)
    up = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    made = merkle.manifest(merkle.leaves(df, {"n_chars": up}), merkle.Merkle(height=height, rows_per_task=50))
    got = [(r.doc_id is None, r.doc_id or 0, r.leaf, r.subroot, r.root, sha(r.siblings), r.folded_root, r.verified) for r in merkle.prove(made).collect()]
    assert sorted(got) == merkle_of(rows)


def test_manifest_of_an_empty_table(spark):
    made = merkle.manifest(merkle.leaves(spark.createDataFrame([], DOCS)))
    assert made.root is None and merkle.prove(made).count() == 0


@pytest.mark.parametrize("levels", range(1, 9))
def test_addresses_are_the_recursive_layout(levels):
    def layout(depth, index, levels):
        if levels == 1:
            return [(depth, index)]
        upper = levels // 2
        out = layout(depth, index, upper)
        for k in range(1 << upper):
            out += layout(depth + upper, (index << upper) + k, levels - upper)
        return out

    nodes = layout(0, 0, levels)
    got = merkle.address(np.array([d for d, _ in nodes]), np.array([i for _, i in nodes]), levels)
    assert got.tolist() == list(range((1 << levels) - 1))


# --- Jaccard regions ----------------------------------------------------------
def jaccard_of(rows, percent=90):
    sets = []
    for _, t in rows:
        w = bytes((t or ""), "utf-8").lower().split()
        sets.append({b" ".join(w[k:k + 3]) for k in range(max(len(w) - 2, min(len(w), 1)))})
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    low = {}
    for (i, _), g in zip(rows, label):
        low.setdefault(g, []).append(i)
    low = {g: min((i for i in ids if i is not None), default=None) for g, ids in low.items()}
    return sorted((i is None, i or 0, len(s), low[g] or 0) for (i, _), s, g in zip(rows, sets, label))


def variants(seed, n_docs, edits):
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    out = []
    for _ in range(n_docs):
        words = list(base)
        for _ in range(r.randrange(edits)):
            words[r.randrange(len(words))] = f"x{r.randrange(10 ** 6)}"
        out.append(" ".join(words))
    return out


def joined(spark, rows, spec=jaccard_regions.Regions()):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(4)
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_regions.join(df, spec).collect())


def test_links_equal_brute_force(spark):
    texts = [t for s in range(6) for t in variants(s, 18, 5)] + ["", None, " \t", "a", "A", "a b", "a b", "a b c", " ", "b a"]
    texts += ["boiler plate line of some words " * 3 + " ".join(f"u{k}x{j}" for j in range(30)) for k in range(15)]
    texts.append(" ".join(f"v{k}" for k in range(30_000)))
    rows = [(500 - k if k % 17 else None, t) for k, t in enumerate(texts)] + [(3, "a b c"), (3, texts[0]), (3, texts[0])]
    assert joined(spark, rows) == jaccard_of(rows)


@pytest.mark.parametrize("spec", [
    jaccard_regions.Regions(region_sets=6, pivots=4), jaccard_regions.Regions(region_sets=5, region_sketches=10, pivots=3, frequent=2),
    jaccard_regions.Regions(region_shingles=900), jaccard_regions.Regions(region_sketches=1)])
def test_cut_regions_lose_no_link(spark, spec):
    texts = variants(1, 60, 9) + variants(2, 20, 30) + [t + f" end{k}" for k, t in enumerate(variants(3, 25, 2))]
    rows = list(enumerate(texts))
    assert joined(spark, rows, spec) == jaccard_of(rows)


def test_other_thresholds_and_an_empty_table(spark):
    rows = list(enumerate(variants(4, 30, 14)))
    assert joined(spark, rows, jaccard_regions.Regions(percent=70)) == jaccard_of(rows, 70)
    assert joined(spark, []) == []


def test_sketches_never_rule_out_a_link():
    for seed in range(30):
        r = np.random.default_rng(seed)
        a = np.unique(r.integers(0, 1 << 63, r.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > 0.04], r.integers(0, 1 << 63, len(a) // 25 + 1).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if 100 * inter >= 90 * (len(a) + len(b) - inter):
            group = jaccard_regions.possible(np.array([len(a), len(b)]), [jaccard_regions.sketch(a), jaccard_regions.sketch(b)], 90)
            assert group[0] == group[1]


# --- depth of the line rounds, tasks of the archive reader ---------------------
def test_runs_that_end_before_different_lines_go_whole(spark):
    from tests.llm.test_corpus_ops import without_copies
    from turnweave.llm import suffix_lines

    shared = "\n".join(["z" * 45, *"abcdefg"])
    tables = [[(1, f"first\n{shared}\nx"), (2, f"other\n{shared}\ny")]]
    for seed in range(6):
        r = random.Random(seed)
        run = "\n".join([r.choice("pq") * r.randrange(20, 49), *[r.choice("abcdef") * r.randrange(1, 4) for _ in range(r.randrange(2, 12))]])
        tables.append([(i, f"{r.choice('uvw') * (i + 1)}\n{run}\n{'st'[i % 2] * (i + 3)}") for i in range(r.randrange(2, 5))])
    for rows in tables:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: (r.text, r.n_deleted) for r in suffix_lines.delete_copies(df).collect()}
        assert got == {d[0]: tuple(x) for d, x in without_copies(rows, 50).items()}
    assert suffix_lines.delete_copies(spark.createDataFrame(tables[0], "doc_id long, text string")).filter("doc_id = 2").first().n_deleted == 8


def test_ranges_are_read_by_many_tasks(spark):
    from turnweave.llm import warc

    spec = warc.Warc(range_bytes=4 << 10, file_bytes=64 << 10)
    pages = spark.createDataFrame([(i, f"u{i}", rng.randbytes(900).hex()) for i in range(300)], "page_id long, url string, html string")
    archives = warc.write(pages, warc.archive_folder(spark), spec)
    records = warc.read(archives, spec)
    tasks = {r.t for r in records.select(F.spark_partition_id().alias("t")).distinct().collect()}
    assert len(tasks) >= 8 and sorted(r.page_id for r in records.select("page_id").collect()) == list(range(300))
