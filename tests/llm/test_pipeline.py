"""The pipeline against a brute-force version, stage by stage, on documents with planted cases."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import pytest
from leafspan.llm import mixture, quality, token_files
from pyspark.sql import functions as F

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(30)) for i in range(5)]
    rows = []
    for i in range(150):
        kind, text = i % 10, prose(rng.randrange(70, 160))
        if kind == 0:
            text = " ".join(w + "###" for w in text.split())
        elif kind == 1 and len(rows) > 12:
            text = rows[-5][1] or text
        elif kind == 2 and len(rows) > 12:
            w = (rows[-9][1] or text).split()
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        elif kind == 3:
            text = prose(20) + " " + items[i % 5][1] + " " + prose(20)
        elif kind == 4:
            text = prose(20)
        rows.append((i, text, "en", rng.choice(["a", "a", "a", "b", None])))
    rows += [(500, None, None, None), (501, "", "en", "a"), (None, prose(80), "en", "b"), (3, rows[3][1], "en", "b")]
    path = tmp_path_factory.mktemp("pipeline")
    brute.docs(spark, rows).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int(i % 10 != 0), 0) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


def listed(df):
    assert df.columns == COLUMNS
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def in_order(rows):
    return sorted(rows, key=str)


def test_stages_against_brute_force(spark, folder):
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "source mixing", "token files"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = listed(docs)

    # quality: the learned rules, applied one by one
    rules = quality.fitted(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    stats = quality.measured(docs, ["doc_id", "text"]).collect()
    ratio = lambda r, a, b: r[a] / max(r[b], 1) if b else r[a]
    kept = []
    for (i, text, source), r in zip(in_order(rows), sorted(stats, key=lambda r: str((r["_c0"], r["_c1"], ""))), strict=True):
        n, _, _, _, again = brute.statistics(text)
        values = {name: ratio(r, a, b) for name, (a, b) in quality.RATIOS.items()}
        hit = any(all(values[c] >= cut if side == ">=" else values[c] <= cut for c, side, cut in rule) for rule in rules)
        if n >= 50 and 100 * again <= 50 * n and not hit:
            kept.append((i, text, source))
    docs = stages["quality rules"](spark, docs, folder).cache()
    assert in_order(listed(docs)) == in_order(kept) and rules
    assert not any("###" in (t or "") for _, t, _ in kept)

    # near-duplicates: the row of the smallest id of each class; rows without an id stay
    classes = brute.near_classes([(i, t) for i, t, _ in kept if i is not None])
    stay = [r for r in kept if r[0] is None or classes[r[0]][1] == r[0]]
    once = {r[0]: r for r in sorted(stay, key=lambda r: (str(r[0]), r[1] or "", r[2] is not None, r[2] or ""), reverse=True) if r[0] is not None}
    stay = [*once.values(), *(r for r in stay if r[0] is None)]
    docs = stages["near-duplicates"](spark, docs, folder).cache()
    assert [(i, t) for i, t, _ in in_order(listed(docs))] == [(i, t) for i, t, _ in in_order(stay)]
    assert len(stay) < len(kept)
    stay = listed(docs)

    # decontamination
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = brute.contaminated([(i, t) for i, t, _ in stay], items)
    clean = [r for r, (_, n, hit, _) in zip(stay, found, strict=True) if not (hit > 0 and 20 * hit >= n)]
    docs = stages["decontamination"](spark, docs, folder).cache()
    assert in_order(listed(docs)) == in_order(clean) and len(clean) < len(stay)

    # mixing: copies as the operator draws them, sums near the targets
    copies = {(r["doc_id"], r["size"]): r["copies"] for r in mixture.mix(docs).collect()}
    mixed = [r for r in clean for _ in range(copies[(r[0], len(brute.words(r[1])))])]
    docs = stages["source mixing"](spark, docs, folder).cache()
    assert in_order(listed(docs)) == in_order(mixed)

    # tokens
    t = Tokenizer.from_file(token_files.tokenizer_path())
    start, want = 0, []
    for i, text, _ in sorted(mixed, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    names = ["start", "doc_id", "n_tokens", "ids_crc32"]
    got = stages["token files"](spark, docs, folder).select(names)
    assert sorted(tuple(r) for r in got.collect()) == want
    whole = corpus_pipeline.run(spark, folder).select(names)
    assert sorted(tuple(r) for r in whole.collect()) == want


def test_stages_on_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "token files" or out.columns == COLUMNS)


def test_stages_keep_further_columns(spark, folder):
    docs = brute.clashing(spark.read.parquet(f"{folder}/documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.filter(F.col("target") == 7).count() > 0
