import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from rowforge.llm import decontamination, near_duplicates, quality, toxicity
from rowforge.llm.catalog import oracle_sql, queries
from rowforge.llm.common import written
from rowforge.llm.labelled import training_labels
from rowforge.llm.near_duplicates import probability_jaccard

from .test_classifiers import naive_statistics, naive_toxic_features
from .test_decontamination import brute
from .test_near_duplicates import sets_of
from .test_packing import check

REPO = Path(__file__).parents[2]


def test_stages(spark, sf_dir, tmp_path):
    """Each stage keeps what its operator keeps of the stage's own input, and all columns; the last packs all of it."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if name == "packing":
            check(after.collect(), before, padding=8192)
            break
        assert after.columns == docs.columns and after.schema == docs.schema
        kept = {r.doc_id for r in after.collect()}
        if name == "toxicity":
            expected = {r.doc_id for r in toxicity.toxicity_scores(docs, labels).where("toxicity < 0.5").collect()}
        elif name == "quality":
            expected = {r.doc_id for r in quality.quality_scores(docs, labels).where("quality >= 0.3").collect()}
        elif name == "near_duplicates":
            expected = {r.doc_id for r in near_duplicates.near_duplicate_classes(docs)[0].where("kept").collect()}
            assert len({before[k] for k in kept}) == len(kept)
        else:
            expected = {r.doc_id for r in decontamination.mark_contamination(docs, bench).where(~decontamination.contaminated()).collect()}
        assert kept == expected and len(kept) < len(before)
        docs = after


def test_stages_against_brute_force(spark):
    """Each stage on all documents of the smallest tables, against a plain version of it on its own input.

    The models are the operators' own; what they are applied to is computed naively, text by text.
    """
    sf_dir = "/root/testdata/sf0.001"
    if not Path(sf_dir).is_dir():
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text or "" for r in docs.collect()}
        after = stage(spark, docs, sf_dir)
        if name == "packing":
            check(after.collect(), before, padding=8192)
            break
        after = written(after, name)
        ids, texts = list(before), list(before.values())
        if name == "toxicity":
            model = toxicity.fit(docs.selectExpr("doc_id", "coalesce(text, '') t"), training_labels(labels, "toxic"))
            scores = model.calibrate(model.trees(np.array([naive_toxic_features(t, model.lexicon) for t in texts])))
            expected = {i for i, score in zip(ids, scores, strict=True) if score < 0.5}
        elif name == "quality":
            x = np.array([naive_statistics(t) for t in texts])
            rows = [(i, zlib.crc32(str(i).encode()) % 5, v.tolist()) for i, v in zip(ids, x, strict=True)]
            model = quality.fit(spark.createDataFrame(rows, "doc_id long, fold int, x array<double>"), training_labels(labels, "quality"))
            expected = {i for i, score in zip(ids, model(x), strict=True) if score >= 0.3}
        elif name == "near_duplicates":
            expected = set()
            sets, root = sets_of(texts), {}
            for a in sorted(range(len(ids)), key=lambda k: ids[k]):
                alike = {root[b] for b in root if texts[a] == texts[b] or probability_jaccard(*sets[a], *sets[b]) >= 0.8 - 1e-9}
                root[a] = min(alike, default=a, key=lambda k: ids[k])
                root |= {b: root[a] for b in root if root[b] in alike}
            expected = {ids[a] for a in root.values()}
        else:
            found = brute(texts, bench)
            expected = {i for i, (words, hit, _) in zip(ids, found, strict=True) if not (hit and 20 * hit >= words)}
        assert {r.doc_id for r in after.collect()} == expected, name
        assert after.count() == len(expected) < len(before)
        docs = after


def test_clashing_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).selectExpr("*", "1 __uid", "2 toxicity", "3 contamination", "4 t", "5 fold", "6 score", "7 __text", "8 label")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.where("__uid <> 1 or toxicity <> 2 or contamination <> 3 or t <> 4 or fold <> 5 or score <> 6 or __text <> 7 or label <> 8").count() == 0


def test_empty_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_catalog():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11)) or len(queries()) >= 9
    assert set(oracle_sql()) <= set(queries())


def test_the_rest_works_without_this_subpackage(tmp_path):
    """As after the driver has deleted it: the entry module imports, and its other queries are there."""
    import shutil

    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={"PATH": "/usr/bin:/bin"})
