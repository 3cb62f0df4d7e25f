"""Each stage of the corpus pipeline against a plain version, over what its predecessor kept."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from test_llm import CLASHING, ODD, brute_components, brute_lines

import corpus_pipeline
from lumenloc.llm import ngram_join, quality, secret_scan
from lumenloc.llm.shared import documents, staged


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output rows of each stage."""
    docs, out = documents(spark, sf_dir), {}
    for name, f in corpus_pipeline.STAGES:
        after = staged(f(spark, docs, sf_dir), name)
        out[name] = (docs.collect(), after.collect(), docs.columns, after.columns)
        docs = after
    return out


def test_order():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "secrets", "packing"]


def test_columns(stages):
    for name, (_, _, before, after) in stages.items():
        if name != "packing":
            assert before == after


def test_quality_stage(spark, sf_dir, stages):
    before, after, _, _ = stages["quality"]
    fitted = quality.fit(quality.with_statistics(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = fitted.scores(quality.statistics([r.text or "" for r in before]))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, s in zip(before, scores, strict=True) if s >= quality.THRESHOLD)
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in after}
    assert len(good & kept) > 0.9 * len(good & {r.doc_id for r in before})


def test_lines_stage(stages):
    before, after, _, _ = stages["lines"]
    expected = brute_lines([(r.doc_id, r.text) for r in before])
    lines = {r.doc_id: len(r.text.split("\n")) for r in before}
    assert {r.doc_id: r.text for r in after} == {i: t for i, (t, gone) in expected.items() if gone < lines[i]}
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_duplicate_stage(stages):
    before, after, _, _ = stages["near_duplicates"]
    groups = brute_components([(r.doc_id, r.text) for r in before], 5, 80, 100)
    assert sorted(str(r.doc_id) for r in after) == sorted(i for i, _, c in groups if i == c)


def test_secret_stage(stages):
    before, after, _, _ = stages["secrets"]
    found = [secret_scan.bin_of(x[0]) for r in before for x in secret_scan.candidates(r.text)]
    cutoff = secret_scan.cutoff_of({k: found.count(k) for k in set(found)})
    assert {r.doc_id: r.text for r in after} == {r.doc_id: secret_scan.redacted(r.text, secret_scan.all_spans(r.text, cutoff)[1]) for r in before}
    assert not any(re.search(r"[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", r.text) for r in after)


def test_packing_stage(stages):
    before, after, _, _ = stages["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    source = {r.doc_id: r.source for r in before}
    bins = {}
    for r in after:
        bins.setdefault(r.bin_id, []).append(source[r.doc_id])
    assert all(len(set(v)) == len(v) for v in bins.values())


def test_run_is_its_stages(spark, sf_dir, stages):
    key = lambda rows: sorted(map(tuple, rows))
    assert key(corpus_pipeline.run(spark, sf_dir).collect()) == key(stages["packing"][1])


def test_odd_documents(spark, sf_dir):
    """Nulls, empty and long texts, repeated rows, columns named as operators name their own, and no documents."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(ODD)] + [(None, "no id at all", None, None, None), (3, ODD[3], "en", "s", 1)]
    own = [c for c in CLASHING if c != "id"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(7) for c in own}).withColumn("document", F.lit(7))
    for docs in (df, df.where("false")):
        for name, f in corpus_pipeline.STAGES:
            docs = staged(f(spark, docs, sf_dir), name)
            if name != "packing":
                assert docs.columns == df.columns
                assert {tuple(r[c] for c in [*own, "document"]) for r in docs.collect()} <= {(7,) * (len(own) + 1)}
        docs.collect()


def test_one_of_each_group_stays(spark, sf_dir):
    """By rows: ids may be null or repeated, and texts of one id may differ."""
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(1, long), (1, "quite another text of more than five words"), (2, long), (2, "something that only this one says here"), (None, long), (None, long), (None, "alone without an id but with words"), (5, ""), (5, ""), (6, long + " more"), (7, "x y"), (7, "x y")]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted([("1", long), ("1", rows[1][1]), ("2", rows[3][1]), ("None", rows[6][1]), ("5", ""), ("5", ""), ("7", "x y")])


def test_near_duplicates_passage(spark, sf_dir, monkeypatch):
    """Documents with a passage in common, but no more, stay and few are compared; of copies one stays."""
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    rnd = random.Random(9)
    passage = " ".join(f"w{k}" for k in range(20))
    apart = [f"{passage} " + " ".join(f"v{rnd.randrange(10**6)}" for _ in range(rnd.randint(90, 110))) for _ in range(250)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate([*apart, *(f"{t} end" for t in apart[:5])])]
    seen = []
    hub_pairs = ngram_join.hub_pairs
    monkeypatch.setattr(ngram_join, "hub_pairs", lambda packed, total: seen.append(packed.count()) or hub_pairs(packed, total))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()) == list(range(250))
    assert seen[0] < 50, seen


def test_quality_keeps_no_texts(spark, sf_dir):
    """What the stage returns is made from the documents, not from a copy of them that stays on disk."""
    docs = documents(spark, sf_dir)
    assert set(corpus_pipeline.quality(spark, docs, sf_dir).inputFiles()) == set(docs.inputFiles())


def test_near_duplicates_alike(spark, sf_dir, monkeypatch):
    """Of sets that are all alike, about one pair a set is verified, in steps; the groups are those of brute force."""
    monkeypatch.setattr(ngram_join, "STEP", 100)
    rnd = random.Random(4)
    texts = []
    for _ in range(12):
        words = [f"v{rnd.randrange(10**6)}" for _ in range(150)]
        for _ in range(12):
            own = list(words)
            for at in rnd.sample(range(150), 1):
                own[at] = f"n{rnd.randrange(10**6)}"
            texts.append(" ".join(own))
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    seen = []
    verified = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *a, **k: seen.append(pairs.count()) or verified(pairs, *a, **k))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect())
    assert kept == sorted(int(i) for i, _, c in brute_components([r[:2] for r in rows], 5, 80, 100) if i == c)
    assert sum(seen) < 2 * len(rows), seen
