import random
import re
from collections import Counter

import pytest

from . import helpers as H

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SECRET = "token=abcdef123456"


def corpus():
    """Awkward rows, junk that is labelled 0, and documents with secrets."""
    rng = random.Random(3)
    rows = [(*r[:4], "clash", "clash", r[5]) for r in H.awkward(80)]
    rows += [(2000 + i, " ".join(f"#{rng.randrange(99)}#!!" for _ in range(rng.randrange(20, 60))), "en", "b", None, None, 0) for i in range(120)]
    return rows + [(4000 + i, H.prose(rng, 60) + f" {SECRET}{i} " + H.prose(rng, 5), "en", "c", "x", None, 0) for i in range(20)]


SCHEMA = "doc_id long, text string, lang string, source string, bucket string, _keep string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(d, 0 if 2000 <= d < 4000 else 1) for d in {r[0] for r in rows if r[0] is not None}]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def results(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = corpus_pipeline.stash(stage(spark, docs, folder), name)
    return {k: (v.columns, v.collect()) for k, v in out.items()}


def key(r):
    return tuple(r[c] for c in ("doc_id", "text", "lang", "source", "bucket", "_keep", "n_chars"))


def test_stages_keep_the_columns(results):
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    assert list(results) == ["quality", "near_dedup", "secrets", "mixing", "packing"]
    assert all(results[n][0] == columns for n in ("quality", "near_dedup", "secrets", "mixing"))
    assert results["packing"][0] == [*columns, "n_tokens", "pack_bucket", "bucket_len", "batch_id", "slot"]


def test_quality_drops_rejected_documents_and_keeps_clean_ones(results):
    kept = Counter(map(key, results["quality"][1]))
    rows = Counter(corpus())
    assert not kept - rows
    junk = [r for r in rows if r[0] is not None and 2000 <= r[0] < 4000]
    prose = [r for r in rows if len(H.words(r[1])) >= 20 and r not in junk]
    assert sum(kept[r] for r in junk) <= 0.05 * len(junk)
    assert sum(kept[r] for r in prose) >= 0.95 * sum(rows[r] for r in prose)


def test_near_dedup_keeps_one_of_each_group(results):
    given = [(r.doc_id, r.text) for r in results["quality"][1]]
    want = H.linked(given, 5, 80)
    kept = Counter(r.doc_id for r in results["near_dedup"][1])
    assert kept == Counter({**{d: 1 for d in want if want[d] == d}, None: sum(d is None for d, _ in given)})


def test_secrets_are_masked(results):
    given, out = ({r.doc_id: r for r in results[n][1] if r.doc_id is not None} for n in ("near_dedup", "secrets"))
    assert set(given) == set(out) and len(results["near_dedup"][1]) == len(results["secrets"][1])
    for d, r in out.items():
        t = given[d].text
        want = None if t is None else re.sub(re.escape(SECRET) + "[0-9]+", "[SECRET]", t)
        assert r.text == want and r.n_chars == (None if want is None else len(want))
    assert sum("[SECRET]" in (r.text or "") for r in out.values()) == sum(SECRET in (r.text or "") for r in given.values()) > 10


def test_mixing_draws_whole_documents(results):
    given, out = Counter(map(key, results["secrets"][1])), Counter(map(key, results["mixing"][1]))
    assert set(out) <= set(given) and all(n <= 3 * given[r] for r, n in out.items())
    words = lambda rows: sum(len(H.words(r[1])) * n for r, n in rows.items())
    longest = max(len(H.words(r[1])) for r in given)  # documents are drawn whole, so a source misses its target by one at most, about
    assert longest == 30_000 and abs(words(out) - words(given)) <= longest + 0.1 * words(given)


def test_packing_places_every_row(results):
    rows = results["packing"][1]
    assert Counter(map(key, rows)) == Counter(map(key, results["mixing"][1]))
    assert all(r.n_tokens == len(H.words(r.text)) <= r.bucket_len for r in rows)
    places = Counter((r.pack_bucket, r.batch_id, r.slot) for r in rows)
    assert max(places.values()) == 1


def test_run_gives_the_rows_of_its_stages(spark, folder, results):
    again = corpus_pipeline.run(spark, folder)
    assert again.columns == results["packing"][0]
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, results["packing"][1]))


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and "batch_id" in out.columns


def test_run_without_labels_keeps_all(spark, tmp_path):
    rows = [r for r in corpus() if r[0] is not None and r[0] >= 4000]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.quality(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).count() == len(rows)


def test_stages_say_what_awkward_rows_become():
    for _, stage in corpus_pipeline.STAGES:
        assert all(word in stage.__doc__ for word in ("null", "empty", "repeated", "ties"))
