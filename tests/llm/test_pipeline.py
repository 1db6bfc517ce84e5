"""Each stage of the pipeline against a plain version on what the stage before it kept, and the whole run."""

from __future__ import annotations

import hashlib
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from test_resemblance import first_of_each  # noqa: E402

from attesta.llm import decontaminate, quality  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def texts(df) -> dict[int, str]:
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(steps):
    assert all(df.columns == COLUMNS for df in steps[:-1])


def test_quality_stage(spark, steps):
    judged = quality.judge(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    kept = texts(steps[1])
    assert set(kept) == {r.doc_id for r in judged.where("kept").collect()}
    assert all(t == texts(steps[0])[i] for i, t in kept.items())


def test_line_stage(steps):
    before, after = texts(steps[1]), texts(steps[2])
    want = brute.deduped_lines(sorted(before.items()))
    assert {i: brute.sha(t.encode()) for i, t in after.items()} == {w[0]: w[3] for w in want}
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_near_duplicate_stage(steps):
    before, after = texts(steps[2]), texts(steps[3])
    assert set(after) == first_of_each(sorted(before.items()))
    assert len(after) < len(before)


def test_decontamination_stage(spark, steps):
    before, after = texts(steps[3]), texts(steps[4])
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, t in before.items() if any(decontaminate.best_distance(x, decontaminate.normal(t), 1000) <= int(len(x) * decontaminate.BUDGET_SHARE) for x in items)}
    assert set(after) == set(before) - leaks


def test_encoding_stage(steps):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    before = texts(steps[4])
    got = {r.doc_id: r for r in steps[5].collect()}
    assert set(got) == set(before)
    for i, t in before.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == brute.sha(library.decode(ids, skip_special_tokens=False).encode())


def test_run_gives_the_rows_of_the_last_stage(spark, steps):
    got = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {(r.doc_id, r.ids_sha256) for r in steps[5].collect()}


def test_stages_take_empty_tables_and_nulls(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, None, None, "s", None), (1, "", "en", None, 0), (1, "", "en", None, 0)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and (out.count() > 0) == bool(rows), name
        assert corpus_pipeline.STAGES[0][1](spark, docs, SF).count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)
