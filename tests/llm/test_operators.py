"""Operators over tables with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from attesta.llm import bpe, decontaminate, html_text, line_dedup, ngram_lm, phrases, quality, sharding, simhash, suffix_array  # noqa: E402

FILE = public_tokenizers.path("word_bpe_49k.json")
#: Extra columns with the names that operators use inside.
SCHEMA = "doc_id long, text string, id string, text_hash int, anchor string, fingerprint string, chunks array<int>, size string, held_out string, gone int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(400)]

    def prose(n: int) -> str:
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))

    passage, lines = prose(90), "\n".join(prose(6) for _ in range(30))
    texts = [prose(rng.randint(1, 150)) for _ in range(40)]
    texts += [prose(20) + " " + passage + " " + prose(15) for _ in range(12)] + [passage + " " + prose(5), prose(7) + " " + passage]
    texts += [prose(3) + "\n" + lines + "\n" + prose(4) for _ in range(5)] + [lines]
    texts += [None, None, "", " \t\n", "one", "Two Words", "x" * 3000, prose(30_000) + passage]
    texts += [texts[3]] * 30 + [texts[45]] * 3  # copies
    out = [(k, t) for k, t in enumerate(texts)]
    out += [(5, texts[5]), (5, texts[5]), (6, texts[7]), (None, passage), (None, texts[3]), (None, None)]  # repeated rows, shared ids, no ids
    rng.shuffle(out)
    return out


def table(spark, rows):
    data = [(i, t, "same", 1, "a", "f", [1], "s", "h", 1) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


def same(found, wanted) -> None:
    assert Counter(map(tuple, found)) == Counter(wanted)


@pytest.mark.parametrize("heavy", [4096, 2])
def test_suffix_array(spark, docs, rows, heavy):
    got = suffix_array.remove_repeats(docs, heavy=heavy).collect()
    want = brute.repeated_bytes([t for _, t in rows], 200)
    assert sum(w[1] for w in want) > 10_000
    same(got, [(i, *w) for (i, _), w in zip(rows, want, strict=True)])


@pytest.mark.parametrize("heavy", [4096, 2])
def test_phrases(spark, docs, rows, heavy):
    got = phrases.remove_phrases(docs, heavy=heavy).collect()
    want = brute.earlier_phrases(rows, 13)
    assert sum(w[1] for w in want) > 1000
    same(got, [(i, *w) for (i, _), w in zip(rows, want, strict=True)])


def test_kept_texts_match_their_digests(docs):
    for df in (phrases.remove_phrases(docs, keep_text=True), suffix_array.remove_repeats(docs, keep_text=True)):
        for r in df.collect():
            kept = r.kept if isinstance(r.kept, (bytes, bytearray)) else r.kept.encode()
            assert hashlib.sha256(kept).hexdigest() == r.kept_sha256


def test_near_duplicates(docs, rows):
    same(simhash.near_duplicates(docs).collect(), [w[:3] for w in brute.near_components(rows)])


def test_one_row_of_each_component(docs, rows):
    components = {}
    for i, _, _, root in brute.near_components(rows):
        components.setdefault(root, []).append(i)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    # an id that names several texts can stand for several components
    got = Counter(r.doc_id for r in kept.collect())
    assert sum(got.values()) == len(components)
    assert set(got) == {min((i for i in ids if i is not None), default=None) for ids in components.values()}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100}


def test_lines(docs, rows):
    want = brute.deduped_lines(rows)
    assert sum(w[2] for w in want) > 50
    same([(r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.dedup_lines(docs).collect()], want)
    whole = line_dedup.with_kept_text(docs)
    assert whole.columns == docs.columns
    same([(r.doc_id, brute.sha(r.text.encode())) for r in whole.collect()], [(w[0], w[3]) for w in want])


def test_repeated_runs_in_other_texts_go(spark):
    rng = random.Random(8)

    def fresh(n: int) -> list[str]:
        return ["".join(rng.choice("abcdefgh ") for _ in range(20)) for _ in range(n)]

    runs = [fresh(n) for n in (2, 3, 4, 5, 6, 20) for _ in range(5)]
    rows = [(k, "\n".join(fresh(3) + run + fresh(4))) for k, run in enumerate(runs + runs)]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert [got[k] for k in range(len(rows))] == [0] * len(runs) + [len(run) for run in runs]


def test_lines_resist_shifts_and_long_texts(spark):
    rng = random.Random(8)
    lines = [f"{k} {rng.random()}" for k in range(20_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new line"] + lines[:9000] + ["other"] + lines[9000:])), (3, "\n".join(["same"] * 5000))]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 20_000, 3: 4999}


@pytest.mark.parametrize("window", [1, 3])
def test_lines_of_other_windows(docs, rows, window):
    same([(r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.dedup_lines(docs, window=window).collect()], brute.deduped_lines(rows, window))


def test_encoding(docs, rows):
    library = Tokenizer.from_file(FILE)
    library.no_truncation()
    library.no_padding()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(text.encode()), tuple(ids), text))
    got = bpe.encode_documents(docs, FILE, keep=True, lexicon_words=300).collect()
    same([(*r[:4], tuple(r.ids), r.decoded) for r in got], want)


def test_shards(docs, rows):
    got = sharding.assign_shards(docs, shards=7).collect()
    same([(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got], [(i, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode()), "bytes", None) for i, t in rows])
    by_text, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        by_text[(r.text_crc32, r.size)].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_sizes_are_near_equal(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(k, "t%d " % (k // 2) * rng.randint(1, 30)) for k in range(4000)], "doc_id long, text string")
    sizes = [r[1] for r in sharding.assign_shards(df, shards=8).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 8 and max(sizes) <= 1.01 * min(sizes)


def test_decontamination(spark, docs, rows):
    by_id = {i: t for i, t in rows if t and i is not None}
    items = [(1, by_id[2][:120].upper()), (2, by_id[2][10:110].replace(" ", "  ")), (3, "no such text at all, anywhere in it"), (4, None), (5, "!!"), (6, by_id[10][20:90].replace("a", "b", 3)), (7, by_id[10][20:90].replace("a", "b", 3))]
    tests = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, distance int")
    want = []
    for i, t in rows:
        for item, text in items:
            norm, whole = decontaminate.normal(text), decontaminate.normal(t)
            if norm and whole and len(whole) < 5000:
                d = brute.substring_distance(norm, whole)
                if d <= int(len(norm) * 0.1):
                    want.append((i, item, d))
    assert {w[1] for w in want} == {1, 2, 6, 7}
    for block in (1 << 20, 40):
        got = decontaminate.contaminated(docs, tests, share=0.1, block_bytes=block)
        same(got.collect(), want)
        kept = decontaminate.without_leaks(docs, tests, share=0.1, block_bytes=block)
        assert kept.columns == docs.columns
        assert kept.count() == len(rows) - sum(1 for i, t in rows if (i in {w[0] for w in want}) and t and t.startswith((by_id[2][:20], by_id[10][:20])))
    assert decontaminate.contaminated(docs, tests.limit(0)).count() == 0


def test_pages(spark):
    page = "<html><body><nav>Menu</nav><article><h1>T</h1><p>A &amp; b,\n  c<br>d</article><footer>x</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, "e"), (1, "u", page, "e"), (2, None, None, "e"), (None, "v", "", "e"), (3, "w", "<article>" + "<p>word, word</p>" * 20000 + "</article>", "e")], "page_id long, url string, html string, text string")
    text = "T\n\nA & b, c d"
    long = "\n\n".join(["word, word"] * 20000)
    same(html_text.extract_pages(df).collect(), [(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", long, len(long))])


def test_language_model(docs, rows):
    got = ngram_lm.score_documents(docs).collect()
    want = brute.language_scores(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, *r[1:5]) for r in got) == sorted((i is None, i or 0, *w[:4]) for (i, _), w in zip(rows, want, strict=True))
    for pick in (4, 5):
        a = sorted((r.doc_id is None, r.doc_id or 0, r[pick + 1]) for r in got)
        b = sorted((i is None, i or 0, w[pick]) for (i, _), w in zip(rows, want, strict=True))
        assert all(x[2] == pytest.approx(y[2], rel=1e-9) for x, y in zip(a, b, strict=True))


def test_language_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own, base = ngram_lm.score_documents(docs).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert own > base


def test_quality(spark, docs, rows):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(None, 1, 1), (3, None, 1), (99_999, 0, 0)], "doc_id long, quality int, text_hash int")
    got = quality.judge(docs, labels)
    counts = [(i, *brute.quality_counts(t)) for i, t in rows]
    same([r[:6] for r in got.collect()], counts)
    same([(r.doc_id, r.n_words, r.base_failed) for r in got.collect()], [(c[0], c[1], c[1] < 50 or 100 * c[5] > 50 * c[1]) for c in counts])
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    same([(r.doc_id,) for r in kept.collect()], [(r.doc_id,) for r in got.where("kept").collect()])
    none = quality.judge(docs, labels.limit(0))
    assert none.where("kept = base_failed").count() == 0


def test_quality_tells_good_from_bad(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judge(docs, labels.where("doc_id % 2 = 0")).drop("quality").join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed")
    assert judged.where("kept = (quality = 1)").count() >= 0.97 * judged.count()


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "some item")], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        suffix_array.remove_repeats(none), phrases.remove_phrases(none), simhash.near_duplicates(none), simhash.one_of_each(none), line_dedup.dedup_lines(none), line_dedup.with_kept_text(none),
        bpe.encode_documents(none, FILE), sharding.assign_shards(none), decontaminate.contaminated(none, items), decontaminate.without_leaks(none, items), html_text.extract_pages(pages),
        ngram_lm.score_documents(none), quality.judge(none, labels), quality.keep_good(none, labels),
    ):
        assert df.count() == 0
