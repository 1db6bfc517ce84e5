"""The parts that run inside tasks, against plain versions."""

from __future__ import annotations

import json
import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from attesta.llm import anchors, bpe, decontaminate, html_text, phrases, quality, sharding, simhash, suffix_array  # noqa: E402
from attesta.llm.text import words  # noqa: E402

FILE = public_tokenizers.path("word_bpe_49k.json")


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def test_words_do_not_cross_rows():
    starts, ends, rows = words(*flat(["a b", "c", "", " \t", "d\x0be "]))
    assert [(int(a), int(b)) for a, b in zip(starts, ends, strict=True)] == [(0, 1), (2, 3), (3, 4), (6, 7), (8, 9)]
    assert rows.tolist() == [0, 2, 3, 3, 3, 5]


def test_equal_windows_own_equal_anchors():
    rng = random.Random(3)
    common = "".join(rng.choice("abcd") for _ in range(300))
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 400))) + common + "x" * rng.randint(0, 50) for _ in range(6)]
    grams, offsets, span = anchors.byte_units(*flat(texts), 16)
    anchor, first, last = anchors.own_anchors(grams, offsets, 64, 16)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    assert sorted(covered) == [k for a, b in zip(offsets[:-1], offsets[1:], strict=True) for k in range(a, b - 63)]
    owner = {}
    data = "".join(texts)
    for p, a, b in zip(anchor, first, last, strict=True):
        for k in range(a, b + 1):
            assert owner.setdefault(data[k : k + 64], p - k) == p - k


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_merged_shards_find_repeats(shards):
    rng = random.Random(shards)
    base = ["".join(rng.choice("ab") for _ in range(120)) for _ in range(3)]
    texts = [rng.choice(base)[: rng.randint(40, 120)] + "".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(24)]
    data, offsets = flat(texts)
    weight = np.array([1 + (k % 5 == 0) for k in range(len(texts))])
    got = suffix_array.merged_repeats(data, offsets, np.arange(len(texts)) % shards, weight, window=32)
    seen: dict[str, int] = {}
    for t, w in zip(texts, weight, strict=True):
        for k in range(len(t) - 31):
            seen[t[k : k + 32]] = seen.get(t[k : k + 32], 0) + int(w)
    want = [len(t) - k >= 32 and seen[t[k : k + 32]] > 1 for t in texts for k in range(len(t))]
    assert got.tolist() == want


def test_shard_order_is_the_suffix_order_in_symbols():
    data, offsets = flat(["abcdefghabcdefghabcdefgh", "abcdefghabcdefgh"])
    symbol = np.zeros(len(data), np.int32)
    text = bytes(data)
    names = sorted({text[k : k + 8] for k in range(17)} | {text[k : k + 8] for k in range(24, 33)})
    for k in [*range(17), *range(24, 33)]:
        symbol[k] = 1 + names.index(text[k : k + 8])
    end = np.repeat(offsets[1:], np.diff(offsets))
    order = suffix_array.shard_order(symbol, np.arange(len(data)), end)

    def key(p):
        return [int(symbol[q]) for q in range(p, end[p], 8)]

    assert [key(p) for p in order] == sorted(key(p) for p in range(len(data)))


def test_bucket_of_fingerprints_two_ways():
    rng = np.random.default_rng(2)
    mask = simhash.TRIPLES[4]
    free = [b for b in range(64) if not mask >> b & 1]
    prints = np.unique(np.array([sum(1 << int(b) for b in rng.choice(free[:12], rng.integers(0, 7), replace=False)) for _ in range(300)], np.uint64))
    assert (simhash.bucket_roots(prints, mask) == simhash.bucket_roots(prints, mask, small=1)).all()


def test_close_fingerprints_share_a_triple():
    for a in range(64):
        for b in range(a):
            assert any(not m >> a & 1 and not m >> b & 1 for m in simhash.TRIPLES)


def test_lexicon_numbers_words_and_shares_suffixes():
    found = sorted({w.encode() for w in "a ab abc bc c walking talking stalking walk talk é".split()})
    arrays = bpe.compile_lexicon(found)
    args = [arrays[k] for k in ("edge", "target", "before", "final")]
    assert bpe.walk(*args, [*found, b"", b"wal", b"walkings", b"zz"]).tolist() == [*range(len(found)), -1, -1, -1, -1]
    assert len(arrays["final"]) < 1 + len({w[:k] for w in found for k in range(1, len(w) + 1)})
    empty = bpe.compile_lexicon([])
    assert bpe.walk(*[empty[k] for k in ("edge", "target", "before", "final")], [b"a"]).tolist() == [-1]


def test_encoding_equals_the_library():
    library = Tokenizer.from_file(FILE)
    library.no_truncation()
    library.no_padding()
    merger = bpe.Merger(json.loads(Path(FILE).read_text(encoding="utf-8")))
    rng = random.Random(1)
    texts = ["ΑΣ ΑΣΣ. İstanbul <|endoftext|>a<|startoftext|>x", "don't WE'RE 's'll '", "x" * 5000, "é 　é\u0085\x1c\x1d", "͸ \U0003fffd", "日本語１２³", ""]
    texts += ["".join(rng.choice("abc éß'.,!?<|>0१\n\tİΣ") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for t in texts:
        got = [i for w in t.encode().split() for i in merger.encode(w.decode())]
        want = library.encode(t, add_special_tokens=False)
        assert got == want.ids, t
        assert bpe.decode(got, merger) == library.decode(want.ids, skip_special_tokens=False)
    long = ["".join(rng.choice("abcthein") for _ in range(rng.randint(1, 39))) for _ in range(300)]
    assert merger.merge_many(long) == [merger.merge(w) for w in long]


def test_myers_equals_dynamic_programming():
    rng = random.Random(7)
    for _ in range(150):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        assert decontaminate.best_distance(item, text, 1000) == brute.substring_distance(item, text)


def test_items_within_the_budget_are_found():
    rng = random.Random(9)
    items = [(k, " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(3, 40)))) for k in range(12)]
    matcher = decontaminate.Matcher(items, 0.1)
    for _ in range(200):
        number = rng.randrange(len(items))
        text = list(items[number][1])
        budget = len(text) // 10
        for _ in range(rng.randint(0, budget + 2)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([["x"], ["y", text[at]], []])
        whole = "some words " + "".join(text) + " more"
        want = {k: d for k, (_, t) in enumerate(items) for d in [brute.substring_distance(t, whole)] if d <= int(len(t) * 0.1)}
        assert matcher.distances(whole) == want


def test_longest_go_first():
    assert sharding.longest_first([5, 9, 4, 4, 3], 2) == [1, 0, 1, 0, 1]
    assert sharding.longest_first([], 3) == []


def test_main_text_of_pages():
    page = """<html><body class="has-sidebar"><header class="site"><h1>Site</h1></header><div id="cookie-notice">We use cookies, a lot, so many words here.</div>
    <div class="wrap"><div class="menu"><a href=x>Home</a></div><div class="content"><h2>Title</h2><div><p>First paragraph, with commas, and a <a href=#>link</a> that is long enough.</p>
    <ul><li>item one</li><li>item two</ul><p>Second&nbsp;one &lt;b&gt; with   spaces
    and lines, long enough to count.<p>Third</div></div><div class="sidebar"><p>Side text, which is long, and has commas, but is no article.</p></div>
    <div id="comments"><p>Great article, I love it, really, thanks so much.</p></div></div><form><input name=q><p>Subscribe, please, now, this is a long form text</p></form>
    <script>if(a<b){"</div>"}</script><footer>f</footer></body></html>"""
    want = ["Title", "First paragraph, with commas, and a link that is long enough.", "item one", "item two", "Second one <b> with spaces and lines, long enough to count.", "Third"]
    assert html_text.main_text(page) == "\n\n".join(want)
    for source in (None, "", "<p>", "<!-- open <p>x", "<script>x"):
        assert html_text.main_text(source) == ""
    assert html_text.main_text("only &amp; text") == "only & text"
    deep = "<div>" * 3000 + "words in a deep place, quite long" + "</div>" * 3000
    assert html_text.main_text(deep) == "words in a deep place, quite long"


def test_an_article_split_over_siblings_without_article_or_main():
    long = "A long story, with commas, and words that go on, and on, and on, so that it scores well, as stories do. " * 4
    page = f"""<body><div class="menu"><p>Menu words</p></div><h1>Title</h1><div><div class="wrap"><div><div>{f"<p>{long}</p>" * 6}</div></div>
    <div><h3>Short part</h3><p>One paragraph of about sixty characters, in its own short div</p></div><div><div><p>Nested.</p></div></div><p>Brief end.</p>
    <div><p><a href=1>More to read, here</a> <a href=2>and there</a></p></div><div class="sidebar"><p>Side text, with commas, and words.</p></div></div></div><footer><p>Foot</p></footer></body>"""
    want = ["Title", *[long.strip()] * 6, "Short part", "One paragraph of about sixty characters, in its own short div", "Nested.", "Brief end."]
    assert html_text.main_text(page) == "\n\n".join(want)


def test_quality_counts():
    rng = random.Random(4)
    texts = ["", " ", "a\na\na", "x y z x y z x", "#$% | é\n\n\nb", "a b c\nd\n"] + ["".join(rng.choice("ab #\n\té") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    counts, matrix = quality.counts_and_statistics(*flat(texts))
    assert np.stack(counts, axis=1).tolist() == [brute.quality_counts(t) for t in texts]
    assert np.isfinite(matrix).all()


def test_trees_learn_and_keep_to_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.4) & (x[:, 1] > 0.2) | (rng.random(3000) < 0.05)).astype(float)
    trees = quality.fit(x, y, [-1, 1, 0])
    assert ((trees.probability(x) > 0.5) == (y > 0.5)).mean() > 0.93
    grid = np.linspace(0, 1, 50)
    for other in rng.random((20, 3)):
        for f, sign in ((0, -1), (1, 1)):
            line = np.repeat(other[None], 50, axis=0)
            line[:, f] = grid
            assert (sign * np.diff(trees.probability(line)) >= -1e-12).all()
    assert (quality.fit(x[:0], y[:0], [0, 0, 0]).probability(x[:3]) > 0.5).all()
    assert (quality.fit(x, np.ones(3000), [0, 0, 0]).probability(x[:3]) > 0.5).all()


def test_items_are_not_found_inside_words():
    items = [(1, decontaminate.normal("cat")), (2, decontaminate.normal("the end"))]
    found = decontaminate.Matcher(items, 0.0)
    assert found.distances(decontaminate.normal("We concatenate; breathe endlessly")) == {}
    assert found.distances(decontaminate.normal("The end. A cat!")) == {0: 0, 1: 0}
    assert decontaminate.normal(None) == decontaminate.normal(" -_!") == ""


def test_long_windows_are_refused(spark):
    with pytest.raises(ValueError):
        phrases.remove_phrases(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), window=300)
