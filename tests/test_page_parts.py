"""Page parts: a page that fits one part is put together by one shuffle, only longer ones are sorted across tasks; hashes leave out time stamps."""

import hashlib

from attesta.functions import text as X
from attesta.operators import pages

LINES = [
    (path, section, k1, float(k2), k3, f"{path}:{section}:{k1}:{k2}:{k3}")
    for path, n in (("short", 3), ("full", 4), ("long", 23), ("one", 1)) for section in (2, 1) for k1 in ("b", "a")[: 1 + n % 2] for k2 in (0, -1)[: 1 + n % 2] for k3 in range(n)
]


def test_parts_hold_the_lines_in_order_and_only_long_pages_are_numbered(spark, monkeypatch):
    numbered = []
    plain = pages.ordered_index
    monkeypatch.setattr(pages, "ordered_index", lambda df, *a: numbered.extend(r.path for r in df.select("path").distinct().collect()) or plain(df, *a))
    lines = spark.createDataFrame(LINES, "path string, section int, k1 string, k2 double, k3 bigint, line string").repartition(5)
    got = {(r.path, r.part): r.content for r in pages.to_parts(lines, 24).collect()}
    want = {}
    for path in {x[0] for x in LINES}:
        page = [x[5] for x in sorted(x for x in LINES if x[0] == path)]
        want.update({(path, at // 24): "\n".join(page[at : at + 24]) for at in range(0, len(page), 24)})
    assert got == want and numbered == ["long"]
    assert len(pages.to_parts(lines, 1000).collect()) == 4 and numbered == ["long"]


def by_lines(content):
    """The hash line by line."""
    lines = r"split(regexp_replace(c, r'(\r\n|\n|\r)$', ''), r'\r\n|\n|\r')"
    return f"sha2(array_join(filter({lines}, x -> NOT {X.ws_trim('x')} RLIKE '^last_(updated|projected):'), '\\n'), 256)".replace("(c,", f"({content},")


def test_hashes_of_odd_texts_are_those_of_their_lines(spark):
    stamp = ["last_updated: 1", "  \tlast_projected:", " last_updated:x\u0085y", "a last_updated: 1", "last_updated", "last_updated:"]
    texts = ["", "\n", "\r", "\r\n", "a\n\n", "a\n\n\n", "a\n ", "a \n", "a\r\n\r\n", "\n\r", "a\rb\r\n\nc\n", None]
    texts += [x + y + z for x in stamp for y in ("\n", "\r", "\r\n", "\n\n", "") for z in (*stamp, "b", "", "\n")]
    texts += [f"a{y}{x}{y}b{y}" for x in stamp for y in ("\n", "\r", "\r\n", "\n\r")]
    df = spark.createDataFrame([(t,) for t in texts], "c string").selectExpr("c", f"{X.stable_hash('c')} AS got", f"{by_lines('c')} AS want")
    assert [r.c for r in df.where("NOT got <=> want").collect()] == []
    plan = spark.createDataFrame([("x",)], "c string").selectExpr(X.stable_hash("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan  # no test per line
    assert df.where("c = 'last_updated: 1\nb'").first().got == hashlib.sha256(b"b").hexdigest()
