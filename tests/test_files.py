"""Listing without reading, parsers by type with a second attempt, and watching a folder."""

import os

from build import NOW

from attesta.__main__ import main
from attesta.api import Brain
from attesta.config import Settings
from attesta.sources import files

GOOD = "# Title\n\nZoe owns the report.\n\n# Points\n\n" + "\n".join(f"- point {k} of the list that says a lot about the matter" for k in range(12)) + "\n"


def test_unchanged_files_are_not_read_again(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"f{k}.md").write_text(f"text {k:02d}")
    found, state = files.scan(spark, str(tmp_path))
    assert found.count() == 40
    state = spark.createDataFrame(state.collect(), state.schema)
    path = tmp_path / "f7.md"
    at = os.stat(path)
    path.write_text("tExt 07")
    os.utime(path, ns=(at.st_atime_ns, at.st_mtime_ns))  # other bytes, but nothing a listing shows
    (tmp_path / "f8.md").write_text("longer than before")
    os.utime(tmp_path / "f9.md", ns=(1, 1_000_000_000))  # another time, the same bytes
    (tmp_path / "new.md").write_text("new")
    found, state = files.scan(spark, str(tmp_path), state)
    assert sorted((r.title, r.change) for r in found.collect()) == [("f8.md", "modified"), ("new.md", "new")]
    assert state.count() == 41 and state.where("content_hash IS NULL").isEmpty()


def test_parsers_and_second_attempts(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF good", "b.pdf": b"%PDF poor", "c.pdf": b"%PDF broken", "d.png": b"\x89PNG\x00", "e.md": b"Ann owns the box.", "f.html": b"<h1>T</h1><p>Ben uses it.</p>"}.items():
        (tmp_path / name).write_bytes(data)
    seen = tmp_path / "seen"
    seen.mkdir()

    def first(content: bytes, path: str) -> str:
        (seen / f"1-{os.path.basename(path)}").write_text("")
        if b"broken" in content:
            raise ValueError("cannot read this")
        return GOOD if b"good" in content else "x"

    def second(content: bytes, path: str) -> str:
        (seen / f"2-{os.path.basename(path)}").write_text("")
        return GOOD.replace("Zoe", "Yan")

    arts, _ = files.scan(spark, str(tmp_path))
    got = {r.title: (r.backend, r.markdown) for r in files.parse(arts, {".pdf": [first, second]}).collect()}
    assert got["a.pdf"] == ("parser:0", GOOD) and got["b.pdf"][0] == got["c.pdf"][0] == "parser:1"
    assert got["e.md"] == ("text", "Ann owns the box.") and got["f.html"][0] == "html" and "d.png" not in got
    assert sorted(os.listdir(seen)) == ["1-a.pdf", "1-b.pdf", "1-c.pdf", "2-b.pdf", "2-c.pdf"]


def test_binary_files_make_no_claims(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    (box / "a.pdf").write_bytes(b"%PDF Zoe owns the report. \xff\xfe")
    b = Brain(spark, str(tmp_path / "brain"), Settings(llm_rate_limit_rpm=10**6))
    assert b.ingest(str(box), NOW) == {"artifacts": 0, "claims": 0, "cached_chunks": 0, "events": 0, "skipped": 1}
    assert b.ingest(str(box), NOW)["skipped"] == 0
    with_parser = Brain(spark, str(tmp_path / "other"), Settings(llm_rate_limit_rpm=10**6), parsers={".pdf": [lambda content, path: GOOD]})
    assert with_parser.ingest(str(box), NOW)["claims"] >= 1 and with_parser.claims().where("subject = 'Zoe'").count() == 1


def test_watch_sees_a_dropped_file(spark, tmp_path, capsys):
    box = tmp_path / "box"
    box.mkdir()
    (box / "a.md").write_text("Ann owns the box.")
    b = Brain(spark, str(tmp_path / "brain"), Settings(llm_rate_limit_rpm=10**6))
    rounds = b.watch(str(box), every=0.1, rounds=3)
    assert next(rounds)["claims"] == 1
    (box / "b.md").write_text("Ben uses the lid.")
    assert next(rounds)["claims"] == 1 and {r.subject for r in b.claims().collect()} == {"Ann", "Ben"}
    assert list(rounds) == []
    (box / "c.md").write_text("Cid owns the cup.")
    main(["--root", str(tmp_path / "brain"), "watch", str(box), "--rounds", "1", "--every", "1"])
    assert "'artifacts': 1" in capsys.readouterr().out
