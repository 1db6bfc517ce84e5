"""Incremental projection: the same pages as a full one, but only the pages of what changed are rendered and written."""

import os

from build import NOW

from attesta.api import Brain
from attesta.config import Settings
from attesta.operators import pages

LATER = "2024-06-09 00:00:00"


def read(folder):
    """Pages without their time stamps."""
    out = {}
    for base, _, names in os.walk(folder):
        for n in names:
            path = os.path.join(base, n)
            lines = open(path, encoding="utf-8").read().split("\n")
            out[os.path.relpath(path, folder)] = [x for x in lines if not x.strip().startswith(("last_updated:", "last_projected:"))]
    return out


def times(folder):
    return {os.path.relpath(os.path.join(b, n), folder): os.stat(os.path.join(b, n)).st_mtime_ns for b, _, ns in os.walk(folder) for n in ns}


def test_only_the_pages_of_changed_claims_are_written(spark, tmp_path, monkeypatch):
    b = Brain(spark, str(tmp_path / "brain"), Settings(llm_rate_limit_rpm=10**6))
    names = ["Ada", "Bea", "Cid", "Dan"]
    for k, n in enumerate(names):
        b.add_text(f"note{k}", f"{n} owns the tool{k}. {n} uses the engine of {names[(k + 1) % 4]}.", "", NOW)
    first = b.project(str(tmp_path / "pages"), NOW)
    assert set(first) == {"create"} and first["create"] >= 9
    index = (tmp_path / "pages" / "index.md").read_text()
    assert "## Topics" in index and "## Entities" in index and "[Ada](entities/ada.md)" in index
    before = times(tmp_path / "pages")
    rendered = {}
    plain = pages.to_parts
    monkeypatch.setattr(pages, "to_parts", lambda lines, *a: rendered.update({r.path: 1 for r in lines.select("path").distinct().collect()}) or plain(lines, *a))
    b.add_text("note3", "Dan owns the extra box.", "", NOW)  # a new claim of Dan from the source of his others
    plan = b.project(str(tmp_path / "pages"), NOW)
    after = times(tmp_path / "pages")
    written = {p for p in after if after[p] != before.get(p)}
    assert {"entities/dan.md", "sources/note3.md", "index.md"} <= written
    assert not any(p.startswith("entities/") and p != "entities/dan.md" for p in written) and not any(p.startswith("sources/") and p != "sources/note3.md" for p in written)
    assert plan.get("delete", 0) == 0 and {p for p in rendered if p.startswith("entities/")} == {"entities/dan.md"}
    monkeypatch.setattr(pages, "to_parts", plain)
    # a claim goes: its page and the relations of others
    for r in b.claims(limit=None).where("subject = 'Bea'").collect():
        b.set_status(r.claim_id, "rejected", NOW)
    assert b.project(str(tmp_path / "pages"), NOW)["delete"] >= 1
    assert not (tmp_path / "pages" / "entities" / "bea.md").exists()
    b.project(str(tmp_path / "whole"), LATER, force_full=True)
    assert read(tmp_path / "pages") == read(tmp_path / "whole")
    assert "Bea" not in "".join(read(tmp_path / "pages")["entities/ada.md"]).split("Related")[-1].split("Source")[0]
    assert set(b.project(str(tmp_path / "pages"), LATER)) <= {"unchanged"}


def test_a_new_layout_renders_everything(spark, tmp_path, monkeypatch):
    b = Brain(spark, str(tmp_path / "brain"), Settings(llm_rate_limit_rpm=10**6))
    b.add_text("note", "Ada owns the tool.", "", NOW)
    b.project(str(tmp_path / "pages"), NOW)
    monkeypatch.setattr("attesta.api.PAGE_LAYOUT", 99)
    seen = []
    plain = pages.entity_lines
    monkeypatch.setattr(pages, "entity_lines", lambda pc, *a, **k: seen.append(pc.count()) or plain(pc, *a, **k))
    assert set(b.project(str(tmp_path / "pages"), NOW)) == {"unchanged"} and seen == [1]


def test_topic_counts_shuffle_only_what_they_count(spark):
    from attesta.queries import load

    plan = load()[0]["topic_page_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1  # claims; no evidence, no file of claims between
