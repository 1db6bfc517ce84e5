"""Command line: ``python -m attesta --root FOLDER <command>``."""

from __future__ import annotations

import argparse

from attesta.api import Brain
from attesta.config import Settings
from attesta.session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="attesta")
    p.add_argument("--root", default=None, help="folder of the tables (default: the brain_dir setting)")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **options: object) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for flag, default in options.items():
            c.add_argument("--" + flag.replace("_", "-"), default=default, type=type(default) if isinstance(default, int) else None)
        return c

    command("ingest", "folder")
    command("watch", "folder", every=5, rounds=0)
    command("add", "title", "body", author="")
    command("search", "query", limit=10)
    command("search-claims", "query", limit=20)
    command("claims", status=None, as_of=None, limit=20)
    command("stats")
    command("coverage", "entity")
    command("project", "folder").add_argument("--full", action="store_true")
    command("authority-list")
    command("authority-set", "source", "weight", topic=None)
    command("authority-remove", "source", topic=None)
    command("changelog", source=None, limit=50)
    command("conflicts-list", limit=50)
    command("conflicts-detect")
    command("conflicts-resolve")
    command("promote")
    command("promote-claim", "claim_id", "status")
    command("retract", "artifact_id")
    command("embedding-stats")
    command("cache-stats")
    command("cache-clear")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    settings = Settings.load()
    spark = build_session(master=a.master)
    brain = Brain(spark, a.root or settings.brain_dir, settings)
    brief = ["claim_id", "natural_language", "status", "knowledge_class", "truth_score"]
    run = {
        "ingest": lambda: brain.ingest(a.folder),
        "watch": lambda: [print(counts, flush=True) for counts in brain.watch(a.folder, a.every, a.rounds or None)] and None,
        "add": lambda: brain.add_text(a.title, a.body, a.author),
        "search": lambda: brain.search(a.query, a.limit),
        "search-claims": lambda: brain.search_claims(a.query, a.limit).select(*brief),
        "claims": lambda: brain.claims(status=a.status, limit=a.limit, as_of_valid=a.as_of).select(*brief),
        "stats": lambda: [brain.stats(), brain.counts_by("status"), brain.counts_by("knowledge_class")],
        "coverage": lambda: brain.coverage(a.entity),
        "project": lambda: brain.project(a.folder, force_full=a.full),
        "authority-list": lambda: brain.authority().orderBy("source", "topic"),
        "authority-set": lambda: brain.set_authority(a.source, float(a.weight), a.topic),
        "authority-remove": lambda: brain.remove_authority(a.source, a.topic),
        "changelog": lambda: brain.recent_events(a.limit, a.source),
        "conflicts-list": lambda: brain.resolutions().orderBy("resolved_at", ascending=False).limit(a.limit),
        "conflicts-detect": lambda: brain.detect_conflicts().select("description", "score_delta"),
        "conflicts-resolve": lambda: brain.resolve_conflicts(),
        "promote": lambda: {"promoted": brain.promote_all()},
        "promote-claim": lambda: brain.set_status(a.claim_id, a.status),
        "retract": lambda: {"retracted": brain.retract(a.artifact_id)},
        "embedding-stats": lambda: brain.embedding_stats(),
        "cache-stats": lambda: brain.cache_stats(),
        "cache-clear": lambda: {"removed": brain.clear_cache()},
    }[a.command]
    result = run()
    for item in result if isinstance(result, list) else [result]:
        if hasattr(item, "show"):
            item.show(100, truncate=False)
        elif item is not None:
            print(item)


if __name__ == "__main__":
    main()
