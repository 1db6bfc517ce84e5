"""One object for the whole workflow: ingest, queries, truth maintenance, projection.

Tables live below one folder as snapshots: claims, evidence, events, resolutions, authority, topics, documents,
extractions, embeddings, file_state and manifest. Methods return DataFrames, or small dicts of counts.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta import schema as S
from attesta.config import Settings
from attesta.functions import text as X
from attesta.functions import topics as TP
from attesta.operators import authority, changelog, conflicts, documents, emission, extraction, ledger, pages, search, semantic
from attesta.plans.ordered import assign_seq
from attesta.plans.sqlrun import run_sql
from attesta.session import cut_lineage
from attesta.sources import files, ledger_store
from attesta.sources.content_cache import ContentCache
from attesta.sources.publish import delete_pages, write_pages
from attesta.sources.snapshots import BUCKETS, Snapshots, Transaction

#: Counted up when pages are laid out anew: the next projection then writes all of them.
PAGE_LAYOUT = 1
EVENT_COLUMNS = "change_type, ts, entity_id, source_uri, payload, agent"


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")


class Brain:
    def __init__(
        self, spark: SparkSession, root: str, settings: Settings | None = None,
        extract: Callable[[str], str] = extraction.sentence_extractor, embed: Callable[[DataFrame], DataFrame] | None = None,
        parsers: dict[str, list[files.Parser]] | None = None, buckets: int = BUCKETS, versions: dict[str, str] | None = None,
    ) -> None:
        """``versions`` names the version of the parsers ('parse') and of the embedder ('embed'): a new one empties what is kept of their answers."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.settings = settings or Settings()
        self.store = Snapshots(spark, f"{self.root}/tables", buckets)
        self.extract = extract
        self.embed = embed
        self.parsers = parsers or {}
        self.answers = ContentCache(self.store, versions or {})
        self.rule = ledger.Promotion(
            self.settings.promote_threshold, self.settings.high_authority_threshold, self.settings.corroboration_count
        )

    def _table(self, name: str, ddl: str) -> DataFrame:
        found = self.store.read(name)
        return self.spark.createDataFrame([], ddl) if found is None else found

    def _ledger(self) -> tuple[DataFrame, DataFrame]:
        claims, evidence = self.store.read("claims"), self.store.read("evidence")
        if claims is None or evidence is None:
            raise LookupError("the ledger is empty: ingest something first")
        return claims, evidence

    # --- ingest ---

    def ingest(self, folder: str, as_of: str | None = None) -> dict[str, int]:
        """Files under ``folder`` into claims, pages and events; unchanged files and known chunks are skipped."""
        now = as_of or utc_now()
        self.answers.check("embed")
        arts, state = files.scan(self.spark, folder, self._table("file_state", files.STATE))
        arts = cut_lineage(arts)
        known, fresh_parses = self._parses(arts)
        parsed = cut_lineage(files.parse(arts, self.parsers, known).selectExpr("*", f"{X.strip_boilerplate('markdown')} AS body_text").drop("markdown").withColumnRenamed("body_text", "markdown"))
        n_arts = parsed.count()
        skipped = arts.count() - n_arts
        if n_arts == 0:
            if skipped:
                self.store.write("file_state", state)
            return {"artifacts": 0, "claims": 0, "cached_chunks": 0, "events": 0, "skipped": skipped}
        old_docs = self._table("documents", "source_uri string, markdown string, content_hash string")
        diff = documents.section_diff(old_docs, parsed)
        summaries = documents.change_summary(diff)
        doc_events = documents.document_events(summaries, parsed.select("source_uri", "title"), now).selectExpr(
            "change_type", "ts", "entity_id", "source_uri", "payload", "'' AS agent"
        )
        chunks = cut_lineage(documents.chunk(
            parsed.selectExpr("artifact_id", "source_uri", "source_type", "title", "author", "markdown", "cast(content_created_at AS STRING) AS dated",
                              "regexp_extract(source_uri, r'([^/]+)$', 1) AS source_artifact"),
            ["artifact_id", "source_uri", "source_type", "title", "author", "dated", "source_artifact"], "markdown", self.settings.chunk_size,
        ))
        cache = self._table("extractions", "chunk_hash string, part int, response string")
        hits, misses = documents.cached_split(chunks, cache)
        # one call for each different chunk, however many files hold it
        once = misses.dropDuplicates(["chunk_hash"])
        answers = self._call(extraction.prompts(once))
        answered = answers.where("error IS NULL").select("chunk_hash", "part", "response")
        fresh = cut_lineage(answered.join(answers.where("error IS NOT NULL").select("chunk_hash"), "chunk_hash", "left_anti"))
        columns = ["artifact_id", "source_uri", "source_artifact", "author", "response"]
        parsed_claims = extraction.parse_responses(misses.join(answered, "chunk_hash").select(*columns).unionByName(hits.select(*columns)))
        claims = extraction.claims_from(parsed_claims, now)
        claim_events = changelog.claim_events(claims.selectExpr("subject", "predicate", "object", "source_artifact AS source_uri"), now)
        n_hits = hits.select("artifact_id", "chunk_hash").distinct().count()
        # one commit: a run that is cut off leaves everything as it was
        with self.store.transaction() as tx:
            n_claims = self._add(claims, now, tx)
            n_events = self._emit(doc_events.unionByName(claim_events.selectExpr(*EVENT_COLUMNS.split(", "))), tx)
            tx.upsert("extractions", fresh, ["chunk_hash"])
            if fresh_parses is not None:
                made = fresh_parses.join(parsed.selectExpr("artifact_id", "to_json(struct(backend, markdown)) AS value"), "artifact_id")
                self.answers.keep(tx, "parse", made.select("cache_key", "value"))
            tx.upsert("documents", parsed.select("source_uri", "markdown", "content_hash"), ["source_uri"])
            tx.write("file_state", state)
        if self.settings.enable_conflict_resolution:
            self.resolve_conflicts(as_of=now)
        return {"artifacts": n_arts, "claims": n_claims, "cached_chunks": n_hits, "events": n_events, "skipped": skipped}

    def _parses(self, arts: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """What parsers made of the same bytes before (artifact_id, backend, markdown), and the keys (artifact_id, cache_key) of files no parser has seen. The key is suffix and bytes."""
        if not self.parsers:
            return None, None
        asked = arts.where(arts["suffix"].isin(*self.parsers)).selectExpr(
            "artifact_id", self.answers.key("parse", "concat(encode(suffix, 'UTF-8'), coalesce(content, encode(body, 'UTF-8')))") + " AS cache_key"
        )
        hits, misses = self.answers.find("parse", cut_lineage(asked))
        read = hits.selectExpr("artifact_id", "from_json(value, 'backend string, markdown string') AS p").selectExpr("artifact_id", "p.backend", "p.markdown")
        return cut_lineage(read), misses

    def watch(self, folder: str, every: float = 5.0, rounds: int | None = None) -> Iterator[dict[str, int]]:
        """Ingest what is new or changed under ``folder`` again and again; yields the counts of each round that found files. A round without changes only lists the folder."""
        for k in itertools.count():
            if rounds is not None and k >= rounds:
                return
            if k:
                time.sleep(every)
            counts = self.ingest(folder)
            if counts["artifacts"] or counts["skipped"]:
                yield counts

    def add_text(self, title: str, body: str, author: str = "", as_of: str | None = None) -> dict[str, int]:
        """One text, extracted and added to the ledger without chunks, cache or events."""
        now = as_of or utc_now()
        art = files.manual_text(self.spark, title, body, author).selectExpr(
            "*", "body AS content", f"'{now}' AS dated", "title AS source_artifact"
        )
        answers = self._call(extraction.prompts(art))
        self.answers.check("embed")
        with self.store.transaction() as tx:
            return {"artifacts": 1, "claims": self._add(extraction.claims_from(extraction.parse_responses(answers), now), now, tx)}

    def _call(self, prompts: DataFrame) -> DataFrame:
        """Answers of the extractor; only an outside service is paced."""
        s = self.settings
        tasks = None if self.extract is extraction.sentence_extractor else 8
        return extraction.call_extractor(prompts, self.extract, s.llm_max_concurrent, s.llm_rate_limit_rpm, s.llm_retry_max, timeout=s.llm_request_timeout, tasks=tasks)

    def _add(self, claims: DataFrame, now: str, tx: Transaction) -> int:
        """Stamp authority, merge (by meaning too when an embedder is given), decay and store. Returns arriving claims."""
        stamped = cut_lineage(authority.stamp(claims, self.authority()))
        if self.store.read("claims") is not None:
            top = self._ledger()[0].agg({"seq": "max"}).collect()[0][0] or 0
            stamped = stamped.withColumn("seq", stamped["seq"] + (top + 1))
        key = "fingerprint"
        if self.embed is not None and self.settings.enable_ingestion_embeddings:
            stamped, key = self._with_meaning(stamped, tx), "merge_to"
        ledger_store.merge_in(tx, stamped, now, self.rule, key, decay=True)
        ledger_store.note_groups(tx, stamped, key)
        return stamped.count()

    def _with_meaning(self, stamped: DataFrame, tx: Transaction) -> DataFrame:
        """Merge key of each arriving claim: the fingerprint of the claim it is equal or similar to. Only arriving claims are embedded; what is stored is matched by its stored vector."""
        vectors = self._vectors_of(stamped, tx)
        stored = self.store.read("embeddings")
        if stored is not None:
            live = self._ledger()[0].select(ledger_store.KEY, "seq")
            stored = stored.join(live, ledger_store.KEY).selectExpr(f"{ledger_store.KEY} AS id", "seq", f"{ledger_store.KEY} AS fingerprint", "embedding")
        found = cut_lineage(semantic.cluster(vectors.select("id", "seq", "fingerprint", "embedding"), self.settings.semantic_dedup_threshold, stored))
        # the id of a stored leader is its merge key already
        keyed = cut_lineage(run_sql(
            """
            SELECT s.*, coalesce(l.fingerprint, f.leader_id, s.fingerprint) AS merge_to FROM @s s
            LEFT JOIN @f f ON s.claim_id = f.id LEFT JOIN @v l ON f.leader_id = l.id
            """,
            s=stamped, f=found, v=vectors.select("id", "fingerprint"),
        ))
        lead = found.where("how = 'new'").select("id")
        self._keep_vectors(tx, vectors.join(lead, "id", "left_semi").selectExpr(f"fingerprint AS {ledger_store.KEY}", "embedding"))
        return keyed

    def _vectors_of(self, claims: DataFrame, tx: Transaction) -> DataFrame:
        """Vectors of claims (id, seq, fingerprint, embedding): the embedder is asked once for each text it has not had."""
        if self.embed is None:
            raise ValueError("this Brain has no embedder")
        rows = cut_lineage(claims.selectExpr("claim_id AS id", "seq", "fingerprint", f"{X.claim_text('subject', 'predicate', 'object')} AS text").selectExpr(
            "*", f"{self.answers.key('embed', 'text')} AS cache_key"
        ))
        hits, misses = self.answers.find("embed", rows)
        once = run_sql("SELECT cache_key, r.* FROM (SELECT cache_key, min_by(struct(id, seq, fingerprint, text), id) AS r FROM @m GROUP BY cache_key)", m=misses)
        new = cut_lineage(self.embed(once.drop("cache_key")).select("id", "embedding").join(once.select("id", "cache_key"), "id").select("cache_key", "embedding"))
        self.answers.keep(tx, "embed", new.selectExpr("cache_key", "to_json(embedding) AS value"))
        columns = ["id", "seq", "fingerprint", "embedding"]
        told = hits.selectExpr("id", "seq", "fingerprint", "from_json(value, 'array<double>') AS embedding")
        asked = misses.join(new.selectExpr("cache_key", "cast(embedding AS ARRAY<DOUBLE>) AS embedding"), "cache_key", "left")
        return cut_lineage(told.select(columns).unionByName(asked.select(columns)))

    def _keep_vectors(self, tx: Transaction, rows: DataFrame) -> None:
        """Vectors by merge key, in the buckets of the claims they belong to."""
        if self.store.read("embeddings") is None:
            tx.write("embeddings", rows, ledger_store.KEY)
        else:
            tx.upsert("embeddings", rows, [ledger_store.KEY])

    def _emit(self, events: DataFrame, tx: Transaction) -> int:
        """Append events with ids and numbers that continue those of the log."""
        log = self.store.read("events")
        start = 0 if log is None else (log.agg({"seq": "max"}).collect()[0][0] or 0) + 1
        rows = assign_seq(events, [F.col(c) for c in ("ts", "change_type", "source_uri", "entity_id", "payload")]).selectExpr(
            "left(sha2(concat_ws('|', seq, change_type, ts, entity_id, source_uri, payload), 256), 32) AS event_id", f"seq + {start}L AS seq",
            "change_type", "ts", "entity_id", "source_uri", "payload", "cast(null AS STRING) AS triggered_by", "agent",
        )
        tx.append("events", rows)
        return rows.count()

    # --- reads ---

    def claims(self, **filters: object) -> DataFrame:
        return ledger.list_claims(self._ledger()[0], **filters)

    def get_claim(self, claim_id: str) -> DataFrame:
        return ledger.get_claim(self._ledger()[0], claim_id)

    def search_claims(self, query: str, limit: int = 20) -> DataFrame:
        return search.search_claims(self._ledger()[0], query, limit)

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """Claims ranked by BM25 over their sentences."""
        found = search.bm25(self._ledger()[0], "claim_id", "natural_language", query.split(), limit)
        return found.join(self._ledger()[0].select("claim_id", "subject", "natural_language", "status"), "claim_id")

    def get_entity(self, name: str) -> DataFrame:
        return search.claims_by_entity(self._ledger()[0], name)

    def coverage(self, name: str) -> DataFrame:
        return search.coverage(*self._ledger(), name)

    def stats(self) -> DataFrame:
        return ledger.stats(self._ledger()[0])

    def counts_by(self, column: str) -> DataFrame:
        return ledger.counts_by(self._ledger()[0], column)

    def events(self) -> DataFrame:
        return self._table("events", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.EVENT.fields))

    def recent_events(self, limit: int = 50, source: str | None = None) -> DataFrame:
        log = self.events()
        return changelog.for_source(log, source) if source else changelog.recent(log, limit)

    def resolutions(self) -> DataFrame:
        return self._table("resolutions", "seq long, conflict_id string, winner_id string, loser_id string, strategy_used string, confidence double, resolved_by string, resolved_at timestamp_ntz, rationale string")

    # --- truth maintenance ---

    def authority(self) -> DataFrame:
        return self._table("authority", "source string, topic string, weight double")

    def set_authority(self, source: str, weight: float, topic: str | None = None) -> None:
        change = self.spark.createDataFrame([(source, topic, float(weight))], "source string, topic string, weight double")
        self.store.write("authority", cut_lineage(authority.set_weights(self.authority(), change)))

    def remove_authority(self, source: str, topic: str | None = None) -> None:
        self.store.write("authority", cut_lineage(authority.remove(self.authority(), source, topic)))

    def promote_all(self, as_of: str | None = None) -> int:
        claims = self._ledger()[0]
        out = ledger.promote_all(claims, as_of or utc_now(), self.rule).where("promoted")
        with self.store.transaction() as tx:
            return ledger_store.change(tx, out.select(*claims.columns))

    def set_status(self, claim_id: str, status: str, as_of: str | None = None) -> None:
        if status not in S.STATUSES:
            raise ValueError(f"Unknown status: {status}. Valid: {list(S.STATUSES)}")
        change = self.spark.createDataFrame([(claim_id, status)], "claim_id string, new_status string")
        claims = self._ledger()[0]
        with self.store.transaction() as tx:
            one = cut_lineage(ledger.set_status(claims.where(claims["claim_id"] == claim_id), change, as_of or utc_now()).select(*claims.columns))
            if ledger_store.change(tx, one):
                ledger_store.note_groups(tx, one, ledger_store.KEY)

    def retract(self, artifact_id: str) -> int:
        gone = self.spark.createDataFrame([(artifact_id,)], "artifact_id string")
        with self.store.transaction() as tx:
            return ledger_store.retract(tx, gone)

    def detect_conflicts(self) -> DataFrame:
        return conflicts.detect_within(self._ledger()[0], self.settings.conflict_similarity_threshold)

    def resolve_conflicts(self, as_of: str | None = None) -> dict[str, int]:
        """Resolve the conflicts between active claims that no resolution names yet, in order; apply the automatic ones and record everything.

        Only groups (subject, predicate) that got claims since the last run are looked at, and only their buckets are read. Links are stored and only grow, so a second run
        finds nothing to do and leaves ledger, links and resolutions as they are.
        """
        now = as_of or utc_now()
        claims = ledger_store.waiting_claims(self.store)
        if claims is None:
            return {"total": 0, "auto": 0, "pending": 0}
        claims = cut_lineage(claims)
        known = self.resolutions().select("conflict_id").distinct()
        found = conflicts.detect_within(ledger.active(claims), self.settings.conflict_similarity_threshold)
        pairs = cut_lineage(found.join(known, "conflict_id", "left_anti"))
        looked_at = self.spark.createDataFrame([], "ck string")
        if pairs.isEmpty():
            self.store.write("open_groups", looked_at)
            return {"total": 0, "auto": 0, "pending": 0}
        res = cut_lineage(conflicts.resolve_in_order(pairs, now, self.settings.resolve_strategy, self.settings.auto_resolve_threshold))
        links, supersede = conflicts.effects(res)
        stored = self._table("links", "a_id string, b_id string")
        links = cut_lineage(stored.unionByName(links).distinct())
        linked = ledger.with_conflict_counts(claims, ledger.conflict_links(claims, links))
        both = res.selectExpr("explode(array(a_claim_id, b_claim_id)) AS claim_id").distinct()
        with self.store.transaction() as tx:
            ledger_store.change(tx, ledger.supersede(linked, supersede).join(both, "claim_id", "left_semi").select(*claims.columns))
            tx.write("links", links)
            tx.write("open_groups", looked_at)
            tx.append("resolutions", res.select("a_seq", "conflict_id", "winner_id", "loser_id", "strategy_used", "confidence", "resolved_by", "resolved_at", "rationale").withColumnRenamed("a_seq", "seq"))
            self._emit(conflicts.resolution_events(res).selectExpr(*EVENT_COLUMNS.split(", ")), tx)
        auto = res.where("auto").count()
        total = res.count()
        return {"total": total, "auto": auto, "pending": total - auto}

    # --- projection ---

    def project(self, folder: str, as_of: str | None = None, force_full: bool = False) -> dict[str, int]:
        """Write the pages that changed since the last projection; returns the number of pages per action.

        What pages showed of each claim is kept, so the claims that changed are known, and a table of claims and pages says which pages held them; those, the pages that hold them now,
        the pages of entities whose relations changed and the index are rendered, no others. A full run renders everything: the first one, one that is asked for, and
        one after a change of the layout of pages.
        """
        now = as_of or utc_now()
        claims, evidence = self._ledger()
        pc = cut_lineage(pages.page_claims(claims, evidence))
        if pc.isEmpty():
            return {}
        topical = cut_lineage(pc.selectExpr("*", f"explode({TP.keyword_topics(X.claim_text('subject', 'predicate', 'object'))}) AS topic"))
        relations = cut_lineage(search.mentions(pc))
        held, states = cut_lineage(pages.claim_paths(pc, topical)), cut_lineage(pages.shown_state(pc, topical))
        manifest = self._table("manifest", "path string, content_hash string")
        layout = self.store.read("page_layout")
        full = force_full or layout is None or layout.first().version != PAGE_LAYOUT or manifest.isEmpty()
        if full:
            parts = cut_lineage(pages.to_parts(pages.union_lines([
                pages.entity_lines(pc, evidence, relations, now, topical), pages.topic_lines(topical, now), pages.source_lines(pc, now),
                pages.conflict_lines(pc, now), pages.index_lines(pc, now, topical),
            ])))
            plan = cut_lineage(emission.full(pages.page_hashes(parts).select("path", "content_hash"), self.spark.createDataFrame([], manifest.schema) if force_full else manifest))
        else:
            parts, plan = self._changed_pages(pc, topical, evidence, relations, held, states, manifest, now)
        todo = parts.join(plan.where("action IN ('create', 'update')").select("path"), "path", "left_semi")
        # old files of changed and orphaned pages go first: a page that shrank leaves no parts behind
        stale = plan.where("action IN ('update', 'delete')").select("path")
        delete_pages(stale, folder).write.format("noop").mode("overwrite").save()
        write_pages(todo, folder).write.format("noop").mode("overwrite").save()
        with self.store.transaction() as tx:
            tx.write("manifest", emission.next_manifest(plan, manifest))
            tx.write("page_claims", held, "path")
            tx.write("page_states", states, "claim_id")
            tx.write("page_relations", relations)
            tx.write("page_layout", self.spark.createDataFrame([(PAGE_LAYOUT,)], "version int"))
        return {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}

    def _changed_pages(
        self, pc: DataFrame, topical: DataFrame, evidence: DataFrame, relations: DataFrame, held: DataFrame, states: DataFrame, manifest: DataFrame, now: str,
    ) -> tuple[DataFrame, DataFrame]:
        """The parts of the pages that may have changed, and the plan for them."""
        old_states, old_held, old_relations = (self.store.read(t) for t in ("page_states", "page_claims", "page_relations"))
        changed = cut_lineage(run_sql(
            "SELECT coalesce(o.claim_id, n.claim_id) AS claim_id FROM @o o FULL JOIN @n n ON o.claim_id = n.claim_id WHERE NOT o.state <=> n.state", o=old_states, n=states
        ))
        entity = f"concat('entities/', {X.slugify('entity')}, '.md') AS path"
        moved = relations.exceptAll(old_relations).unionByName(old_relations.exceptAll(relations)).selectExpr(entity)
        look = cut_lineage(emission.files_for_claims(old_held, changed).unionByName(emission.files_for_claims(held, changed)).unionByName(moved).distinct())

        def on(rows: DataFrame, kind: str, column: str) -> DataFrame:
            """Rows whose page of that kind is looked at."""
            return rows.selectExpr("*", f"concat('{kind}/', {X.slugify(column)}, '.md') AS path").join(look, "path", "left_semi").drop("path")

        own = cut_lineage(on(pc, "entities", "subject"))
        parts = cut_lineage(pages.to_parts(pages.union_lines([
            pages.entity_lines(own, evidence.join(own.select("merge_key"), "merge_key", "left_semi"), on(relations, "entities", "entity"), now, on(topical, "entities", "subject")),
            pages.topic_lines(on(topical, "topics", "topic"), now), pages.source_lines(on(pc.where("source IS NOT NULL"), "sources", "source"), now),
            pages.conflict_lines(pc, now), pages.index_lines(pc, now, topical),
        ])))
        rendered = pages.page_hashes(parts).select("path", "content_hash")
        plan = emission.incremental(rendered, manifest, old_held, changed, also=look)
        gone = manifest.join(look, "path", "left_semi").join(rendered, "path", "left_anti").selectExpr("path", "content_hash", "'delete' AS action")
        return parts, cut_lineage(plan.unionByName(gone))

    # --- caches and vectors ---

    def cache_stats(self) -> dict[str, int]:
        return {name: self._table(name, "x int").count() for name in ("documents", "extractions")} | self.answers.counts()

    def _embedded(self) -> DataFrame:
        """Merge keys of the stored vectors that can be compared."""
        return self._table("embeddings", f"{ledger_store.KEY} string, embedding array<double>").where("size(embedding) > 0").select(ledger_store.KEY)

    def unembedded(self) -> DataFrame:
        """Claims without a stored vector."""
        return self._ledger()[0].join(self._embedded(), ledger_store.KEY, "left_anti")

    def embed_claims(self) -> int:
        """Embed and store the vectors of claims that have none; the number of vectors that came. Stored claims are not merged with each other by it."""
        self.answers.check("embed")
        missing = cut_lineage(self.unembedded().drop("fingerprint").withColumnRenamed(ledger_store.KEY, "fingerprint"))
        if missing.isEmpty():
            return 0
        with self.store.transaction() as tx:
            rows = cut_lineage(self._vectors_of(missing, tx).where("size(embedding) > 0").selectExpr(f"fingerprint AS {ledger_store.KEY}", "embedding"))
            self._keep_vectors(tx, rows)
        return rows.count()

    def embedding_stats(self) -> DataFrame:
        """Claims, those with a stored vector, those without, and the share of the first in percent."""
        return run_sql(
            f"""
            SELECT count(*) AS total, count(e.{ledger_store.KEY}) AS embedded, count(*) - count(e.{ledger_store.KEY}) AS missing,
              if(count(*) = 0, 0D, round(100D * count(e.{ledger_store.KEY}) / count(*), 1)) AS coverage_pct
            FROM @c c LEFT JOIN @e e ON c.{ledger_store.KEY} = e.{ledger_store.KEY}
            """,
            c=self._ledger()[0], e=self._embedded(),
        )

    def clear_cache(self) -> int:
        n = self._table("extractions", "chunk_hash string, part int, response string").count()
        self.store.write("extractions", self.spark.createDataFrame([], "chunk_hash string, part int, response string"))
        return n + self.answers.invalidate()
