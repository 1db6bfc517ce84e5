"""Reads for people and agents: text and entity search, coverage, related claims, relations and ranked retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attesta.functions import render as R
from attesta.functions import text as X
from attesta.operators.ledger import list_claims
from attesta.plans.sqlrun import run_sql
from attesta.session import cut_lineage


def contains_any(needle: str, *columns: str) -> str:
    low = X.lit(needle.lower())
    return "(" + " OR ".join(f"contains(lower({c}), {low})" for c in columns) + ")"


def search_claims(claims: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Best ``limit`` hits in the whole ledger; text, subject and object are searched, the predicate is not."""
    return list_claims(claims.where(contains_any(query, "natural_language", "subject", "object")), limit=limit)


def claims_by_entity(claims: DataFrame, name: str) -> DataFrame:
    return claims.where(contains_any(name, "subject", "object"))


def similar_claims(claims: DataFrame, subject: str, obj: str, limit: int = 20, least: float = 0.6) -> DataFrame:
    s = X.token_overlap("lower(subject)", X.lit(subject.lower()))
    o = X.token_overlap("lower(object)", X.lit(obj.lower()))
    return list_claims(claims.where(f"{s} > {least} OR {o} > {least}"), limit=limit)


def coverage(claims: DataFrame, evidence: DataFrame, name: str) -> DataFrame:
    """One row on an entity: claims, counts per class, average confidence and score, distinct artifacts."""
    return run_sql(
        """
        SELECT count(*) AS total_claims, round(avg(confidence), 3) AS avg_confidence, round(avg(truth_score), 3) AS avg_truth_score,
          count_if(knowledge_class = 'stable') AS n_stable, count_if(knowledge_class = 'process') AS n_process,
          count_if(knowledge_class = 'tacit') AS n_tacit, count_if(knowledge_class = 'stateful') AS n_stateful,
          (SELECT count(DISTINCT artifact_id) FROM @e e LEFT SEMI JOIN @m m ON e.merge_key = m.merge_key) AS source_count
        FROM @m
        """,
        m=claims_by_entity(claims, name), e=evidence,
    )


def entities(claims: DataFrame) -> DataFrame:
    """Distinct subjects and objects."""
    return run_sql("SELECT DISTINCT explode(array(subject, object)) AS entity FROM @c", c=claims)


def claims_for_entities(claims: DataFrame, names: DataFrame) -> DataFrame:
    """Claims whose subject or object is one of ``names`` (entity), compared in lower case."""
    return run_sql(
        """
        WITH n AS (SELECT DISTINCT lower(entity) AS name FROM @names)
        SELECT c.* FROM @claims c LEFT JOIN n s ON lower(c.subject) = s.name LEFT JOIN n o ON lower(c.object) = o.name
        WHERE s.name IS NOT NULL OR o.name IS NOT NULL
        """,
        claims=claims, names=names,
    )


def related_claims(claims: DataFrame, given: DataFrame, limit: int | None = 50) -> DataFrame:
    """Claims that share an entity with the given ones, best first, without the given ones."""
    found = claims_for_entities(claims, entities(given)).join(given.select("claim_id"), "claim_id", "left_anti")
    return list_claims(found, limit=limit)


def claims_for_source(evidence: DataFrame, source: str) -> DataFrame:
    """Merge keys of claims with evidence from a source, by source name or artifact id."""
    hit = f"contains(artifact_id, {X.lit(source)}) OR contains(source_artifact, {X.lit(source)})"
    return evidence.where(hit).select("merge_key").distinct()


def claims_block(ranked: DataFrame, max_claims: int = 50) -> DataFrame:
    """One text: the first lines of ``ranked`` (ord, line, total) and how many more there are."""
    return run_sql(
        f"""
        SELECT array_join(array_append(transform(array_sort(collect_list(struct(ord, line))), x -> x.line),
          if(max(total) > {max_claims}, concat('... and ', max(total) - {max_claims}, ' more'), null)), '\\n') AS block
        FROM @r WHERE ord <= {max_claims}
        """,
        r=ranked,
    )


#: Lengths in bytes of the pieces under which names are filed: the longest one that a name has.
PIECES = (1, 2, 4, 8, 16)
STEP = 1 << 20  # bytes of text that are looked at together
#: Least and most words of 64 bits in the table that tells which pieces no name has; 64 bits for each piece in between.
WORDS = (1 << 12, 1 << 22)


def _hashes(texts: list[bytes], lengths: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: hashes of all pieces of that length, and the numbers of the texts they stand in."""
    sizes = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(row))  # bytes up to the end of the text
    h = (np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for p in PIECES:
        if p > 1:  # two pieces of half the length
            half = p // 2
            h = h[:-half] * np.uint64(0xC2B2AE3D27D4EB4F) + h[half:]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x165667B19E3779F9)
            h ^= h >> np.uint64(29)
        if p in lengths:
            whole = left[: len(h)] >= p
            yield p, row[: len(h)][whole], h[whole].view(np.int64)
        if p >= max(lengths) or len(h) <= p:
            return


def _segments(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts in groups of about ``STEP`` bytes, with their numbers; a longer text comes in parts that overlap by less than the longest piece."""
    rows, parts, size = [], [], 0
    for k, text in enumerate(texts):
        for start in range(0, len(text), STEP):
            part = text[start : start + STEP + PIECES[-1] - 1]
            rows.append(k)
            parts.append(part)
            size += len(part)
            if size >= STEP:
                yield rows, parts
                rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


def _pieces_of_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, low in bytes) -> (name, k, m, piece): the m distinct pieces of each name, of the longest length k that it has."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for k, longer in zip(PIECES, [*PIECES[1:], None], strict=True):
            at = [i for i, t in enumerate(texts) if len(t) >= k and (longer is None or len(t) < longer)]
            for rows, parts in _segments([texts[i] for i in at]):
                for _, row, h in _hashes(parts, {k}):
                    of = np.array(at)[np.array(rows)[row]]
                    found = np.unique(np.stack([of, h]), axis=1)
                    m = np.bincount(found[0], minlength=len(texts))[found[0]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found[0])), pa.array(np.full(len(m), k)), pa.array(m), pa.array(found[1])], ["name", "k", "m", "piece"])


def mentions(claims: DataFrame) -> DataFrame:
    """Relations (entity, related): another claim's subject occurs in a claim's object, in either direction.

    Substring search by an inverted index: the pieces of all distinct objects that some name has as well are counted, and each name is filed under
    the rarest of its own, so names behind one common beginning meet only objects that hold what tells them apart. A name one of whose pieces
    stands in no object is in none of them. Candidates are compared whole. Empty subjects are in nothing; claims without an object mention nobody.

    Every object has a piece for each of its bytes and lengths, nearly all in no name: a table of bits, one place for each hash, tells tasks so before anything is shuffled. A
    place that two hashes share lets a piece through that meets no name later.
    """
    spark = claims.sparkSession
    names = cut_lineage(run_sql("SELECT subject AS name, cast(lower(subject) AS BINARY) AS low FROM @c WHERE subject <> '' GROUP BY subject", c=claims).mapInArrow(
        _pieces_of_names, "name string, k long, m long, piece long"
    ))
    known = run_sql("SELECT count(*) AS n, collect_set(k) AS lengths FROM @n", n=names).first()
    n_words, lengths = min(max(1 << known.n.bit_length(), WORDS[0]), WORDS[1]), set(known.lengths) or {1}
    # at most ``WORDS[1]`` rows, whatever the number of names
    words = run_sql(f"SELECT shiftright(piece, 6) & {n_words - 1}L AS word, bit_or(shiftleft(1L, cast(piece & 63 AS INT))) AS bits FROM @n GROUP BY 1", n=names).toArrow()
    table = np.zeros(n_words, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(table)

    def known_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, parts in _segments(batch.column(1).to_pylist()):
                for _, row, h in _hashes(parts, lengths):
                    may = (bits[(h >> 6) & (len(bits) - 1)] >> (h & 63)) & 1 == 1
                    found = np.unique(np.stack([np.array(rows)[row[may]], h[may]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[found[0]]), pa.array(found[1])], ["obj_id", "piece"])

    objects = run_sql("SELECT xxhash64(obj) AS obj_id, cast(obj AS BINARY) AS obj FROM (SELECT DISTINCT lower(object) AS obj FROM @c WHERE object <> '')", c=claims)
    held = cut_lineage(objects.mapInArrow(known_pieces, "obj_id long, piece long"))
    filed = cut_lineage(run_sql(
        """
        WITH often AS (SELECT piece, count(*) AS n FROM @h GROUP BY piece)
        SELECT name, min(struct(o.n, p.piece)).piece AS piece FROM @n p JOIN often o ON o.piece = p.piece GROUP BY name HAVING count(*) = max(m)
        """,
        h=held, n=names,
    ))
    # a pair is kept once, whichever of the two mentions the other
    return run_sql(
        """
        WITH candidates AS (SELECT h.obj_id, f.name FROM @h h JOIN @f f ON h.piece = f.piece),
        pairs AS (
          SELECT DISTINCT least(c.subject, n.name) AS a, greatest(c.subject, n.name) AS b FROM candidates n JOIN (SELECT DISTINCT subject, lower(object) AS obj FROM @c WHERE object <> '') c ON n.obj_id = xxhash64(c.obj)
          WHERE c.subject <> n.name AND contains(c.obj, lower(n.name)))
        SELECT r.* FROM (SELECT explode(array(named_struct('entity', a, 'related', b), named_struct('entity', b, 'related', a))) AS r FROM pairs)
        """,
        c=claims, h=held, f=filed,
    )


def shared_sources(evidence_of_claims: DataFrame) -> DataFrame:
    """Relations through a shared source, kept as groups: (source, entity, n_entities).

    All entities of a source are related to each other. A source with m entities is m rows here instead of m x m pairs;
    ``related_through_sources`` expands it for the entities somebody asks for.
    """
    return run_sql(
        """
        WITH e AS (SELECT DISTINCT source_artifact AS source, subject AS entity FROM @e WHERE coalesce(source_artifact, '') <> ''),
        n AS (SELECT source, count(*) AS n_entities FROM e GROUP BY source)
        SELECT e.source, e.entity, n.n_entities FROM e JOIN n ON e.source = n.source
        """,
        e=evidence_of_claims,
    )


def related_through_sources(groups: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs (entity, related) for the asked entities."""
    return run_sql(
        """
        SELECT DISTINCT a.entity, g.entity AS related FROM @a q JOIN @g a ON q.entity = a.entity JOIN @g g ON a.source = g.source
        WHERE a.entity <> g.entity
        """,
        a=asked, g=groups,
    )


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], limit: int | None = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 ranking for a few query terms: term counts per row, and one small aggregate for the collection."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    tokens = "filter(split(lower({0}), r'[^\\p{{L}}\\p{{N}}]+'), w -> w <> '')".format(text)
    tfs = ", ".join(f"size(filter(ws, w -> w = {X.lit(t)})) AS tf{i}" for i, t in enumerate(terms))
    names = ", ".join(f"tf{i}" for i in range(len(terms)))
    # one pass over the texts; ranking then reads only a few numbers per document
    counts = cut_lineage(run_sql(
        f"SELECT {key}, dl, {names} FROM @docs LATERAL VIEW inline(transform(array({tokens}), ws -> struct(size(ws) AS dl, {tfs}))) t AS dl, {names}",
        docs=docs,
    ))
    dfs = ", ".join(f"count_if(tf{i} > 0) AS df{i}" for i in range(len(terms)))
    parts = " + ".join(
        f"ln(1 + (st.n - st.df{i} + 0.5D) / (st.df{i} + 0.5D)) * tf{i} * {k1 + 1}D / (tf{i} + {k1}D * ({1 - b}D + {b}D * dl / st.avgdl))"
        for i in range(len(terms))
    )
    found = " + ".join(f"tf{i}" for i in range(len(terms)))
    ranked = run_sql(
        f"""
        SELECT {key}, {parts} AS score FROM (
          SELECT *, (SELECT struct(count(*) AS n, avg(dl) AS avgdl, {dfs}) FROM @d) AS st FROM @d WHERE {found} > 0)
        """,
        d=counts,
    )
    out = ranked.orderBy(ranked["score"].desc(), ranked[key].asc())
    return out if limit is None else out.limit(limit)


def fuse(rankings: list[DataFrame], key: str, limit: int = 10, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of whole rankings (key, rank): one grouped sum, then the best ``limit``."""
    both = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        both = both.unionByName(r.select(key, "rank"))
    fused = run_sql(f"SELECT {key}, sum(1D / ({k} + rank)) AS score FROM @b GROUP BY {key}", b=both)
    return fused.orderBy(fused["score"].desc(), fused[key].asc()).limit(limit)


ONELINER = R.claim_oneliner("claim_id", "subject", "predicate", "object", "knowledge_class", "confidence", "n_supporting")
