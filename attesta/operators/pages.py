"""Pages projected from claims: entity, topic, source, conflict and index pages, as lines and as page parts.

A page is a set of ordered lines. Lines are numbered with a distributed sort and joined into parts of a fixed number of
lines; a page's text is its parts in order. Ordinary pages have one part; the page of an entity with a third of all
claims has many, and no task ever holds it whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import render as R
from attesta.functions import text as X
from attesta.operators import ledger
from attesta.plans.ordered import ordered_index
from attesta.plans.sqlrun import run_sql
from attesta.session import cut_lineage

PART_LINES = 5000


def active_claims(claims: DataFrame) -> DataFrame:
    return claims.where("status NOT IN ('superseded', 'rejected')")


def page_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Active claims with their first source: name and span of the earliest evidence, which claims with ``first_piece`` know themselves."""
    known = active_claims(claims)
    if "first_piece" not in claims.columns:
        known = ledger.with_first_piece(known, evidence)
    return known.selectExpr("* EXCEPT (first_piece)", f"{R.source_key('first_piece.source_artifact', 'first_piece.artifact_id')} AS source", "first_piece.source_span AS span")


def entity_summary(pc: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """Per subject: claims, average score (a decimal sum, so that the order of addition does not matter), number of sources, and topics."""
    base = run_sql(
        "SELECT subject, count(*) AS claim_count, round(cast(sum(cast(round(truth_score, 9) AS DECIMAL(28,9))) AS DOUBLE) / count(*), 3) AS avg_truth_score, count(DISTINCT source) AS n_sources FROM @p GROUP BY subject",
        p=pc,
    )
    if topics is None:
        return base
    return run_sql(
        """
        SELECT b.*, coalesce(t.topics, array('general')) AS topics FROM @b b LEFT JOIN (
          SELECT subject, array_sort(collect_set(topic)) AS topics FROM @t GROUP BY subject) t ON b.subject = t.subject
        """,
        b=base, t=topics,
    )


def topic_summary(topic_claims: DataFrame) -> DataFrame:
    return run_sql(
        "SELECT topic, count(*) AS claim_count, count(DISTINCT subject) AS n_entities, min(subject) AS first_entity FROM @t GROUP BY topic", t=topic_claims
    )


def source_summary(pc: DataFrame) -> DataFrame:
    """Per source and subject: how many claims were extracted."""
    return run_sql("SELECT source, subject, count(*) AS n FROM @p WHERE source IS NOT NULL GROUP BY source, subject", p=pc)


def index_summary(pc: DataFrame) -> DataFrame:
    return run_sql(
        "SELECT count(*) AS total_claims, count(DISTINCT subject) AS entity_count, count(DISTINCT source) AS source_count FROM @p", p=pc
    )


def bullets(pc: DataFrame) -> DataFrame:
    return pc.selectExpr(
        "claim_id", "subject", "source", f"{R.claim_bullet('status', 'natural_language', 'truth_score', 'source', 'span')} AS bullet"
    )


def _stamp(as_of: str) -> str:
    return R.iso_utc(f"TIMESTAMP_NTZ '{as_of}'")


# Every page producer returns lines (path, section, k1, k2, k3, line): section orders the blocks of a page; within a
# block lines go by k1 (text), k2 (descending number) and k3 (arrival).
LINE = "path, section, k1, k2, k3, line"


def entity_lines(
    pc: DataFrame, evidence: DataFrame, relations: DataFrame | None, as_of: str, topic_claims: DataFrame | None = None, title_sources: int = 10
) -> DataFrame:
    """Lines of entity pages: header, facts by score (under their topics when given), related entities, sources.

    Subjects that differ only in case or spaces have one path, hence one page, and its lines are those of all of them. The
    pairs of subject and source are found and written once; lines are put together after repeated rows are gone.
    """
    path = f"concat('entities/', {X.slugify('subject')}, '.md')"
    src = cut_lineage(run_sql(
        f"""
        SELECT DISTINCT path, subject, source FROM (SELECT merge_key, subject, {path} AS path FROM @p) c JOIN (
          SELECT DISTINCT merge_key, {R.source_key('source_artifact', 'artifact_id')} AS source FROM @e) e ON c.merge_key = e.merge_key
        WHERE source <> ''
        """,
        p=pc, e=evidence,
    ))
    head = R.frontmatter([
        ("entity", "subject"), ("claim_count", "claim_count"), ("avg_truth_score", "avg_truth_score"), ("", R.list_field("topics", "topics")),
        ("", R.list_field("sources", "coalesce(sources, array())")), ("last_updated", _stamp(as_of)),
    ])
    facts = pc.selectExpr("*", "'' AS topic") if topic_claims is None else topic_claims
    summaries = entity_summary(pc, facts.selectExpr("subject", "coalesce(nullif(topic, ''), 'general') AS topic"))
    top_sources = run_sql(
        f"""
        SELECT subject, array_sort(collect_list(source)) AS sources FROM (
          SELECT *, row_number() OVER (PARTITION BY h, subject ORDER BY source) AS rn FROM (SELECT xxhash64(subject) AS h, subject, source FROM @s))
        WHERE rn <= {title_sources} GROUP BY h, subject
        """,
        s=src,
    )
    parts = [
        # a subject with sources has the heading of section 4; with claims among the facts it has a header, too
        run_sql(
            f"""
            SELECT {path} AS path, section, subject AS k1, if(section = 1, 0D, -1D) AS k2, 0L AS k3,
              if(section = 1, concat({head}, '\\n\\n# ', subject, '\\n\\n## Facts\\n'), '\\n## Source Documents\\n') AS line
            FROM (SELECT *, explode(if(claim_count IS NULL, array(4), array(1, 4))) AS section FROM @t t LEFT JOIN @h h USING (subject))
            """,
            h=summaries, t=top_sources,
        ),
        facts.selectExpr(
            f"{path} AS path", "2 AS section", "topic AS k1", "-truth_score AS k2", "seq AS k3",
            f"{R.claim_bullet('status', 'natural_language', 'truth_score', 'source', 'span')} AS line",
        ),
        src.select("path", "source").distinct().selectExpr(
            "path", "5 AS section", "source AS k1", "0D AS k2", "0L AS k3", f"concat('- [', source, '](../sources/', {X.slugify('source')}, '.md)') AS line",
        ),
    ]
    if topic_claims is not None:
        parts.append(facts.selectExpr(f"{path} AS path", "topic").distinct().selectExpr(
            "path", "2 AS section", "topic AS k1", "double('-Infinity') AS k2", "0L AS k3",
            f"concat('\\n### [', topic, '](../topics/', {X.slugify('topic')}, '.md)\\n') AS line",
        ))
    if relations is not None:
        parts.append(relations.selectExpr(
            f"concat('entities/', {X.slugify('entity')}, '.md') AS path", "3 AS section", "related AS k1", "0D AS k2", "0L AS k3",
            f"concat('- [', related, '](', {X.slugify('related')}, '.md)') AS line",
        ))
        parts.append(run_sql(
            f"""SELECT DISTINCT concat('entities/', {X.slugify('entity')}, '.md') AS path, 3 AS section, '' AS k1, 0D AS k2, 0L AS k3,
            '\\n## Related Entities\\n' AS line FROM @r""", r=relations,
        ))
    return union_lines(parts)


def source_lines(pc: DataFrame, as_of: str) -> DataFrame:
    """Lines of source pages: numbered claims by score, then the entities with their counts.

    The numbers come from the same distributed sort that orders the page.
    """
    path = f"concat('sources/', {X.slugify('source')}, '.md')"
    counts = source_summary(pc)
    totals = run_sql("SELECT source, sum(n) AS n, count(*) AS n_entities FROM @c GROUP BY source", c=counts)
    head = R.frontmatter([("source", "source"), ("claims_extracted", "n"), ("entity_count", "n_entities"), ("last_updated", _stamp(as_of))])
    numbered = ordered_index(
        pc.where("source IS NOT NULL").select("source", "subject", "natural_language", "truth_score", "seq"),
        ["source"], [F.desc("truth_score"), F.asc("seq")], "no",
    )
    text = (
        f"concat(no, '. ', natural_language, ' `score=', {R.two_places('truth_score')}, '` ', {R.score_bar('truth_score')},"
        f" ' → [', subject, '](../entities/', {X.slugify('subject')}, '.md)')"
    )
    return union_lines([
        totals.selectExpr(
            f"{path} AS path", "1 AS section", "source AS k1", "0D AS k2", "0L AS k3",
            f"concat({head}, '\\n\\n# ', source, '\\n\\n## Extracted Claims\\n') AS line",
        ),
        numbered.selectExpr(f"{path} AS path", "2 AS section", "source AS k1", "0D AS k2", "no AS k3", f"{text} AS line"),
        totals.selectExpr(f"{path} AS path", "3 AS section", "source AS k1", "0D AS k2", "0L AS k3", "'\\n## Entities Referenced\\n' AS line"),
        counts.selectExpr(
            f"{path} AS path", "4 AS section", "subject AS k1", "0D AS k2", "0L AS k3",
            f"concat('- [', subject, '](../entities/', {X.slugify('subject')}, '.md) (', n, ' claims)') AS line",
        ),
    ])


def topic_lines(topic_claims: DataFrame, as_of: str) -> DataFrame:
    """Lines of topic pages: facts per entity by score, then the entities. ``topic_claims``: page claims with ``topic``."""
    path = f"concat('topics/', {X.slugify('topic')}, '.md')"
    link = f"concat('[', subject, '](../entities/', {X.slugify('subject')}, '.md)')"
    ents = topic_claims.select("topic", "subject").distinct()
    head = R.frontmatter([("topic", "topic"), ("entity_count", "n_entities"), ("claim_count", "claim_count"), ("last_updated", _stamp(as_of))])
    return union_lines([
        topic_summary(topic_claims).selectExpr(
            f"{path} AS path", "1 AS section", "topic AS k1", "0D AS k2", "0L AS k3", f"concat({head}, '\\n\\n# ', topic, '\\n\\n## Key Facts\\n') AS line"
        ),
        ents.selectExpr(f"{path} AS path", "2 AS section", "subject AS k1", "double('-Infinity') AS k2", "0L AS k3", f"concat('### ', {link}, '\\n') AS line"),
        topic_claims.selectExpr(
            f"{path} AS path", "2 AS section", "subject AS k1", "-truth_score AS k2", "seq AS k3",
            f"{R.claim_bullet('status', 'natural_language', 'truth_score', 'source', 'span')} AS line",
        ),
        ents.selectExpr(f"{path} AS path", "4 AS section", "subject AS k1", "0D AS k2", "0L AS k3", f"concat('- ', {link}) AS line"),
        topic_summary(topic_claims).selectExpr(f"{path} AS path", "3 AS section", "'' AS k1", "0D AS k2", "0L AS k3", "'\\n## Entities Involved\\n' AS line"),
    ])


def conflict_lines(pc: DataFrame, as_of: str) -> DataFrame:
    """The page of claims that have conflict links."""
    hit = pc.where("n_conflicts > 0")
    head = R.frontmatter([("title", "'Pending Conflicts'"), ("conflict_count", "n"), ("last_updated", _stamp(as_of))])
    body = (
        f"concat('### ', natural_language, '\\n\\n- **Entity:** [', subject, '](../entities/', {X.slugify('subject')}, '.md)\\n- **Score:** ',"
        f" {R.two_places('truth_score')}, '\\n- **Conflicts with:** ', n_conflicts, ' claim(s)\\n')"
    )
    return union_lines([
        run_sql(
            f"""SELECT 'conflicts/pending.md' AS path, 1 AS section, '' AS k1, 0D AS k2, 0L AS k3,
            concat({head}, '\\n\\n# Pending Conflicts\\n') AS line FROM (SELECT count(*) AS n FROM @h) WHERE n > 0""", h=hit,
        ),
        hit.selectExpr("'conflicts/pending.md' AS path", "2 AS section", "'' AS k1", "0D AS k2", "seq AS k3", f"{body} AS line"),
    ])


def index_lines(pc: DataFrame, as_of: str, topical: DataFrame | None = None) -> DataFrame:
    """The index page: totals, counts per status, entities, sources and, where given, topics with their counts."""
    head = R.frontmatter([("title", "'Index'"), ("total_claims", "total_claims"), ("entity_count", "entity_count"), ("source_count", "source_count"), ("last_projected", _stamp(as_of))])
    totals = "concat('- **Total active claims:** ', total_claims, '\\n- **Entities:** ', entity_count, '\\n- **Sources:** ', source_count)"
    at = "'index.md' AS path"

    def listing(section: int, title: str, folder: str, column: str, rows: DataFrame = pc) -> list[DataFrame]:
        counts = run_sql(f"SELECT {column} AS name, count(*) AS n FROM @p WHERE {column} IS NOT NULL GROUP BY {column}", p=rows)
        return [
            run_sql(f"SELECT {at}, {section} AS section, '' AS k1, -1D AS k2, 0L AS k3, '\\n## {title}\\n' AS line FROM @c LIMIT 1", c=counts),
            counts.selectExpr(at, f"{section} AS section", "name AS k1", "0D AS k2", "0L AS k3", f"concat('- [', name, ']({folder}/', {X.slugify('name')}, '.md) (', n, ' claims)') AS line"),
        ]

    status = run_sql("SELECT status, count(*) AS n FROM @p GROUP BY status", p=pc)
    return union_lines([
        index_summary(pc).selectExpr(at, "1 AS section", "'' AS k1", "0D AS k2", "0L AS k3", f"concat({head}, '\\n\\n# Index\\n\\n## Summary\\n\\n', {totals}) AS line"),
        status.selectExpr(at, "2 AS section", "status AS k1", "0D AS k2", "0L AS k3", "concat('- ', status, ': ', n) AS line"),
        *listing(3, "Entities", "entities", "subject"), *listing(4, "Sources", "sources", "source"),
        *(listing(5, "Topics", "topics", "topic", topical) if topical is not None else []),
    ])


def claim_paths(pc: DataFrame, topical: DataFrame) -> DataFrame:
    """(path, claim_id) of all pages that show a claim: its entity's, its source's, those of its topics, and the conflicts page if it has any."""
    return run_sql(
        f"""
        SELECT concat('entities/', {X.slugify('subject')}, '.md') AS path, claim_id FROM @p
        UNION SELECT concat('sources/', {X.slugify('source')}, '.md'), claim_id FROM @p WHERE source IS NOT NULL
        UNION SELECT concat('topics/', {X.slugify('topic')}, '.md'), claim_id FROM @t
        UNION SELECT 'conflicts/pending.md', claim_id FROM @p WHERE n_conflicts > 0
        """,
        p=pc, t=topical,
    )


def shown_state(pc: DataFrame, topical: DataFrame) -> DataFrame:
    """(claim_id, state): a hash of all that pages show of a claim."""
    topics = topical.groupBy("claim_id").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    columns = ["subject", "predicate", "object", "natural_language", "status", "truth_score", "source", "span", "n_conflicts", "n_supporting", "n_refuting", "n_sources", "seq", "topics"]
    return pc.join(topics, "claim_id", "left").select("claim_id", F.xxhash64(*columns).alias("state"))


def union_lines(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_parts(lines: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """Page parts (path, part, content, content_hash): at most ``part_lines`` lines each.

    ``content_hash`` leaves out the time stamps, so an unchanged page keeps its hash. Lines are written once. A page that
    fits one part is put together by one shuffle; only the lines of longer pages are sorted and numbered across tasks.
    """
    order = ["section", "k1", "k2", "k3"]
    lines = cut_lineage(lines.select("path", *order, "line"))
    long = cut_lineage(lines.groupBy("path").count().where(F.col("count") > part_lines).select("path"))
    parts = run_sql(
        f"SELECT path, 0 AS part, transform(sort_array(collect_list(struct({', '.join(order)}, line))), x -> x.line) AS lines FROM @l GROUP BY path",
        l=lines.join(long, "path", "left_anti").repartition("path"),
    )
    if not long.isEmpty():
        numbered = ordered_index(lines.join(long, "path", "left_semi"), ["path"], [F.asc(c) for c in order], "no")
        parts = parts.unionByName(run_sql(
            f"""
            SELECT path, cast((no - 1) div {part_lines} AS INT) AS part, transform(sort_array(collect_list(struct(no, line))), x -> x.line) AS lines
            FROM @n GROUP BY path, (no - 1) div {part_lines}
            """,
            n=numbered,
        ))
    return parts.selectExpr("path", "part", "array_join(lines, '\\n') AS content").selectExpr("*", f"{X.stable_hash('content')} AS content_hash")


def page_hashes(parts: DataFrame) -> DataFrame:
    """One hash per page (path, content_hash, n_parts): that of its part hashes, which a page of n lines has n/5000 of."""
    return run_sql(
        """
        SELECT path, left(sha2(array_join(transform(array_sort(collect_list(struct(part, content_hash))), x -> x.content_hash), ''), 256), 16) AS content_hash,
          count(*) AS n_parts FROM @p GROUP BY path
        """,
        p=parts,
    )


def claim_files(claims: DataFrame) -> DataFrame:
    """One file per active claim, claims/<class>/<slug>.md, with its front matter (path, claim_id, content).

    Where several claims have one slug (case, punctuation, a long common beginning), each path gets a short hash of the whole key.
    """
    fields = R.frontmatter([
        ("claim_id", "claim_id"), ("subject", "subject"), ("predicate", "predicate"), ("object", "object"), ("status", "status"),
        ("truth_score", "round(truth_score, 3)"), ("confidence", "confidence"), ("knowledge_class", "knowledge_class"),
        ("created_at", R.iso_utc("created_at")), ("last_confirmed", R.iso_utc("coalesce(last_confirmed_at, created_at)")),
        ("evidence_count", "n_supporting + n_refuting"),
    ])
    slug = X.slugify("concat_ws('-', subject, predicate, object)")
    body = "concat('# ', natural_language, '\\n\\n**Subject:** ', subject, '  \\n**Predicate:** ', predicate, '  \\n**Object:** ', object, '  \\n')"
    files = claims.where("status NOT IN ('superseded', 'rejected')").selectExpr(
        f"concat('claims/', knowledge_class, '/', {slug}) AS stem", "left(sha2(concat_ws('|', subject, predicate, object, claim_id), 256), 8) AS tag", "claim_id", f"concat({fields}, '\\n\\n', {body}) AS content"
    )
    return run_sql(
        """
        SELECT concat(f.stem, if(s.stem IS NULL, '', concat('-', tag)), '.md') AS path, claim_id, content
        FROM @f f LEFT JOIN (SELECT stem FROM @f GROUP BY stem HAVING count(*) > 1) s ON f.stem = s.stem
        """,
        f=files,
    )
