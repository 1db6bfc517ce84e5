"""Vector similarity: best match against a set, and leader clustering of near-equal claims, both exact.

Two levels of pivots. Vectors of the set lie in the cell of their nearest pivot; the number of pivots grows with the
set. Cells that are neighbours are put together into bins of bounded size, a cell larger than that is several bins. A
vector looks only into bins with a cell that can hold a similar one: no further than r (the largest distance of a
similar pair) beyond the plane halfway to the cell's pivot, and no further than r outside the shell between the
smallest and the largest distance of the cell's members from its pivot. So a vector is copied at most once for each bin,
also where high dimensions leave nothing to prune. A bin and a block of vectors that look into it are one matrix
product, and only the best match per vector and block leaves it. No list of similar pairs is ever built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta import schema as S
from attesta.plans.sqlrun import run_sql
from attesta.session import cut_lineage

BLOCK = 8192       # vectors per side of a cell of pairs
SIMS = 1 << 21     # numbers of a matrix product that are in memory at once
PER_PIVOT = 512    # vectors of the set for each pivot
MOST_PIVOTS = 1024  # read to the driver, and so are the sizes of their cells
MATCH = "id string, best_sim double, best_seq long, best_id string, open_before boolean"


def _matrix(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), dtype=np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _usable(df: DataFrame, dim: int) -> DataFrame:
    """Vectors that can be similar to anything: of one length and not zero."""
    return df.where(f"size(embedding) = {dim} AND exists(embedding, v -> v <> 0)")


def _pivots(existing: DataFrame, n: int) -> np.ndarray | None:
    """Unit vectors of the set, chosen by the hash of their ids and put in a chain in which neighbours are near."""
    rows = existing.select("embedding").orderBy(F.xxhash64("id")).limit(min(MOST_PIVOTS, -(-n // PER_PIVOT))).collect()
    if not rows:
        return None
    m = np.unique(_matrix(pd.Series([r[0] for r in rows])), axis=0)
    dots, at, order = m @ m.T, 0, [0]
    left = np.ones(len(m), dtype=bool)
    left[0] = False
    while left.any():
        at = int(np.where(left, dots[at], -np.inf).argmax())
        left[at] = False
        order.append(at)
    return m[order]


def _slices(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Rows in parts whose products with ``width`` vectors fit: memory does not grow with the number of pivots."""
    step = max(1, SIMS // width)
    for pdf in batches:
        for at in range(0, len(pdf), step):
            yield pdf.iloc[at : at + step]


def _chord(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * dots, 0))


def _homes(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with their ``cell`` and the distance ``away`` from its pivot."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(batches, len(pivots)):
            dots = _matrix(pdf["embedding"]) @ pivots.T
            yield pdf.assign(cell=dots.argmax(axis=1), away=_chord(dots.max(axis=1)))

    return df.mapInPandas(place, df.schema.simpleString()[len("struct<"):-1] + ",cell:int,away:double")


def _bins(sizes: list[tuple[int, int, float, float]]) -> dict[int, tuple[int, int]]:
    """First bin and number of bins of each cell (cell, rows, ...), in the order of the pivots."""
    out: dict[int, tuple[int, int]] = {}
    nxt, room = -1, 0
    for cell, n, *_ in sizes:
        if n > BLOCK:
            width, room = -(-n // BLOCK), 0
            out[cell], nxt = (nxt + 1, width), nxt + width
            continue
        if n > room:
            nxt, room = nxt + 1, BLOCK
        room -= n
        out[cell] = (nxt, 1)
    return out


def _looks(df: DataFrame, pivots: np.ndarray, sizes: list[tuple[int, int, float, float]], bins: dict[int, tuple[int, int]], reach: float) -> DataFrame:
    """Rows with the ``bins`` that can hold a similar vector."""
    cells = np.array([c for c, *_ in sizes])
    near, far = np.array([s[2] for s in sizes]), np.array([s[3] for s in sizes])
    gap = _chord(pivots @ pivots[cells].T)
    gap[gap < 1e-9] = np.inf  # a pivot against itself
    spans = [np.arange(bins[c][0], sum(bins[c])) for c in cells]
    slack = reach + 1e-6

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(batches, len(pivots)):
            dots = _matrix(pdf["embedding"]) @ pivots.T
            own, to = dots.argmax(axis=1), dots[:, cells]
            beyond = (dots.max(axis=1)[:, None] - to) / gap[own]
            away = _chord(to)
            open_cells = (beyond <= slack) & (away <= far + slack) & (away >= near - slack)
            yield pdf.assign(bins=[np.unique(np.concatenate([spans[c] for c in np.flatnonzero(row)] or [[]])).astype(int).tolist() for row in open_cells])

    return df.mapInPandas(look, df.schema.simpleString()[len("struct<"):-1] + ",bins:array<int>")


def matches(new: DataFrame, existing: DataFrame, theta: float, earlier_only: bool = False) -> DataFrame:
    """Per new vector (id, seq, embedding): the best existing one (id, seq, embedding, is_leader) with cosine >= theta.

    Only leaders can be the best match; among equals the earliest wins. ``open_before`` tells whether a similar one
    that is no leader comes earlier. With ``earlier_only`` later vectors are not looked at. Unmatched ones are left out.
    """
    # vectors of different lengths are never similar: each length is a search of its own
    sizes = existing.groupBy(F.size("embedding").alias("d")).count().where("d > 0").orderBy("d").collect()
    found = new.sparkSession.createDataFrame([], MATCH)
    for dim, n in sizes:
        found = found.unionByName(_matches_of_length(new, existing, dim, n, theta, earlier_only))
    return found


def _matches_of_length(new: DataFrame, existing: DataFrame, dim: int, n: int, theta: float, earlier_only: bool) -> DataFrame:
    spark = new.sparkSession
    new, existing = _usable(new, dim), _usable(existing, dim)
    pivots = _pivots(existing, n)
    if pivots is None:
        return spark.createDataFrame([], MATCH)
    reach = float(np.sqrt(max(0.0, 2 - 2 * theta)))
    y = cut_lineage(_homes(existing.select("id", "seq", "embedding", "is_leader"), pivots))
    sizes = [tuple(r) for r in y.groupBy("cell").agg(F.count("*"), F.min("away"), F.max("away")).orderBy("cell").collect()]
    bins = _bins(sizes)
    x = cut_lineage(_looks(new.select("id", "seq", "embedding"), pivots, sizes, bins, reach))
    # how many blocks look into a bin: at most as many rows as there are bins, and a bin is BLOCK vectors of the set
    looks = x.select(F.explode("bins").alias("bin")).groupBy("bin").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nx"))
    cells = spark.createDataFrame([(c, first, width) for c, (first, width) in bins.items()], "cell int, first int, width int")
    own = F.xxhash64("id")
    ys = (
        y.join(F.broadcast(cells), "cell").withColumn("bin", (F.col("first") + F.pmod(own, "width")).cast("int")).join(looks, "bin")
        .withColumn("xb", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).select("bin", "xb", "id", "seq", "embedding", "is_leader")
    )
    xs = x.withColumn("bin", F.explode("bins")).join(looks, "bin").withColumn("xb", F.pmod(own, "nx").cast("int")).select("bin", "xb", "id", "seq", "embedding")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({name: pd.Series([], dtype=object) for name in ("id", "best_sim", "best_seq", "best_id", "open_before")})
        b = b.sort_values("seq")
        right, lead = _matrix(b["embedding"]).T, b["is_leader"].to_numpy()
        # numbers in place of ids: a comparison of texts for each pair costs more than its product
        codes = pd.factorize(pd.concat([a["id"], b["id"]], ignore_index=True))[0]
        a, others, found = a.assign(code=codes[: len(a)]), codes[len(a):], []
        for part in _slices(iter([a]), len(b)):
            sims = _matrix(part["embedding"]) @ right
            ok = (sims >= theta) & (part["code"].to_numpy()[:, None] != others[None, :])
            if earlier_only:
                ok &= b["seq"].to_numpy()[None, :] < part["seq"].to_numpy()[:, None]
            waiting = (ok & ~lead[None, :]).any(axis=1)
            hit = ok.any(axis=1)
            scores = np.where(ok & lead[None, :], sims, -2.0)[hit]
            best = scores.argmax(axis=1)
            top = scores[np.arange(len(best)), best]
            led = top > -2.0
            found.append(pd.DataFrame({
                "id": part["id"].to_numpy()[hit], "best_sim": pd.Series(top, dtype=object).where(led, None),
                "best_seq": pd.Series(b["seq"].to_numpy()[best], dtype=object).where(led, None),
                "best_id": pd.Series(b["id"].to_numpy()[best], dtype=object).where(led, None), "open_before": waiting[hit],
            }))
        return pd.concat(found, ignore_index=True)

    keys = ["bin", "xb"]
    local = xs.groupBy(*keys).cogroup(ys.groupBy(*keys)).applyInPandas(compare, MATCH)
    return run_sql(
        """
        SELECT id, b.best_sim, b.best_seq, b.best_id, open_before FROM (
          SELECT id, max_by(struct(best_sim, best_seq, best_id), struct(best_sim, -best_seq)) AS b, max(open_before) AS open_before
          FROM @m GROUP BY id)
        """,
        m=local,
    )


def best_match(new: DataFrame, existing: DataFrame, theta: float = S.SEMANTIC_THRESHOLD) -> DataFrame:
    """For each new vector its most similar existing one, if any reaches ``theta``."""
    found = matches(new, existing.selectExpr("id", "seq", "embedding", "true AS is_leader"), theta)
    return found.where("best_id IS NOT NULL").select("id", "best_id", "best_sim")


def leaders(claims: DataFrame, theta: float = S.SEMANTIC_THRESHOLD, stored: DataFrame | None = None) -> DataFrame:
    """Claims (id, seq, fingerprint, embedding) that stay when added in order: no earlier leader is equal or similar.

    ``stored`` are leaders that are there already, with smaller numbers; they are part of the result.

    The first ``2 * BLOCK`` claims are decided, those that come after meet the leaders found, and what is left goes on in the same way with four times as
    many. So most claims are compared with leaders only, and the pairs follow the number of claims times that of leaders. Copies (same text and
    vector) are one candidate, the first of them.
    """
    reps = run_sql(
        """
        SELECT r.id, r.seq, fingerprint, r.embedding FROM (
          SELECT fingerprint, min_by(struct(id, seq, embedding), seq) AS r FROM @c GROUP BY fingerprint, embedding)
        """,
        c=claims,
    )
    decided = None if stored is None else stored.select("id", "seq", "fingerprint", "embedding")
    rest = cut_lineage(reps if decided is None else _unled(reps, decided, theta))
    size = 2 * BLOCK
    while n := rest.count():
        cut = rest.selectExpr(f"approx_percentile(seq, {size / n}D)").first()[0] if n > size else None
        found = _decide(rest if cut is None else rest.where(f"coalesce(seq <= {cut}, true)"), theta)
        decided = found if decided is None else decided.unionByName(found)
        if cut is None:
            break
        rest, size = cut_lineage(_unled(rest.where(f"seq > {cut}"), found, theta)), 4 * size
    return reps.limit(0) if decided is None else decided


def _unled(claims: DataFrame, lead: DataFrame, theta: float) -> DataFrame:
    """Claims that are neither equal nor similar to any of ``lead``, which all come before them."""
    other = claims.join(lead.select("fingerprint").distinct(), "fingerprint", "left_anti").select("id", "seq", "fingerprint", "embedding")
    return other.join(matches(other, lead.withColumn("is_leader", F.lit(True)), theta).select("id"), "id", "left_anti")


def _decide(claims: DataFrame, theta: float) -> DataFrame:
    """The leaders among claims that no earlier leader is near.

    A claim with no earlier undecided neighbour is decided at once: a leader when no earlier leader is near, else not.
    Rounds repeat that on the shrinking rest, until at most ``2 * BLOCK`` are left: one task takes these in order.
    """
    open_set, decided = claims, None
    while n := open_set.count():
        if n <= 2 * BLOCK:
            last = cut_lineage(_in_order(open_set if decided is None else _unled(open_set, decided, theta), theta))
            return last if decided is None else decided.unionByName(last)
        alive = open_set.withColumn("is_leader", F.lit(False))
        if decided is not None:
            alive = alive.unionByName(decided.withColumn("is_leader", F.lit(True)))
        near = matches(open_set, alive, theta, earlier_only=True)
        step = cut_lineage(run_sql(
            """
            WITH same AS (
              SELECT fingerprint, min(if(is_leader, seq, null)) AS led, min(if(is_leader, null, seq)) AS waiting FROM @alive GROUP BY fingerprint)
            SELECT o.*, CASE WHEN n.best_id IS NOT NULL OR coalesce(s.led < o.seq, false) THEN 'member'
                WHEN coalesce(n.open_before, false) OR coalesce(s.waiting < o.seq, false) THEN 'open' ELSE 'leader' END AS state
            FROM @open o LEFT JOIN @near n ON o.id = n.id LEFT JOIN same s ON o.fingerprint = s.fingerprint
            """,
            alive=alive, open=open_set, near=near,
        ))
        chosen = step.where("state = 'leader'").drop("state")
        decided = chosen if decided is None else decided.unionByName(chosen)
        open_set = step.where("state = 'open'").drop("state")
    return decided


def _in_order(claims: DataFrame, theta: float) -> DataFrame:
    """The leaders among a bounded number of claims, taken one by one."""
    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        leading, texts, keep = {}, set(), []
        for text, vector in zip(pdf["fingerprint"], pdf["embedding"], strict=True):
            v = np.array([] if vector is None else vector, dtype=np.float64)
            rows, k = leading.get(len(v), (None, 0))
            v = v / np.linalg.norm(v) if v.any() else None
            near = v is not None and k > 0 and bool((rows[:k] @ v >= theta).any())
            keep.append(not near and (text is None or text not in texts))
            if keep[-1]:
                texts.add(text)
                if v is not None:
                    rows = np.empty((len(pdf), len(v))) if rows is None else rows
                    rows[k] = v
                    leading[len(v)] = rows, k + 1
        return pdf[keep]

    return claims.groupBy(F.pmod(F.xxhash64("id"), F.lit(1))).applyInPandas(lead, claims.schema)


def cluster(claims: DataFrame, theta: float = S.SEMANTIC_THRESHOLD, stored: DataFrame | None = None) -> DataFrame:
    """Every claim (id) with its ``leader_id`` and how it was found: 'new', 'exact' or 'semantic' (with the cosine).

    ``stored`` (same columns, ids of its own) are claims that came before; each stays a leader, and none is in the result.

    An equal fingerprint has priority over similarity; a similar claim goes to the best leader that came before it.
    """
    lead = leaders(claims, theta, stored)
    rest = claims.join(lead.select("id"), "id", "left_anti")
    near = matches(rest, lead.withColumn("is_leader", F.lit(True)), theta, earlier_only=True)
    return run_sql(
        """
        SELECT id, id AS leader_id, 'new' AS how, cast(null AS DOUBLE) AS similarity FROM @lead LEFT SEMI JOIN @claims c USING (id)
        UNION ALL
        SELECT r.id, coalesce(e.id, n.best_id), if(e.id IS NOT NULL, 'exact', 'semantic'), if(e.id IS NOT NULL, null, n.best_sim)
        FROM @rest r LEFT JOIN @lead e ON r.fingerprint = e.fingerprint AND e.seq < r.seq LEFT JOIN @near n ON r.id = n.id
        """,
        lead=lead, claims=claims.select("id"), rest=rest, near=near,
    )


def dedup_counts(clusters: DataFrame) -> DataFrame:
    return run_sql("SELECT count_if(how <> 'new') AS merged_count, count_if(how = 'new') AS unique_count FROM @c", c=clusters)
