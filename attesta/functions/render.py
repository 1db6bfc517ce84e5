"""Text forms of claims, conflicts and summaries as Spark SQL expressions."""

from __future__ import annotations

from attesta.functions.text import lit, slugify


def score_bar(score: str) -> str:
    return f"repeat('█', cast(floor({score} * 10) AS INT))"


def two_places(score: str) -> str:
    return f"format_string('%.2f', {score})"


def source_key(source_artifact: str, artifact_id: str) -> str:
    """The name a source page is filed under."""
    return f"coalesce(nullif({source_artifact}, ''), left({artifact_id}, 8))"


def span_preview(span: str, n: int = 120) -> str:
    return f"replace(left({span}, {n}), '\\n', ' ')"


def claim_oneliner(claim_id: str, s: str, p: str, o: str, cls: str, conf: str, n_sup: str) -> str:
    return f"format_string('[C:%s] %s | %s | %s (%s, %.2f, %d src)', left({claim_id}, 7), {s}, {p}, {o}, {cls}, {conf}, {n_sup})"


def entity_oneliner(uuid: str, name: str, summary: str) -> str:
    return f"format_string('[E:%s] %s: %s', left({uuid}, 7), {name}, left({summary}, 80))"


def counted(parts: list[tuple[str, str, str]], empty: str) -> str:
    """``+3 added, =2 unchanged`` from (prefix, count, suffix) parts; zero counts are left out."""
    shown = ", ".join(f"if({n} > 0, concat('{pre}', {n}, '{post}'), null)" for pre, n, post in parts)
    return f"coalesce(nullif(concat_ws(', ', {shown}), ''), '{empty}')"


def claim_bullet(status: str, sentence: str, score: str, source: str, span: str, prefix: str = "../") -> str:
    """A claim line with score bar, and a second line that links the first source."""
    head = f"concat('- **[', {status}, ']** ', {sentence}, '  `score=', {two_places(score)}, '` ', {score_bar(score)})"
    link = f"concat('[', {source}, ']({prefix}sources/', {slugify(source)}, '.md)')"
    second = f"if(coalesce({span}, '') <> '', concat('\\n  > _', {span_preview(span)}, '_ — ', {link}), concat('\\n  — ', {link}))"
    return f"concat({head}, if({source} IS NULL, '', {second}))"


def frontmatter(fields: list[tuple[str, str]]) -> str:
    """A front matter block of (key, value expression); give list values as ``list_field``."""
    lines = ", ".join(v if k == "" else f"concat({lit(k + ': ')}, {v})" for k, v in fields)
    return f"concat_ws('\\n', '---', {lines}, '---')"


def list_field(key: str, items: str) -> str:
    return f"concat_ws('\\n', '{key}:', transform({items}, x -> concat('  - ', x)))"


def iso_utc(t: str) -> str:
    return f"concat(date_format({t}, \"yyyy-MM-dd'T'HH:mm:ss\"), '+00:00')"
