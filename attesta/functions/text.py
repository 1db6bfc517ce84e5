"""Text functions as Spark SQL expressions.

Each function takes SQL expressions (usually column names) and returns one, to be used with ``F.expr``, ``selectExpr``
or inside a statement. They are built-in functions only, so they run in the JVM within the surrounding projection.
"""

from __future__ import annotations

# Fixed values (patterns). A heading line; flag d makes \n the only line end, U lets \s cover Unicode spaces.
HEADING = r"(?mdU)^(#{1,4})\s+(.+)$"
# A page number line, such as "Page 3 of 9", "- 4 -" or "12".
PAGE_LINE = r"(?U)^(Page\s+\d+|[-–—]\s*\d+\s*[-–—]|\d+\s*$)"
# Line ends as splitlines() sees them.
ANY_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
# White space as strip() sees it.
WHITE_SPACE = (
    r"\t\n\u000B\u000C\r\u001C\u001D\u001E\u001F \u0085\u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A"
    r"\u2028\u2029\u202F\u205F\u3000"
)
# Private-use characters put before each heading to split there.
MARK = "\uE000\uE001"


def lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ws_trim(x: str) -> str:
    """Strip every kind of white space, not only blanks; a character list is much faster than a pattern."""
    return f"btrim({x}, '{WHITE_SPACE}')"


def norm(x: str) -> str:
    return f"lower({ws_trim(f'coalesce({x}, {lit(str())})')})"


def fingerprint(s: str, p: str, o: str) -> str:
    return f"concat_ws('|', {norm(s)}, {norm(p)}, {norm(o)})"


def conflict_key(s: str, p: str) -> str:
    return f"concat_ws('|', {norm(s)}, {norm(p)})"


def pair_key(a: str, b: str) -> str:
    """Key of an unordered pair of names."""
    return f"array_join(array_sort(array({norm(a)}, {norm(b)})), '|')"


def claim_text(s: str, p: str, o: str) -> str:
    return f"concat_ws(' ', {s}, {p}, {o})"


def sha_prefix(x: str, n: int = 16) -> str:
    return f"left(sha2({x}, 256), {n})"


def slugify(x: str) -> str:
    kept = f"regexp_replace(replace({norm(x)}, ' ', '-'), r'[^\\p{{L}}\\p{{N}}_-]', '')"
    return f"coalesce(nullif(left({kept}, 80), ''), 'unnamed')"


def words(x: str) -> str:
    return f"filter(split({x}, r'(?U)\\s+'), w -> w <> '')"


def word_count(x: str) -> str:
    return f"cast(size({words(x)}) AS BIGINT)"


def token_overlap(a: str, b: str) -> str:
    """Shared tokens over the larger token set; 0 when either side has none."""
    ta, tb = f"array_distinct({words(a)})", f"array_distinct({words(b)})"
    return f"coalesce(try_divide(size(array_intersect({ta}, {tb})), greatest(size({ta}), size({tb}))), 0D)"


def objects_conflict(a: str, b: str, similarity: float = 0.8) -> str:
    na, nb = norm(a), norm(b)
    return f"({na} <> {nb} AND {token_overlap(na, nb)} < {similarity}D)"


def count_literal(x: str, needle: str) -> str:
    """Occurrences of a literal, not overlapping."""
    return f"cast((length({x}) - length(replace({x}, {lit(needle)}, ''))) div {len(needle)} AS BIGINT)"


def table_markers(x: str) -> str:
    return f"({count_literal(x, '| --- ')} + {count_literal(x, '|---')})"


def quality_score(md: str, tables: str) -> str:
    """Heuristic 0..1 score of a parse: length, tables and structure, less for noise."""
    marks = f"(regexp_count({md}, r'(?mdU)^#{{1,6}}\\s') + regexp_count({md}, r'(?mdU)^[-*]\\s'))"
    noisy = f"length(regexp_replace({md}, r'[\\x00-\\x7F]', '')) / length({md}) > 0.1 AND wc > 0"
    lines = f"filter(split({md}, r'{ANY_LINE_END}'), x -> {ws_trim('x')} <> '')"
    short = let("ls", lines, "coalesce(try_divide(aggregate(ls, 0L, (acc, x) -> acc + length(x)), size(ls)) < 10, false)")
    control = f"length(regexp_replace(left({md}, 500), r'[^\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ''))"
    base = f"(least(wc / 500D, 0.3D) + if({tables} > 0, 0.15D, 0D) + least({marks} / 20D, 0.2D))"
    score = f"{base} * if({noisy}, 0.7D, 1D) * if({short}, 0.5D, 1D) * if({control} > 10, 0.1D, 1D)"
    return f"if(coalesce(length({md}), 0) = 0, 0D, least({let('wc', word_count(md), score)}, 1D))"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is then computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def strip_boilerplate(md: str, repeat: int = 3, max_len: int = 100) -> str:
    """Drop short lines that occur ``repeat`` times or more, and page number lines.

    In sorted order repeats are equal neighbours, so a text costs one n log n pass.
    """
    bare = f"array_sort(filter(transform(split({md}, '\\n'), x -> {ws_trim('x')}), x -> x <> '' AND length(x) < {max_len}))"
    repeated = f"array_distinct(filter(srt, (x, i) -> get(srt, i + {repeat - 1}) <=> x))"
    keep = let("b", ws_trim("x"), f"NOT array_contains(gone, b) AND NOT b RLIKE r'{PAGE_LINE}'")
    body = f"array_join(filter(split({md}, '\\n'), x -> {keep}), '\\n')"
    return let("gone", let("srt", bare, repeated), body)


def headings(md: str) -> str:
    return f"transform(regexp_extract_all({md}, r'{HEADING}', 2), h -> {ws_trim('h')})"


def sections(md: str, preamble: str = "", strip_plain: bool = False) -> str:
    """Sections as an array of (heading, content); text before the first heading is the preamble.

    A text without headings is one section with an empty heading: as it is, or stripped (and dropped when blank) with
    ``strip_plain``.
    """
    parts = f"split(regexp_replace({md}, r'{HEADING}', '{MARK}$0'), '{MARK}')"
    title = f"if(i = 0, {lit(preamble)}, {ws_trim(f'''regexp_extract(p, r'{HEADING}', 2)''')})"
    found = f"filter(transform(parts, (p, i) -> struct({title} AS heading, {ws_trim('p')} AS content)), s -> s.content <> '')"
    plain = f"array(struct('' AS heading, {ws_trim(md) if strip_plain else md} AS content))"
    if strip_plain:
        plain = f"filter({plain}, s -> s.content <> '')"
    return let("parts", parts, f"if(size(parts) = 1, {plain}, {found})")


def pack_paragraphs(content: str, max_chars: int) -> str:
    """Greedy packing of paragraphs; a paragraph is never split.

    The accumulator keeps only where the open chunk starts and its length, so a long section costs one pass.
    """
    span = "array(struct(acc.start AS start, acc.pos - acc.start AS n))"
    full = f"(acc.len + n + 2 > {max_chars} AND acc.pos > acc.start)"
    zero = "struct(cast(array() AS array<struct<start:int,n:int>>) AS done, 1 AS start, 0 AS len, 1 AS pos)"
    step = (
        f"struct(if({full}, concat(acc.done, {span}), acc.done) AS done, if({full}, acc.pos, acc.start) AS start, "
        f"if({full}, 0, acc.len) + n + 2 AS len, acc.pos + 1 AS pos)"
    )
    spans = f"aggregate(transform(ps, t -> length(t)), {zero}, (acc, n) -> {step}, acc -> concat(acc.done, {span}))"
    return let("ps", f"split({content}, r'\\n\\n+')", f"transform({spans}, s -> array_join(slice(ps, s.start, s.n), '\\n\\n'))")


def chunks(md: str, max_chars: int = 6000) -> str:
    """Section-aware chunks as an array of (heading, content); the position is the chunk index."""
    texts = f"if(length(sec.content) <= {max_chars}, array(sec.content), {pack_paragraphs('sec.content', max_chars)})"
    split_all = f"flatten(transform({sections(md)}, sec -> transform({texts}, t -> struct(sec.heading AS heading, t AS content))))"
    return f"if({ws_trim(md)} = '', cast(array() AS array<struct<heading:string,content:string>>), {split_all})"


def stable_hash(content: str) -> str:
    """Hash of a page without its ``last_updated:`` and ``last_projected:`` lines, whatever its line ends.

    One pattern passes over the text as a whole; the others only where a line end asks for them.
    """
    within_line = WHITE_SPACE.replace(r"\n", "").replace(r"\r", "")
    trimmed = f"if(right({content}, 2) RLIKE r'[\\r\\n]', regexp_replace({content}, r'(\\r\\n|\\n|\\r)$', ''), {content})"
    lines = f"if(contains(page, '\\r'), regexp_replace(page, r'\\r\\n?', '\\n'), page)"
    kept = f"substr(regexp_replace(concat('\\n', {lines}), r'\\n[{within_line}]*last_(updated|projected):[^\\n]*', ''), 2)"
    return f"sha2({let('page', trimmed, kept)}, 256)"


def html_to_markdown(html: str) -> str:
    """Readable text of an HTML page with ``#`` headings, list items and blank lines between blocks."""
    hidden = "|".join(rf"<{tag}\b.*?</{tag}\s*>" for tag in ("script", "style", "head"))
    t = f"regexp_replace({html}, r'(?is){hidden}|<!--.*?-->', '')"
    for level in range(1, 7):
        t = f"regexp_replace({t}, r'(?i)<h{level}\\b[^>]*>', '\\n\\n{'#' * level} ')"
    t = f"regexp_replace({t}, r'(?i)<li\\b[^>]*>', '\\n- ')"
    t = f"regexp_replace({t}, r'(?i)<br\\s*/?>', '\\n')"
    t = f"regexp_replace({t}, r'(?i)</?(p|div|h[1-6]|ul|ol|table|tr|article|section|nav|footer)\\b[^>]*>', '\\n\\n')"
    t = f"regexp_replace({t}, r'<[^>]*>', '')"
    # The character references of markup itself.
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, {lit(ref)}, {lit(char)})"
    return ws_trim(f"regexp_replace({t}, r'\\n{{3,}}', '\\n\\n')")
