"""Keyword topics of a claim."""

from __future__ import annotations

# Topic -> keywords, matched as substrings of the lower-cased claim text.
TOPIC_KEYWORDS = {
    "trade-compliance": ["trade", "customs", "import", "export", "tariff", "duty"],
    "http-protocol": ["http", "rfc", "protocol", "header", "request", "response"],
    "machine-learning": ["model", "training", "neural", "transformer", "bert", "gpt"],
    "legislation": ["act", "law", "regulation", "statute", "section", "amendment"],
    "permits-licensing": ["permit", "license", "approval", "registration"],
    "organizational": ["team", "department", "role", "manager", "employee"],
    "technical-infrastructure": ["server", "database", "api", "deployment", "cloud"],
}
FALLBACK_TOPIC = "general"


def keyword_topics(text: str, table: dict[str, list[str]] | None = None) -> str:
    """Every topic one of whose keywords occurs in the text, in table order; ``general`` when none does."""
    hits = []
    for topic, keywords in (table or TOPIC_KEYWORDS).items():
        test = " OR ".join(f"contains(low, '{k}')" for k in keywords)
        hits.append(f"if({test}, '{topic}', null)")
    found = f"transform(array(lower({text})), low -> array_compact(array({', '.join(hits)})))[0]"
    return f"transform(array({found}), t -> if(size(t) = 0, array('{FALLBACK_TOPIC}'), t))[0]"
