"""Text functions as column expressions.

White space in patterns is ASCII and lengths count code points.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for retrieval.
STOPWORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had",
    "her", "was", "one", "our", "out", "has", "have", "been", "from", "that",
    "this", "with", "they", "will", "each", "make", "like", "then", "than",
    "them", "some", "what", "when", "where", "which", "who", "how", "use",
    "into", "does", "also", "just", "more", "over", "such", "only", "very",
    "about", "after", "being", "between", "could", "during", "before",
    "should", "would", "their", "there", "these", "those", "through",
    "because", "using", "other",
)

#: Words left out of keyword extraction.
KEYWORD_STOPWORDS = (
    "that", "this", "with", "from", "have", "been", "will", "when", "what",
    "which", "then", "than", "into", "over", "after", "some", "more", "also",
    "most", "other", "each", "such", "only", "just", "about", "there", "their",
    "where", "would", "could", "should", "these", "those", "make", "made",
    "using", "used", "call", "calls", "does", "done", "were", "they",
)

#: Capitalised words that name no entity.
ENTITY_STOPWORDS = (
    "The", "This", "That", "These", "Those", "There", "Then", "They", "Them",
    "And", "But", "For", "With", "From", "Into", "When", "What", "Where", "Which",
    "While", "Who", "Why", "How", "Also", "After", "Before", "Because", "Should",
    "Would", "Could", "Will", "Was", "Were", "Has", "Have", "Had", "Not", "Now",
    "New", "One", "Two", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
    "Saturday", "Sunday", "January", "February", "March", "April", "June", "July",
    "August", "September", "October", "November", "December",
)

#: Topic tags and their words.
TOPICS = {
    "cat:personal": r"\b(i |my |i'm |i've |we |our |me )\b",
    "cat:work": r"\b(work|job|office|meeting|project|team|manager|colleague|career|salary|hired)\b",
    "cat:tech": r"\b(code|programming|software|database|api|server|deploy|bug|git|typescript|python|react|node)\b",
    "cat:health": r"\b(health|doctor|exercise|yoga|gym|diet|sleep|meditation|therapy|medicine|symptom)\b",
    "cat:finance": r"\b(money|budget|savings|invest|salary|cost|price|payment|bank|credit|expense|coupon|store|bought|purchased)\b",
    "cat:home": r"\b(home|house|apartment|room|kitchen|bedroom|furniture|garden|repair|renovation|neighbor|moved)\b",
    "cat:location": r"\b(travel|trip|vacation|flight|hotel|restaurant|city|country|visited|downtown|park)\b",
    "cat:education": r"\b(school|university|college|degree|course|class|study|learn|graduate|student|teacher|exam)\b",
    "cat:social": r"\b(friend|family|partner|spouse|child|parent|sibling|birthday|party|dinner|wedding|date)\b",
    "cat:hobby": r"\b(music|movie|book|game|sport|hobby|play|concert|theater|playlist|podcast|guitar|tennis|yoga|painting)\b",
    "cat:shopping": r"\b(bought|purchased|ordered|shop|store|amazon|target|walmart|coupon|sale|discount|delivery)\b",
    "cat:food": r"\b(cook|recipe|restaurant|meal|food|dinner|lunch|breakfast|coffee|tea|bake|kitchen)\b",
    "cat:pets": r"\b(pet|dog|cat|animal|vet|shelter|walk|breed)\b",
    "cat:temporal": r"\b(yesterday|today|last week|last month|tomorrow|next week|this morning|this evening|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
}
#: Tags of what kind of knowledge a text is.
KNOWLEDGE = {
    "cat:preference": r"\b(i like|i prefer|i enjoy|i love|i hate|my favorite|i don't like)\b",
    "cat:identity": r"\b(my name is|i am a|i work at|i live in|i graduated|my birthday|i was born)\b",
    "cat:plan": r"\b(i plan to|i'm going to|i want to|i'm thinking of|i'm considering|next week i|planning to)\b",
    "cat:experience": r"\b(i went|i visited|i attended|i tried|i saw|i heard|i found|i discovered)\b",
}
#: Verbs of saying.
FEEDBACK_VERBS = ("said", "verbatim", "feedback", "asked", "wants", "prefers", "requested", "directed", "decided", "confirmed", "clarified", "chose", "specified", "explained")
#: Marks of records of work, of identifiers and of routine messages.
RECORD_VERBS = r"(?i)\b(Submitted|Finalized|Completed|Reconciled|Triaged|Posted|Resolved|Stamped|Pushed|Deployed|Migrated|Imported|Exported|Backfilled)\b"
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
CONCRETE_ID = r"(?i)\b(?:events?|tickets?|comps?|comp_id|usef|usea|classes|class|cases?|orders?|payments?|member_id|horse_id|user_id|orgs?|#)\s*[#:]?\s*\d{3,}"
ROUTINE_VERBS = r"(?i)\b(completed|succeeded|finished|returned|loaded|saved|read|wrote|synced|pinged|checked|started|stopped|rotated|flushed)\b"
ROUTINE_NOUNS = r"(?i)\b(file|log|request|response|status|job|connection|task|cron|sync|tick|batch)\b"
#: What a report of finished work mentions.
ACTION_WORDS = r"(?i)\b(committed?|sha|[0-9a-f]{7,40}|builds?|audite?d?|teste?d?|verified|fixe?d?|created?|updated?|implemented?|added|refactored?|documented?|resolved|merged|deployed|removed|migrated|wrote|reviewed)\b"
#: Failure modes by what the result mentions, first match wins, with hints for the retry.
FAILURES = {
    "agent_stale": ("stale", "disconnected"),
    "timeout": ("timeout", "timed out"),
    "output_invalid": ("json", "schema", "parse"),
    "test_fail": ("test fail", "vitest", "jest"),
    "lint_fail": ("lint", "eslint", "typecheck"),
    "merge_conflict": ("conflict",),
}
RETRY_HINTS = {
    "agent_stale": "Previous worker disconnected before completion. Resume from last known state; check git status before re-running destructive commands.",
    "timeout": "Previous attempt timed out. Break work into smaller commits; report progress every 5 minutes.",
    "output_invalid": "Previous output failed validation. Return a single fenced code block; verify JSON parses before submitting.",
    "test_fail": "Previous attempt left tests failing. Run vitest before completion; do NOT mark complete if any test fails.",
    "lint_fail": "Previous attempt had lint/typecheck errors. Run pnpm typecheck and pnpm lint before completion.",
    "merge_conflict": "Previous attempt left merge conflicts unresolved. git pull --rebase, resolve, then re-attempt.",
    "unknown": "Previous attempt failed for an unclassified reason. Investigate the prior result before re-running.",
}
SEPARATOR = "\n\n--- reinforced ---\n"
FADED = "… [faded]"


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def tokens(text: Column) -> Column:
    """Distinct lower-case words of three letters or more that carry meaning."""
    return F.array_distinct(F.filter(_words(text), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)


def keyword_score(query: Column, concept: Column, content: Column) -> Column:
    """.6 of the concept's and .4 of the content's similarity to the query's tokens."""
    return 0.6 * jaccard(query, concept) + 0.4 * jaccard(query, content)


def concept_overlap(query: Column, concept: Column) -> Column:
    return F.when(F.size(concept) > 0, F.size(F.array_intersect(concept, query)) / F.size(concept)).otherwise(0.0)


def search_terms(text: Column) -> Column:
    """Terms of a full-text query: word characters only, two or more, lower case, distinct."""
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\w\s]", " ")), r"\s+"), lambda w: F.length(w) > 1))


def index_terms(text: Column) -> Column:
    """Terms of an indexed text, in order, with repeats."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\w\s]", " ")), r"\s+"), lambda w: w != "")


def n_index_terms(text: Column) -> Column:
    """The number of index_terms, without making them."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\w++"), 0))


def index_terms_among(text: Column, terms: Sequence[str]) -> Column:
    """Those of index_terms that are among a few lower-case ``terms``, in order, with repeats."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)(?<!\w)(?:{'|'.join(terms)})(?!\w)"), 0), F.lower)  # letters, digits and _ of ASCII


def classify_query(text: Column) -> Column:
    """targeted, exploratory or balanced by the marks of each that the text has."""
    n = F.size(F.filter(F.split(text, r"[\t\n\f\r ]+"), lambda w: w != ""))
    low = F.lower(text)
    # letters, digits and _ of ASCII make words: the JVM's own \b takes others for letters too, and its $ stands before a last line break
    marks = [(text, r"[A-Z]+-\d+", 2), (text, r"[a-z][A-Z]", 1), (text, r"\w+_\w+", 1), (low, r"[0-9a-f]{8}-[0-9a-f]{4}", 2), (text, r"[\"']", 1), (text, r"[/\\]", 1), (F.trim(text), r"\.\w{1,4}\z", 1)]
    vague = [(text, r"(?iu)^(what|how|why|when|where|who|which|can|does|is|are)(?!\w)"), (low, r"(?<!\w)(overview|general|about|related|similar|like|broad|concept|idea|approach|strategy)(?!\w)"), (low, r"(?<!\w)(any|all|everything|anything)(?!\w)")]
    score = F.when(n <= 5, 2).when(n <= 8, 1).otherwise(0) - F.when(n > 15, 2).when(n > 10, 1).otherwise(0)
    for c, p, w in marks:
        score = score + F.when(c.rlike(p), w).otherwise(0)
    for c, p in vague:
        score = score - F.when(c.rlike(p), 1).otherwise(0)
    return F.when(score >= 2, "targeted").when(score <= -2, "exploratory").otherwise("balanced")


def _held(pattern: str) -> str:
    r"""A pattern of the form ``\b(one|other )\b`` with Java's bounds of words (letters, decimal digits, _ and marks upon
    them) spelt out for RE2, whose own know ASCII alone."""
    word = r"\pL\p{Nd}_"
    some = pattern.removeprefix(r"\b(").removesuffix(r")\b").split("|")
    ends = [("|".join(x for x in some if not x.endswith(" ")), rf"(?:[^{word}\p{{Mn}}]|\z)"), ("|".join(x for x in some if x.endswith(" ")), f"[{word}]")]
    return rf"(?:\A|[^{word}\p{{Mn}}])\p{{Mn}}*(?:" + "|".join(f"(?:{x}){end}" for x, end in ends if x) + ")"


_NAMES = r"(?:\.[ \t-\r]+)?[A-Z][a-z]+(?:[ \t-\r]+[A-Z][a-z]+)*"


def auto_tags(concept: Column, content: Column) -> Column:
    """Topic tags, up to five entity tags, then tags of the kind of knowledge.  A text is read once for each
    table of words by an automaton, and for names only until it has five."""
    topics, knowledge = ({t: _held(p) for t, p in table.items()} for table in (TOPICS, KNOWLEDGE))

    @F.arrow_udf("array<string>")
    def run(low, texts):
        import re

        import pyarrow as pa
        import pyarrow.compute as pc

        found = re.compile(_NAMES)
        held = lambda table: list(zip(*([t if x else None for x in pc.match_substring_regex(low, p).to_pylist()] for t, p in table.items())))
        out = []
        for before, text, after in zip(held(topics), texts, held(knowledge)):
            if not text.is_valid:
                out.append(None)
                continue
            names = {}
            for m in found.finditer(text.as_py()):
                if 2 < len(m[0]) < 30 and names.setdefault(f"entity:{m[0]}") is None and len(names) == 5:
                    break
            out.append([t for t in (*before, *names, *after) if t])
        return pa.array(out, pa.list_(pa.string()))

    return run(F.lower(F.concat_ws(" ", concept, content)), content)


def entities(text: Column) -> Column:
    """Distinct capitalised names of 3 to 40 letters."""
    found = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+)*)\b"), 1)
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) <= 40) & ~x.isin(*ENTITY_STOPWORDS)))


#: Capitalised words of a query that name nothing, and those of a memory that lead no further.
QUERY_ENTITY_STOPWORDS = (
    "what", "who", "when", "where", "why", "how", "which", "whose", "whom", "the", "this", "that", "these", "those", "and", "but",
    "for", "did", "does", "is", "are", "was", "were", "tell", "about", "they", "them",
)
SEED_ENTITY_STOPWORDS = (
    "my", "the", "a", "an", "i", "we", "you", "he", "she", "it", "they", "this", "that", "what", "when", "where", "who", "why", "how",
    "is", "are", "was", "were", "do", "does", "project", "account", "codename", "name", "team", "main", "internal",
)
_CAPITALISED = r"\b[A-Z][a-zA-Z]{2,}\b"


def query_entities(text: Column) -> Column:
    """Distinct names of a query, lower-cased."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_CAPITALISED), 0), F.lower)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*QUERY_ENTITY_STOPWORDS)))


def seed_entities(text: Column, asked: Column) -> Column:
    """Distinct names of a memory's text that the query's tokens do not hold."""
    found = F.regexp_extract_all(text, F.lit(_CAPITALISED), 0)
    return F.array_distinct(F.filter(found, lambda w: ~F.lower(w).isin(*SEED_ENTITY_STOPWORDS) & ~F.array_contains(asked, F.lower(w))))


def is_feedback(text: Column, names: tuple[str, ...]) -> Column:
    """Texts that begin with one of the names and a verb of saying; no names, no feedback."""
    if not names:
        return F.lit(False)
    return F.coalesce(F.trim(text).rlike(rf"(?i)^({'|'.join(names)})\s+({'|'.join(FEEDBACK_VERBS)})\b"), F.lit(False))


def is_verified_record(text: Column) -> Column:
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), 0))
    return F.coalesce(text.rlike(RECORD_VERBS) & (count(ISO_DATE) + count(CONCRETE_ID) >= 2), F.lit(False))


def is_routine(text: Column) -> Column:
    t = F.trim(text)
    return F.coalesce((F.length(t) > 0) & (F.length(t) <= 150) & t.rlike(ROUTINE_VERBS) & t.rlike(ROUTINE_NOUNS) & ~is_verified_record(t), F.lit(False))


def memory_type(text: Column) -> Column:
    steps = text.rlike(r"(?i)\bhow to\b|\bsteps?:") | text.rlike(r"(?m)^\s*\d+[.)]\s") | text.rlike(r"(?i)\bthen run\b|\bfirst,?\s")
    event = text.rlike(r"(?i)\b(discovered|debugged|fixed|encountered|happened|resolved|found that|we did|i did|yesterday|last week|today)\b")
    fact = text.rlike(r"(?i)\b(is|are|should|always|never|must|uses?|requires?|means|pattern|decision|rule|convention)\b")
    return F.when(steps, "procedural").when(event, "episodic").when(fact & (F.length(text) < 500), "semantic").otherwise("unclassified")


def keywords(text: Column, most: int = 8) -> Column:
    """The first words of four letters or more that carry meaning; repeats stay."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+")
    return F.slice(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*KEYWORD_STOPWORDS)), 1, most)


def failure_mode(result: Column) -> Column:
    low, out = F.lower(result), None
    for mode, words in FAILURES.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, mode) if out is None else out.when(hit, mode)
    return F.when(result.isNull(), "unknown").otherwise(out.otherwise("unknown"))


def retry_hint(mode: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RETRY_HINTS.items() for x in kv]), mode)


def completion_accepted(result: Column) -> Column:
    return F.coalesce((F.length(F.trim(result)) >= 20) & result.rlike(ACTION_WORDS), F.lit(False))


def merge_content(old: Column, new: Column, most: int = 1500) -> Column:
    """Append a text as a segment; beyond ``most`` characters the oldest segments go, the newest stays."""
    addition = F.trim(F.coalesce(new, F.lit("")))
    parts = F.concat(F.split(old, SEPARATOR.replace("-", r"\-")), F.array(addition))
    n = F.size(parts)
    tails = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), SEPARATOR))
    fitting = F.filter(tails, lambda t: F.length(t) <= most)
    merged = F.when(F.size(fitting) > 0, F.get(fitting, F.lit(0))).otherwise(addition)
    return F.when((addition == "") | F.contains(old, addition), old).otherwise(merged)


def fade(content: Column, chars: int = 150) -> Column:
    return F.concat(F.rtrim(F.substring(content, 1, chars)), F.lit(FADED))


def explain(scores: dict[str, Column]) -> Column:
    """Why a result is there: its non-zero parts."""
    return F.concat_ws(" | ", *[F.when(c > 0, F.concat(F.lit(f"{name}="), F.format_number(c, 3))) for name, c in scores.items()])


# Functions that need a program per text: Arrow batches.


def densest_window(text: str, terms: list[str], size: int) -> str:
    """At most ``size`` characters around the place where most terms stand."""
    if len(text) <= size:
        return text
    low, hits = text.lower(), []
    for t in terms:
        at = low.find(t) if len(t) >= 2 else -1
        while at >= 0:
            hits.append(at)
            at = low.find(t, at + len(t))
    if not hits:
        return text[:size].rstrip() + "…"
    hits.sort()
    best, most, j = hits[0], 0, 0
    for i, h in enumerate(hits):
        start = max(0, h - size // 4)
        while j < len(hits) and hits[j] - start < size:
            j += 1
        if j - i > most:
            best, most = start, j - i
    body = size - (best > 0) - (min(len(text), best + size) < len(text))
    end = min(len(text), best + body)
    start = max(0, end - body)
    out = text[start:end]
    out = "…" + out.lstrip() if start else out
    return out.rstrip() + "…" if end < len(text) else out


def snippet(text: Column, terms: Column, size: int = 200) -> Column:
    @F.pandas_udf("string")
    def run(texts, many):
        return texts.combine(many, lambda t, w: None if t is None else densest_window(t, list(w if w is not None else []), size))

    return run(text, terms)


def _cell(x: object) -> str | None:
    if x is None or isinstance(x, (bool, int, float)):
        return json.dumps(x)
    if isinstance(x, str) and x and x == x.strip() and not any(c in x for c in ",\n\r\"\\") and x not in ("null", "true", "false"):
        try:
            float(x)
        except ValueError:
            return x
    return json.dumps(x, ensure_ascii=False) if isinstance(x, str) else None


def _encode(value: object) -> str | None:
    """A uniform array of flat objects as a header and one line per row."""
    if not isinstance(value, list) or not value or not all(isinstance(r, dict) and list(r) == list(value[0]) for r in value) or not value[0]:
        return None
    names = list(value[0])
    if any(c in n for n in names for c in ",{}[]:\n\"") or "" in names:
        return None
    rows = [[_cell(r[n]) for n in names] for r in value]
    if any(c is None for r in rows for c in r):
        return None
    return f"[{len(rows)}]{{{','.join(names)}}}:\n" + "\n".join("  " + ",".join(r) for r in rows)


def _decode(text: str) -> list[dict]:
    head, *lines = text.split("\n")
    names = head[head.index("{") + 1 : head.rindex("}")].split(",")
    read, out = json.JSONDecoder(), []
    for line in lines:
        at, row = 2, []
        while at <= len(line):
            if line[at : at + 1] == '"':
                cell, at = read.raw_decode(line, at)
            else:
                end = line.find(",", at)
                end = len(line) if end < 0 else end
                raw, at = line[at:end], end
                try:
                    cell = json.loads(raw)
                except ValueError:
                    cell = raw
            row.append(cell)
            at += 1
        out.append(dict(zip(names, row, strict=True)))
    return out


def compress_json(text: str, least_saving: int = 40) -> tuple[str, str]:
    """(text, format): a table where that reads back exactly and saves enough, else the text itself."""
    try:
        value = json.loads(text)
    except ValueError:
        return text, "passthrough"
    if not isinstance(value, (dict, list)):
        return text, "json"
    table = _encode(value)
    try:
        good = table is not None and json.dumps(_decode(table)) == json.dumps(value) and len(text) - len(table) >= least_saving
    except ValueError:
        good = False
    return (table, "table") if good else (text, "json")


def compressed(text: Column, least_saving: int = 40) -> Column:
    """struct(text, format) of compress_json."""
    import pandas as pd

    @F.pandas_udf("text string, format string")
    def run(texts):
        return pd.DataFrame([(None, None) if t is None else compress_json(t, least_saving) for t in texts], columns=["text", "format"])

    return run(text)
