"""Text preparation at ingest: redaction, keywords, sentences, claims, gates, dates. JVM expressions throughout."""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning as keywords, and particles that end a Korean word, longest first.
STOP_WORDS = (
    "이 그 저 것 수 등 및 를 을 에 의 가 는 은 도 로 와 과 한 하 the a an is are was were be been have has had do does did will would should could can may might "
    "this that with from for and but or not in on at to of it its by as"
).split()
PARTICLES = "(까지|부터|에서|에게|으로|라는|에는|를|을|는|은|이|가|의|에|로|도|와|과|만)$"

# What redaction looks for and puts in its place, in order.
REDACTIONS = [
    (r"(?i)\b(?:sk|pk|api|key|token)[-_][A-Za-z0-9_\-]{16,}", "[REDACTED_KEY]"),
    (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]"),
    (r"(?i)\b(password|passwd|pwd)\s*[:=]\s*\S+", "$1=[REDACTED]"),
    (r"(?<![0-9])(?:\+?[0-9]{1,3}[- ])?[0-9]{2,4}[- ][0-9]{3,4}[- ][0-9]{4}(?![0-9])", "[REDACTED_PHONE]"),
]

# Endings that tell of a modal family a text speaks in.
MODALITY = {
    "future": "(예정이|ㄹ 것이다|할 것이다|될 것이다|전망이|계획이|방침이)",
    "intention": "(려 한다|려고 한다|하고자 한다|하겠다|하려는)",
    "conjecture": "(것으로 보인다|듯하다|추정된다|가능성이 높다|일 수 있다)",
    "obligation": "(해야 한다|하여야 한다|필요가 있다)",
}

# What the policy rules look for in a text.
RATIONALE = "(?i)(근거|이유|because|reason|rationale|왜냐하면|기반|기반으로)"
CAUSE_OR_FIX = r"(?i)(원인|이유|해결|조치|복구|cause|reason|fix|resolve|root\s*cause|workaround)"
STEPS = r"(?i)(\b1\.\s|\b2\.\s|\bstep\s*\d|단계|\n\s*-\s|\n\s*\*\s|\n\s*\d+\)\s)"

# Openings that point at something outside the text, of split children and of reflected items.
PRONOUNS = ["이 ", "그 ", "저 ", "해당 ", "이로 인해", "그로 인해", "이것", "그것", "위 ", "아래 "]
META_OPENINGS = ["이것", "그것", "위", "이번", "해당", "재작성을 통해"]

# Keywords that end in a particle, and how a query speaks of an assistant's words.
PARTICLE_ENDING = "[가-힣](를|을|는|은|이|가|의|에|로|도|와|과|만|까지|부터|에서|에게|으로|라는|에는)$"
ASSISTANT_PHRASES = [
    "어시스턴트가", "ai가", "클로드가", "봇이", "뭐라고 했", "뭐라고 답", "뭐라 했", "뭐라 답", "답변", "대답",
    "assistant said", "ai said", "what did you say", "your response", "your answer", "you said", "you told", "you mentioned", "you replied", "bot said",
]
ASSISTANT_MARKS = ["Assistant:", "assistant:", "답변:"]

# Words that a plain tokeniser drops.
PLAIN_STOP_WORDS = ["이", "그", "저", "것", "수", "등", "및", "를", "을", "에", "의", "가", "는", "은", "도", "로", "와", "과", "한", "하", "the", "a", "an", "is", "are", "was", "were"]


def redact(c: Column) -> Column:
    for pattern, with_ in REDACTIONS:
        c = F.regexp_replace(c, pattern, with_)
    return c


def prepare_for_embedding(c: Column, cap: int = 8000) -> Column:
    """Drop front matter, code fences and tags, keep link texts, squeeze blanks, cap the length."""
    for pattern, with_ in ((r"(?s)\A---\n.*?\n---\n", ""), (r"(?s)```.*?```", " "), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]+>", " "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, with_)
    return F.substring(F.trim(c), 1, cap)


def sentences(c: Column) -> Column:
    """Sentences that end in ``.``, ``!`` or ``?`` before white space, or at a line break."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def packed_sentences(c: Column, most: int = 300) -> Column:
    """Sentences joined with blanks into pieces of at most ``most`` characters; a longer sentence is its own piece."""
    last = lambda a: F.element_at(a, -1)

    def add(acc: Column, s: Column) -> Column:
        fits = (F.size(acc) > 0) & (F.length(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(""))) + 1 + F.length(s) <= most)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last(acc), F.lit(" "), s)))
        return F.when(fits, joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(sentences(c), F.array().cast("array<string>"), add)


def implicit_keywords(c: Column, most: int = 5) -> Column:
    """Distinct words of two or more letters or digits that aren't stop words, in order."""
    return F.slice(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]{2,}"), 0), lambda w: ~w.isin(*STOP_WORDS))), 1, most)


def numeric_anchors(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"[0-9]+(?:[.,:/-][0-9]+)*%?"), 0))


def missing_anchors(parent: Column, children: Column) -> Column:
    """Numbers of a parent text that its children, joined, don't have."""
    return F.filter(numeric_anchors(parent), lambda a: ~F.contains(children, a))


def modalities(c: Column) -> Column:
    return F.filter(F.array(*(F.when(c.rlike(p), F.lit(k)) for k, p in MODALITY.items())), lambda x: x.isNotNull())


def valid_content(c: Column, type_: Column, topic: Column) -> Column:
    """First reason a text isn't accepted, or null."""
    t = F.trim(c)
    few = (F.length(t) < 10) & (F.size(F.split(t, r"\s+")) < 3)
    return F.when(c.isNull() | few, "too_short").when(t.rlike(r"^https?://\S+$"), "url_only").when(type_.isNull() & topic.isNull(), "no_type_and_topic")


def policy_violations(f: dict[str, Column]) -> Column:
    """Names of the policy rules a row breaks, of columns content, type, linked (a count), resolution_status, case_id, assertion_status, rejected, workspace."""
    text, kind = F.coalesce(f["content"], F.lit("")), f["type"]
    rules = {
        "decisionHasRationale": (kind == "decision") & (F.coalesce(f["linked"], F.lit(0)) < 2) & ~text.rlike(RATIONALE),
        "errorHasResolutionPath": (kind == "error") & ~text.rlike(CAUSE_OR_FIX) & f["resolution_status"].isNull(),
        "procedureHasStepMarkers": (kind == "procedure") & ~text.rlike(STEPS),
        "caseIdHasResolutionStatus": f["case_id"].isNotNull() & f["resolution_status"].isNull(),
        "assertionNotContradictory": (f["assertion_status"] == "verified") & f["rejected"],
        "fragmentHasWorkspace": f["workspace"].isNull(),
    }
    return F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())


def _opens_with(c: Column, openings: list[str]) -> Column:
    return F.greatest(*(c.startswith(p) for p in openings))


def acceptable_child(c: Column) -> Column:
    """Whether a piece of a split text may stand alone: 20 characters, no broken ones, no Han or kana among Hangul, no pronoun first."""
    t = F.trim(c, F.lit(" \t\n\r"))
    mixed = t.rlike("[가-힣]") & t.rlike("[\u3040-\u30ff\u4e00-\u9fff]")
    return F.coalesce((F.length(t) >= 20) & ~F.contains(t, F.lit("\ufffd")) & ~mixed & ~_opens_with(t, PRONOUNS), F.lit(False))


def self_contained(c: Column) -> Column:
    """Whether a reflected item says something by itself: 20 characters (10 with Hangul) and no opening that points elsewhere."""
    t = F.trim(c, F.lit(" \t\n\r"))
    least = F.when(t.rlike("[가-힣ㄱ-ㅎㅏ-ㅣ]"), 10).otherwise(20)
    return F.coalesce((F.length(t) >= least) & ~_opens_with(t, META_OPENINGS), F.lit(False))


def polluted(keywords_of: Column) -> Column:
    """Whether any keyword still carries a particle."""
    return F.exists(keywords_of, lambda k: k.rlike(PARTICLE_ENDING))


def hidden_identifier(content: Column, keywords_of: Column) -> Column:
    """Whether the text has a camel-case name and no keyword does."""
    return content.rlike("[a-z][A-Z]") & ~F.exists(keywords_of, lambda k: k.rlike("[a-z][A-Z]"))


def asks_assistant(c: Column) -> Column:
    """Whether a query is about what an assistant said."""
    return F.coalesce(F.greatest(*(F.contains(F.lower(c), F.lit(p)) for p in ASSISTANT_PHRASES)), F.lit(False))


def assistant_query(c: Column) -> Column:
    """The query as it is embedded: with a prefix where it is about an assistant's words."""
    return F.when(asks_assistant(c), F.concat(F.lit("Assistant: "), c)).otherwise(c)


def assistant_boost(content: Column, importance: Column, boost: float = 0.02) -> Column:
    """Importance of an assistant's words for such a query."""
    said = F.greatest(*(F.contains(content, F.lit(m)) for m in ASSISTANT_MARKS))
    return F.when(said, F.least(F.lit(1.0), F.coalesce(importance, F.lit(0.0)) + boost)).otherwise(importance)


def merged_keywords(supplied: Column, extracted: Column, most: int = 10) -> Column:
    """Supplied keywords, then extracted ones that aren't among them whatever their case, up to ``most`` in all."""
    low = lambda a: F.transform(a, lambda k: F.lower(k))
    keys = low(extracted)
    new = F.filter(extracted, lambda k, i: ~F.array_contains(low(supplied), F.lower(k)) & (F.array_position(keys, F.lower(k)) == i + 1))
    return F.concat(supplied, F.slice(new, 1, F.greatest(F.lit(most) - F.size(supplied), F.lit(0))))


def plain_tokens(c: Column, most: int = 10) -> Column:
    """Words of two characters or more without stop words, in order, repeats included."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_\sㄱ-ㅎ가-힣]", " "), r"\s+")
    return F.slice(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*PLAIN_STOP_WORDS)), 1, most)


def document_metadata(content: Column, path: Column) -> Column:
    """(title, category, headings, words, bytes) of a markdown document: front matter first, then headings and the path."""
    front = F.regexp_extract(content, r"(?s)\A---\n(.*?)\n---", 1)
    field = lambda name: F.nullif(F.trim(F.regexp_extract(front, rf"(?m)^.*{name}:[ \t]*[\"']?(.+?)[\"']?[ \t]*$", 1)), F.lit(""))
    headings = F.transform(F.regexp_extract_all(content, F.lit(r"(?m)^#[ \t]+(.+)$"), 1), lambda h: F.trim(h))
    parts = F.split(path, "/")
    return F.struct(
        F.coalesce(field("title"), F.get(headings, F.lit(0))).alias("title"),
        F.coalesce(field("category"), F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("root")).alias("category"),
        headings.alias("headings"),
        F.size(F.filter(F.split(content, r"\s+"), lambda w: w != "")).alias("words"),
        F.octet_length(content).alias("bytes"),
    )


def parse_dates(expression: str, now: dt.date) -> tuple[dt.date, dt.date] | None:
    """[from, to) of a relative Korean or English date phrase, or None."""
    s = expression.strip().lower()
    day = dt.timedelta(days=1)
    words = {"오늘": 0, "today": 0, "어제": 1, "yesterday": 1, "그저께": 2, "그제": 2}
    for w, n in words.items():
        if s == w:
            return now - n * day, now - n * day + day
    if m := re.fullmatch(r"(\d+)\s*(일|주|주일|개월|달|년|days?|weeks?|months?|years?)\s*(전|ago)", s):
        n, unit = int(m[1]), m[2]
        if unit in ("일", "day", "days"):
            start = now - n * day
        elif unit.startswith(("주", "week")):
            start = now - 7 * n * day
        else:
            months = n if unit in ("개월", "달") or unit.startswith("month") else 12 * n
            y, mo = divmod(now.year * 12 + now.month - 1 - months, 12)
            start = dt.date(y, mo + 1, min(now.day, calendar.monthrange(y, mo + 1)[1]))
        return start, start + day
    monday = now - now.weekday() * day
    first = now.replace(day=1)
    last_first = (first - day).replace(day=1)
    spans = {"이번 주": (monday, monday + 7 * day), "this week": (monday, monday + 7 * day), "지난주": (monday - 7 * day, monday), "지난 주": (monday - 7 * day, monday), "last week": (monday - 7 * day, monday), "지난달": (last_first, first), "지난 달": (last_first, first), "last month": (last_first, first)}
    return spans.get(s)
