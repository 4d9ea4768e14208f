"""What foreign text may bring along: delimiters and roles in prompts, personal data in messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.columns import once
from quillspark.operators.payloads import kind

#: Brackets that look like angle brackets, and characters that can't be seen.
LOOK_ALIKE, ANGLES = "＜＞❮❯⟨⟩", "<><><>"
INVISIBLE = r"[­᠎​-‏‪-‮⁠-⁤⁦-⁩﻿\x{e0000}-\x{e007f}]"
#: How models' templates mark roles, and what stands there instead.
ROLES = (
    (r"<\|([A-Za-z_]{1,24})\|>", "‹|$1|›"),
    (r"(?i)<(/?(?:system|assistant|user|instruction|instructions|developer|tool|data|document|context|records|prompt|rules?)\s*)>", "‹$1›"),
    (r"(?i)\[(/?)(INST|SYS)\]", "⟦$1$2⟧"),
    (r"(?im)^([ \t]*(?:#{1,6}[ \t]*)?)(system|assistant|human|user|developer|instruction)\s*:", "$1$2 -"),
)
#: Shapes of personal data, in the order in which they go.
PERSONAL = (
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"\b\d{3}[ .]\d{2}[ .]\d{4}\b",
    r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+",
    r"(?i)\b(?:https?|s3|gs|ftp)://\S+",
    r"(?:(?<!\S)[A-Za-z]:\\(?:[^\\\n\r\"'|;,()]{1,80}\\){1,6}[^\s\\\n\r\"'|;,()]{0,80}|(?<!\S)/(?:[^/\n\r\"'|;,()]{1,80}/){1,6}[^\s/\n\r\"'|;,()]{0,80})",
    r"(?i)\b[\p{L}\p{N}_.\-()' ]{1,64}?\.(?:pdf|docx?|xlsx?|csv|txt|md|zip|jsonl?|log|tiff?|png|jpe?g)\b",
    r"(?:(?:\+?\d{1,3}[ .\-]?)?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4})\b",
    r"\b(?i:veteran|patient|claimant|witness|spouse|name)\b([:\s]+)(?:[A-Z][\p{L}\p{N}_'.-]*\s+){0,2}[A-Z][\p{L}\p{N}_'.-]+",
    r"\b\d{7,}\b",
)
#: What a text has in which the pattern of that place in PERSONAL can match: looked for first, as it is found faster.
NEEDED = {2: r"@", 3: r"://", 4: r"[/\\]", 5: r"(?i)\.(?:pdf|docx?|xlsx?|csv|txt|md|zip|jsonl?|log|tiff?|png|jpe?g)\b", 7: r"(?i)veteran|patient|claimant|witness|spouse|name"}
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def _spelt_out(text: Column, pattern: str, to: dict[str, str], between: str = "") -> Column:
    """Every match of a run of one character replaced by as many of what it maps to."""
    swap = lambda r: F.rtrim(F.translate(F.regexp_replace(r, "(.)", "$1" + between), "".join(to), "".join(to.values())))

    def spelt(t: Column) -> Column:
        between_, runs = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.array_join(F.transform(F.arrays_zip(between_.alias("a"), F.transform(runs, swap).alias("b")), lambda z: F.concat(z["a"], F.coalesce(z["b"], F.lit("")))), "")

    return once(text, lambda t: F.when(t.rlike(pattern), spelt(t)).otherwise(t))


def for_prompt(text: Column, most: int | None = None) -> Column:
    """Text that can't close the block of a prompt that it stands in, nor act as a role: line
    ends as LF, look-alike brackets as angle brackets, invisible characters gone, role marks
    defused, runs of two or more angle brackets and those at either end as guillemets, code
    fences spelt out; cut to most characters with a note that says how many are left out."""
    t = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), LOOK_ALIKE, ANGLES)
    t = F.regexp_replace(t, INVISIBLE, "")
    for pattern, to in ROLES:
        t = F.regexp_replace(t, pattern, to)
    t = _spelt_out(t, r"<{2,}|>{2,}", {"<": "«", ">": "»"})
    t = _spelt_out(t, r"`{3,}|~{3,}", {}, " ")
    for bracket, to in (("<", "«"), (">", "»")):
        t = F.regexp_replace(t, rf"\A{bracket}|{bracket}\z", to)
    if most is None:
        return t

    def cut(t: Column) -> Column:
        note = F.concat(F.lit("\n… [truncated "), (F.length(t) - most).cast("string"), F.lit(" chars by prompt sanitizer]"))
        short = F.concat(F.substring(t, F.lit(1), F.greatest(F.lit(0), F.lit(most) - F.length(note))), note)
        return F.when(F.lit(most <= 0), "").when(F.length(t) > most, short).otherwise(t)

    return once(t, cut)


def scrubbed(text: Column, most: int = 300) -> Column:
    """A message on one line without control and invisible characters and without what has the
    shape of personal data, at most most characters."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, ""), INVISIBLE, "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    for k, pattern in enumerate(PERSONAL):
        t = _redacted(t, pattern, NEEDED.get(k))
    return F.substring(t, 1, most)


def _redacted(text: Column, pattern: str, needed: str | None) -> Column:
    if needed is None:
        return F.regexp_replace(text, pattern, "[redacted]")
    return once(text, lambda t: F.when(t.rlike(needed), F.regexp_replace(t, pattern, "[redacted]")).otherwise(t))


#: What a log may hold. Counts, and the words that a field can have.
COUNTS = ("duration_ms", "pages", "files", "record_files", "record_pages", "calls", "chunks", "facts", "attempt", "retries", "tokens_in", "tokens_out", "prompt_tokens", "completion_tokens", "total_tokens", "status_code")
REQUEST = r"^(req_[a-f0-9]{12}|[a-f0-9-]{32,36})\z"
WORDS = {
    "action": ("app", "evaluate", "draft"),
    "status": ("start", "ok", "partial", "error", "timeout", "rejected", "queued", "done"),
    "scoring_status": ("complete", "incomplete", "invalid", "unvalidated"),
    "topic_status": ("complete", "incomplete", "invalid", "unvalidated"),
}


def loggable(record: Column) -> Column:
    """Of a log record (JSON text) what may be kept, as JSON text: counts that are numbers or
    booleans, a request_id of the known form, and fields with one of their words. Nothing of
    what is no object, or no JSON."""

    def kept(v: Column) -> Column:
        def field(name: str, kinds: tuple[str, ...]) -> Column:
            x = F.try_variant_get(v, f"$.{name}", "variant")
            return F.when(kind(x).isin(*kinds), x)

        def word(name: str) -> Column:
            return F.try_variant_get(field(name, ("STRING",)), "$", "string")

        counts = [field(c, ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN")).alias(c) for c in COUNTS]
        words = [F.when(word(w).isin(*some), word(w)).alias(w) for w, some in WORDS.items()]
        return F.to_json(F.struct(*counts, F.when(word("request_id").rlike(REQUEST), word("request_id")).alias("request_id"), *words))

    return once(F.try_parse_json(record), kept)
