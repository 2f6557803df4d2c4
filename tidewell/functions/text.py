"""Text rules of memory facts as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that the rules know.
CHATTER_EXACT = (
    "assistant", "the assistant", "ai assistant", "system", "tool", "tool_call", "tool-call", "tool_output", "tool-output",
    "tool result", "tool_result", "function_call", "function-call", "function output", "function_output",
)
CHATTER_WITH_ASSISTANT = ("unable", "cannot", "can't", "refus", "no assistance")
CHATTER_PHRASES = ("unable to provide assistance", "i cannot", "i can't", "as an ai", "tool call", "tool output", "system prompt")
BRANCH_PREFIXES = ("refs/heads/", "refs/remotes/", "origin/", "feature/", "fix/", "bugfix/", "release/")
URL_PREFIXES = ("http://", "https://", "file://", "mcp://")
PATH_PREFIXES = ("/", "./", "../", ".\\", "..\\")
VAGUE_PREDICATES = ("none", "null", "unknown", "n_a", "na", "thing", "stuff")
WEAK_LITERAL_PREDICATES = ("has", "has_value", "has_feature", "has_property", "mentions", "references", "related_to", "is")
RUNTIME_ROLES = ("assistant", "ai_assistant", "chat_assistant", "system", "model", "llm")
RUNTIME_PREDICATES = (
    "can_assist", "can_help", "cannot_assist", "unable_to_assist", "has_access", "has_direct_access", "can_access", "cannot_access",
    "can_run_commands", "can_execute_commands", "can_use_tools", "tool_access", "model", "provider", "based_on", "is_based_on",
)
#: Phrases of abstractions that say nothing.
LOW_SIGNAL = (
    "assistant was unable to provide assistance", "unable to provide assistance", "cannot provide assistance", "can't provide assistance",
    "could not provide assistance", "no assistance was provided",
)
REFUSALS = ("cannot", "cant", "unable", "no_access", "sorry", "refusal")


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests)


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    return any_of([text.startswith(p) for p in prefixes])


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return any_of([F.contains(text, F.lit(p)) for p in parts])


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def clean_label(raw: Column) -> Column:
    """Without surrounding space, quotes and brackets, nor an `ent:` in front."""
    bare = F.regexp_replace(F.trim(raw), "^[\"'`\\[\\]()]+|[\"'`\\[\\]()]+$", "")
    return F.trim(F.regexp_replace(bare, "^ent:", ""))


def _joined(text: Column, dropped: str, runs: str, sep: str) -> Column:
    """Lower ASCII letters and digits of text, runs of separators as one sep, none at the ends."""
    kept = F.regexp_replace(text, dropped, "")
    return F.lower(F.regexp_replace(F.regexp_replace(kept, runs, sep), f"^{sep}+|{sep}+$", ""))


def canonical_entity_id(raw: Column) -> Column:
    return _joined(clean_label(raw), r"[^A-Za-z0-9\s_\-./\\]", r"[\s_\-./\\]+", "-")


def normalize_predicate(raw: Column) -> Column:
    return _joined(F.trim(raw), r"[^A-Za-z0-9\s\-_:/\\]", r"[\s\-_:/\\]+", "_")


def alias_key(label: Column) -> Column:
    """Lower ASCII letters and digits only; null if none."""
    key = F.lower(F.regexp_replace(label, "[^A-Za-z0-9]", ""))
    return F.when(key != "", key)


def useful_predicate(predicate: Column) -> Column:
    return F.char_length(predicate).between(2, 64) & ~predicate.isin(*VAGUE_PREDICATES)


def path_or_url(value: Column) -> Column:
    v, lower = F.trim(value), F.lower(F.trim(value))
    drive = F.substring(v, 2, 2) == ":\\"
    source = F.contains(v, F.lit("\\")) & contains_any(v, (":", ".rs", ".ts"))
    return starts_with_any(lower, URL_PREFIXES) | starts_with_any(v, PATH_PREFIXES) | drive | source


def commit_hash(value: Column) -> Column:
    return F.lower(F.trim(value)).rlike("^(commit[_-])?[0-9a-f]{7,64}$")


def branch_ref(value: Column) -> Column:
    return starts_with_any(F.lower(F.trim(value)), BRANCH_PREFIXES)


def metadata_value(value: Column) -> Column:
    return path_or_url(value) | commit_hash(value) | branch_ref(value)


def audit_path_or_url(value: Column) -> Column:
    """The looser rule of the quality audit: any slash at all."""
    return F.contains(value, F.lit("/")) | F.contains(value, F.lit("\\"))


def audit_commit(value: Column) -> Column:
    return F.lower(value).rlike("^(commit[_-])?[0-9a-f]{6,40}$")


def chatter(value: Column) -> Column:
    lower = F.lower(value)
    return lower.isin(*CHATTER_EXACT) | (F.contains(lower, F.lit("assistant")) & contains_any(lower, CHATTER_WITH_ASSISTANT)) | contains_any(lower, CHATTER_PHRASES)


def underscore_blob(value: Column) -> Column:
    return (F.char_length(value) >= 72) & (count_of(value, "_") >= 5) & (count_of(value, r"\s") <= 2)


def machine_identifier(value: Column) -> Column:
    v = F.trim(value)
    separators = count_of(v, r"[_\-.]")
    return v.rlike(r"^[a-z0-9_.\-]+$") & (((F.char_length(v) >= 24) & (separators >= 1)) | (separators >= 3) | (count_of(v, "[0-9]") >= 6))


def machine_literal(value: Column) -> Column:
    v = F.trim(value)
    return ~v.rlike(r"\s") & (F.char_length(v) >= 32) & (count_of(v, r"[_\-.:/]") >= 2) & (count_of(v, "[A-Za-z0-9]") >= 12)


def useful_literal(value: Column) -> Column:
    return F.char_length(value).between(1, 240) & ~underscore_blob(value)


def low_signal(content: Column) -> Column:
    """Abstractions that read like a refusal; null counts as none."""
    return F.coalesce(contains_any(F.lower(content), LOW_SIGNAL), F.lit(False))


def compact_identifier(text: Column, most: int = 120) -> Column:
    """Lower ASCII letters and digits, with one underscore for each run of anything else; none at the ends, cut at most characters."""
    made = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    return F.regexp_replace(F.substring(F.regexp_replace(made, "^_", ""), 1, most), "_$", "")


def extraction_reason(subject: Column, predicate: Column, obj: Column, kind: Column) -> Column:
    """Why an extracted fact is dropped at once, or null: an empty part, or a runtime role's talk about itself."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    s, p, o = (compact_identifier(x) for x in (subject, predicate, obj))
    role = s.isin(*RUNTIME_ROLES)
    return (
        F.when(blank(obj), "empty object_id")
        .when(blank(subject), "empty subject_id")
        .when(blank(predicate), "empty predicate")
        .when(role & p.isin(*RUNTIME_PREDICATES), "runtime metadata")
        .when(role & (kind == "literal") & (o.isin("true", "false") | contains_any(o, REFUSALS)), "refusal or capability literal")
    )


def millis_of_rfc3339(text: Column) -> Column:
    """Milliseconds since 1970 of an RFC 3339 time with its offset; null if it is none."""
    form = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?([Zz]|[+-]\d{2}:\d{2})$"
    moment = F.try_to_timestamp(F.regexp_replace(F.upper(text), "T", " "))
    return F.when(text.rlike(form), F.floor(F.unix_micros(moment) / 1000).cast("long"))


def rfc3339_of_millis(ms: Column) -> Column:
    """An RFC 3339 time in UTC, to the millisecond."""
    day, rest = F.floor(ms / 86_400_000).cast("int"), F.pmod(ms, F.lit(86_400_000))
    clock = F.format_string("%02d:%02d:%02d.%03dZ", F.floor(rest / 3_600_000).cast("int"), F.floor(rest / 60_000).cast("int") % 60, F.floor(rest / 1000).cast("int") % 60, (rest % 1000).cast("int"))
    return F.concat(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd"), F.lit("T"), clock)


def seconds_of_duration(text: Column) -> Column:
    """Seconds of a duration such as 90s, 15m, 2h or 7d; null if it is none."""
    parts = F.regexp_extract(text, r"^(\d{1,12})([smhd])$", 1)
    unit = F.regexp_extract(text, r"^(\d{1,12})([smhd])$", 2)
    return F.when(parts != "", parts.try_cast("long") * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).otherwise(86_400))


def valid_salience(value: Column) -> Column:
    """Whether a salience may be stored: null, or finite within 0 and 1."""
    return value.isNull() | F.coalesce(~F.isnan(value) & value.between(0.0, 1.0), F.lit(False))


def checked_salience(value: Column) -> Column:
    """The salience; a value that may not be stored is an error of the query."""
    return F.when(valid_salience(value), value).otherwise(F.raise_error(F.concat(F.lit("salience must be in [0.0, 1.0]; got "), value.cast("string"))).cast("double"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4).cast("long")


def chunk_estimate(size: Column, target: int) -> Column:
    return F.ceil(size / (max(target, 1) * 4)).cast("long")


def ellipsis(text: Column, most: int, mark: str = "…", within: bool = True) -> Column:
    """text, or its start and a mark; within: the mark counts towards the length."""
    room = most - len(mark) if within else most
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, room), F.lit(mark))).otherwise(text)


def first_line(text: Column, most: int = 80) -> Column:
    return ellipsis(F.trim(F.substring_index(text, "\n", 1)), most)


def clean_title(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(flat == "", F.lit("Untitled")).otherwise(flat)


def slug(text: Column) -> Column:
    made = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-", ""), 1, 48), "-$", "")
    return F.when(made == "", F.lit("import")).otherwise(made)


def html_unescape(text: Column) -> Column:
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def role_name(role: Column) -> Column:
    return F.when(role == "human", F.lit("user")).when(role.isin("assistant", "system", "tool"), role).otherwise(clean_title(role))


def _accents() -> tuple[str, str]:
    """Latin letters with one diacritic or more, in lower case, and what they are without."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if chr(c) == chr(c).lower()]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BARE = _accents()


def folded(text: Column) -> Column:
    """Lower case, Latin letters without diacritics. Only texts that aren't ASCII are translated, which takes an object a letter."""
    lower = F.lower(text)
    return F.when(F.octet_length(lower) == F.char_length(lower), lower).otherwise(F.translate(lower, _ACCENTED, _BARE))


def query_terms(query: str, most: int = 8) -> list[str]:
    """Terms of a query: split at what is no letter or digit, distinct as written, the first `most`, then lower case."""
    seen: list[str] = []
    for term in "".join(c if c.isalnum() else " " for c in query).split():
        if term not in seen:
            seen.append(term)
        if len(seen) == most:
            break
    return [t.lower().translate(str.maketrans(_ACCENTED, _BARE)) for t in seen]


def words(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.array_remove(F.split(folded(text), r"[^\p{L}\p{N}]+"), "")


def day_bucket(ms: Column) -> Column:
    return F.floor(ms / 86_400_000).cast("long")


def luhn_valid(digits: Column) -> Column:
    """Whether a digit string's Luhn sum ends in 0."""
    doubled = F.transform(F.reverse(F.transform(F.split(digits, ""), lambda c: c.cast("int"))), lambda d, j: F.when(j % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0
