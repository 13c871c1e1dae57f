"""Cleaning, identity and scoring functions: Column in, Column out."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags of injected envelopes.
ENVELOPES = (
    "task-notification", "system-reminder", "command-message", "command-name", "command-args", "local-command-caveat",
    "local-command-stdout", "local-command-stderr", "bash-input", "bash-stdout", "bash-stderr", "environment_context",
)
# Openings of user messages that nobody typed.
NOT_TYPED = (
    "[TOOL_RESULT]", "[TOOL:", "[Request interrupted", "<command-", "<local-command-",
    "<task-notification>", "<system-reminder>", "<bash-", "<environment_context>",
)
# Messages without content of their own.
GREETINGS = ("hi", "hey", "hello", "yo", "sup", "thanks", "thx", "ok", "okay", "ty")
SLASH_COMMANDS = ("/clear", "/compact", "/resume", "/help", "/exit", "/quit", "/init", "/cost", "/review")
COMMAND_MARKUP = ("<command-name", "<command-message", "<command-args", "<local-command-")
BARE_MARKERS = ("[THINKING]", "[SYSTEM]", "[TOOL_RESULT]")
INTERRUPTED = "[Request interrupted by user"
TITLE_CAP = 80

_TOOL_RUN = r"(?s)\[TOOL(?:_RESULT)?[:\]].*?(?=\s\[[A-Z]|\z)"
_THINKING_RUN = r"(?s)\[THINKING[:\]].*?(?=\s\[[A-Z]|\n[^ \t]|\z)"
_ENVELOPE_RUN = rf"(?s)<({'|'.join(ENVELOPES)})(?=[> \t\n\r])[^>]*>(?:.*?</\1>|.*\z)"


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_tools(c: Column) -> Column:
    return collapse(F.regexp_replace(c, _TOOL_RUN, ""))


def strip_envelopes(c: Column) -> Column:
    return F.regexp_replace(c, _ENVELOPE_RUN, "")


def strip_thinking(c: Column) -> Column:
    return collapse(F.regexp_replace(c, _THINKING_RUN, ""))


def strip_generated(c: Column) -> Column:
    """What a person or a model wrote: without tool runs and envelopes."""
    return collapse(strip_envelopes(F.regexp_replace(c, _TOOL_RUN, "")))


def display_text(c: Column, tools: bool = False, thinking: bool = True, cap: int = -1) -> Column:
    """Text as shown, on one line: without thinking, which goes first, as its runs may end at a
    line, and without what tools said; cap counts code points, -1 is none."""
    shown = c if thinking else F.regexp_replace(c, _THINKING_RUN, "")
    shown = collapse(shown) if tools else strip_generated(shown)
    return shown if cap < 0 else F.left(shown, F.lit(cap))


def is_low_signal(c: Column) -> Column:
    t = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    low = F.lower(t)
    head = F.regexp_extract(low, r"^(/\S*)", 1)
    return (t == "") | low.isin(*GREETINGS) | head.isin(*SLASH_COMMANDS) | F.substring(t, 1, 1).isin("{", "[", "<")


def is_interruption(c: Column) -> Column:
    return F.ltrim(c).startswith(INTERRUPTED)


def is_bare_marker(c: Column) -> Column:
    t = F.trim(c)
    return t.isin(*BARE_MARKERS) | t.rlike(r"^\[TOOL:[^\]]*\]$")


def is_displayable(c: Column) -> Column:
    clean = strip_generated(c)
    return (clean != "") & ~is_interruption(c) & ~is_bare_marker(clean)


def is_human_turn(role: Column, content: Column) -> Column:
    typed = (role == "user") & (F.length(F.trim(content)) > 2)
    for opening in NOT_TYPED:
        typed = typed & ~content.startswith(opening)
    return typed


def non_empty(*columns: Column) -> Column:
    """The first column that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def mint_uuid(*parts: Column) -> Column:
    return F.left(F.sha1(F.concat_ws(":", *parts)), F.lit(16))


def normalize_uuid(raw: Column, *parts: Column) -> Column:
    return F.when(raw.rlike("^[0-9a-fA-F]{8,}$"), F.lower(raw)).otherwise(mint_uuid(*parts))


def normalize_role(c: Column) -> Column:
    r = F.lower(F.trim(c))
    return F.when(r.isin("user", "human"), "user").when(r.isin("assistant", "model", "ai", "bot", "tool"), "assistant").when(r == "system", "system").otherwise("assistant")


def iso_to_epoch(c: Column) -> Column:
    """Seconds since 1970 of an ISO time; without an offset it is UTC; 0 if it is none."""
    zoned = F.when(c.rlike(r"(Z|[+-]\d\d:?\d\d)$"), c).otherwise(F.concat(c, F.lit("Z")))
    return F.coalesce(F.unix_micros(F.try_to_timestamp(zoned)) / 1e6, F.lit(0.0))


def normalize_epoch(c: Column) -> Column:
    """Seconds from numbers in seconds, milliseconds or microseconds, or from a written time."""
    v = c.try_cast("double")
    number = F.when(v > 1e14, v / 1e6).when(v > 1e11, v / 1e3).otherwise(v)
    return F.coalesce(number, iso_to_epoch(F.regexp_replace(c, "^(\\d{4}-\\d\\d-\\d\\d) ", "$1T")))


def content_hash(c: Column) -> Column:
    return F.left(F.sha1(c), F.lit(16))


def file_fingerprint(content: Column) -> Column:
    """Of a file's bytes: its first and last 4 KB."""
    tail = F.when(F.length(content) > 4096, F.substring(content, -4096, 4096)).otherwise(content)
    return F.left(F.sha1(F.concat(F.substring(content, 1, 4096), F.lit("|").cast("binary"), tail)), F.lit(16))


def project_of(cwd: Column, fallback: Column | None = None) -> Column:
    """Last part of a working directory, null where it has none."""
    name = F.element_at(F.split(F.regexp_replace(cwd, "/+$", ""), "/"), -1)
    usable = F.when(~name.isin("", ".", "~"), name)
    return usable if fallback is None else F.coalesce(usable, fallback)


def read_ref(session_id: Column, uuid: Column) -> Column:
    return F.concat(F.left(session_id, F.lit(8)), F.lit(":"), F.left(uuid, F.lit(8)))


def condense(uuid: Column, role: Column, content: Column, cap: int = 200) -> Column:
    return F.concat(F.left(uuid, F.lit(8)), F.lit(" ["), role, F.lit("] "), F.left(collapse(content), F.lit(cap)))


def coverage(content: Column, terms: Column) -> Column:
    """How many of the terms (lower case) the text contains."""
    low = F.lower(content)
    return F.size(F.filter(F.array_distinct(terms), lambda t: F.contains(low, t)))


def quoted(term: Column) -> Column:
    """A term as a regular expression that matches it alone."""
    return F.regexp_replace(term, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def make_snippet(content: Column, terms: Column, before: int = 90, after: int = 170) -> Column:
    """The surroundings of the earliest term with all terms marked, longest first; null if none occurs."""
    low = F.lower(content)
    places = F.filter(F.transform(terms, lambda t: F.position(t, low)), lambda p: p > 0)
    at = F.array_min(places)
    start = F.greatest(at - before, F.lit(1))
    window = F.substr(content, start, at + after - start)
    ordered = F.array_sort(F.array_distinct(terms), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    marked = F.aggregate(ordered, window, lambda w, t: F.regexp_replace(w, F.concat(F.lit("(?i)("), quoted(t), F.lit(")")), F.lit(">>>$1<<<")))
    return F.when(F.size(places) > 0, collapse(marked))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; a zero norm counts as 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.when(dot(x, x) == 0, 1.0).otherwise(F.sqrt(dot(x, x)))
    return dot(a, b) / (norm(a) * norm(b))


def rrf_term(rank: Column, k: int = 60) -> Column:
    """Reciprocal-rank term of a rank that starts at 1."""
    return F.lit(1.0) / (k + rank)


def segment_hash(segments: Column) -> Column:
    """Of an array of structs (start_uuid, end_uuid, topic, summary): one hash, whatever their order."""
    rows = F.transform(F.array_sort(segments), lambda s: F.concat_ws("\x00", s["start_uuid"], F.coalesce(s["end_uuid"], F.lit("")), s["topic"], s["summary"]))
    return F.sha1(F.array_join(rows, "\x00"))


def _folding() -> tuple[str, str]:
    """Letters with marks and their plain letters, in lower case, from Unicode's decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    pairs = [(a, b) for a, b in pairs if a == a.lower() and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Lower case without diacritics."""
    marked, plain = _folding()
    low = F.lower(c)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, marked, plain)).otherwise(low)


def folder() -> Callable[[str], str]:
    """The same of a Python text."""
    table = str.maketrans(*_folding())
    return lambda text: text.lower() if text.isascii() else text.lower().translate(table)


def n_tokens(c: Column) -> Column:
    """How many word tokens a text has (folding keeps their number)."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+"))


def tokens(c: Column) -> Column:
    """Word tokens of the folded text."""
    return F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
