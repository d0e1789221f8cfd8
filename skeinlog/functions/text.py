"""Column functions over turn texts, names, tags and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinlog.functions import constants as C


def trim_space(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def compact_space(text: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(text, F.lit(p)) for p in prefixes], F.lit(False))


def _quoted(texts: list[str]) -> str:
    return "(?:" + "|".join(r"\Q" + t + r"\E" for t in texts) + ")"


#: One pattern each: these functions name their argument once, so that nested calls stay small plans.
_HIDDEN = r"(?U)^\s*" + _quoted(C.INJECTED_PREFIXES + C.LOCAL_COMMAND_PREFIXES)
_SCHEDULED = C.SCHEDULED_PATTERN + r"(?U)\s*"
_FIRST, _SECOND = (r"\Q" + m + r"\E" for m in C.ATTACHMENT_MARKERS)
_ATTACHMENTS = rf"(?s)^\Q{C.ATTACHMENT_OPENING}\E(?:(?=.*?{_FIRST}).*?{_FIRST}|.*?{_SECOND})(?U)\s*"


def is_hidden_context(text: Column) -> Column:
    """Injected context or local-command telemetry rather than a prompt."""
    return F.rlike(text, F.lit(_HIDDEN))


def strip_scheduled(text: Column) -> Column:
    """A trimmed text without the preamble of a scheduled task."""
    return F.regexp_replace(text, _SCHEDULED, "")


def strip_attachments(text: Column) -> Column:
    """A trimmed text without the attachment inventory before its request."""
    return F.regexp_replace(text, _ATTACHMENTS, "")


def after_first(text: Column, markers: list[str], otherwise: Column) -> Column:
    """What follows the first of ``markers`` that the text holds."""
    out = otherwise
    for marker in reversed(markers):
        at = F.locate(marker, text)
        out = F.when(at > 0, F.substr(text, at + len(marker))).otherwise(out)
    return out


def normalized_turn(role: Column, text: Column) -> Column:
    """The stable visible text of a turn; null if the row takes no part in comparisons."""
    base = trim_space(F.coalesce(text, F.lit("")))
    user = strip_attachments(strip_scheduled(base))
    made = F.when(role == "user", user).otherwise(base)
    hidden = (role == "user") & is_hidden_context(made)
    return F.when((made != "") & ~hidden, made)


def join_text_blocks(content: Column) -> Column:
    """Text blocks of a content array, joined by a blank line."""
    return F.array_join(F.transform(F.filter(content, lambda b: (b["type"] == "text") & (b["text"] != "")), lambda b: b["text"]), "\n\n")


def summary_text(text: Column) -> Column:
    """A turn for titles: without scaffolding and media, white space compacted."""
    return compact_space(F.regexp_replace(after_first(text, C.SUMMARY_MARKERS, text), C.MEDIA_PATTERN, " "))


def has_payload(payload: Column) -> Column:
    return payload.isNotNull() & ~F.trim(payload).isin("", "null")


#: The e-mail pattern from the start of a run of its first characters (or where the last match ended), without
#: giving back: it finds the same addresses, but in a time that grows with the length of a run and not its square.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\-]))" + C.EMAIL_PATTERN.replace("+@", "++@", 1)
#: What a text must hold for a secret pattern to be tried.
_SIGNS = ["ghp_", "gho_", "xox", "sk-", "AKIA", None]


def _stages(home: str | None) -> list[tuple[str, str, str, str | None]]:
    """(kind, pattern, mark, sign) of each stage."""
    first = [("path", r"\Q" + home + r"\E", "~", home)] if home else []
    return [*first, ("email", _EMAIL, C.EMAIL_MARK, "@"), *[("secret", p, C.SECRET_MARK, s) for p, s in zip(C.SECRET_PATTERNS, _SIGNS, strict=True)]]


def _replaced(text: Column, pattern: str, mark: str, sign: str | None) -> Column:
    made = F.regexp_replace(text, pattern, F.lit(mark))
    return made if sign is None else F.when(F.contains(text, F.lit(sign)), made).otherwise(text)


def _stage(pattern: str, mark: str, sign: str | None):
    return lambda text: _replaced(text, pattern, mark, sign)


def _counting(kind: str, pattern: str, mark: str, sign: str | None):
    def step(x):
        found = F.regexp_count(x["t"], F.lit(pattern))
        found = found if sign is None else F.when(F.contains(x["t"], F.lit(sign)), found).otherwise(0)
        return F.struct(_replaced(x["t"], pattern, mark, sign).alias("t"), *[(x[k] + (found if k == kind else 0)).alias(k) for k in ("path", "email", "secret")])

    return step


def scrubbed(text: Column, home: str | None = None) -> Column:
    """Home path, e-mail addresses, then secrets replaced, in that order.

    The stages are elements of a fold, so the text is named once however many
    stages there are; a stage is only run on texts that hold its sign.
    """
    out = F.array(text)
    for _, pattern, mark, sign in _stages(home):
        out = F.transform(out, _stage(pattern, mark, sign))
    return F.get(out, F.lit(0))


def scrub_counts(text: Column, home: str | None = None) -> dict[str, Column]:
    """How often each stage of ``scrubbed`` finds something in what the stages before it left."""
    state = F.array(F.struct(text.alias("t"), *[F.lit(0).alias(k) for k in ("path", "email", "secret")]))
    for stage in _stages(home):
        state = F.transform(state, _counting(*stage))
    last = F.get(state, F.lit(0))
    return {k: last[k] for k in ("path", "email", "secret")}


def scrub_summary(counts: dict[str, Column]) -> Column:
    """``path:1, email:2`` in fixed order; ``no matches`` if there are none."""
    parts = F.array_compact(F.array(*[F.when(counts[k] > 0, F.concat(F.lit(f"{k}:"), counts[k].cast("string"))) for k in ("path", "email", "secret")]))
    return F.when(F.size(parts) == 0, F.lit("no matches")).otherwise(F.array_join(parts, ", "))


def normalized_branch(name: Column) -> Column:
    """Branch name in lower case with single hyphens, at most 64 characters; null if nothing valid is left."""
    kept = F.regexp_replace(F.lower(name), r"[^a-z0-9\-_ /.]", "")
    joined = F.regexp_replace(F.regexp_replace(kept, r"[\-_ /.]+", "-"), "^-|-$", "")
    made = F.regexp_replace(F.substring(joined, 1, 64), "-+$", "")
    return F.when(name == C.MAIN, F.lit(C.MAIN)).when(made != "", made)


def normalized_tag(tag: Column) -> Column:
    """Tag in lower case without outer space; null if empty, over 64 characters or with another character."""
    made = F.lower(trim_space(tag))
    return F.when((tag != "") & (F.char_length(made) <= 64) & F.rlike(made, F.lit(r"^[a-z0-9:\-_./]*$")), made)


#: System-owned tag namespaces beside the caller's own.
RESERVED_TAGS = ["fork-of:", "device:", "conflict:"]


def is_reserved_tag(tag: Column, own: str = "system:") -> Column:
    return starts_with_any(tag, [own, *RESERVED_TAGS])


def glob_regex(pattern: str) -> str:
    """Regex of a path glob whose ``*`` and ``?`` never cross a slash; a bad pattern matches itself only."""
    import re

    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return re.escape(pattern)
            out.append("[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def glob_match(pattern: str, target: Column) -> Column:
    target = F.coalesce(target, F.lit(""))
    if not set(pattern) & set("*?[]"):
        return target == pattern
    return (target == pattern) | F.rlike(target, F.lit(f"^(?:{glob_regex(pattern)})$"))


def remote_url(url: Column) -> Column:
    """A version-control remote as host/path: no scheme, user, ``.git`` or closing slash; scp form becomes a path."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    no_user = F.regexp_replace(bare, r"^[^@/]*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(no_user, r"^([^:/]+):(?!\d)", "$1/"), r"/+$", ""), r"\.git$", ""))


def path_id(path: Column, digits: int = 16) -> Column:
    """Project id of a path without a remote: its last part and a piece of its SHA-256."""
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    safe = F.regexp_replace(F.regexp_replace(F.lower(last), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.concat(F.when(safe == "", F.lit("project")).otherwise(safe), F.lit("-"), F.substring(F.sha2(path, 256), 1, digits))


def display_path(path: Column) -> Column:
    """Only the last two parts of a path, for display."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda p: p != "")
    return F.when(F.size(parts) <= 2, path).otherwise(F.concat(F.lit(".../"), F.array_join(F.slice(parts, -2, 2), "/")))


def escaped_label(value: Column) -> Column:
    """A metric label's value: backslash, quote and newline escaped."""
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def human_delta(seconds: Column) -> Column:
    unit = F.when(seconds < 60, F.concat(F.floor(seconds).cast("string"), F.lit("s ago")))
    unit = unit.when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
    unit = unit.when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
    return F.when(seconds.isNull(), F.lit("—")).otherwise(unit.otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago"))))


def backoff_seconds(attempts: Column) -> Column:
    """Delay before the next retry: a quarter second doubled each time, a quarter hour at most."""
    return F.least(F.lit(0.25) * F.pow(F.lit(2.0), F.least(attempts, F.lit(32))), F.lit(900.0))


def backoff_exhausted(attempts: Column, first: Column, now: Column) -> Column:
    return (attempts >= 64) & first.isNotNull() & ((F.unix_timestamp(now) - F.unix_timestamp(first)) >= 86400)


def event_key(ts_nanos: Column, role: Column, kind: Column, content: Column) -> Column:
    """Identity of a conversation event across devices: its time and a hash of role, type and content."""
    none = F.lit("")
    body = F.concat(F.coalesce(role, none), F.lit("\x1f"), F.coalesce(kind, none), F.lit("\x1f"), F.coalesce(content, none))
    return F.concat(ts_nanos.cast("string"), F.lit("\x1f"), F.sha2(body, 256))


def deterministic_uuid(name: Column) -> Column:
    """A UUID-shaped id from SHA-256, version and variant bits set."""
    h = F.sha2(name, 256)
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def is_uuid7(value: Column) -> Column:
    return F.rlike(F.coalesce(value, F.lit("")), F.lit("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"))
