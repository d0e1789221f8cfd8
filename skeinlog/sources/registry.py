"""Registry of session formats: a reader and, where there is one, an encoder by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from skeinlog.sources import sessions


@dataclass(frozen=True)
class Format:
    """``read`` takes the format's rows to canonical events; ``encode`` goes back; ``needs`` are its input columns."""

    read: Callable[[DataFrame], DataFrame]
    encode: Callable[[DataFrame], DataFrame] | None = None
    needs: tuple[str, ...] = ("session_id", "line_no", "line")
    abilities: frozenset = field(default_factory=lambda: frozenset(["import"]))


_BOTH = frozenset(["import", "export"])
_PARTS = ("session_id", "message_id", "id", "role", "message_time", "time_created", "data")
FORMATS: dict[str, Format] = {
    "typed": Format(sessions.typed_sessions, sessions.encode_typed, abilities=_BOTH),
    "typed-portable": Format(sessions.typed_sessions, sessions.encode_typed_portable, abilities=_BOTH),
    "message": Format(sessions.message_sessions, sessions.encode_messages, abilities=_BOTH),
    "rollout": Format(sessions.rollout_sessions, sessions.encode_rollout, abilities=_BOTH),
    "rollout-portable": Format(sessions.rollout_sessions, sessions.encode_rollout_portable, abilities=_BOTH),
    "table": Format(sessions.table_sessions, sessions.encode_table, needs=tuple(sessions.CORE_MESSAGE), abilities=_BOTH),
    "parts": Format(sessions.part_sessions, needs=_PARTS),
    "part-export": Format(sessions.part_sessions, sessions.encode_parts, needs=_PARTS, abilities=_BOTH),
}


def register(name: str, made: Format) -> None:
    """Add a format; a name can't be taken twice."""
    if name in FORMATS:
        raise ValueError(f"format {name!r} exists")
    FORMATS[name] = made


def read(name: str, rows: DataFrame) -> DataFrame:
    """Canonical events of rows in a registered format."""
    made = FORMATS[name]
    if lost := [c for c in made.needs if c not in rows.columns]:
        raise ValueError(f"{name}: missing columns {lost}")
    return made.read(rows)


def convert(source: str, target: str, rows: DataFrame) -> DataFrame:
    """Rows of one format as lines of another."""
    encode = FORMATS[target].encode
    if encode is None:
        raise ValueError(f"{target} can't be written")
    return encode(read(source, rows))
