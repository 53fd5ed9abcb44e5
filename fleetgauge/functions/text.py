"""Text helpers: literals, statement slices, object names, job keys."""

from __future__ import annotations

from collections.abc import Iterable

# Program name prefix of a scheduled job step, the label written
# in front of the job's name, and the length of '0x' and 32 hex digits.
JOB_STEP_PREFIX = "SQLAgent - TSQL JobStep (Job "
JOB_LABEL = "Job - "
JOB_KEY_LENGTH = 34

# Last part of a dotted name: bracketed (']]' is an escaped ']') or bare.
_LAST_PART = r"(?:\[((?:[^\]]|\]\])*)\]|([^.\[\]]+))$"


def literal(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(column: str, values: Iterable[str | int]) -> str:
    """True where the column is one of the values; never for an empty list."""
    listed = ", ".join(literal(v) if isinstance(v, str) else str(int(v)) for v in values)
    return f"({column} IN ({listed}))" if listed else f"({column} IS NOT NULL AND false)"


def contains_all(text: str, terms: Iterable[str]) -> str:
    """True where the text holds every term, in any case."""
    return " AND ".join(f"contains(lower({text}), lower({literal(t)}))" for t in terms) or "true"


def substring_clipped(text: str, start: str, length: str) -> str:
    """Substring in which positions before the first character use up length.

    Spark treats start 0 as 1 and a negative start as counted from the end.
    """
    return (
        f"CASE WHEN {start} < 1 THEN substring({text}, 1, CAST(greatest({start} + {length} - 1, 0) AS INT))"
        f" ELSE substring({text}, CAST({start} AS INT), CAST(greatest({length}, 0) AS INT)) END"
    )


def utf16_length(text: str) -> str:
    """Length in UTF-16 units, as servers count: characters beyond the basic plane take two."""
    return f"(octet_length(encode({text}, 'UTF-16LE')) div 2)"


def utf16_substring(text: str, start: str, length: str) -> str:
    """:func:`substring_clipped` over UTF-16 units.

    A slice that cuts a character of two units in half has U+FFFD in its place,
    since half a character cannot be stored.  Texts without such characters,
    that is nearly all, are cut by characters.
    """
    # Offsets and bytes of one text, bound once.  The high byte of a unit tells the halves apart.
    bound = (
        f"struct(CAST(greatest({start}, 1) - 1 AS INT) AS f, CAST(greatest({start} + {length} - 1, 0) AS INT) AS t,"
        f" encode({text}, 'UTF-16LE') AS b)"
    )
    cut = f"transform(array({bound}), s -> substring(s.b, 2 * s.f + 1, 2 * greatest(s.t - s.f, 0)))"
    halves = (
        f"transform({cut}, b -> struct(b, substring(b, 2, 1) BETWEEN X'DC' AND X'DF' AS low,"
        " octet_length(b) > 0 AND substring(b, -1, 1) BETWEEN X'D8' AND X'DB' AS high))"
    )
    whole = "substring(s.b, IF(s.low, 3, 1), octet_length(s.b) - IF(s.low, 2, 0) - IF(s.high, 2, 0))"
    half = "decode(X'FDFF', 'UTF-16LE')"
    joined = f"concat(IF(s.low, {half}, ''), decode({whole}, 'UTF-16LE'), IF(s.high, {half}, ''))"
    return (
        f"CASE WHEN {utf16_length(text)} = char_length({text}) THEN {substring_clipped(text, start, length)}"
        f" WHEN {start} IS NOT NULL THEN get(transform({halves}, s -> {joined}), 0) END"
    )


def statement_slice(text: str, start_offset: str, end_offset: str, mode: str) -> str:
    """The running statement of a batch, from its byte offsets (2 per UTF-16 unit).

    An end offset of -1 means "to the end of the text".  ``exact`` is the
    documented formula.  ``legacy`` leaves out both +1 terms, so it begins one
    unit early and loses the last one, and ignores trailing blanks when it
    measures the text; some reports have always been read that way.
    """
    if mode not in ("exact", "legacy"):
        raise ValueError(f"unknown mode: {mode}")
    measured, extra = (text, 1) if mode == "exact" else (f"rtrim({text})", 0)
    end = f"(CASE WHEN {end_offset} = -1 THEN 2 * {utf16_length(measured)} ELSE {end_offset} END)"
    return utf16_substring(
        text, f"({start_offset} div 2 + {extra})", f"(({end} - {start_offset}) div 2 + {extra})"
    )


def last_name_part(name: str) -> str:
    """Last part of a dotted, possibly bracketed name; NULL when there is none."""
    bracketed = f"replace(regexp_extract({name}, {literal(_LAST_PART)}, 1), ']]', ']')"
    return f"nullif(concat({bracketed}, regexp_extract({name}, {literal(_LAST_PART)}, 2)), '')"


def job_key_of_program(program: str) -> str:
    """Job key carried by a program name, NULL when it holds none.

    The prefix is compared by the column's collation; the key is plain text.
    """
    stripped = f"replace({program}, {literal(JOB_STEP_PREFIX)}, '')"
    key = f"lower(substring(CAST({stripped} AS STRING), 1, {JOB_KEY_LENGTH}))"
    return f"CASE WHEN {key} RLIKE '^0x[0-9a-f]{{32}}$' THEN {key} END"


def job_key_of_uuid(uuid: str) -> str:
    """Hexadecimal text of a job UUID as stored bytes.

    The first three groups of the UUID are little-endian, the rest is not.
    """
    digits = f"lower(replace({uuid}, '-', ''))"
    first_groups = ", ".join(f"substring({digits}, {2 * byte + 1}, 2)" for byte in (3, 2, 1, 0, 5, 4, 7, 6))
    return f"concat('0x', {first_groups}, substring({digits}, 17, 16))"
