"""Chat formatting with a grammar that reads back exactly what was written.

    conversation := turn*
    turn         := "[SYS]" text "[/SYS]" | "[INST]" text "[/INST]" | "<s>" text "</s>"
                  | "[TURN]" role "[:]" text "[/TURN]"          (any other role)

for system, user and assistant.  A control string inside a text, with any
number of backslashes after its first character, is escaped by one more
backslash there; reading takes one away.  The first character of a control
string is found nowhere else in one, so neither a control string nor an
escaped one can straddle the border of a text, and a conversation reads back
exactly if each of its turns does.

Hence turns are checked one by one, before they are brought together: a turn
is written as it is, read back, and escaped only where the reading differs
from the source or a bare control string is left in it; the check is repeated on what was escaped and on every whole
conversation, and a difference stops the job.

Defined results: null texts and roles are empty, turns are ordered by
``(turn, role, text)`` with nulls first, rows with a null ``conv_id`` form one
conversation, and an empty table gives an empty one.  A conversation becomes
one string, so its turns have to fit into one row; all work on texts is done
before that, turn by turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The template.
MARKERS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN]", "[:]", "[/TURN]")
TRAINED = "assistant"

_BRACKETED = r"/?SYS\]|/?INST\]|/?TURN\]|:\]"
_ANGLED = r"/?s>"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# A control string with any number of backslashes, in two groups around the place of the next one.
_ESCAPE = _sql(rf"(\[)(\\*(?:{_BRACKETED}))|(<)(\\*(?:{_ANGLED}))")
_BARE = _sql(rf"\[(?:{_BRACKETED})|<(?:{_ANGLED})")
_UNESCAPE = _sql(rf"(\[)\\(\\*(?:{_BRACKETED}))|(<)\\(\\*(?:{_ANGLED}))")
# One turn of the grammar.
_TURN = _sql(
    r"(?s)\[SYS\].*?\[/SYS\]|\[INST\].*?\[/INST\]|<s>.*?</s>|\[TURN\].*?\[:\].*?\[/TURN\]"
)


def escaped(text: str) -> str:
    return f"regexp_replace({text}, {_ESCAPE}, {_sql('$1$3')} || {_sql(chr(92) * 2)} || {_sql('$2$4')})"


def unescaped(text: str) -> str:
    return f"regexp_replace({text}, {_UNESCAPE}, '$1$3$2$4')"


def written(role: str, text: str) -> str:
    """SQL of a turn in the template."""
    cases = " ".join(f"WHEN '{r}' THEN concat('{a}', {text}, '{b}')" for r, (a, b) in MARKERS.items())
    first, middle, last = OTHER
    return f"CASE {role} {cases} ELSE concat('{first}', {role}, '{middle}', {text}, '{last}') END"


def read(formatted: str) -> str:
    """SQL of the turns ``struct(role, text, raw)`` in a string, in order.

    Text outside a turn is not in the result; compare lengths for that.
    """

    def body(turn: str, start: str, end: str) -> str:
        return f"substring({turn}, {len(start) + 1}, char_length({turn}) - {len(start) + len(end)})"

    def parsed(role: str, raw: str) -> str:
        return f"named_struct('role', {role}, 'text', {unescaped(raw)}, 'raw', {raw})"

    cases = " ".join(
        f"WHEN startswith(t, '{a}') THEN {parsed(repr(r), body('t', a, b))}" for r, (a, b) in MARKERS.items()
    )
    first, middle, last = OTHER
    rest = body("t", first, last)
    cut = f"instr({rest}, '{middle}')"
    role = unescaped(f"substring({rest}, 1, {cut} - 1)")
    other = parsed(role, f"substring({rest}, {cut} + {len(middle)})")
    return f"transform(regexp_extract_all({formatted}, {_TURN}, 0), t -> CASE {cases} ELSE {other} END)"


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``turns``, ``formatted`` and ``loss_spans``.

    ``turns`` are the source's ``struct(role, text)``.  ``loss_spans`` are
    ``struct(start, length)`` in code points of ``formatted``: the texts of
    the assistant without their markers.
    """
    rows = turns.selectExpr(
        "CAST(conv_id AS BIGINT) AS conv_id", "CAST(turn AS BIGINT) AS turn",
        "coalesce(role, '') AS role", "coalesce(text, '') AS text",
    )
    # One turn, the same as in the source, and no control string in it that a reader could take for a marker.
    same = (
        "size({0}) = 1 AND get({0}, 0).role = role AND get({0}, 0).text = text"
        f" AND NOT get({{0}}, 0).raw RLIKE {_BARE}"
    )
    plain = f"{same.format(read(written('role', 'text')))}"
    rows = rows.selectExpr("*", f"{plain} AS plain").selectExpr(
        "conv_id", "turn", "role", "text",
        f"IF(plain, role, {escaped('role')}) AS role_out",
        f"IF(plain, text, {escaped('text')}) AS text_out",
        "plain",
    )
    # Known roles are their markers, not text.
    known = ", ".join(f"'{r}'" for r in MARKERS)
    rows = rows.selectExpr("*", f"{written(f'IF(role IN ({known}), role, role_out)', 'text_out')} AS piece")
    rows = rows.selectExpr(
        "*",
        f"IF(plain OR ({same.format(read('piece'))}), char_length(piece), raise_error('a turn does not read back'))"
        " AS piece_length",
    )
    # Where a piece starts is a running sum, so spans cost no search in the whole.
    order = "PARTITION BY conv_id ORDER BY turn, role, text"
    before = f"sum(piece_length) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    rows = rows.selectExpr("*", f"CAST(coalesce({before}, 0) AS INT) AS piece_start", f"row_number() OVER ({order}) AS place")
    opening = len(MARKERS[TRAINED][0])
    turn = f"struct(place, role, text, piece, piece_start + {opening + 1} AS start, char_length(text_out) AS length)"
    chats = rows.groupBy("conv_id").agg(F.expr(f"array_sort(collect_list({turn}))").alias("all_turns"))
    trained = f"transform(filter(all_turns, t -> t.role = '{TRAINED}'), t -> struct(t.start AS start, t.length AS length))"
    chats = chats.selectExpr(
        "conv_id",
        "transform(all_turns, t -> struct(t.role AS role, t.text AS text)) AS turns",
        "concat_ws('', transform(all_turns, t -> t.piece)) AS formatted",
        f"{trained} AS loss_spans",
    )
    whole = f"transform({read('formatted')}, t -> struct(t.role AS role, t.text AS text)) = turns"
    return chats.selectExpr(
        "conv_id", "turns", f"IF({whole}, formatted, raise_error('a conversation does not read back')) AS formatted",
        "loss_spans",
    )


def read_back(chats: DataFrame) -> DataFrame:
    """What a reader of ``formatted`` and ``loss_spans`` gets, as counts and digests."""
    loss = "concat_ws('', transform(loss_spans, s -> {0}))".format(unescaped("substring(formatted, s.start, s.length)"))
    turns = "concat_ws('', transform(found, t -> concat(t.role, '\\n', t.text, '\\n')))"
    return (
        chats.selectExpr("conv_id", "formatted", f"{read('formatted')} AS found", f"{loss} AS loss")
        .selectExpr(
            "conv_id",
            "CAST(size(found) AS BIGINT) AS n_turns",
            f"sha2({turns}, 256) AS turns_sha256",
            "CAST(char_length(loss) AS BIGINT) AS loss_chars",
            "sha2(loss, 256) AS loss_sha256",
            "CAST(char_length(formatted) AS BIGINT) AS formatted_chars",
        )
    )
