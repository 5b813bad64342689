"""Chat formatting: a finite-state machine over roles, a declarative template, and text segments with loss flags.

The template's marks begin with ``#`` or ``<``. Inside texts and role names those marks and the
backslash itself get a backslash in front, so a text that looks like a mark stays a text and the
output can be read back exactly.

Conversations are dealt out by id, sorted by turn, and streamed: a task holds one turn at a time,
however long the conversation. A digest over all turns is sequential by nature, so one conversation
is one task's work, but never one value in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "open": "### ",
    "after_role": ": ",
    "close": "</turn>\n",
    "roles": {"system": "System", "user": "User", "assistant": "Assistant"},
    "loss": ["assistant"],
    #: state -> roles that may follow; a conversation ends well in a state named in "final".
    "next": {"": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "final": ["assistant"],
}
ESCAPED = re.compile(r"\\|#|</turn>")
UNESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return UNESCAPED.sub(r"\1", text)


def _role_mark(role: str, template: dict) -> str:
    """Known roles by their name in the template; any other after a ``?``, with line ends and colons escaped as well."""
    return template["roles"].get(role) or "?" + re.sub(r"[:\n]", lambda m: "\\" + m[0], escape(role))


def ordered(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text), each conversation in one partition, in turn order; null role and text count as empty."""
    return (conversations.select(conversations[id_col].alias("conv_id"), conversations[turn_col].alias("turn"),
                                 F.coalesce(conversations[role_col], F.lit("")).alias("role"),
                                 F.coalesce(conversations[text_col], F.lit("")).alias("text"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))


def _key(value) -> object:
    return None if pd.isna(value) else int(value)


def format_segments(turns: DataFrame, template: dict | None = None) -> DataFrame:
    """(conv_id, turn_no, part, text, loss, role, error), three segments a turn: opening, text, closing mark.

    ``turns`` come from ``ordered``. ``error`` names the first turn whose role may not follow, on
    every segment from there on; the conversation is formatted all the same, so that nothing is lost.
    The last segment of a conversation that ends in a wrong state can't know it, ``read_back`` can.
    Ties of a turn number are in order of role and text; null ids form a conversation of their own.
    """
    rules = template or TEMPLATE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state, number, error = object(), "", 0, None
        for batch in batches:
            rows = []
            for conv, role, text in zip(map(_key, batch["conv_id"]), batch["role"], batch["text"], strict=True):
                if conv != here:
                    here, state, number, error = conv, "", 0, None
                if error is None and role not in rules["next"].get(state, []):
                    error = f"turn {number}: {role or 'no role'} after {state or 'the start'}"
                state = role
                for part, (segment, loss) in enumerate((
                        (rules["open"] + _role_mark(role, rules) + rules["after_role"], False),
                        (escape(text), role in rules["loss"]), (rules["close"], False))):
                    rows.append((conv, number, part, segment, loss, role, error))
                number += 1
            yield pd.DataFrame(rows, columns=["conv_id", "turn_no", "part", "text", "loss", "role", "error"]).astype({"conv_id": "Int64"})

    return turns.mapInPandas(run, "conv_id long, turn_no int, part int, text string, loss boolean, role string, error string")


def read_back(segments: DataFrame, template: dict | None = None) -> DataFrame:
    """One row per conversation, parsed from the formatted text: turns and loss text as digests, sizes, error.

    ``segments`` are in order, each conversation in one partition, as ``format_segments`` leaves
    them; a stored table must be sorted by conversation, turn and part first. Only the texts and
    loss flags are read: where a turn begins and ends and who speaks follows from the marks.
    """
    rules = template or TEMPLATE
    names = {v: k for k, v in rules["roles"].items()}
    mark = re.compile(re.escape(rules["open"]) + r"((?:\\.|[^\\:\n])*)" + re.escape(rules["after_role"]), re.S)
    close = re.compile(r"(?:\\.|[^\\<]|<(?!/turn>\n))*", re.S)

    def turns_of(buffer: str) -> tuple[list[tuple[str, str]], str]:
        """Complete turns at the start of the buffer, and the rest."""
        found, at = [], 0
        while (m := mark.match(buffer, at)) and (end := close.match(buffer, m.end()).end()) < len(buffer):
            role = names.get(m[1]) if not m[1].startswith("?") else unescape(m[1][1:])
            found.append((role, unescape(buffer[m.end():end])))
            at = end + len(rules["close"])
        return found, buffer[at:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, now = None, None
        for batch in batches:
            rows = []
            for conv, part, text, loss, error in zip(map(_key, batch["conv_id"]), batch["part"], batch["text"], batch["loss"], batch["error"], strict=True):
                if now is None or conv != here:
                    if now is not None:
                        rows.append(_row(here, now, rules))
                    here, now = conv, {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_n": 0, "chars": 0, "rest": "", "error": None, "last": ""}
                now["chars"] += len(text)
                now["error"] = now["error"] or error
                if loss:
                    plain = unescape(text)
                    now["loss"].update(plain.encode())
                    now["loss_n"] += len(plain)
                now["rest"] += text
                if text == rules["close"]:
                    found, now["rest"] = turns_of(now["rest"])
                    for role, said in found:
                        now["turns"].update(f"{role}\n{said}\n".encode())
                        now["n"], now["last"] = now["n"] + 1, role
            yield pd.DataFrame(rows, columns=OUT).astype({"conv_id": "Int64"})
        if now is not None:
            yield pd.DataFrame([_row(here, now, rules)], columns=OUT).astype({"conv_id": "Int64"})

    return segments.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                     "formatted_chars long, valid boolean, error string")


OUT = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "error"]


def _row(conv, now: dict, rules: dict) -> tuple:
    error = now["error"]
    if error is None and now["rest"]:
        error = "text after the last closed turn"
    if error is None and now["last"] not in rules["final"]:
        error = f"ends with {now['last'] or 'nothing'}"
    return conv, now["n"], now["turns"].hexdigest(), now["loss_n"], now["loss"].hexdigest(), now["chars"], error is None, error
