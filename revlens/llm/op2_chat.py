r"""Chat formatting with a grammar round trip.

A turn is written as ``OPEN text CLOSE`` with the control strings of its role:

    user       [INST] text [/INST]
    assistant  <s> text </s>
    system     <<SYS>> text <</SYS>>
    any other  <<ROLE>> role <<TEXT>> text <</ROLE>>

A text may itself hold control strings.  The rendered turn is reparsed by the
deterministic parser of the same grammar and compared with the source; where the two
differ, every control string of the conflicting content gets a backslash after its
first character, and again until the reparse is identical.  The parser drops one
backslash from each escaped control string, so the escape is reversible for any
text, one with escaped control strings of its own included.

Cases: null text and null role are empty; turns are taken in the order (turn, role,
text), nulls first, so ties and repeated rows have one defined order and repeated
rows count as turns of their own; an empty table gives no rows; rows with a null
conv_id form one conversation; other columns are ignored.  A conversation of any
length passes through a task as a sorted stream, one turn at a time (its digests
are sequential by definition); formatting and checking happen before that, in
parallel over turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from revlens.llm.common import map_batches, pa_schema, texts

OPEN = {"user": "[INST] ", "assistant": "<s> ", "system": "<<SYS>> "}
CLOSE = {"user": " [/INST]", "assistant": " </s>", "system": " <</SYS>>"}
OTHER_OPEN, OTHER_MID, OTHER_CLOSE = "<<ROLE>> ", " <<TEXT>> ", " <</ROLE>>"

#: first character and rest of every control string
_CONTROL = r"(/?INST\]|/?s>|</?SYS>>|</?ROLE>>|<TEXT>>)"
CONTROL_LIKE = rf"([\[<])(\\*){_CONTROL}"
_like = re.compile(CONTROL_LIKE)
_escaped = re.compile(rf"([\[<])\\(\\*){_CONTROL}")
_bare = re.compile(rf"[\[<]{_CONTROL}")


def escape(text: str) -> str:
    return _like.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1\2\3", text)


def render(role: str, text: str) -> str:
    """One turn as written, its content taken as it is."""
    if role in OPEN:
        return OPEN[role] + text + CLOSE[role]
    return OTHER_OPEN + role + OTHER_MID + text + OTHER_CLOSE


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """All turns of a rendered string: (role, text, start and end of the written text).

    Raises ValueError where the string is not a sequence of turns.
    """
    turns, at = [], 0
    while at < len(rendered):
        for role, opening in OPEN.items():
            if rendered.startswith(opening, at):
                start, closing = at + len(opening), CLOSE[role]
                break
        else:
            if not rendered.startswith(OTHER_OPEN, at):
                raise ValueError(f"no turn at {at}")
            mark = _bare.search(rendered, at + len(OTHER_OPEN))
            if mark is None or mark.group() != OTHER_MID.strip() or rendered[mark.start() - 1] != " ":
                raise ValueError(f"no role at {at}")
            role = unescape(rendered[at + len(OTHER_OPEN):mark.start() - 1])
            start, closing = mark.end() + 1, OTHER_CLOSE
        mark = _bare.search(rendered, start)
        if mark is None or mark.group() != closing.strip() or mark.start() - 1 < start or rendered[mark.start() - 1] != " ":
            raise ValueError(f"turn at {at} is not closed")
        turns.append((role, unescape(rendered[start:mark.start() - 1]), start, mark.start() - 1))
        at = mark.end()
    return turns


def _reads_back(rendered: str, role: str, text: str) -> bool:
    try:
        return [t[:2] for t in parse(rendered)] == [(role, text)]
    except ValueError:
        return False


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and the place of its written text; escaped until it reads back."""
    r, t = role, text
    for _ in range(3):
        out = render(r, t)
        if _reads_back(out, role, text):
            _, _, start, end = parse(out)[0]
            return out, start, end
        r, t = (role if role in OPEN else escape(r)), escape(t)
    raise ValueError("turn does not read back")


FORMATTED = "conv_id long, turn long, role string, text string, formatted string, text_start long, text_end long, loss boolean"


def format_turns(conversations: DataFrame) -> DataFrame:
    """Every row of ``conversations`` with its formatted turn, checked by reparsing.

    A conversation's formatted text is the concatenation of its ``formatted`` strings
    in order; ``text_start``/``text_end`` bound the written text in it, and ``loss``
    marks the turns that a training loss covers (assistant).
    """
    def run(b):
        roles, contents = list(texts(b.column("role"))), list(texts(b.column("text")))
        done = [format_turn(r, t) for r, t in zip(roles, contents)]
        yield {"conv_id": b.column("conv_id"), "turn": b.column("turn"), "role": roles, "text": contents,
               "formatted": [d[0] for d in done], "text_start": [d[1] for d in done], "text_end": [d[2] for d in done],
               "loss": [r == "assistant" for r in roles]}

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its formatted turns say when parsed again: counts and digests."""
    schema = pa_schema(DIGEST)
    ordered = (formatted.select("conv_id", "turn", "role", "text", "formatted", "loss")
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
               .select("conv_id", "formatted", "loss"))

    def run(batches) -> Iterator:
        import pyarrow as pa

        state = None  # conv_id, turns, turn digest, loss chars, loss digest, characters
        rows: list[tuple] = []

        def close():
            rows.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for b in batches:
            for conv, text, loss in zip(b.column("conv_id").to_pylist(), texts(b.column("formatted")), b.column("loss").to_pylist()):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content, start, end in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{content}\n".encode())
                    if loss:
                        said = unescape(text[start:end])
                        state[3] += len(said)
                        state[4].update(said.encode())
                state[5] += len(text)
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows)))), schema=schema)
                rows.clear()
        if state is not None:
            close()
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows)))), schema=schema)

    return ordered.mapInArrow(run, DIGEST)
