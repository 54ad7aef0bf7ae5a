"""Chat formatting: a finite-state machine over roles, a declarative template, reversible escapes and loss flags."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What surrounds a turn, which roles may follow which, and which roles' texts are trained on.

    A turn is written as head + role + mid + text + tail. Inside roles and texts each special character is written as
    the escape character and a letter, so head, mid and tail, which all hold a special character, occur nowhere else.
    """

    head: str = "### "
    mid: str = ": "
    tail: str = " </turn>\n"
    escape: str = "\\"
    special: dict = field(default_factory=lambda: {"\\": "b", "#": "h", "<": "l", ":": "c"})
    loss_roles: frozenset = frozenset({"assistant"})
    start: str = "start"
    follows: dict = field(
        default_factory=lambda: {
            "start": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )
    final: frozenset = frozenset({"assistant"})


TEMPLATE = Template()
SEGMENTS = "conv_id long, valid boolean, bad_turn int, segments array<struct<text:string,loss:boolean>>"
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
    " formatted_chars long, valid boolean"
)


def escaped(text: str, template: Template = TEMPLATE) -> str:
    return text.translate({ord(c): template.escape + code for c, code in template.special.items()})


def unescaped(text: str, template: Template = TEMPLATE) -> str:
    meant = {code: c for c, code in template.special.items()}
    first, *rest = text.split(template.escape)
    return first + "".join(meant[x[0]] + x[1:] for x in rest)


def walk(roles: Iterable[str], template: Template = TEMPLATE) -> tuple[bool, int | None]:
    """Whether the machine accepts the roles, and the place of the first turn that it refuses."""
    state = template.start
    for i, role in enumerate(roles):
        if role not in template.follows.get(state, ()):
            return False, i
        state = role
    return state in template.final, None


def segments(turns: Iterable[tuple[str, str]], template: Template = TEMPLATE) -> list[tuple[str, bool]]:
    """The formatted conversation as (text, loss) segments; markup never has loss, a trained role's text has."""
    out = []
    for role, text in turns:
        out.append((template.head + escaped(role, template) + template.mid, False))
        out.append((escaped(text, template), role in template.loss_roles))
        out.append((template.tail, False))
    return out


def parse(formatted: str, template: Template = TEMPLATE) -> list[tuple[str, str]]:
    """The turns, read back from a formatted conversation."""
    turns = []
    for turn in formatted.split(template.tail)[:-1]:
        role, text = turn[len(template.head) :].split(template.mid, 1)
        turns.append((unescaped(role, template), unescaped(text, template)))
    return turns


def gathered(conversations: DataFrame) -> DataFrame:
    """One row per conversation with its turns in order: by turn, then role and text; null texts count as empty."""
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        turns = [[(t["role"], t["text"]) for t in x] for x in batch.column(1).to_pylist()]
        yield ids, turns


def format_conversations(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, valid, bad_turn and the segments (text, loss) of every conversation.

    A conversation whose roles the machine refuses is still formatted, with valid false and the place of the first
    refused turn (null when only the end is wrong). Unknown and null roles are refused; null and empty texts are written as
    empty ones; repeated rows are turns each, in order of role and text. All rows of a conversation meet in one row, which is
    what a formatted conversation is, so a very long one must fit in a row; long texts are escaped in one pass.
    """

    def run(batches):
        for ids, all_turns in _conversations(batches):
            checked = [walk((r for r, _ in turns), template) for turns in all_turns]
            rows = [[{"text": t, "loss": on} for t, on in segments(turns, template)] for turns in all_turns]
            kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([x[0] for x in checked], pa.bool_()),
                    pa.array([x[1] for x in checked], pa.int32()),
                    pa.array(rows, kind),
                ],
                ["conv_id", "valid", "bad_turn", "segments"],
            )

    return gathered(conversations).mapInArrow(run, SEGMENTS)


def chat_digest(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Digests of each formatted conversation, all read back from format_conversations()'s segments.

    An empty table gives no rows; rows without conv_id form one conversation; extra columns are ignored.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for cid, valid, segs in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True
            ):
                formatted = "".join(s["text"] for s in segs)
                turns = parse(formatted, template)
                told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                loss = "".join(unescaped(s["text"], template) for s in segs if s["loss"])
                rows.append(
                    {
                        "conv_id": cid,
                        "n_turns": len(turns),
                        "turns_sha256": told,
                        "loss_chars": len(loss),
                        "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
                        "formatted_chars": len(formatted),
                        "valid": valid,
                    }
                )
            schema = pa.schema(
                [
                    ("conv_id", pa.int64()),
                    ("n_turns", pa.int64()),
                    ("turns_sha256", pa.string()),
                    ("loss_chars", pa.int64()),
                    ("loss_sha256", pa.string()),
                    ("formatted_chars", pa.int64()),
                    ("valid", pa.bool_()),
                ]
            )
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return format_conversations(conversations, template).mapInArrow(run, DIGEST)
