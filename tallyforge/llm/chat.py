"""Chat logs folded into final messages, and messages rendered with a loss mask that can be read back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import streamed

#: Code points of a streamed piece of a message, and steps a turn has room for in a log made of a table.
PIECE = 512
EVENTS = "conv_id long, turn long, message long, step long, kind string, role string, text string"
# A message's frame: its opening, the role, its head's end, the text, its closing.
OPEN, HEAD, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Strings that mean something to a template or a tokenizer. Each begins with < or [, which none of them holds further on.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
#: Roles whose texts carry loss.
LEARNT = ("assistant",)
_RESTS = "|".join(c[1:].replace("|", r"\|").replace("]", r"\]") for c in CONTROLS)


def escaped(text: Column) -> Column:
    """One backslash more behind the first character of each control string, however many there are: none is left whole."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({_RESTS})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_RESTS})", r"$1$2$3")


def _name(role: Column) -> Column:
    """A role on one line: behind each backslash is an n for a line end or a b for a backslash."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _role(name: Column) -> Column:
    return F.replace(F.replace(unescaped(name), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def log_of(conversations: DataFrame) -> DataFrame:
    """The events by which a chat service would have come to these messages (conv_id, turn, role, text).

    A message opens and its text comes in pieces. A learnt role's message first streams a draft, its text's first piece
    twice, which is regenerated; any other is posted with its first piece doubled and then edited to its text's first
    piece. Repeated rows are messages of their own. Null texts are empty.
    """
    text = F.coalesce("text", F.lit(""))
    piece = lambda i: F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE))
    event = lambda step, kind, role, text: F.struct(F.lit(step).cast("long").alias("step"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    no_role = F.lit(None).cast("string")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("message"))
    first = piece(F.lit(0))
    begun = F.array(
        event(0, "open", F.col("role"), F.lit("")),
        event(1, "delta", no_role, first),
        event(2, "delta", no_role, first),
        F.when(F.col("role").isin(*LEARNT), event(3, "regenerate", no_role, F.lit(""))).otherwise(event(3, "edit", no_role, first)),
        event(4, "delta", no_role, F.when(F.col("role").isin(*LEARNT), first).otherwise(F.lit(""))),
    )
    pieces = F.ceil(F.length("text") / F.lit(PIECE)).cast("int")
    rest = F.when(pieces > 1, F.transform(F.sequence(F.lit(1), pieces - 1), lambda i: F.struct((i + 4).cast("long").alias("step"), F.lit("delta").alias("kind"), no_role.alias("role"), piece(i).alias("text"))))
    return rows.select("conv_id", "turn", "message", F.inline(F.concat(begun, F.coalesce(rest, F.slice(begun, 1, 0)))))


def messages(events: DataFrame) -> DataFrame:
    """conv_id, turn, message, role, text: what each message of a log (EVENTS) came to.

    Logs are dealt by conversation and message, sorted by step and folded as they stream: `open` gives the role, `delta`
    appends, `edit` replaces the text, `regenerate` clears it, `delete` ends the message until it is opened again; other kinds
    and null texts change nothing. Edits touch one message alone, so a conversation of any size spreads over tasks; a
    task holds the live pieces of one message. Events of one step are folded in order of kind, role and text, so opening
    and deleting in one step is decided alike everywhere. A message without `open` has no role (null). Null ids are ids.
    """

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, steps in groupby(rows, key=itemgetter(0, 1, 2)):
            role, live, parts = None, True, []
            for _, _, _, kind, role_, text in steps:
                if kind == "open":
                    role, live, parts = role_, True, []
                elif kind in ("edit", "regenerate"):
                    parts = []
                elif kind == "delete":
                    live, parts = False, []
                if kind in ("delta", "edit", "open") and text:
                    parts.append(text)
            if live:
                yield *key, role, "".join(parts)

    columns = ["conv_id", "turn", "message", "kind", "role", "text"]
    return streamed(events.select(*columns, "step"), ["conv_id", "turn", "message"], ["step", "kind", "role", "text"], columns, fold, "conv_id long, turn long, message long, role string, text string")


def rendered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, message, part and its loss mask: loss_from and loss_to, code points of the part, null without loss.

    A conversation's formatted text is its parts in the order of turn (nulls first), role, text and message, one after the
    other. As one part is a message, no conversation has to fit a cell. Null roles and texts are empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = messages.select("conv_id", "turn", "message", role.alias("role"), F.concat(F.lit(OPEN), _name(role), F.lit(HEAD)).alias("head"), escaped(text).alias("body"))
    learnt = F.col("role").isin(*LEARNT)
    start = F.length("head").cast("long")
    return rows.select(
        "conv_id", "turn", "message", F.concat("head", "body", F.lit(CLOSE)).alias("part"),
        F.when(learnt, start).alias("loss_from"), F.when(learnt, start + F.length("body")).alias("loss_to"),
    )


def read_back(parts: DataFrame) -> DataFrame:
    """conv_id, turn, message, role, text, learnt (the text under the loss mask, or null) and n_chars of each part."""
    role = F.substring_index(F.substring("part", len(OPEN) + 1, F.length("part")), HEAD, 1)
    body = F.expr(f"substr(part, instr(part, '\\n') + 1, length(part) - instr(part, '\\n') - {len(CLOSE)})")
    under = F.expr("substr(part, loss_from + 1, loss_to - loss_from)")
    return parts.select("conv_id", "turn", "message", _role(role).alias("role"), unescaped(body).alias("text"), unescaped(under).alias("learnt"), F.length("part").cast("long").alias("n_chars"))


def digests(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read back from its parts.

    A hash goes through a conversation from its first turn to its last, so one task sees all of a conversation; its turns
    stream through, and only one is held.
    """

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, turns in groupby(rows, key=itemgetter(0)):
            n, said, learnt, loss, size = 0, hashlib.sha256(), hashlib.sha256(), 0, 0
            for _, role, text, under, n_chars in turns:
                n, size = n + 1, size + n_chars
                said.update(f"{role}\n{text}\n".encode())
                if under is not None:
                    learnt.update(under.encode())
                    loss += len(under)
            yield conv_id, n, said.hexdigest(), loss, learnt.hexdigest(), size

    columns = ["conv_id", "role", "text", "learnt", "n_chars"]
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return streamed(read_back(parts).select(*columns, "turn", "message"), ["conv_id"], ["turn", "role", "text", "message"], columns, walk, kind)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) by way of their logs, as the parts of rendered().

    Null texts are empty, null roles are the empty role, null turns come first and null conversations are one
    conversation. Rows of one turn follow in order of role and text; repeated rows are turns of their own. Very long texts are
    streamed in pieces and whole again. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    return rendered(messages(log_of(conversations)))
