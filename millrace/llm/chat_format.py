"""Operator 5: chat formatting by prefix-target expansion.

A turn is written as ``<turn ROLE>\\nTEXT</turn>\\n``. Inside roles and texts a backslash becomes two,
``<`` becomes ``\\l`` and ``###`` becomes ``\\h``; in roles a line end becomes ``\\n`` and ``>``
becomes ``\\g``. So no control string is left in a text, and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

OPEN, MIDDLE, CLOSE = "<turn ", ">\n", "</turn>\n"
_TURN = re.compile(r"<turn ((?:[^\\<>\n]|\\.)*)>\n((?:[^\\<]|\\.)*)</turn>\n", re.S)
#: Characters of examples that a task hands on at once.
_HAND_ON = 8 << 20


#: What stands after a backslash for what.
_CODES = {"\\": "\\", "l": "<", "h": "###", "n": "\n", "g": ">"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("###", "\\h")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n").replace(">", "\\g")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _CODES[m[1]], text) if "\\" in text else text


def expand(turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, int, int]]:
    """(text, loss_start, loss_end) for each assistant turn, with all earlier turns before it.

    Turns after the last reply, or a conversation without one, come as a last example without loss.
    """
    text, open_end = "", False
    for role, said in turns:
        head = f"{OPEN}{escape_role(role)}{MIDDLE}"
        body = escape(said)
        begin = len(text) + len(head)
        text = f"{text}{head}{body}{CLOSE}"
        open_end = role != "assistant"
        if not open_end:
            yield text, begin, begin + len(body)
    if open_end:
        yield text, 0, 0


def _by_conversation(batches: Iterator[pd.DataFrame], begins: Callable[[tuple], bool]) -> Iterator[tuple]:
    """(id, rows) of neighbouring rows of one id; where ``begins`` holds of a row, it opens another group."""
    rows = (r for b in batches for r in zip(b["conv"].astype(object).where(b["conv"].notna(), None), *(b[c] for c in b.columns[1:])))
    opened = 0

    def group(r: tuple) -> tuple:
        nonlocal opened
        opened += begins(r)
        return r[0], opened

    return ((key[0], own) for key, own in groupby(rows, key=group))


def chat_examples(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One training example for each assistant turn: conv_id, example, text, loss_start, loss_end.

    Offsets are code points of ``text``; only the reply itself is trainable. Turns go by number, then
    role, then text (ties and repeated rows: each row is a turn of its own). Null roles and texts
    are empty; a row without a conversation id is a conversation of its own, null turns come first. Other
    columns are ignored; an empty table gives no examples. Conversations are dealt out whole, since
    every reply needs all turns before it; a task holds one conversation's text at a time.
    """
    small_batches(conversations.sparkSession)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("said"))
    kind = turns.schema["conv"].dataType.simpleString()
    alone = F.when(F.col("conv").isNull(), F.xxhash64("turn", "role", "said"))  # so that such rows don't meet in one task
    ordered = turns.repartition("conv", alone).sortWithinPartitions("conv", "turn", "role", "said").select("conv", "role", "said")
    names = ["conv_id", "example", "text", "loss_start", "loss_end"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for conv, own in _by_conversation(batches, lambda r: r[0] is None):
            for i, (example, begin, end) in enumerate(expand((role, said) for _, role, said in own)):
                rows.append((conv, i, example, begin, end))
                size += len(example)
                if size > _HAND_ON:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return ordered.mapInPandas(run, f"conv_id {kind}, example long, text string, loss_start long, loss_end long")


def read_back(examples: Iterable[tuple[str, int, int]]) -> tuple[list[tuple[str, str]], list[str], int]:
    """(turns, trained texts, characters) of one conversation's examples, in order.

    Each example must begin with the one before, so that only what is new needs to be parsed.
    """
    turns, trained, size, before = [], [], 0, ""
    for text, begin, end in examples:
        if not text.startswith(before):
            raise ValueError("an example does not continue the one before it")
        at = len(before)
        while at < len(text):
            if not (m := _TURN.match(text, at)):
                raise ValueError(f"no turn at character {at}")
            turns.append((unescape(m[1]), unescape(m[2])))
            at = m.end()
        if end > begin or (turns and turns[-1][0] == "assistant" and begin):
            trained.append(unescape(text[begin:end]))
        size += len(text)
        before = text
    return turns, trained, size


def chat_digest(examples: DataFrame) -> DataFrame:
    """Read ``chat_examples`` back, in the order it gives them: a row of counts and digests for each conversation, which begins with example 0."""
    kind = examples.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for conv, own in _by_conversation((b.rename(columns={"conv_id": "conv"}) for b in batches), lambda r: r[1] == 0):
            turns, trained, size = read_back((text, begin, end) for _, _, text, begin, end in own)
            loss = "".join(trained)
            rows.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), size))
            if len(rows) == 5000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return examples.select("conv_id", "example", "text", "loss_start", "loss_end").mapInPandas(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
