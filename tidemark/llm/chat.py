"""Chat formatting: every assistant turn becomes an example with all turns before it as context."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick

TARGET = "assistant"
# a turn is OPEN role CLOSE text END; inside roles and texts ESCAPE breaks up what could be read as a mark
OPEN, CLOSE, END, ESCAPE = "<|turn ", "|>", "<|end|>\n", "\\"
_TURN = re.compile(r"<\|turn (.*?)\|>(.*?)<\|end\|>\n", re.S)
_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """No mark can be read in the result: every ``<|`` and ``|>`` gets a backslash inside, every backslash a second one."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|").replace("|>", "|\\>")


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def turn(role: str, text: str) -> str:
    return f"{OPEN}{escape(role)}{CLOSE}{escape(text)}{END}"


def turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted example."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def expand(conversations: DataFrame, conv_id: str = "conv_id", turn_no: str = "turn", role: str = "role",
           text: str = "text", target: str = TARGET) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): an example per assistant turn, only its reply under the loss.

    ``text`` is all turns up to and with the target, ``[loss_start, loss_end)`` the code points of the escaped reply in
    it. Turns after the last reply make one more example without a loss, so every turn is in the output; so does a
    conversation without a reply. Turns go by number (null last), then role and text; null role or text is empty; rows
    of a null id are one conversation; repeated rows are turns of their own. An empty table gives no rows.

    Rows are sorted, spilling as needed, and streamed; a task holds one conversation's text, which its last example is
    anyway. Examples of a conversation come one after the other, in order.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "example", "text", "loss_start", "loss_end"]
        rows, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        begun, now, parts, chars, example, open_ = False, None, [], 0, 0, False
        for b in batches:
            for conv, who, said in zip(*(b.column(i).to_pylist() for i in range(3))):
                if begun and conv != now:
                    if open_:
                        rows.append((now, example, "".join(parts), chars, chars))
                        size += chars
                    parts, chars, example, open_ = [], 0, 0, False
                begun, now = True, conv
                piece = turn(who or "", said or "")
                parts.append(piece)
                chars += len(piece)
                open_ = who != target
                if not open_:
                    parts = ["".join(parts)]
                    stop = chars - len(END)
                    rows.append((conv, example, parts[0], stop - len(escape(said or "")), stop))
                    example += 1
                    size += chars
                if size > 4_000_000:
                    yield out()
                    rows, size = [], 0
        if open_:
            rows.append((now, example, "".join(parts), chars, chars))
        if rows:
            yield out()

    return (pick(conversations, conv_id=f"{conv_id} bigint", turn=f"{turn_no} bigint", role=f"{role} string", text=f"{text} string")
            .repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
            .select("conv_id", "role", "text")
            .mapInArrow(run, "conv_id bigint, example bigint, text string, loss_start bigint, loss_end bigint"))


def digests(examples: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from the examples :func:`expand` gives, in their order.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples); ``formatted_chars`` counts all
    examples, context included.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
        begun, now, last, loss, chars, total, count = False, None, "", hashlib.sha256(), 0, 0, 0

        def done() -> tuple:
            said = turns(last)
            digest = hashlib.sha256()
            for who, what in said:
                digest.update(f"{who}\n{what}\n".encode("utf-8", "surrogatepass"))
            return now, len(said), digest.hexdigest(), chars, loss.hexdigest(), total, count

        for b in batches:
            rows = []
            for conv, example, text, start, stop in zip(*(c.to_pylist() for c in b.columns)):
                if begun and example == 0:
                    rows.append(done())
                    loss, chars, total, count = hashlib.sha256(), 0, 0, 0
                reply = unescape(text[start:stop])
                loss.update(reply.encode("utf-8", "surrogatepass"))
                begun, now, last, chars, total, count = True, conv, text, chars + len(reply), total + len(text), count + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(done(), kinds)], names=names)

    return examples.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                    "loss_sha256 string, formatted_chars bigint, n_examples bigint")
