"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a text. Conversations are rendered after each turn; what one output adds
to the one before is the new turn's span. If an output does not begin with the one before it, the template rewrites
history: the first turn whose span moved is reported, and the spans are those of the last output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, quoted

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: The marks of the ChatML layout.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    """Doubled backslashes, and one between `<` and `|`: no mark is left in the result, and unescape gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return "\\".join(part.replace("<\\|", "<|") for part in text.split("\\\\"))


def chatml(turns: list[Turn]) -> str:
    """Every turn as open mark, role, line end, text, close mark, line end; marks inside roles and texts are escaped."""
    return "".join(f"{OPEN}{escape_role(role)}\n{escape(text)}{CLOSE}\n" for role, text in turns)


def escape_role(role: str) -> str:
    """A role's line ends are escaped as well, so that its line stays one."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return "\\".join(part.replace("\\n", "\n").replace("<\\|", "<|") for part in role.split("\\\\"))


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:  # the longest equal prefix lies between
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def locate(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int]], int | None]:
    """The last output, each turn's span in it, and the first turn at which the template rewrote history (None: never).

    Where history was rewritten a turn's span runs from where its rendering first differs from the one before to where the
    next turn's begins; spans never overlap and cover the output from the first turn on.
    """
    before, starts, rewritten = template([]), [], None
    for i in range(len(turns)):
        now = template(turns[: i + 1])
        same = len(before) if now.startswith(before) else common_prefix(before, now)
        if same < len(before) and rewritten is None:
            rewritten = i
        starts = [min(s, same) for s in starts] + [same]
        before = now
    return before, list(zip(starts, [*starts[1:], len(before)], strict=True)) if starts else [], rewritten


def read_turn(chunk: str) -> Turn | None:
    """Role and text that a turn's span of the chatml layout holds; None if it is no such span."""
    if not (chunk.startswith(OPEN) and chunk.endswith(f"{CLOSE}\n")):
        return None
    role, line, text = chunk[len(OPEN) : -len(CLOSE) - 1].partition("\n")
    return (unescape_role(role), unescape(text)) if line else None


def loss_spans(output: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of the output under the loss mask: what stands between a loss turn's role line and its close mark."""
    found = []
    for start, end in spans:
        turn = read_turn(output[start:end])
        if turn and turn[0] == LOSS_ROLE:
            found.append((output.index("\n", start) + 1, end - len(CLOSE) - 1))
    return found


def format_conversations(rows: DataFrame, template: Template = chatml, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, output, turns, loss, rewritten): one row per conversation, turns and loss as arrays of (start, end).

    Turns stand by turn number (nulls first), ties by role and then text; null roles and texts are empty; repeated rows are
    turns of their own. Rows of a null conv_id form one conversation. Other columns take no part; an empty table gives no
    rows. Positions count code points. A conversation is rendered once per turn, in one task: its turns are one value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            outputs, turns, loss, rewritten = [], [], [], []
            for value in batch.column(1):
                output, spans, at = locate([(t["role"], t["text"]) for t in value.as_py()], template)
                outputs.append(output)
                turns.append([{"start": a, "end": b} for a, b in spans])
                loss.append([{"start": a, "end": b} for a, b in loss_spans(output, spans)])
                rewritten.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(outputs, pa.string()), pa.array(turns, pairs), pa.array(loss, pairs), pa.array(rewritten, pa.int64())], names=["conv_id", "output", "turns", "loss", "rewritten"])

    empty = lambda name: F.coalesce(quoted(name).cast("string"), F.lit(""))
    turn = F.struct(quoted(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    talks = rows.groupBy(quoted(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    talks = talks.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    kind = talks.schema["conv_id"].dataType.simpleString()
    span = "array<struct<start: bigint, end: bigint>>"
    return talks.transform(in_batches).mapInArrow(run, f"conv_id {kind}, output string, turns {span}, loss {span}, rewritten bigint")


def digests(formatted: DataFrame, read: Callable[[str], Turn | None] = read_turn, plain: Callable[[str], str] = unescape) -> DataFrame:
    """What can be read back from the outputs alone: turns, their hash, the length and hash of all text under the mask, and
    whether the template rewrote history.

    read and plain undo the template's marks and escapes; a span that read can't make out stands for itself, of no role.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for output, spans, loss in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                output = output.as_py()
                chunks = [output[s["start"] : s["end"]] for s in spans.as_py()]
                turns = [read(chunk) or ("", chunk) for chunk in chunks]
                masked = "".join(plain(output[s["start"] : s["end"]]) for s in loss.as_py())
                sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
                found.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(masked), sha(masked), len(output)))
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
            rewrites = pa.array([x.is_valid for x in batch.column(4)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), rewrites], names=names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    shape = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites boolean"
    return formatted.select("conv_id", "output", "turns", "loss", "rewritten").transform(in_batches).mapInArrow(run, shape)
