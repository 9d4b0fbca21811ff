"""Chat formatting with a black-box template: turns are found by rendering successive prefixes.

Rendering the first i turns and the first i - 1 turns shows turn i as what was appended. If the earlier
output is no prefix of the later one, the template rewrites history; this is reported, and the turn then
starts where the outputs part. Rendering the prefix once more with two probe texts shows how much of the
turn is header and how much is trailer, hence which characters carry the text itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
Turns = list[tuple[str, str]]


def escape(text: str) -> str:
    """Text without control strings: backslashes are doubled, and `<|` is parted by one."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def render(turns: Turns) -> str:
    """The template: marks around each turn, its role on the first line, texts escaped."""
    return "".join(f"{START}{_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


#: A role ends at the first line break that no backslash escapes.
_TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def parse(formatted: str) -> Turns:
    """The turns, read back from the template's output."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def shared(a: str, b: str) -> int:
    """Length of the common prefix, found by halving on whole-string comparisons."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def locate(turns: Turns, template: Callable[[Turns], str] = render) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """(output, spans, rewrites): per turn where it starts and ends, and where its text starts and ends.

    A template that rewrites history has its spans taken from the prefix that ends with each turn; they
    hold in the final output only up to the first rewritten character, so such output gets no loss mask.
    """
    before, spans, rewrites = template([]), [], False
    for i, (role, _) in enumerate(turns):
        after = template(turns[: i + 1])
        start = len(before) if after.startswith(before) else shared(before, after)
        rewrites |= start < len(before)
        x, y = (template([*turns[:i], (role, probe)]) for probe in ("x", "y"))
        head = shared(x, y)
        tail = len(x) - head - 1
        spans.append((start, len(after), head, len(after) - tail))
        before = after
    return before, spans, rewrites


def format_conversations(conversations: DataFrame, template: Callable[[Turns], str] = render, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, spans (role, start, stop, text_start, text_stop, loss), rewrites.

    Turns follow the turn number, nulls first, ties by role and text. Null roles and texts are empty. Null
    ids form one conversation. The loss covers the texts of `loss_role` and nothing else; if the template
    rewrites history it covers nothing. A conversation is formatted in one task: its output is one string.
    Repeated rows are repeated turns. Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for turns in batch["turns"]:
                pairs = [(t["role"], t["text"]) for t in turns]
                text, spans, rewrites = locate(pairs, template)
                out.append((text, [{"role": r, "start": a, "stop": b, "text_start": c, "text_stop": d, "loss": r == loss_role and not rewrites} for (r, _), (a, b, c, d) in zip(pairs, spans, strict=True)], rewrites))
            yield pd.DataFrame({"conv_id": batch["conv_id"], "formatted": [o[0] for o in out], "spans": [o[1] for o in out], "rewrites": [o[2] for o in out]}).astype({"conv_id": "Int64"})

    empty = F.lit("")
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), empty).alias("role"), F.coalesce(F.col(text_col).cast("string"), empty).alias("text"))
    grouped = conversations.groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.mapInPandas(run, "conv_id long, formatted string, spans array<struct<role string, start int, stop int, text_start int, text_stop int, loss boolean>>, rewrites boolean")


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all read from the formatted text."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for text, spans in zip(batch["formatted"], batch["spans"], strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["text_start"] : s["text_stop"]]) for s in spans if s["loss"])
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).assign(conv_id=batch["conv_id"].astype("Int64").to_numpy())[["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]].astype({"conv_id": "Int64"})

    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
