"""Stateful stream operators: folds over a session's rows in order, with the state kept by Structured Streaming.

Each fold takes the rows that arrived and the state before them, so a stream and a batch run the same code: a batch is
one arrival with an empty state. A session's rows of one trigger are one group.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Fold = Callable[[pd.DataFrame, tuple], tuple[list[tuple], tuple]]


def folded(rows: DataFrame, key: str, order: list[str], fold: Fold, empty: tuple, schema: str, state: str) -> DataFrame:
    """``fold`` over each key's rows in order; its output has ``schema``, its state ``state``."""
    names = [f.split()[0] for f in schema.split(", ")]

    if not rows.isStreaming:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(fold(pdf.sort_values(order), empty)[0], columns=names)

        return rows.groupBy(key).applyInPandas(whole, schema)

    def part(_: tuple, arrived: Iterable[pd.DataFrame], held: GroupState):
        found, now = fold(pd.concat(list(arrived)).sort_values(order), held.get if held.exists else empty)
        held.update(now)
        yield pd.DataFrame(found, columns=names)

    return rows.groupBy(key).applyInPandasWithState(part, schema, state, "append", GroupStateTimeout.NoTimeout)


INTENTS = "session_id string, segment_id string, tag string, position string"
INTENT_STATE = "text string, text_at double, position string, tag string, tag_at double"


def stream_intents(segments: DataFrame, groups: list[tuple[str, str]], stitch: float = 4.0, duplicate: float = 2.5) -> DataFrame:
    """Intents of (session_id, segment_id, at seconds, status, text): ``groups`` are (pattern, tag) in order.

    A final row is read with the row before it, if that came at most ``stitch`` seconds earlier. Entries on the held side are
    ADDs; management without a position is none; the tag of the last intent within ``duplicate`` seconds is none. Partial
    rows never change state and give no intent.
    """
    rules = [(re.compile(p), t) for p, t in groups]
    effect = {"ENTER_LONG": "LONG", "ENTER_SHORT": "SHORT", "EXIT_ALL": "FLAT"}

    def fold(rows: pd.DataFrame, state: tuple):
        text, text_at, position, last, last_at = state
        out = []
        for r in rows.itertuples():
            if r.status != "final":
                continue
            joined = f"{text} {r.text}".strip() if text is not None and r.at - text_at <= stitch else r.text
            text, text_at = r.text, float(r.at)
            tag = next((t for p, t in rules if p.search(joined)), None)
            if tag in ("TRIM", "MOVE_STOP", "EXIT_ALL") and position == "FLAT":
                tag = None
            elif tag == f"ENTER_{position}":
                tag = "ADD"
            if tag is None or tag in ("NO_ACTION", "SETUP") or tag == last and r.at - last_at <= duplicate:
                continue
            out.append((r.session_id, r.segment_id, tag, position))
            position, last, last_at = effect.get(tag, position), tag, float(r.at)
        return out, (text, text_at, position, last, last_at)

    return folded(segments, "session_id", ["at", "segment_id"], fold, (None, 0.0, "FLAT", None, 0.0), INTENTS, INTENT_STATE)


EDGE = re.compile(r"^\W+|\W+$")


def _same(word: str) -> str:
    low = word.lower()
    return EDGE.sub("", low) or low


def merged(before: list[str], words: list[str]) -> list[str]:
    """Two word lists with their longest overlap once."""
    a, b = [_same(w) for w in before], [_same(w) for w in words]
    size = next((n for n in range(min(len(a), len(b)), 0, -1) if a[-n:] == b[:n]), 0)
    return before + words[size:]


def stabilize_partials(partials: DataFrame, margin: int = 1) -> DataFrame:
    """What to show after each of (utterance_id, seq, text): committed words, and the new tail joined to them at its overlap.

    Words that two shown texts in a row begin with, less the last ``margin`` of them, are committed and don't change any more.
    """

    def fold(rows: pd.DataFrame, state: tuple):
        committed, shown = (list(x) for x in state)
        out = []
        for r in rows.itertuples():
            tail = (r.text or "").split()
            now = merged(committed, tail) if tail else list(committed)
            if tail and shown:
                common = next((k for k, (a, b) in enumerate(zip(shown, now, strict=False)) if _same(a) != _same(b)), min(len(shown), len(now)))
                if common - margin > len(committed):
                    committed = now[: common - margin]
                    now = merged(committed, tail)
            shown = now
            out.append((r.utterance_id, r.seq, " ".join(shown), " ".join(committed)))
        return out, (committed, shown)

    schema = "utterance_id string, seq long, shown string, committed string"
    return folded(partials, "utterance_id", ["seq"], fold, ([], []), schema, "committed array<string>, shown array<string>")


ACTIONS = ("ENTER_LONG", "ENTER_SHORT", "ADD", "TRIM", "EXIT_ALL", "MOVE_STOP", "MOVE_TO_BREAKEVEN")


def newest_candidates(segments: DataFrame, tag: Column, confidence: float = 0.74) -> DataFrame:
    """The newest partial row of each session that is an action with enough confidence; in a stream, as of each trigger."""
    rows = segments.filter(F.col("status") == "partial").withColumn("tag", tag).filter(F.col("tag").isin(*ACTIONS) & (F.col("confidence") >= confidence))
    newest = F.max_by(F.struct("segment_id", "tag", "confidence"), F.struct("at", "segment_id")).alias("c")
    return rows.groupBy("session_id").agg(newest).select("session_id", "c.segment_id", "c.tag", "c.confidence")


def preview_entries(segments: DataFrame, strong: dict[str, str], risk_words: list[str], least: float = 0.9) -> DataFrame:
    """Partial rows that show an entry before it is final: (tag, side, stop, confidence, guard, position, text) without a
    position, with a strong phrase of the side, a word of risk, a stop, enough confidence and no guard."""
    phrase = F.when(F.col("side") == "LONG", F.col("text").rlike(strong["LONG"])).when(F.col("side") == "SHORT", F.col("text").rlike(strong["SHORT"]))
    risk = F.exists(F.array(*[F.lit(w) for w in risk_words]), lambda w: F.col("text").contains(w))
    fine = F.col("position").isNull() & F.col("tag").isin("ENTER_LONG", "ENTER_SHORT") & F.col("guard").isNull() & F.col("stop").isNotNull()
    return segments.filter((F.col("status") == "partial") & fine & (F.col("confidence") >= least) & F.coalesce(phrase, F.lit(False)) & risk)
