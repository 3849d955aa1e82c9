"""Debounced event memory by key, in batch and as a stream.

A caption stands for the entry of its key's list of known captions that is most alike, if
one is alike enough, else for itself. Each key has an active state. Another state takes over once it was seen STABLE times in
a row, not counting returns to the active one in between. The state that ends is
committed to the key's memory if it was itself seen STABLE times and had reached DONE
percent or had announced the one that follows; the same state is not committed twice
running. States are the same if their captions are, without differences of case, white
space and punctuation at the end; the first caption seen of a state names it. Whether a
state is the one that was announced, or the one committed last, goes by captions that
are alike.

The memory shown is its last SHOWN states, told when there are earlier ones; how many
there are in all is counted, and the rows that commit name every one, so nothing of the
memory is lost although a key's state stays small. The step function is all the Python
there is; both engines sort and deal the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspan.functions.text import NULL_WORDS
from loomspan.operators.nearest import ALIKE, Vocabulary, canonical_states, likeness

STABLE, DONE, SHOWN = 2, 80, 8
_END = re.compile(r"[\s.,;:!?。！？，；：…]+$")


@lru_cache(1 << 14)
def canonical(caption: str) -> str:
    one = " ".join(caption.split()).casefold()
    return "" if one in NULL_WORDS else _END.sub("", one)


@lru_cache(256)
def _vocabulary(captions: tuple[str, ...]) -> Vocabulary:
    return Vocabulary(map(canonical, captions))


@lru_cache(1 << 14)
def _named(caption: str, known: tuple[str, ...]) -> str:
    return canonical_states(caption, _vocabulary(known))


@lru_cache(1 << 14)
def alike(left: str, right: str) -> bool:
    return likeness(canonical(left), canonical(right)) >= ALIKE


@dataclass
class Seen:
    caption: str
    times: int = 1
    progress: int = 0
    following: str = ""

    def same(self, caption: str) -> bool:
        return canonical(self.caption) == canonical(caption)

    def again(self, progress: int, following: str) -> None:
        self.times += 1
        self.progress = max(self.progress, progress)
        self.following = following or self.following


@dataclass
class Memory:
    active: Seen | None = None
    candidate: Seen | None = None
    shown: list[str] = field(default_factory=list)
    count: int = 0
    known: tuple[str, ...] = ()

    def reset(self, known: Iterable[str] = ()) -> None:
        """Begin anew, with captions that stand for those that are alike."""
        self.active = self.candidate = None
        self.shown, self.count, self.known = [], 0, tuple(known)

    def named(self, caption: str) -> str:
        """The known caption that stands for one, or itself."""
        return _named(canonical(caption), self.known) if self.known else caption

    @property
    def committed(self) -> list[str]:
        return self.shown

    def text(self) -> str:
        return ">".join((["..."] if self.count > len(self.shown) else []) + self.shown)

    def _outcome(self, ended: Seen, begun: Seen) -> str:
        done = ended.progress >= DONE or (ended.following != "" and alike(begun.caption, ended.following))
        if ended.times < STABLE or not done:
            return "transition_without_commit"
        if self.shown and alike(ended.caption, self.shown[-1]):
            return "transition_duplicate_suppressed"
        return "transition_committed"

    def step(self, caption: str, progress: int, following: str) -> str:
        """Take one observation in; the name of what happened. An empty caption or a progress outside 0 to 100 changes nothing."""
        if not canonical(caption) or not 0 <= progress <= 100:
            return "refused"
        caption, following = self.named(caption), self.named(following) if following else ""
        if self.active is None:
            self.active = Seen(caption, 1, progress, following)
            return "initialized"
        if self.active.same(caption):
            self.active.again(progress, following)
            self.candidate = None
            return "active_stable"
        if self.candidate is not None and self.candidate.same(caption):
            self.candidate.again(progress, following)
        else:
            self.candidate = Seen(caption, 1, progress, following)
        if self.candidate.times < STABLE:
            return "transition_candidate"
        what = self._outcome(self.active, self.candidate)
        if what == "transition_committed":
            self.shown = [*self.shown, self.active.caption][-SHOWN:]
            self.count += 1
        self.active, self.candidate = self.candidate, None
        return what


SCHEMA = "key string, at long, caption string, what string, active string, memory string, n_committed long"


def _rows(key: str, memory: Memory, frame: pd.DataFrame) -> list[tuple]:
    out = []
    for at, caption, progress, following, known in zip(frame["at"], frame["caption"], frame["progress"], frame["following"], frame["known"], strict=True):
        memory.known = () if known is None else tuple(x for x in known if x is not None)
        what = memory.step(caption, int(progress), following)
        out.append((key, at, caption, what, memory.active.caption if memory.active else None, memory.text(), memory.count))
    return out


def _clean(observations: DataFrame) -> DataFrame:
    known = "known" if "known" in observations.columns else "CAST(NULL AS array<string>) AS known"
    return observations.where("caption is not null").selectExpr("key", "at", "caption", "coalesce(progress, 0) as progress", "coalesce(following, '') as following", known)


def batch_memory(observations: DataFrame) -> DataFrame:
    """(key, at, caption, what, active, memory) of every observation (key, at, caption, progress, following), by at; a column known may have the key's known captions.

    Keys are dealt out and sorted by Spark; a task reads its sorted rows as a stream of
    batches with one key's memory at a time, so no key has to fit in a frame. Null
    captions are left out; null progress is 0, a null following is none.
    """
    clean = _clean(observations)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, memory = None, Memory()
        for frame in frames:
            out = []
            for own, part in frame.groupby("key", sort=False):
                if own != key:
                    key, memory = own, Memory()
                out += _rows(own, memory, part)
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    return clean.repartition("key").sortWithinPartitions("key", "at", "caption").mapInPandas(read, SCHEMA)


_STATE = "active struct<caption:string,times:int,progress:int,following:string>, candidate struct<caption:string,times:int,progress:int,following:string>, shown array<string>, count long"


def _step_frames(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    memory = Memory()
    if state.exists:
        active, candidate, shown, count = state.get
        memory = Memory(Seen(*active) if active else None, Seen(*candidate) if candidate else None, list(shown), count)
    frame = pd.concat(list(frames)).sort_values(["at", "caption"], kind="stable")
    rows = _rows(key[0], memory, frame)
    state.update((astuple(memory.active) if memory.active else None, astuple(memory.candidate) if memory.candidate else None, memory.shown, memory.count))
    yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])


def stream_memory(observations: DataFrame) -> DataFrame:
    """As batch_memory, over a stream: each key's memory is kept between micro-batches; within one, rows go by ``at``.

    Equal to the batch where micro-batches come in order of ``at``; a row that comes after
    a later one was read is taken as it comes. A key's state has a fixed size and stays
    for as long as the stream runs.
    """
    return _clean(observations).groupBy("key").applyInPandasWithState(_step_frames, SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)
