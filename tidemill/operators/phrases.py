"""Long lists of phrases: found and replaced in one pass over a text, however many there are."""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.sources.batches import map_rows

#: Characters that a list may have in all; its automaton goes to every executor.
MOST_CHARS = 32 << 20


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Phrases:
    """An Aho-Corasick automaton over the phrases of a list, whatever their case; of equal phrases the first counts."""

    def __init__(self, phrases: Sequence[str]) -> None:
        if sum(map(len, phrases)) > MOST_CHARS:
            raise ValueError(f"a list of phrases may have {MOST_CHARS} characters")
        self.sizes = [len(p) for p in phrases]
        self.automaton = ahocorasick.Automaton()
        for i, phrase in enumerate(phrases):
            if phrase and folded(phrase) not in self.automaton:
                self.automaton.add_word(folded(phrase), i)
        if len(self.automaton):
            self.automaton.make_automaton()

    def places(self, text: str) -> list[tuple[int, int]]:
        """Phrase and start of every occurrence, by its end."""
        return [(i, end + 1 - self.sizes[i]) for end, i in self.automaton.iter(folded(text))] if len(self.automaton) else []

    def longest(self, text: str) -> list[tuple[int, int, int]]:
        """Start, end and phrase of occurrences that do not overlap: the leftmost, and of those the longest."""
        out, at = [], 0
        for start, size, i in sorted((start, -self.sizes[i], i) for i, start in self.places(text)):
            if start >= at:
                at = start - size
                out.append((start, at, i))
        return out

    def replaced(self, text: str, by: Sequence[str]) -> tuple[str, int]:
        """The text after replacing each phrase in list order, and how many replacements that took.

        The same as a pass for each phrase; but only phrases that the text holds take one. What a replacement makes
        counts for the phrases that follow.
        """
        done, n = -1, 0
        while later := [(i, start) for i, start in self.places(text) if i > done]:
            done = min(i for i, _ in later)
            parts, at = [], 0
            for start in sorted(start for i, start in later if i == done):
                if start >= at:
                    parts += [text[at:start], by[done]]
                    at = start + self.sizes[done]
                    n += 1
            text = "".join(parts) + text[at:]
        return text, n


def longest_first(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rules by the length of their phrase, longest first; equal lengths keep their order."""
    return sorted(rules, key=lambda r: -len(r[0]))


def find_phrases(df: DataFrame, text: str, phrases: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The columns of ``keep`` with ``found``, the phrases that a text holds, in list order, and ``spans``, the leftmost longest occurrences (start, end, phrase).

    One pass over each text for all phrases; null counts as empty. Nothing is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(Phrases(phrases))
    words = list(phrases)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("phrase", pa.string())])

    def make():
        own = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            found = [[words[i] for i in sorted({i for i, _ in own.places(t)})] for t in texts]
            spans = [[dict(zip(("start", "end", "phrase"), (a, b, words[i]), strict=True)) for a, b, i in own.longest(t)] for t in texts]
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.string())), pa.array(spans, pa.list_(span))], [*keep, "found", "spans"])

        return each

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return map_rows(df.select(F.col(text).alias("__text"), *keep), make, f"{kinds}, found array<string>, spans array<struct<start:int,end:int,phrase:string>>")


def replace_phrases(df: DataFrame, text: str, rules: Sequence[tuple[str, str]], keep: Sequence[str]) -> DataFrame:
    """The columns of ``keep`` with ``replaced``, the text after all rules, longest phrase first, and ``replacements``, their number; null stays null."""
    ordered = longest_first(rules)
    shared = df.sparkSession.sparkContext.broadcast((Phrases([a for a, _ in ordered]), [b for _, b in ordered]))

    def make():
        own, by = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [own.replaced(t, by) if t is not None else (None, 0) for t in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([t for t, _ in made], pa.string()), pa.array([n for _, n in made], pa.int32())], [*keep, "replaced", "replacements"])

        return each

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return map_rows(df.select(F.col(text).alias("__text"), *keep), make, f"{kinds}, replaced string, replacements int")
