"""Operator 1: language proportions of documents by expectation-maximisation.

Byte trigrams of lower-cased text are hashed into a fixed number of slots; training counts
them in each language over a bounded sample. A document is a mixture: EM estimates how much
of it each language wrote from the likelihoods of its trigrams. More than one language is
kept only if the likelihood gains more than a penalty for each further one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import arrow_batches, drawn_by_hash, map_rows, pieces

SLOT_BITS = 15
SLOTS = 1 << SLOT_BITS
#: Documents of a language that training reads, about.
SAMPLE_PER_LANGUAGE = 1500
#: Languages that are learned at most: a dirty column must not grow the model.
MOST_LANGUAGES = 500
ROUNDS = 12
#: Log-likelihood that a further language must gain: a fixed part and a part for each trigram.
PENALTY, PENALTY_PER_GRAM = 12.0, 0.02
UNDETERMINED = "und"

_KIND = np.zeros(256, np.uint8)  # every byte that is no letter counts as a space
_KIND[97:123] = np.arange(97, 123)
_KIND[128:] = np.arange(128, 256)
_KIND[_KIND == 0] = 32


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigram slots of a text and how often each comes."""
    data = _KIND[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)  # one space for each gap
    x = data[keep].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.uint32), np.zeros(0)
    code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    slots, counts = np.unique((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS), return_counts=True)
    return slots, counts.astype(np.float64)


@dataclass
class LanguageModel:
    """Log-probabilities of trigram slots (slots x languages)."""

    languages: list[str]
    log_p: np.ndarray

    def infer(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Proportions of the languages in each document (documents x languages); all need at least one trigram."""
        sizes = np.array([len(s) for s, _ in docs])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        slots, counts = np.concatenate([s for s, _ in docs]), np.concatenate([c for _, c in docs])
        n = np.add.reduceat(counts, starts)
        log_p = self.log_p[slots]
        best = log_p.max(1)
        p = np.exp(log_p - best[:, None])
        single = np.add.reduceat(log_p * counts[:, None], starts)
        share = self._maximise(p, counts, starts, sizes, n, np.full((len(docs), len(self.languages)), 1 / len(self.languages)))
        return self._select(share, p, counts, best, starts, sizes, n, single)

    def _maximise(self, p, counts, starts, sizes, n, share) -> np.ndarray:
        for _ in range(ROUNDS):
            part = p * np.repeat(share, sizes, axis=0)
            part *= (counts / np.maximum(part.sum(1), 1e-300))[:, None]
            share = np.add.reduceat(part, starts) / n[:, None]
        return share

    def _select(self, share, p, counts, best, starts, sizes, n, single) -> np.ndarray:
        """Grows the set of languages, largest proportion first, while the penalised likelihood rises."""
        out = np.zeros_like(share)
        rows = np.arange(len(share))
        out[rows, single.argmax(1)] = 1
        score = single.max(1)
        order = np.argsort(-share, axis=1, kind="stable")
        base = np.add.reduceat(best * counts, starts)
        cost = PENALTY + PENALTY_PER_GRAM * n
        open_ = rows[base - score > cost]  # no mixture can gain more than the best language of every trigram
        for size in range(2, len(self.languages) + 1):
            open_ = open_[share[open_, order[open_, size - 1]] > 0.01]
            if not len(open_):
                break
            inside = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in open_])
            own = sizes[open_]
            at = np.concatenate(([0], np.cumsum(own)[:-1]))
            allowed = np.zeros((len(open_), len(self.languages)))
            np.put_along_axis(allowed, order[open_, :size], 1.0 / size, axis=1)
            fitted = self._maximise(p[inside], counts[inside], at, own, n[open_], allowed)
            mixed = np.log(np.maximum((p[inside] * np.repeat(fitted, own, axis=0)).sum(1), 1e-300))
            value = np.add.reduceat(mixed * counts[inside], at) + base[open_] - (size - 1) * cost[open_]
            better = value > score[open_]
            open_, fitted = open_[better], fitted[better]
            out[open_], score[open_] = fitted, value[better]
        return out


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, most: int = MOST_LANGUAGES) -> LanguageModel:
    """Learns from rows where ``learn`` holds and text and language are not null; of more than ``most`` languages those with most rows.

    Of each language about ``per_language`` documents, chosen by a hash of their id, are counted.
    Counts are added up in tasks; the driver gets one array of fixed size for each language.
    """
    usable = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {row[lang_col]: row["count"] for row in usable.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(most).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((SLOTS, 0)))
    languages = sorted(sizes)
    part = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(per_language / sizes[lang]))])
    chosen = usable.where(F.col(lang_col).isin(languages)).where(drawn_by_hash(F.col(id_col), part[F.col(lang_col)]))
    place = {lang: i for i, lang in enumerate(languages)}
    total = np.zeros((len(languages), SLOTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in pieces(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                slots, counts = trigrams(text)
                sums.setdefault(place[lang], np.zeros(SLOTS))[slots] += counts
        for lang, counts in sums.items():
            slots = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": np.full(len(slots), lang, np.int32), "slot": slots.astype(np.int32), "n": counts[slots]})

    counted = arrow_batches(chosen.select(lang_col, text_col)).mapInArrow(run, "lang int, slot int, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    for row in counted.toLocalIterator():
        total[row.lang, row.slot] = row.n
    smooth = total + 0.1
    return LanguageModel(languages, np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``proportions`` to every row, from its whole text.

    Rows whose ``keep`` has the text carry it once. ``score`` is the proportion of the predicted language, from 0 to 1. A null text, one without
    letters, or a model without languages gives ``und`` and 0. Of equal proportions the language
    that sorts first wins. Only ``id_col`` and the columns of ``keep`` are carried along; repeated
    rows give one row each, an empty table an empty one.
    """
    names = list(dict.fromkeys([id_col, *(keep or [])]))
    at = names.index(text_col) if text_col in names else len(names)
    fields = [docs.schema[name] for name in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double, proportions map<string,double>"])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.log_p.astype(np.float32)))

    def make():
        languages, log_p = shared.value
        own = LanguageModel(languages, log_p)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at).to_pylist()
            pred, score, shares = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            waiting: list[tuple[int, tuple]] = []

            def flush() -> None:
                found = own.infer([grams for _, grams in waiting])
                for (i, _), share in zip(waiting, found, strict=True):
                    top = int(share.argmax())
                    pred[i], score[i] = languages[top], min(1.0, float(share[top]))
                    shares[i] = [(languages[k], float(share[k])) for k in np.flatnonzero(share > 0)]
                waiting.clear()

            total = 0
            for i, text in enumerate(texts):
                if text and languages and any(map(str.isalpha, text)):
                    grams = trigrams(text)
                    if len(grams[0]):
                        waiting.append((i, grams))
                        total += len(grams[0])
                if total > 40_000:
                    flush()
                    total = 0
            if waiting:
                flush()
            columns = [batch.column(k) for k in range(len(names))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(pred), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))], [*names, "lang_pred", "score", "proportions"])

        return each

    return map_rows(docs.select(*names, *([F.col(text_col).alias("__text")] if at == len(names) else [])), make, schema)
