"""Language identification, word first.

A known word counts by its log frequency in each language. An unknown word
backs off: the longest character n-grams of it that the model knows stand in,
going to shorter ones only while none is known.

Learning: words are counted in Spark over a sample of the labelled rows whose
expected size is ``SAMPLE`` rows (all rows if there are fewer). Words that the sample holds ``OFTEN`` times or more are known, and
all n-grams of all its words; the sample is what bounds the model that is sent
to the executors. Prediction is one Arrow pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import small, stored

SAMPLE, OFTEN, LONGEST, SEED = 20_000, 2, 5, 17
#: N-grams from this length on count as known, as whole words do.
LONG, WHOLE = 3, 100
#: Words that a worker remembers before it begins anew.
CACHE = 150_000
#: Runs of letters (and of the few other signs that count as word characters).
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(any(map(str.isalpha, w)) for w in words)


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)] if n > 1 else list(word)


@dataclass
class Model:
    """Log frequencies, less their mean over the languages; a row of a table for each word and n-gram."""

    languages: list[str]
    words: dict[str, int]
    word_table: np.ndarray
    grams: dict[str, int]
    gram_table: np.ndarray
    longest: int = LONGEST

    def evidence(self, word: str) -> tuple[np.ndarray, int]:
        """What a word says for each language, and the length of the n-grams that say it (``WHOLE``: the word itself)."""
        k = self.words.get(word)
        if k is not None:
            return self.word_table[k], WHOLE
        for n in range(self.longest, 0, -1):
            found = [self.grams[g] for g in grams_of(word, n) if g in self.grams]
            if found:
                return self.gram_table[found].mean(axis=0), n
        return np.zeros(len(self.languages)), 0


class Scorer:
    """Sums the evidence of a text's words; words are looked up once."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages)))
        self.reach = np.zeros(1024, np.int8)

    def learn(self, word: str) -> int:
        k = len(self.place)
        if k == len(self.rows):
            self.rows, self.reach = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rows, self.reach))
        self.rows[k], self.reach[k] = self.model.evidence(word)
        self.place[word] = k
        return k

    def score(self, text: str | None) -> tuple[str, float, int, int]:
        """Language, probability, number of words, and how many of them the model knows whole or by n-grams of three letters or more."""
        words = words_of(text or "")
        if not has_letter(words) or not self.model.languages:
            return "und", 0.0, len(words), 0
        if len(self.place) > CACHE:
            self.reset()
        get, learn = self.place.get, self.learn
        at = np.array([learn(w) if (i := get(w)) is None else i for w in words])
        total = self.rows[at].sum(axis=0) / np.sqrt(len(words))
        p = np.exp(total - total.max())
        best = int(p.argmax())
        return self.model.languages[best], float(p[best] / p.sum()), len(words), int((self.reach[at] >= LONG).sum())


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows, each as likely as any other, or all if there are no more.

    Ids and texts don't matter, so null or repeated ones are neither all chosen
    nor all left out. Another dealing of the rows to partitions gives another
    sample.
    """
    n = rows.count()
    return rows if n <= most else rows.sample(most / n, seed=SEED)


def _counts(top: pa.Table, key: str, languages: list[str] | None) -> tuple[list[str], np.ndarray, list[str]]:
    """Keys, counts by language, and the languages, from (key, of: list of (lang, n))."""
    of = top["of"].combine_chunks()
    lang = of.values.field("lang").to_pylist()
    languages = languages or sorted(set(lang))
    number = {x: k for k, x in enumerate(languages)}
    at = np.array([number[x] for x in lang], dtype=np.int64)
    row = np.repeat(np.arange(len(of)), np.diff(of.offsets.to_numpy()))
    table = np.zeros((len(of), len(languages)))
    table[row, at] = of.values.field("n").to_numpy()
    return top[key].to_pylist(), table, languages


def _frequencies(table: np.ndarray) -> np.ndarray:
    logs = np.log((table + 0.1) / (table.sum(axis=0) + 0.1 * max(1, len(table))))
    return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def fit(labelled: DataFrame, most: int = SAMPLE, often: int = OFTEN) -> Model:
    """Learn from ``text`` and ``lang`` of ``labelled``; rows with a null in either don't count.

    Without any such row the model knows no language and predicts ``und``.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = sampled(rows.select("text", "lang"), most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1000):
            found: dict[str, Counter] = {}
            for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist()):
                found.setdefault(lang, Counter()).update(words_of(text))
            for lang, words in found.items():
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(words), "word": list(words), "n": pa.array(words.values(), pa.int64())}, schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    by_lang = rows.mapInArrow(count, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    by_lang = stored(by_lang, "words")  # read twice
    of = F.array_sort(F.collect_list(F.struct("lang", "n"))).alias("of")  # one entry for each language
    words = by_lang.groupBy("word").agg(F.sum("n").alias("total"), of).where(F.col("total") >= often).select("word", "of").toArrow()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for word, lang, n in zip(b["word"].to_pylist(), b["lang"].to_pylist(), b["n"].to_pylist()):
                for size in range(1, LONGEST + 1):
                    for g in grams_of(word, size):
                        found[g, lang] += n
            yield pa.RecordBatch.from_pydict({"gram": [g for g, _ in found], "lang": [lang for _, lang in found], "n": pa.array(found.values(), pa.int64())}, schema=pa.schema([("gram", pa.string()), ("lang", pa.string()), ("n", pa.int64())]))

    grams = by_lang.mapInArrow(cut, "gram string, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    grams = grams.groupBy("gram").agg(of).toArrow()
    if not grams.num_rows:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    keys, table, languages = _counts(grams, "gram", None)
    names, counts, _ = _counts(words, "word", languages)
    word_table = _frequencies(counts)
    # N-grams of each length have frequencies of their own.
    length = np.array(list(map(len, keys)))
    gram_table = np.zeros(table.shape, dtype=np.float32)
    for n in np.unique(length):
        gram_table[length == n] = _frequencies(table[length == n])
    return Model(languages, {w: k for k, w in enumerate(names)}, word_table, {g: k for k, g in enumerate(keys)}, gram_table)


ADDED = "lang_pred string, score double, n_words integer, n_known integer"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``n_words`` and ``n_known``.

    ``n_known`` words are known themselves or by n-grams of ``LONG`` letters or
    more; a low share of them means a language or letters never learned.

    Only ``text`` is looked at. A null text, or one without a letter, is
    ``und`` with score 0. Columns of ``docs`` named like the added ones are
    replaced; repeated rows give repeated results.
    """
    names = [p.split()[0] for p in ADDED.split(", ")]
    docs = docs.drop(*names)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in small(batches):
            got = [scorer.score(t) for t in b["text"].to_pylist()]
            added = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *names])

    schema = StructType(list(docs.schema.fields))
    for part in ADDED.split(", "):
        schema = schema.add(*part.split())
    return docs.mapInArrow(run, schema)
