"""Language identification by segmentation-marginalised unigrams.

A text's words are its runs of letters in lower case. Each language has a probability for every piece of a fixed public
vocabulary of byte strings. A word's likelihood is the sum, by a forward algorithm, over all its segmentations into pieces, so no segmentation has to be chosen; pieces do not cross
words, and a text's log-likelihood is the sum of its words'. The probabilities are expected piece counts: a forward-backward
pass weighs all segmentations of every training word by START, one round of expectation maximisation from a
distribution that pays the same for every piece. Counts cover all training texts; they are smoothed by those of all languages.

The model has at most one number for each piece and language, so it is gathered on the driver and sent to the tasks.
"""

from __future__ import annotations

import base64
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from tallyforge.llm.shared import held, named_back, numbered, picked, place, with_python

#: Runs of letters (and numbers that are no digits, such as Roman ones).
LETTERS = re.compile(r"[^\W\d_]+").findall
#: log of what a piece costs before training.
START = -10.0
#: Weight of all languages' piece distribution in one language's, in pieces, and what every piece has at least, in parts of one.
SMOOTH, FLOOR = 200.0, 0.02
#: Words that a worker keeps with their likelihoods or counts, characters taken at once.
KEPT, CHARS = 300_000, 2_000_000
#: A likelihood ratio over the text counts as if of so many words at most, so that scores stay away from 0 and 1.
WORDS = 20


def vocabulary(path: str) -> dict[bytes, int]:
    """Piece -> number, from a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Worker:
    """What a Python worker keeps between tasks: the automaton that finds all pieces of the vocabulary, each with length * 2^32 +
    number, and the words that it has met with their likelihoods by one model: {word: row}, array [row, language]."""

    def __init__(self, path: str):
        import ahocorasick

        self.known = ahocorasick.Automaton()
        for t, k in vocabulary(path).items():
            self.known.add_word(t.decode("latin-1"), len(t) << 32 | k)
        self.known.make_automaton()
        self.model, self.rows, self.table = None, {}, None


def worker(path: str) -> Worker:
    return held(("langid", path), lambda: Worker(path))


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; false for a null doc_id, which is not learnt from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def words_of(text: str) -> list[str]:
    return LETTERS(text.lower())


def lattice(words: list[str], known):
    """All pieces in the words, as arrays (word, start, end, piece) in order of end; a space stands before each word."""
    import numpy as np

    found = chain.from_iterable(known.iter("\u0100".join([" " + x.encode().decode("latin-1") for x in words])))
    hits = np.fromiter(found, dtype=np.int64).reshape(-1, 2)
    starts = np.cumsum([0, *[len(x.encode()) + 2 for x in words[:-1]]])
    w = np.searchsorted(starts, hits[:, 0], side="right") - 1
    end = hits[:, 0] + 1 - starts[w]
    return by_end(w, end - (hits[:, 1] >> 32), end, hits[:, 1] & 0xFFFFFFFF)


def by_end(w, i, j, k):
    """The spans, which are in order of word, in order of end and word."""
    import numpy as np

    order = np.argsort(j.astype(np.int16) if len(j) and j.max() < 1 << 15 else j, kind="stable")
    return w[order], i[order], j[order], k[order]


def sums(n_words: int, spans, weights):
    """weights [piece, language] -> (logs, scales), arrays [place, word, language] and [place, word]: exp(scale) * value is the
    weight of all segmentations of the word's first bytes. Every place is scaled anew, so a word may have any length."""
    import numpy as np

    w, i, j, k = spans
    longest = int(j.max(initial=0))
    value, scale = np.zeros((longest + 1, n_words, weights.shape[1])), np.zeros((longest + 1, n_words))
    value[0] = 1.0
    cuts = np.searchsorted(j, np.arange(1, longest + 2))
    for end in range(1, longest + 1):
        a, b = cuts[end - 1], cuts[end]
        rows, starts = w[a:b], i[a:b]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        base = np.maximum.reduceat(scale[starts, rows], first)
        terms = value[starts, rows] * weights[k[a:b]] * np.exp(scale[starts, rows] - np.repeat(base, np.diff(np.append(first, b - a))))[:, None]
        total = np.add.reduceat(terms, first, axis=0)
        top = total.max(axis=1)
        value[end, rows[first]], scale[end, rows[first]] = total / top[:, None], base + np.log(top)
    return value, scale


def batches_of(words: list[str]) -> Iterator[list[str]]:
    """The words in order of length, in groups that need little memory."""
    group: list[str] = []
    for x in sorted(words, key=len):
        if group and (len(group) + 1) * (len(x) + 2) > 30_000:
            yield group
            group = []
        group.append(x)
    if group:
        yield group


def expected(words: list[str], times: list[int], known) -> tuple:
    """(pieces, counts): expected piece counts over all segmentations of the words, each piece weighing exp(START)."""
    import numpy as np

    w, i, j, k = spans = lattice(words, known)
    lengths = np.array([len(x.encode()) + 1 for x in words])
    each = np.full((int(k.max(initial=0)) + 1, 1), math.exp(START))
    value, scale = sums(len(words), spans, each)
    order = np.argsort(w, kind="stable")
    back = lengths[w] - j, lengths[w] - i  # the same sums from the words' ends
    value_b, scale_b = sums(len(words), by_end(w[order], back[0][order], back[1][order], k[order]), each)
    all_v, all_s = value[lengths[w], w, 0], scale[lengths[w], w]
    p = value[i, w, 0] * value_b[back[0], w, 0] / all_v * np.exp(scale[i, w] + scale_b[back[0], w] + START - all_s) * np.array(times)[w]
    n = np.bincount(k, weights=p)
    found = np.flatnonzero(n)
    return found, n[found]


def likelihoods(words: list[str], known, probabilities):
    """[word, language]: log-likelihood of each word, over all segmentations."""
    import numpy as np

    value, scale = sums(len(words), lattice(words, known), probabilities)
    ends = np.array([len(x.encode()) + 1 for x in words])
    rows = np.arange(len(words))
    with np.errstate(divide="ignore"):
        return np.maximum(np.log(value[ends, rows]), -700.0) + scale[ends, rows][:, None]


def counts(docs: DataFrame, vocab_path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, piece, n): expected piece counts of all texts with a language whose fold is not held out."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def settled() -> Iterator[pa.RecordBatch]:
            for name, n in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "word", "n"])
            found.clear()

        for b in batches:
            for x, name in zip((v.as_py() for v in b.column(0)), b.column(1).to_pylist()):
                found.setdefault(name, Counter()).update(words_of(x))
                if sum(map(len, found.values())) > KEPT:
                    yield from settled()
        yield from settled()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker(vocab_path).known
        gathered: dict[str, dict[int, float]] = {}
        for b in batches:
            by_lang: dict[str, dict[str, int]] = {}
            for name, word, n in zip(*[c.to_pylist() for c in b.columns]):
                by_lang.setdefault(name, {})[word] = n
            for name, n in by_lang.items():
                to = gathered.setdefault(name, {})
                for group in batches_of(list(n)):
                    for k, p in zip(*expected(group, [n[x] for x in group], known)):
                        to[int(k)] = to.get(int(k), 0.0) + float(p)
        for name, to in gathered.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(to), pa.string()), pa.array(list(to), pa.int32()), pa.array(list(to.values()), pa.float64())], ["lang", "piece", "n"])

    rows = picked(docs, doc_id=doc_id, text=text, lang=lang)
    train = rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    met = train.select("text", F.col("lang").cast("string")).mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return met.mapInArrow(pieces, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def fit(found: list, n_pieces: int):
    """rows (lang, piece, n) -> (languages in order, array [piece, language] of probabilities)."""
    import numpy as np

    langs = sorted({r["lang"] for r in found})
    table = np.zeros((n_pieces, len(langs)))
    for r in sorted(found, key=lambda r: (r["lang"], r["piece"])):
        table[r["piece"], langs.index(r["lang"])] = round(r["n"], 6)
    every = table.sum(axis=1) + 1e-6
    every = (1 - FLOOR) * every / every.sum() + FLOOR / n_pieces
    return langs, (table + SMOOTH * every[:, None]) / (table.sum(axis=0) + SMOOTH)


def predict(docs: DataFrame, langs: list[str], probabilities, vocab_path: str, text: str = "text") -> DataFrame:
    """docs with lang_pred and score. und and 0 for a text that is null or has no letter, or if no language was learnt.

    score is the best language's share of the likelihoods, each to the power min(1, WORDS / words of the text). Ties fall to
    the language first in code-point order. Very long texts are judged whole. Repeated rows are judged alike and kept; columns of
    docs named like a new one, in any case, are replaced.
    """
    model, model_id = docs.sparkSession.sparkContext.broadcast((langs, probabilities)), uuid.uuid4().hex

    def judge(texts: list) -> list[pa.Array]:
        import numpy as np

        langs, probabilities = model.value
        w = worker(vocab_path)
        if w.model != model_id:
            w.model, w.rows, w.table = model_id, {}, np.zeros((KEPT, len(langs)))

        def learn(words: set[str]) -> None:
            new = [x for x in words if x not in w.rows]
            if len(w.rows) + len(new) > KEPT:
                w.rows.clear()
                new = list(words)
            if len(new) > len(w.table):
                w.table = np.zeros((len(new), len(langs)))
            for group in batches_of(new):
                w.table[len(w.rows) : len(w.rows) + len(group)] = likelihoods(group, w.known, probabilities)
                w.rows.update(zip(group, range(len(w.rows), len(w.rows) + len(group))))

        def judged(texts: list[str | None]) -> list[tuple[str, float]]:
            cut = [words_of(x) if langs and x and any(map(str.isalpha, x)) else None for x in texts]
            learn(set().union(*filter(None, cut)))
            out = []
            for words in cut:
                if words is None:
                    out.append(("und", 0.0))
                    continue
                total = w.table[[w.rows[x] for x in words]].sum(axis=0)
                best = int(total.argmax())
                share = np.exp((total - total[best]) * min(1.0, WORDS / len(words)))
                out.append((langs[best], float(1 / share.sum())))
            return out

        out, at = [], 0
        while at < len(texts):  # texts of about CHARS at once
            start, size = at, 0
            while at < len(texts) and size < CHARS:
                size += len(texts[at] or "")
                at += 1
            out += judged(texts[start:at])
        return [pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())]

    return with_python(docs, text, StructType().add("lang_pred", StringType()).add("score", DoubleType()), judge, 2000)


def identify(docs: DataFrame, vocab_path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with held_out, lang_pred and score; learnt from text and lang of the documents that are not held out.

    Every row is kept, repeated ones too, and judged by its text alone. Null languages teach nothing. Columns of docs named
    like a new one, in any case, are replaced. The model, at most one number for each piece of the vocabulary and language,
    goes through the driver, so languages have to be a bounded set, as codes are.
    """
    found = counts(docs, vocab_path, doc_id, text, lang).collect()  # at most pieces times languages
    langs, probabilities = fit(found, 1 + max(vocabulary(vocab_path).values()))
    flat = numbered(docs).withColumn("held_out", held_out(F.col(f"c{place(docs, doc_id)}")))
    judged = predict(flat, langs, probabilities, vocab_path, f"c{place(docs, text)}")
    return named_back(judged, docs, ["held_out", "lang_pred", "score"])
