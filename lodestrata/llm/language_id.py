"""Language identification by a linear-chain conditional random field over words.

A word is a run of letters (ASCII letters and all non-ASCII characters, lower-cased); a chain is the words of a line, cut after
CHAIN words. Each word is scored per language by hashed affixes (first and last one to three bytes), byte trigrams and
a lexicon of the training sample's frequent words; learned transitions tie neighbours, so that a switch of language inside
a line costs what the sample shows. Forward-backward gives each word's label probabilities; a text's score for a language is
the mean over all its words, its prediction the best.

Training takes a bounded sample: about `per_lang` documents of each language, chosen by a hash of their id and text, twice that at
most, and `lines` pieces of each, drawn from all of its text: lines, and those over `span` characters in pieces of that length. Chains of several languages are made from them, since documents carry one label. Labels are learned from,
never read in prediction; scoring covers whole texts.

Defined results: a null text, or one without any letter, is `und` with score 0; without labelled rows all are. Ties go to the
language first in order. Rows are independent: repeated rows, null ids and further columns pass through as they are; a column
that has the name of an added one is refused with a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm._shared import byte_chunks, mixed, table, word_hashes, word_spans

CHAIN, SLOTS, LEXICON = 256, 1 << 16, 3000
AFFIXES = [(side, k) for side in ("first", "last") for k in (1, 2, 3)]


@dataclass
class Words:
    """The words of a chunk of lower-cased texts and what their scores are made of."""

    row: np.ndarray
    chain: np.ndarray  # of each word
    affixes: np.ndarray  # slots, by word
    trigrams: np.ndarray  # slots of all trigrams
    owner: np.ndarray  # word of each trigram
    hashes: np.ndarray


def slot(x: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(x.astype(np.uint64) * np.uint64(64) + np.uint64(kind)) >> np.uint64(48)).astype(np.int64)


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    letters = ((data >= 97) & (data <= 122)) | (data >= 128)
    starts, ends, row = word_spans(letters, offsets)
    n = len(starts)
    length = ends - starts
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    new = np.ones(n, bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(new)
    within = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    chain = np.cumsum(new | (within % CHAIN == 0)) - 1
    wide = data.astype(np.int64)
    affixes = np.empty((n, len(AFFIXES)), np.int64)
    for j, (side, k) in enumerate(AFFIXES):
        value = np.zeros(n, np.int64)
        for i in range(k):
            at = starts + i if side == "first" else ends - 1 - i
            value = np.where(i < length, value * 256 + wide[np.clip(at, 0, max(len(data) - 1, 0))] if len(data) else value, value * 256)
        affixes[:, j] = slot(value, j + 1)
    if len(data) >= 3:
        owner = np.full(len(data), -1, np.int64)
        mark = np.zeros(len(data), np.int64)
        mark[starts] = 1
        owner = np.cumsum(mark) - 1
        at = np.flatnonzero(letters[:-2] & letters[2:] & (owner[:-2] == owner[2:]))
        trigrams, owner = slot((wide[at] << 16) | (wide[at + 1] << 8) | wide[at + 2], 0), owner[at]
    else:
        trigrams = owner = np.zeros(0, np.int64)
    return Words(row, chain, affixes, trigrams, owner, word_hashes(data, starts, ends))


class Crf:
    def __init__(self, langs: list[str], known: np.ndarray):
        n = len(langs)
        self.langs, self.known = langs, np.sort(known)
        self.weights = np.zeros((SLOTS, n), np.float32)
        self.lexicon = np.zeros((len(known) + 1, n), np.float32)  # the last row is for unknown words
        self.moves = np.zeros((n, n), np.float32)

    def entries(self, words: Words) -> np.ndarray:
        at = np.searchsorted(self.known, words.hashes)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == words.hashes, at, len(self.known)) if len(self.known) else np.zeros(len(words.hashes), np.int64)

    def scores(self, words: Words, entries: np.ndarray) -> np.ndarray:
        out = self.lexicon[entries]
        for j in range(words.affixes.shape[1]):
            out += self.weights[words.affixes[:, j]]
        if len(words.owner):
            first = np.flatnonzero(np.diff(words.owner, prepend=-1))
            out[words.owner[first]] += np.add.reduceat(self.weights[words.trigrams], first, axis=0)
        return out

    def marginals(self, scores: np.ndarray, chain: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Label probabilities by forward-backward, all chains in step, the longest first; the expected moves too, if asked."""
        own = np.exp(scores - scores.max(1, keepdims=True)) + 1e-12
        move = np.exp(self.moves - self.moves.max())
        first = np.flatnonzero(np.diff(chain, prepend=-1))
        length = np.diff(np.append(first, len(chain)))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # chains longer than t
        ahead, back = np.empty_like(own), np.empty_like(own)
        for t in range(length[0]):
            at = first[: active[t]] + t
            a = own[at] if t == 0 else (a[: active[t]] @ move) * own[at]
            a /= a.sum(1, keepdims=True)
            ahead[at] = a
        expected = np.zeros_like(move) if pairs else None
        for t in range(length[0] - 1, -1, -1):
            at = first[: active[t]] + t
            b = np.ones((len(at), own.shape[1]), own.dtype)
            if t + 1 < length[0] and active[t + 1]:
                after = first[: active[t + 1]] + t + 1
                weight = own[after] * later
                if pairs:
                    both = ahead[at[: active[t + 1]]][:, :, None] * move[None] * weight[:, None, :]
                    expected += (both / both.sum((1, 2), keepdims=True)).sum(0)
                b[: active[t + 1]] = weight @ move.T
                b /= b.sum(1, keepdims=True)
            back[at] = later = b
        out = ahead * back
        return out / out.sum(1, keepdims=True), expected

    def learn(self, words: Words, labels: np.ndarray, epochs: int, batch: int, seed: int = 7) -> None:
        """Adagrad on the log-likelihood of labelled chains, with weight decay."""
        n = len(self.langs)
        params = [self.weights, self.lexicon, self.moves]
        squares = [np.full_like(p, 1e-3) for p in params]
        entries = self.entries(words)
        first = np.flatnonzero(np.diff(words.chain, prepend=-1))
        stop = np.append(first[1:], len(words.chain))
        t_stop = np.searchsorted(words.owner, np.arange(len(labels)), side="right")
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            starts = np.arange(0, len(first), batch)
            for s in rng.permutation(starts):
                e = min(s + batch, len(first)) - 1
                lo, hi = first[s], stop[e]
                t_lo, t_hi = (t_stop[lo - 1] if lo else 0), t_stop[hi - 1]
                part = Words(words.row[lo:hi], words.chain[lo:hi] - words.chain[lo], words.affixes[lo:hi], words.trigrams[t_lo:t_hi], words.owner[t_lo:t_hi] - lo, words.hashes[lo:hi])
                own = labels[lo:hi]
                prob, expected = self.marginals(self.scores(part, entries[lo:hi]), part.chain, True)
                off = -prob
                off[np.arange(hi - lo), own] += 1
                joined = part.chain[1:] == part.chain[:-1]
                seen = np.bincount(own[:-1][joined] * n + own[1:][joined], minlength=n * n).reshape(n, n)
                slots = np.concatenate([part.affixes.T.ravel(), part.trigrams])
                who = np.concatenate([np.tile(np.arange(hi - lo), part.affixes.shape[1]), part.owner])
                add = lambda at, rows, size: np.stack([np.bincount(at, rows[:, k], size) for k in range(n)], 1).astype(np.float32)
                grads = [add(slots, off[who], SLOTS), add(entries[lo:hi], off, len(self.lexicon)), (seen - expected).astype(np.float32)]
                for p, q, g in zip(params, squares, grads, strict=True):
                    g = g / (hi - lo) - 1e-6 * p
                    q += g * g
                    p += 0.5 * g / np.sqrt(q)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names: list[str] = []
        scores: list[np.ndarray] = []
        for _, _, data, offsets in byte_chunks(pc.utf8_lower(texts)):
            n = len(offsets) - 1
            words = read_words(data, offsets)
            mean = np.zeros((n, len(self.langs)))
            if len(words.row):
                prob, _ = self.marginals(self.scores(words, self.entries(words)), words.chain)
                for k in range(len(self.langs)):
                    mean[:, k] = np.bincount(words.row, prob[:, k], n)
                mean /= np.maximum(np.bincount(words.row, minlength=n), 1)[:, None]
            best = mean.argmax(1)
            ascii_letter = np.zeros(n, bool)
            ascii_letter[words.row[np.maximum.reduceat((data >= 97) & (data <= 122), word_firsts(data, offsets))] if len(words.row) else []] = True
            for i in range(n):
                sure = ascii_letter[i] or (mean[i].any() and any(map(str.isalpha, bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8"))))
                names.append(self.langs[best[i]] if sure else "und")
                if not sure:
                    mean[i] = 0
            scores.append(mean.max(1))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def word_firsts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return word_spans(((data >= 97) & (data <= 122)) | (data >= 128), offsets)[0]


def held_out(doc_id: str) -> Column:
    """Rows that training never sees: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_lang: int = 300, lines: int = 8, span: int = 2000, epochs: int = 6, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Crf | None:
    """A model from a sample of about per_lang documents a language, 2 * per_lang at most. None without labelled rows."""
    counts = {r[0]: r[1] for r in docs.where(F.col(lang).isNotNull()).groupBy(lang).count().collect()}  # a row per language
    langs = sorted(counts)
    if not langs:
        return None
    draw = F.pmod(F.xxhash64(doc_id, text), F.lit(1 << 30))
    chance = F.create_map(*[F.lit(x) for k in langs for x in (k, max(1, min(1 << 30, int(per_lang / counts[k] * (1 << 30)))))])
    sample = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (draw < F.element_at(chance, F.col(lang))))
    # the bound holds whatever repeats: few rows are left here, and of them the first by draw
    first = F.row_number().over(W.partitionBy("lang").orderBy("_draw", F.xxhash64("text")))
    sample = sample.select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("_draw")).withColumn("_place", first).where(F.col("_place") <= 2 * per_lang)
    parts = F.regexp_extract_all("text", F.lit(rf"[^\n]{{1,{span}}}"), F.lit(0))
    some = F.slice(F.array_sort(F.transform(parts, lambda line, i: F.struct(F.xxhash64(line, i).alias("h"), line.alias("line")))), 1, lines)
    rows = sorted(sample.select("lang", F.col("_draw").alias("draw"), F.transform(some, lambda x: x["line"]).alias("lines")).collect(), key=lambda r: (r["lang"], r["draw"], r["lines"]))
    by = {k: [x for r in rows if r["lang"] == k for x in r["lines"]] for k in langs}
    rng = np.random.default_rng(5)
    pool = [(line, i) for i, k in enumerate(langs) for line in by[k]]
    pool = [pool[i] for i in rng.permutation(len(pool))]
    chains: list[list] = []
    for line, i in pool:
        if chains and rng.random() < 0.2:  # a switch inside the line
            chains[-1].append((line, i))
        else:
            chains.append([(line, i)])
    texts = [" ".join(line for line, _ in own) for own in chains]
    array = pc.utf8_lower(pa.array(texts or [""], pa.large_string()))
    (chunk,) = byte_chunks(array, 1 << 40)
    words = read_words(chunk[2], chunk[3])
    if not len(words.row):
        return None
    marks = []
    for own in chains:
        for line, i in own:
            one = pc.utf8_lower(pa.array([line], pa.large_string()))
            marks.append(np.full(sum(len(word_firsts(d, o)) for _, _, d, o in byte_chunks(one)), i))
    mark = np.concatenate(marks)
    values, count = np.unique(words.hashes, return_counts=True)
    model = Crf(langs, values[np.argsort(-count, kind="stable")[:LEXICON]])
    model.learn(words, mark, epochs, 64)
    return model


def identify(docs: DataFrame, model: Crf | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language of each whole text and its score."""
    added = [T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())]
    kept = docs.schema.fields
    if clash := sorted({lang_pred, score} & set(docs.columns)):
        raise ValueError(f"columns {clash} are there already; give other names")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if own is None:
                names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                names, scores = own.predict(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], [f.name for f in kept + added])

    return docs.mapInArrow(run, T.StructType(kept + added))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out("doc_id")))
    return identify(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model).drop("text")
