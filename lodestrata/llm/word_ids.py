"""Ids of texts by a tokenizers file that drops blanks: each distinct word of a run of texts once, by its parts.

Most words are plain: letters of ASCII and Latin-1, digits and ASCII marks. What the file does to such a word (lower case, split into
letter runs, single digits, mark runs and English endings) is done here, for all words of a run in one go, and the library's merge model
sees each distinct part once while a bounded memory holds it, many in one call. All other words go through the whole library, likewise. A file of another make than that takes the library for all words;
`plain_as_expected` tells which by its stated normaliser and splitter.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# --- fixed values: the normaliser and the splitter of the file, as it states them ---
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# --- end of fixed values ---
#: Characters which NFC leaves alone and of which every engine knows the lower case and the kind; "<|" may begin a special token.
NOT_PLAIN = r"[^!-~À-ÖØ-öø-ÿ]|<\|"
#: Parts that go to the merge model as one text: in longer texts each takes more time.
JOINED = 100
#: Bytes of plain words: lower case (the second byte of a capital of Latin-1 is in 80-9E, its first is C3) and kind (0 letter, 1 digit, 2 mark).
LOWER = np.array([b + 32 if chr(b).isupper() and b < 128 or 0x80 <= b <= 0x9E else b for b in range(256)], np.uint8)
KIND = np.array([0 if b >= 128 or chr(b).isalpha() else 1 if chr(b).isdigit() else 2 for b in range(256)], np.uint8)
ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def plain_as_expected(spec: dict) -> bool:
    normalizer, splitter = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    first, *rest = splitter.get("pretokenizers") or [{}]
    return (
        normalizer.get("normalizers") == NORMALIZER
        and (first.get("pattern"), first.get("behavior"), first.get("invert")) == ({"Regex": SPLIT}, "Removed", True)
        and [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
        and spec.get("post_processor") is None
        and spec["model"]["type"] == "BPE"
        and not spec["model"].get("dropout")
    )


class Memory:
    """Two generations of up to `held` entries: what is asked for again moves into the newer one."""

    def __init__(self, held: int):
        self.held, self.known, self.older = held, {}, {}

    def missing(self, keys: set) -> list:
        """Those of keys that are not held; room is made for all of them."""
        new = keys.difference(self.known)
        if len(self.known) + len(new) > self.held:
            self.known, self.older = {}, self.known
            new = keys
        if not self.older:
            return list(new)
        again = {k: v for k in new if (v := self.older.get(k)) is not None}
        self.known.update(again)
        return [k for k in new if k not in again] if again else list(new)


def spread(found: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of found, in the order of which, end to end, and the count of each."""
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    ids, starts, per = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes, sizes[which]
    ends = np.cumsum(per)
    return ids[np.repeat(starts[which] - ends + per, per) + np.arange(int(ends[-1]) if len(ends) else 0)], per


def parts_of(words: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The parts of plain words in lower case, end to end, and how many of them come before each word, and before the end."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    held = words.buffers()[2]
    data = LOWER[np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)]
    offsets, kind, size = offsets - offsets[0], KIND[data], len(data)
    words_begin, begins = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
    words_begin[offsets] = True
    begins[1:size] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
    begins |= words_begin
    marks = np.flatnonzero((data == ord("'")) & begins[:-1])
    for ending in ENDINGS:  # they begin with different letters; one is its own part, whatever letters follow
        at = marks[marks + len(ending) < size]
        for k, letter in enumerate(ending, 1):
            at = at[(data[at + k] == letter) & ~words_begin[at + k]]
        begins[at + 1] = False
        begins[at + 1 + len(ending)] = True
    edges = np.flatnonzero(begins)
    return pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(data)), np.searchsorted(edges, offsets)


class WordIds:
    """Little-endian 32-bit ids of whole texts. Bounded by `held` parts of words, and as many words that are not plain, twice."""

    def __init__(self, path: str, held: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.library, self.words, self.parts, self.model = Tokenizer.from_file(path), Memory(held), Memory(held), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if plain_as_expected(spec):
            own = spec["model"]
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in own["merges"]]
            same = {k: own.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "unk_token") if own.get(k) is not None}
            self.model = Tokenizer(BPE(vocab=own["vocab"], merges=merges, cache_capacity=0, **same))
            self.model.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
            suffix = own.get("end_of_word_suffix")
            self.ends = np.zeros(max(own["vocab"].values()) + 1, bool)
            self.ends[[i for token, i in own["vocab"].items() if suffix and token.endswith(suffix)]] = True

    def _by_library(self, words: list[str]) -> Iterator[bytes]:
        for at in range(0, len(words), 20_000):
            for e in self.library.encode_batch_fast(words[at : at + 20_000], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()

    def _by_model(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of parts without blanks: joined by blanks they stay apart, and the last id of each is one that ends words."""
        for at in range(0, len(parts), 50 * JOINED):
            groups = [parts[first : first + JOINED] for first in range(at, min(at + 50 * JOINED, len(parts)), JOINED)]
            for some, e in zip(groups, self.model.encode_batch_fast(list(map(" ".join, groups)), add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
                if len(ends) != len(some):  # not a vocabulary with ends of words throughout
                    yield from self._by_library(some)
                    continue
                yield from map(ids.tobytes().__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist()))

    def _by_parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, end to end, and their counts by word."""
        parts, before = parts_of(words)
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := self.parts.missing(set(distinct)):
            self.parts.known.update(zip(new, self._by_model(new), strict=True))
        ids, sizes = spread(list(map(self.parts.known.__getitem__, distinct)), coded.indices.to_numpy())
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[before])

    def _by_word(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of other words, by the whole library."""
        words = words.to_numpy(zero_copy_only=False).tolist()
        if new := self.words.missing(set(words)):
            self.words.known.update(zip(new, self._by_library(new), strict=True))
        return spread(list(map(self.words.known.__getitem__, words)), np.arange(len(words)))

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, where each word's begin, and how many they are."""
        other = pc.match_substring_regex(words, NOT_PLAIN) if self.model else pa.array(np.ones(len(words), bool))
        sizes, starts, runs, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, "<u4")], 0
        for own, of in ((pc.invert(other), self._by_parts), (other, self._by_word)):
            if len(some := words.filter(own)):
                ids, counts = of(some)
                places = np.flatnonzero(own.to_numpy(zero_copy_only=False))
                sizes[places], starts[places] = counts, at + np.cumsum(counts) - counts
                runs.append(ids)
                at += len(ids)
        return np.concatenate(runs), starts, sizes

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Each text's ids as bytes."""
        for ids, counts in self.encode(pa.array(texts, pa.string())):
            ends = np.cumsum(counts)
            yield from (ids[e - c : e].astype("<u4").tobytes() for e, c in zip(ends, counts, strict=True))

    def encode(self, texts: pa.Array, most: int = 8 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of runs of texts, of about `most` bytes each, and their counts by text; null and empty texts have none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        sums = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        first = 0
        while first < len(texts):
            end = max(first + 1, int(np.searchsorted(sums, sums[first] + most, side="right")) - 1)
            yield self._run(texts.slice(first, end - first))
            first = end

    def _run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        ids, starts, sizes = self._distinct(coded.dictionary)
        per_word = sizes[which]
        ends = np.cumsum(per_word)
        out = ids[np.repeat(starts[which] - ends + per_word, per_word) + np.arange(int(ends[-1]) if len(ends) else 0)]
        by_text = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
        return out, np.diff(by_text)


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)
