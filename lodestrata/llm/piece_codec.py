"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte fallback.

Encoding is by a score-ordered agenda: all adjacent symbol pairs whose union is a piece stand in it by (score, place); the best
is merged and its new neighbours enter, until the agenda is empty. Short segments, nearly all, have a row of ranks as agenda and
are merged in step by array operations; longer ones have a heap, where pairs whose symbols have changed are passed over.
Symbols that are no piece become bytes. No piece crosses the start of a run of blanks or a newline, which `Vocabulary`
verifies, so a text's segments are encoded apart and each distinct one once per task while a bounded memory holds it.

New segments of each Arrow batch are also encoded by the sentencepiece library; a difference raises `Disagreement`.

Defined results: a null or empty text has no ids and decodes to the empty text. Any text is encoded whole, whatever its length.
Rows are independent: repeated rows, null ids and further columns pass through as they are. A column that has the name of an
added one is refused with a ValueError; `prefix` gives the added ones other names.
The model's path is a parameter; it must be readable where tasks run, as installed packages are.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestrata.llm._shared import table

SPACE = "▁"
#: Segments of up to so many characters are encoded in step.
WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32)
NEVER = np.iinfo(np.int32).max
RUNS = re.compile("▁+[^▁\n]*|\n[^▁\n]*|[^▁\n]+")


class Disagreement(ValueError):
    """The agenda and the library gave different ids for a segment."""


class Vocabulary:
    """Pieces, scores and byte ids of a model file, with the encoder and decoder over them."""

    def __init__(self, path: str, held: int = 250_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: self.library.get_score(i) for i in plain}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if self.library.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items() if b >= 128}  # those that take others to make a character
        self.unknown = self.library.unk_id()
        crossing = [p for p in self.ids if "\n" in p or SPACE in p.lstrip(SPACE)]
        if crossing or self.library.normalize(" AÅ ﬁ") != "▁▁AÅ▁ﬁ":
            raise ValueError("only vocabularies without normalisation whose pieces start no run of blanks inside are handled")
        self.texts = [p.replace(SPACE, " ") for p in self.pieces]
        for i in range(size):
            if self.library.is_control(i):
                self.texts[i] = ""
            elif self.library.is_unknown(i):
                self.texts[i] = " ⁇ "
        for b, i in self.bytes.items():
            if b < 128:
                self.texts[i] = chr(b)
        self.digits = [f"{i}," for i in range(size)]
        self.held, self.known, self.older, self.digests = held, {}, {}, False
        self._tabulate()

    def _tabulate(self) -> None:
        """The symbols (pieces, and characters of pieces) by number, and the pairs of symbols that make a piece."""
        number = dict(self.ids)
        for c in sorted(set("".join(self.ids))):
            number.setdefault(c, len(self.pieces) + len(number))
        self.symbol = np.full(0x110000, -1, np.int32)
        for c, i in number.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        self.base = max(number.values(), default=0) + 1
        pairs = {number[p[:k]] * self.base + number[p[k:]]: i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        falling = sorted({-x for x in self.scores.values()})
        rank = dict(zip(falling, range(len(falling)), strict=True))
        self.pair_ranks = np.array([rank[-self.scores[self.pieces[i]]] for i in self.pair_ids.tolist()], np.int32)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (least for the highest score) and id of the piece of two symbols; rank NEVER where there is none."""
        if not len(self.pair_keys):
            return np.full(left.shape, NEVER, np.int32), np.zeros(left.shape, np.int32)
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_ranks[at], NEVER).astype(np.int32), self.pair_ids[at]

    def merge_all(self, segments: list[str]) -> list[list[int]]:
        """The ids of each segment. The agendas of segments of like length are worked off in step; `merge` takes the others."""
        out: list = [None] * len(segments)
        length = np.fromiter(map(len, segments), np.int64, len(segments))
        least = 0
        for width in WIDTHS:
            own = np.flatnonzero((length > least) & (length <= width))
            least = width
            if len(own):
                for i, ids in zip(own.tolist(), self._in_step([segments[i] for i in own.tolist()], length[own], width), strict=True):
                    out[i] = ids
        return [list(self.merge(s)) if ids is None else ids for s, ids in zip(segments, out, strict=True)]

    def _in_step(self, segments: list[str], length: np.ndarray, width: int) -> list[list[int] | None]:
        """Ids of segments of up to `width` characters; None where a character or a last symbol is no piece.

        A segment's agenda is a row of ranks by place: the least, and of equals the first, is the next to merge.
        """
        n, stride = len(segments), width + 2  # a place without symbol stands at both ends
        place = np.arange(stride)
        alive = (place > 0) & (place <= length[:, None])
        symbols = np.full((n, stride), -1, np.int32)
        symbols[alive] = self.symbol[np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")]
        strange = (alive & (symbols < 0)).any(1)
        ranks, made = np.full((n, stride), NEVER, np.int32), np.zeros((n, stride), np.int32)
        ranks[:, :-1], made[:, :-1] = self.pair(symbols[:, :-1], symbols[:, 1:])
        after, before = np.arange(1, n * stride + 1), np.arange(-1, n * stride - 1)
        rows = np.flatnonzero(~strange)
        symbols, lives, made, flat = symbols.ravel(), alive.ravel(), made.ravel(), ranks.ravel()
        while len(rows):
            some = ranks[rows]
            best = some.argmin(1)
            go = some[np.arange(len(rows)), best] != NEVER
            rows, best = rows[go], best[go]
            i = rows * stride + best
            j, h = after[i], before[i]
            k = after[j]
            symbols[i] = made[i]
            lives[j], flat[j] = False, NEVER
            after[i], before[k] = k, i
            flat[i], made[i] = self.pair(symbols[i], symbols[k])
            flat[h], made[h] = self.pair(symbols[h], symbols[i])
        ids = symbols[lives]
        ends = np.cumsum(lives.reshape(n, stride).sum(1))
        if len(ids):
            strange |= np.maximum.reduceat(ids, np.concatenate([[0], ends[:-1]])) >= len(self.pieces)  # each segment has a symbol at least
        whole, stops = ids.tolist(), ends.tolist()
        return [None if odd else whole[a:b] for a, b, odd in zip([0, *stops[:-1]], stops, strange.tolist(), strict=True)]

    def merge(self, segment: str) -> tuple[int, ...]:
        """The ids of a segment, by the agenda."""
        symbols: list = list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        scores = self.scores
        agenda = [(-scores[p], i, i + 1, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in scores]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            left, right = symbols[i], symbols[j]
            if left is None or right is None or left + right != piece:  # changed since it entered
                continue
            symbols[i], symbols[j] = piece, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (p := piece + symbols[k]) in scores:
                    heapq.heappush(agenda, (-scores[p], i, k, p))
            h = before[i]
            if h >= 0 and (p := symbols[h] + piece) in scores:
                heapq.heappush(agenda, (-scores[p], h, i, p))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                if (i := self.ids.get(s)) is not None:
                    out.append(i)
                elif self.bytes:
                    out.extend(self.bytes[b] for b in s.encode("utf-8"))
                else:
                    out.append(self.unknown)
        return tuple(out)

    def segments(self, text: str) -> list[str]:
        """Segments start at runs of blanks and at newlines; a dummy blank stands before the text."""
        marked = SPACE + text.replace(" ", SPACE)
        if SPACE * 2 in marked or SPACE in text:
            return RUNS.findall(marked)
        return marked.replace("\n", "\u0000\n").replace(SPACE, "\u0000" + SPACE)[1:].split("\u0000") if "\u0000" not in text else RUNS.findall(marked)

    def learn(self, segments: set[str], check: bool) -> None:
        """Encode segments not yet known, and compare with the library.

        Two generations of at most `held` segments are kept: when one is full it becomes the older one, whose segments come
        back as they are met again.
        """
        new = [s for s in segments if s not in self.known]
        if len(self.known) + len(new) > self.held:
            self.known, self.older = {}, self.known
            new = list(segments)
        if self.older:
            again = {s: ids for s in new if (ids := self.older.get(s)) is not None}
            self.known.update(again)
            new = [s for s in new if s not in again]
        for at in range(0, len(new), 20_000):
            self._learn_new(new[at : at + 20_000], check)

    def _learn_new(self, new: list[str], check: bool) -> None:
        ids = self.merge_all(new)
        if check and new:
            # the library puts a blank before a text: it stands for the segment's own, or comes on top of a newline's segment;
            # a blank alone it cannot be asked for
            blank = self.ids.get(SPACE, self.unknown)
            asked = self.library.encode([s[1:] if s[0] == SPACE else s for s in new], num_threads=1)
            for s, own, theirs in zip(new, ids, asked, strict=True):
                if s != SPACE and theirs != (own if s[0] == SPACE else [blank, *own]):
                    raise Disagreement(repr(s))
        if self.digests:
            self.known.update((s, ("".join([self.digits[i] for i in own]), self.plain(own))) for s, own in zip(new, ids, strict=True))
        else:
            self.known.update((s, (array("i", own).tobytes(), self.plain(own))) for s, own in zip(new, ids, strict=True))

    def code_all(self, texts: list[str | None], check: bool = True, digests: bool = False) -> Iterator[tuple[bytes | str, str]]:
        """The ids of each text, as 32-bit integers or (digests) each in digits with a comma, and the text they decode to.

        Segments of about 2 MB of texts are learned at a time. Bytes of a character never part over segments, so segments decode apart.
        """
        if digests != self.digests:
            self.forget()
            self.digests = digests
        none = "" if digests else b""
        first = 0
        while first < len(texts):
            end, weight = first, 0
            while end < len(texts) and (end == first or weight < 2_000_000):
                weight += len(texts[end] or "")
                end += 1
            cut = [self.segments(t) if t else [] for t in texts[first:end]]
            self.learn(set(chain.from_iterable(cut)), check)
            for own in cut:
                if own:
                    ids, back = zip(*map(self.known.__getitem__, own), strict=True)
                    back = "".join(back)
                    yield none.join(ids), back[1:] if own[0][0] == SPACE else back  # without the dummy blank
                else:
                    yield none, ""
            first = end

    def encode_all(self, texts: list[str | None], check: bool = True) -> Iterator[list[int]]:
        """The ids of each text."""
        for raw, _ in self.code_all(texts, check):
            yield array("i", raw).tolist()

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def plain(self, ids: list[int]) -> str:
        """The text of ids with the dummy blank: pieces joined, runs of byte ids read as UTF-8."""
        return "".join([self.texts[i] for i in ids]) if self.byte_of.keys().isdisjoint(ids) else self._with_bytes(ids)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the dummy blank."""
        out = self.plain(ids)
        first = next((i for i in ids if self.texts[i] or i in self.byte_of), None)  # marks without text do not count
        return out[1:] if first is not None and self.pieces[first].startswith(SPACE) else out

    def _with_bytes(self, ids: list[int]) -> str:
        raw = bytearray()
        out: list[str] = []
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(lenient(bytes(raw)))
                raw.clear()
            out.append(self.texts[i])
        return "".join(out) + (lenient(bytes(raw)) if raw else "")


codecs.register_error("each_byte", lambda e: ("\ufffd", e.start + 1))


def lenient(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that starts no valid character."""
    return raw.decode("utf-8", "each_byte")


def sha256(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One per worker process, kept from task to task."""
    return Vocabulary(path)


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", ids: bool = True, digests: bool = False, check: bool = True, prefix: str = "", keep: bool = True) -> DataFrame:
    """docs with columns n_tokens, and ids and decoded, or their digests ids_sha256 and decoded_sha256, under `prefix`.

    keep: a worker process holds its segments from task to task, which is faster; without, memory is let go with each task.
    """
    added = [T.StructField(f"{prefix}n_tokens", T.LongType())]
    if ids:
        added += [T.StructField(f"{prefix}ids", T.ArrayType(T.IntegerType())), T.StructField(f"{prefix}decoded", T.StringType())]
    if digests:
        added += [T.StructField(f"{prefix}ids_sha256", T.StringType()), T.StructField(f"{prefix}decoded_sha256", T.StringType())]
    kept = docs.schema.fields
    if clash := sorted({a.name for a in added} & set(docs.columns)):
        raise ValueError(f"columns {clash} are there already; give a prefix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
                columns += digested(own, texts) if digests and not ids else listed(own, texts)
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept + added])
        if not keep:
            own.forget()

    def digested(own: Vocabulary, texts: list[str | None]) -> list[pa.Array]:
        rows = [(found.count(","), sha256(found[:-1]), sha256(back)) for found, back in own.code_all(texts, check, digests=True)]
        return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]

    def listed(own: Vocabulary, texts: list[str | None]) -> list[pa.Array]:
        raw, back = zip(*own.code_all(texts, check), strict=True)
        ends = np.cumsum([0, *[len(r) // 4 for r in raw]])
        values = np.frombuffer(b"".join(raw), np.int32)
        columns = [pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)), pa.array(back, pa.string())]
        if digests:
            columns += [pa.array([sha256(",".join(map(str, values[a:b].tolist()))) for a, b in zip(ends, ends[1:], strict=False)]), pa.array(list(map(sha256, back)))]
        return columns if ids else columns[:1] + columns[3:]

    return docs.mapInArrow(run, T.StructType(kept + added))


def op1_piece_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=False, digests=True).drop("text")
