"""SentencePiece encoding and decoding: an agenda of adjacent symbol pairs, by score, for merge-type vocabularies."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import slices

MARK = "▁"
#: Bytes of text whose ids are held as Python objects at once, unless one text is longer.
BATCH_BYTES = 1 << 20
#: Encoded segments that a task remembers; then it starts anew.
REMEMBERED = 1 << 19
#: Segments of at most so many characters keep their agenda as a list, or as a column beside others.
SHORT = 48
#: Symbols of all agendas that are worked off side by side.
CELLS = 1 << 18


#: What normal forms differ in: compatibility forms, marks, case, blanks of all kinds at all places.
_PROBE = "  a  \u3000ﬁ Ａ①½ é e\u0301 ñ\tX\r\n\xa0\u200b\u00ad…ß㌔ ▁ İ\x85\ufeff  "


class Remembered(dict):
    """Encoded segments, as tuples of numbers, which cost the collector nothing; long ones are not kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, segment: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = tuple(self.encode(segment))
        if len(segment) <= 64:
            self[segment] = ids
        return ids


class Agendas:
    """Agendas of many short segments, one column each, worked off side by side.

    A symbol is a piece or a character of one, as a number. A column holds a
    segment's symbols at the places where they begin, and for each the rank of
    the pair it begins, ``NEVER`` where their joint text is no piece. Each
    round merges the best pair of every column, the first of equal ones: the
    symbol of its second place goes, and the ranks of the pairs to the left
    and right of the joint one are looked up anew.
    """

    NEVER = np.iinfo(np.int32).max
    #: A place holds so many bits beside the rank.
    PLACE = SHORT.bit_length()

    def __init__(self, ids: dict[str, int], rank: dict[str, float], n: int, byte_ids: list[int]):
        self.n, self.byte_ids = n, byte_ids
        symbols = dict(ids)
        for c in sorted({c for t in ids for c in t}):
            symbols.setdefault(c, n + len(symbols) - len(ids))
        #: Symbols of what is no character of a piece, and of a place without one.
        self.other = n + len(symbols) - len(ids)
        self.gone = self.other + 1
        self.of_char = np.full(max((ord(c) for c in symbols if len(c) == 1), default=0) + 2, self.other, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        self.base = self.gone + 1
        order = {r: k for k, r in enumerate(sorted(set(rank.values())))}
        get, pairs = symbols.get, []
        for t, i in ids.items():
            for k in range(1, len(t)):
                if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None:
                    pairs.append((a * self.base + b, order[rank[t]], i))
        keys, ranks, joint = np.array(pairs, np.int64).reshape(-1, 3).T
        #: Pairs by a hash of theirs, in the first free slot from there on; an empty slot has the key -1.
        self.bits = max(len(keys), 1).bit_length() + 2
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, self.NEVER, np.int32)
        self.joint = np.full(1 << self.bits, self.gone, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]  # of several that want a slot the last stays
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = slot[left] + 1 & len(self.keys) - 1
        self.ranks[slot], self.joint[slot] = ranks << self.PLACE, joint
        #: Numbers as objects that all segments share.
        self.numbers = np.arange(n).astype(object)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of pairs, an empty one where there is no such pair."""
        keys = left.astype(np.int64) * self.base + right
        slot = self._slot(keys)
        found = self.keys[slot]
        far = np.flatnonzero((found != keys) & (found >= 0))
        while len(far):
            slot[far] = next_ = slot[far] + 1 & len(self.keys) - 1
            found = self.keys[next_]
            far = far[(found != keys[far]) & (found >= 0)]
        return slot

    def merged(self, segments: list[str], mark: str = "") -> Iterator[tuple[list[str], list[tuple[int, ...]]]]:
        """Segments with the ids they have behind a mark, some at a time; with the mark each has ``SHORT`` characters at most, and one at least."""
        segments = sorted(segments, key=len)
        i = 0
        while i < len(segments):
            size = len(segments[i]) + len(mark)
            j = min(i + max(CELLS // (size + 1), 1), len(segments))
            while len(segments[j - 1]) > 2 * size:  # columns of like length only
                j = i + (j - i) // 2
            yield segments[i:j], self._columns(segments[i:j], mark)
            i = j

    def _columns(self, segments: list[str], mark: str) -> list[tuple[int, ...]]:
        text = mark + mark.join(segments)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments)) + len(mark)
        w, high = len(segments), int(sizes.max())
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        column = np.repeat(np.arange(w), sizes)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # One row more, of places without a symbol, is what comes before the first place and after the last.
        symbol = np.full((high + 1) * w, self.gone, np.int32)
        symbol[place * w + column] = self.of_char[np.minimum(chars, len(self.of_char) - 1)]
        slot = self._pairs(symbol[:-w], symbol[w:])
        agenda = np.full((high + 1) * w, self.NEVER, np.int32)
        spot = np.repeat(np.arange(high + 1, dtype=np.int32), w)
        agenda[:-w] = self.ranks[slot] | spot[:-w]  # NEVER has all bits
        joint = np.full((high + 1) * w, self.gone, np.int32)
        joint[:-w] = self.joint[slot]
        after, before = np.arange(w, (high + 2) * w), np.arange(-w, high * w)
        rows = agenda.reshape(high + 1, w)
        while len(open_ := np.flatnonzero((best := rows.min(axis=0)) != self.NEVER)):
            p = (best[open_] & (1 << self.PLACE) - 1) * w + open_
            q, h = after[p], before[p]
            t = after[q]
            symbol[p], symbol[q], agenda[q] = joint[p], self.gone, self.NEVER
            after[p], before[t] = t, p
            first = np.concatenate([h, p])
            slot = self._pairs(symbol[first], symbol[np.concatenate([p, t])])
            agenda[first] = self.ranks[slot] | spot[first]
            joint[first] = self.joint[slot]
        grid = np.ascontiguousarray(symbol.reshape(high + 1, w).T).ravel()
        live = np.flatnonzero(grid != self.gone)
        flat, ends = grid[live], np.cumsum(np.bincount(live // (high + 1), minlength=w)).tolist()
        starts = [0, *ends[:-1]]
        numbers = self.numbers[np.minimum(flat, self.n - 1)].tolist()
        out = [tuple(numbers[a:b]) for a, b in zip(starts, ends)]
        odd = np.flatnonzero(flat >= self.n)[::-1]
        of, at = np.divmod(live[odd], high + 1)
        for i, k, x in zip(odd.tolist(), of.tolist(), chars[(np.cumsum(sizes) - sizes)[of] + at].tolist()):  # what is no piece stands in its bytes
            i -= starts[k]
            out[k] = (*out[k][:i], *[self.byte_ids[b] for b in chr(x).encode()], *out[k][i + 1 :])
        return out


class PieceCoder:
    """Encoder and decoder of a merge-type vocabulary with byte fallback, read from a model file.

    ``encode`` merges the adjacent pair of the best score first, the leftmost
    of equal ones, as long as a pair's joint text is a piece. No merge crosses
    a place that no piece spans, so a text is cut before each mark of a blank
    that follows another character, around control characters, and between a
    letter and a stop where no piece has both; equal segments are encoded once,
    and so are equal words between single blanks, which ``sure`` then holds
    against the library. ``learn`` works off the agendas of what is new in
    many texts side by side.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(n)]
        odd = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        if any(model.is_unused(i) for i in range(n)) or sum(map(model.is_byte, range(n))) != 256:
            raise ValueError("a vocabulary of the merge type with all 256 byte pieces and no unused ones is needed")
        self.ids = {t: i for i, t in enumerate(texts) if not odd[i]}
        self.rank = {t: -model.get_score(i) for t, i in self.ids.items()}
        self.byte_ids = [0] * 256
        #: What each id adds to a decoded text.
        self.out = [b""] * n
        for i, t in enumerate(texts):
            if model.is_byte(i):
                value = int(t[3:5], 16)
                self.byte_ids[value], self.out[i] = i, bytes([value])
            elif not odd[i]:
                self.out[i] = t.replace(MARK, " ").encode()
            elif model.is_unknown(i):
                self.out[i] = " ⁇ ".encode()
        self.marked = {i for t, i in self.ids.items() if t.startswith(MARK)}
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.bytes_of = {i: v for v, i in enumerate(self.byte_ids)}
        alone = "".join(re.escape(c) for c in "\n\t\r\x00" if not any(c in t and t != c for t in self.ids))
        after = {b for t in self.ids for a, b in zip(t, t[1:]) if a.isascii() and a.isalpha()}
        ends = "".join(re.escape(c) for c in ".,;:!?" if c not in after)
        self.by_word = not any(MARK in t.lstrip(MARK) for t in self.ids)
        if not self.by_word:  # a piece spans a mark behind another character
            self.cut = re.compile(f"[{alone}]|[^{alone}]+")
        else:
            word = f"{MARK}*[A-Za-z]++(?=[{ends}])|" if ends else ""
            self.cut = re.compile(f"{word}{MARK}*[^{MARK}{alone}]+|{MARK}+|[{alone}]")
        self.known, self.words = Remembered(self.merged), Remembered(self._word)
        self.agendas = Agendas(self.ids, self.rank, n, self.byte_ids)
        #: Words encoded since the last ``sure``, with their ids, and those that the library encodes otherwise.
        self.fresh: dict[str, list[int] | tuple[int, ...]] = {}
        self.wrong: set[str] = set()
        self.plain = model.normalize(_PROBE) == self._marked(_PROBE)

    def merged(self, segment: str) -> list[int]:
        """Ids of a segment by the agenda of its pairs."""
        out: list[int] = []
        for part in self._by_list(list(segment)) if len(segment) <= SHORT else self._by_heap(list(segment)):
            known = self.ids.get(part)
            if known is None:
                out += [self.byte_ids[b] for b in part.encode()]
            else:
                out.append(known)
        return out

    def _by_list(self, parts: list[str]) -> list[str]:
        """A short agenda, in the order of places: the first of the best pairs is found by a look at all."""
        rank, none = self.rank.get, float("inf")
        agenda = list(map(rank, map(add, parts, parts[1:]), repeat(none)))
        while agenda and (best := min(agenda)) != none:
            i = agenda.index(best)
            joint = parts[i] + parts[i + 1]
            parts[i : i + 2] = (joint,)
            agenda[i : i + 2] = (rank(joint + parts[i + 1], none),) if i + 1 < len(parts) else ()
            if i:
                agenda[i - 1] = rank(parts[i - 1] + joint, none)
        return parts

    def _by_heap(self, parts: list[str]) -> list[str]:
        """A long agenda as a heap; pairs of which a symbol has gone into another are passed over."""
        rank, n = self.rank, len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i, i + 1, 2) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            _, i, j, size = heappop(agenda)
            if after[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = k = after[j]
            after[j] = -1
            if k < n:
                before[k] = i
                if (r := rank.get(parts[i] + parts[k])) is not None:
                    heappush(agenda, (r, i, k, size + len(parts[k])))
            if (h := before[i]) >= 0 and (r := rank.get(parts[h] + parts[i])) is not None:
                heappush(agenda, (r, h, i, len(parts[h]) + size))
        return [part for part in parts if part]

    @staticmethod
    def _marked(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def normalized(self, texts: list[str]) -> list[str]:
        """Texts in the model's normal form, which for many models is the text with its blanks marked."""
        return [self._marked(t) for t in texts] if self.plain else self.model.normalize(texts)

    def _word(self, word: str) -> list[int]:
        """Ids of a word behind the mark of a blank, from those of its segments."""
        first, *rest = self.cut.findall(MARK + word)
        ids = self.merged(first) if not rest else [*self.words[first[1:]], *chain.from_iterable(map(self.known.__getitem__, rest))]
        self.fresh[word] = ids
        return ids

    def learn(self, texts: list[str]) -> None:
        """Remembers the ids of the words and segments of texts in normal form, as far as they are short and there is room."""
        words, segments = set(), set()
        for text in texts:
            if self._of_words(text):
                words.update(text[1:].split(MARK))
            else:
                segments.update(self.cut.findall(text))
        for new, ids in self._learnt(self.words, words, MARK):
            self.fresh.update(zip(new, ids))
        for _ in self._learnt(self.known, segments, ""):
            pass

    def _learnt(self, held: Remembered, met: set[str], mark: str) -> Iterator[tuple[list[str], list[tuple[int, ...]]]]:
        new: Iterable[str] = [x for x in met if x not in held]
        if len(held) + len(new) > REMEMBERED:
            held.clear()
            new = islice(met, REMEMBERED)
        for some, ids in self.agendas.merged([x for x in new if len(x) + len(mark) <= SHORT], mark):
            held.update(zip(some, ids))
            yield some, ids

    def _of_words(self, normalized: str) -> bool:
        """Whether each word of a text has one mark before it, and the text nothing else."""
        return self.by_word and normalized[:1] == MARK and normalized[-1:] != MARK and MARK * 2 not in normalized

    def sure(self, texts: list[str], normalized: list[str], decoded: list[str]) -> list[bool]:
        """Whether texts, encoded just before, have the library's ids and text by what is known of their words.

        A text of words between single blanks has the ids of its words, as no
        piece spans a mark behind another character. The library encodes
        each word that is new, and the ids must decode to the text itself.
        """
        self.fresh.pop("", None)
        words = list(self.fresh)
        for word, want in zip(words, self.model.encode(words, num_threads=1) if words else []):
            if list(self.fresh[word]) != want:
                self.wrong.add(word)
        self.fresh.clear()
        if len(self.wrong) >= REMEMBERED:  # not this kind of model
            self.plain = False
        return [self.plain and t == d and self._of_words(n) and not (self.wrong and self.wrong.intersection(n[1:].split(MARK))) for t, n, d in zip(texts, normalized, decoded)]

    def encode(self, normalized: str) -> list[int]:
        """Ids of a text in the model's normal form."""
        if self._of_words(normalized):
            return list(chain.from_iterable(map(self.words.__getitem__, normalized[1:].split(MARK))))
        return list(chain.from_iterable(map(self.known.__getitem__, self.cut.findall(normalized))))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the first blank that a text's start was given is dropped, bytes that are no UTF-8 become U+FFFD."""
        if ids and ids[0] in self.silent:
            ids = [i for i in ids if i not in self.silent]
        raw = b"".join(map(self.out.__getitem__, ids))
        if ids and ids[0] in self.marked:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids)

    def _decode_runs(self, ids: list[int]) -> str:
        out, i = [], 0
        while i < len(ids):
            j = i
            while j < len(ids) and ids[j] in self.bytes_of:
                j += 1
            if j > i:
                out.append(_replaced(bytes(self.bytes_of[x] for x in ids[i:j])))
                i = j
            else:
                out.append((self.out[ids[i]][1:] if i == 0 and ids[i] in self.marked else self.out[ids[i]]).decode())
                i += 1
        return "".join(out)


def _replaced(run: bytes) -> str:
    """A run of bytes as text, each byte that begins no whole character as U+FFFD."""
    out, i = [], 0
    while i < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[i : i + size].decode())
                i += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def _by_bytes(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, t in enumerate(texts):
        size = len(t.encode())
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(texts):
        yield start, len(texts)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``ids`` (array of int), ``decoded``, their text, and ``agrees``.

    Ids and text come from ``PieceCoder``. In the same batch the library
    encodes each word that the task has not met; texts that are not all words
    between single blanks, have a word that it encodes otherwise, or don't
    come back from their ids, it encodes and decodes as a whole. ``agrees`` is
    whether both are equal, and where they are not, the library's results
    stand in the row.

    A null text counts as empty (no ids, empty text), a null id is kept,
    repeated rows each get their row, an empty table gives no rows. Texts are
    never shortened; other columns are not read. Batches are cut by bytes of
    text, and one text is the least.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(model_path)
        model = coder.model
        for batch in slices(batches, 1024):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for i, j in _by_bytes(texts):
                held = texts[i:j]
                normalized = coder.normalized(held)
                coder.learn(normalized)
                ids = [coder.encode(x) for x in normalized]
                decoded = [coder.decode(x) for x in ids]
                agrees = coder.sure(held, normalized, decoded)
                if open_ := [k for k, ok in enumerate(agrees) if not ok]:
                    want = model.encode([held[k] for k in open_], num_threads=1)
                    for k, x, y in zip(open_, want, model.decode(want, num_threads=1)):
                        agrees[k] = ids[k] == x and decoded[k] == y
                        ids[k], decoded[k] = x, y
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], ["doc_id", "ids", "decoded", "agrees"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(code, "doc_id long, ids array<int>, decoded string, agrees boolean")


def decode_pieces(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id and ``decoded``, the text of its array of ids. A null array counts as empty; ids beyond the vocabulary are an error."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(model_path)
        for batch in slices(batches, 256):
            texts = [coder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(code, "doc_id long, decoded string")
