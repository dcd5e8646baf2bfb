"""Encoding of whole Arrow batches by cutting texts into units that the tokenizer treats independently.

A unit boundary is set only where no pre-token of the vocabularies in use can span it: before a blank or newline that
follows a character that is certainly not white space, after a lone newline before a visible ASCII character, and
between a Latin letter and a following comma or full stop. Each distinct unit of a batch is looked up once; the library
encodes the ones this worker has not met, so ids are exactly the library's, and texts of any length are split safely.
"""

from __future__ import annotations

import ctypes
import itertools
import os
import re

import numpy as np
import pyarrow as pa

#: Units that one Python worker keeps, of KEPT_CHARS code points at most: some 200 bytes each, 50 MB in all. Beyond it
#: those go that were met in one block only.
KEPT_UNITS = 250_000
KEPT_CHARS = 48
#: Bytes of text that are encoded at once (one text at least), bytes whose boundaries are sought at once, and units
#: that are looked up at once: so a very long text takes no more working memory than a block.
BLOCK_BYTES, WINDOW, CHUNK = 2 << 20, 1 << 20, 1 << 18

#: Units handed to the library in one call, and how many of these make one text.
TOGETHER, JOINED = 8192, 256

#: A unit of visible characters, after one blank at most, without the mark; and one of Latin letters only, which is one
#: pre-token of the vocabularies in use.
_PLAIN = re.compile(r" ?[^\s\x01]+").fullmatch
_WORD = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+").fullmatch

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_WIDE_SPACE_LEAD = np.zeros(256, bool)
_WIDE_SPACE_LEAD[[0xE1, 0xE2, 0xE3]] = True


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted starts of units, with len(data) at the end; each text's start is one. The rules look at three bytes before
    a place and at one after it, so windows that overlap by these give what the whole would."""
    found, n = [], len(data)
    for a in range(0, n, WINDOW):
        low, high = max(0, a - 4), min(n, a + WINDOW + 2)
        own = np.flatnonzero(_cuts(data[low:high], offsets[(offsets >= low) & (offsets < high)] - low)) + low
        found.append(own[(own >= a) & (own < a + WINDOW)])
    return np.append(np.concatenate(found) if found else np.zeros(0, np.int64), n)


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 1:
        here, before = data[1:], data[:-1]
        second, third = np.zeros(n - 1, np.uint8), np.zeros(n - 1, np.uint8)
        second[1:], third[2:] = data[:-2], data[:-3]
        newline = here == 10
        visible = (before > 32) & (before != 127) & ((before < 128) | ((second != 0xC2) & ~_WIDE_SPACE_LEAD[third]))
        cut[1:] = (newline | (here == 32)) & visible
        # Where a text begins with the newline, what lies before it belongs to another text; the next rule needs its own.
        cut[2:] |= (newline & visible)[:-1] & (data[2:] > 32) & (data[2:] < 127)
        accented = (second == 0xC3) & (before != 0x97) & (before != 0xB7)
        cut[1:] |= ((here == 44) | (here == 46)) & (_LETTER[before] | accented)
    cut[offsets] = True
    return cut


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer | None]:
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), None
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[0]:
        texts = pa.array(texts.to_pylist(), pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    if not offsets[-1]:
        return np.zeros(0, np.uint8), offsets, None
    return np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]], offsets, texts.buffers()[2]


def distinct_units(starts: np.ndarray, buffer: pa.Buffer) -> tuple[list[str], np.ndarray]:
    """The distinct units in order of appearance, and for each unit its place among them."""
    units = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(np.ascontiguousarray(starts, np.int64)), buffer)
    coded = units.dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices)


def gathered(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[begin[i] : begin[i] + length[i]] for all i, one after the other."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return flat[np.repeat(begin - (ends - length), length) + np.arange(total)]


class UnitEncoder:
    """Encodes Arrow string arrays with a tokenizers file; keeps what it learnt for later batches of the worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A control character is a pre-token of its own; white space around it keeps it apart from any unit.
        self.between = "\n\x01\n"
        own = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.mark, self.around = own[len(own) // 2], len(own) - 1
        self._word_form()
        self._reset()

    def _word_form(self) -> None:
        """How a unit of letters reaches the model: as bytes in the byte-level alphabet, after the sign of a blank or without
        it, in lower case or not. Seen from probes; if these fit no such form, all units go through the whole library."""
        alphabet = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]  # these stand for themselves
        others = [c for c in range(256) if c not in set(alphabet)]
        self.table = dict(zip([*alphabet, *others], [*alphabet, *range(256, 256 + len(others))]))
        self.sign = chr(self.table[32])
        normalizer, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        probes = ["a", " a", " aZ", "ZaZ", " \u00c9\u00e9\u00df\u00ff", "\u00c0\u00d6\u00d8\u00f6", " Es's"]
        seen = [[x for x, _ in split.pre_tokenize_str(normalizer.normalize_str(p) if normalizer else p)] for p in probes] if split else []
        self.words = False
        for blank, lower in itertools.product((True, False), repeat=2):
            self.blank, self.lower = blank, lower
            if seen and all(x == [self._as_model_sees(p)] for x, p in zip(seen[:-1], probes[:-1])):
                self.words = True
                return

    def _as_model_sees(self, unit: str) -> str:
        unit = unit if self.blank else unit.lstrip(" ")
        unit = unit.lower() if self.lower else unit
        return unit.replace(" ", self.sign) if unit.isascii() else unit.encode().decode("latin-1").translate(self.table)

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.begin, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.met = np.zeros(1 << 16, np.uint8)  # blocks in which a unit was met, up to 2
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def _forget(self) -> None:
        """Keep the units met in several blocks, unless these are most of the table; they have to be met again to stay longer."""
        names = [u for u, k in self.place.items() if self.met[k] > 1]
        if len(names) > KEPT_UNITS // 2:
            return self._reset()
        old = np.asarray([self.place[u] for u in names], np.int64)
        length = self.length[old]
        flat = gathered(self.flat, self.begin[old], length)
        self._reset()
        self._add(names, flat, length)

    def _library(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units and the number in each. Words go to the library's model, other plain units are encoded many at
        once, with a mark between them, the rest one by one; so many in a call that what it returns stays small."""
        parts = [self._some(units[i : i + TOGETHER]) for i in range(0, len(units), TOGETHER)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _some(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        kinds = np.asarray([0 if self.words and _WORD(u) else 1 if _PLAIN(u) else 2 for u in units])
        lengths, ids = np.zeros(len(units), np.int64), []
        model = self.tokenizer.model
        each = [[t.id for t in model.tokenize(self._as_model_sees(u))] for u, k in zip(units, kinds) if k == 0]
        lengths[kinds == 0] = [len(x) for x in each]
        ids.append(np.fromiter(itertools.chain.from_iterable(each), np.uint32))
        ids.append(np.zeros(0, np.uint32))
        if together := [u for u, k in zip(units, kinds) if k == 1]:
            joined = [self.between.join(["", *together[i : i + JOINED], ""]) for i in range(0, len(together), JOINED)]
            flat = np.concatenate([np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            marks = np.flatnonzero(flat == self.mark)
            sizes = np.diff(marks) - 1 - self.around
            kept = np.ones(len(flat), bool)
            kept[marks] = False
            if self.around:
                kept[marks - 1] = kept[marks + 1] = False
            ends = np.cumsum([min(JOINED, len(together) - i) + 1 for i in range(0, len(together), JOINED)])[:-1] - 1
            lengths[kinds == 1] = np.delete(sizes, ends)  # between two inputs there is no unit
            ids[1] = flat[kept]
        each = [e.ids for e in self.tokenizer.encode_batch_fast([u for u, k in zip(units, kinds) if k == 2], add_special_tokens=False)]
        lengths[kinds == 2] = [len(x) for x in each]
        ids.append(np.fromiter(itertools.chain.from_iterable(each), np.uint32))
        mixed, of = np.zeros(int(lengths.sum()), np.uint32), np.repeat(kinds, lengths)
        for k in range(3):
            mixed[of == k] = ids[k]
        return mixed, lengths

    def _add(self, units: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        at, count = len(self.place), len(units)
        while at + count > len(self.begin):
            self.begin, self.length, self.met = (np.concatenate([x, x * 0]) for x in (self.begin, self.length, self.met))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[at : at + count] = lengths
        self.begin[at : at + count] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.place.update(zip(units, range(at, at + count)))

    def _ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and for each of the distinct units where its own begin there and how many they are."""
        places = np.fromiter(map(self.place.get, units, itertools.repeat(-1)), np.int64, len(units))
        known = places >= 0
        self.met[places[known]] = np.minimum(self.met[places[known]] + 1, 2)
        begin, length = np.where(known, self.begin[places], 0), np.where(known, self.length[places], 0)
        missing = np.flatnonzero(~known)
        if not len(missing):
            return self.flat, begin, length
        fresh = [units[k] for k in missing.tolist()]
        ids, lengths = self._library(fresh)
        flat = np.concatenate([self.flat[: self.used], ids])
        begin[missing], length[missing] = self.used + np.cumsum(lengths) - lengths, lengths
        short = np.asarray([len(u) <= KEPT_CHARS for u in fresh])
        if len(self.place) + int(short.sum()) > KEPT_UNITS:
            self._forget()
        if (kept := int(short.sum())) <= KEPT_UNITS - len(self.place):
            self._add([u for u, s in zip(fresh, short) if s], ids[np.repeat(short, lengths)], lengths[short])
            self.met[len(self.place) - kept : len(self.place)] = 1
        return flat, begin, length

    def _blocks(self, texts: pa.Array):
        """For runs of consecutive texts their bounds in bytes, and chunks of their units: where these begin, ids, begins and lengths."""
        data, offsets, buffer = text_bytes(texts)
        at = 0
        while at < len(offsets) - 1:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
            own = offsets[at : to + 1]
            starts = unit_starts(data[own[0] : own[-1]], own - own[0])
            yield own - own[0], self._chunks(starts, own[0], buffer)
            at = to

    def _chunks(self, starts: np.ndarray, base: int, buffer: pa.Buffer | None):
        for a in range(0, len(starts) - 1, CHUNK):
            part = starts[a : a + CHUNK + 1]
            units, which = distinct_units(part + base, buffer)
            flat, begin, length = self._ids(units)
            yield part[:-1], flat, begin[which], length[which]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text (null: none)."""
        out = []
        for own, chunks in self._blocks(texts):
            total = np.zeros(len(own), np.int64)
            for starts, _, _, length in chunks:
                sums = np.concatenate([[0], np.cumsum(length)])
                total += sums[np.searchsorted(starts, own)]
            out.append(np.diff(total))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def encode(self, texts: pa.Array):
        """Yields, for runs of consecutive texts, their ids one after the other and the bounds of each text's."""
        for own, chunks in self._blocks(texts):
            ids, bounds = [np.zeros(0, np.uint32)], np.zeros(len(own), np.int64)
            for starts, flat, begin, length in chunks:
                sums = np.concatenate([[0], np.cumsum(length)])
                bounds += sums[np.searchsorted(starts, own)]
                ids.append(gathered(flat, begin, length))
            yield np.concatenate(ids), bounds


_HELD: dict[str, UnitEncoder] = {}


def held(path: str, kind: type[UnitEncoder] = UnitEncoder) -> UnitEncoder:
    """The worker's encoder for a file; only the last file's is kept."""
    if path not in _HELD:
        release()
        _HELD[path] = kind(path)
    return _HELD[path]


def encoder(path: str) -> UnitEncoder:
    return held(path)


def release() -> None:
    """Drop the worker's encoder: for functions that need none, as the worker may have served a stage that did."""
    if _HELD:
        _HELD.clear()
        tidy()


def tidy() -> None:
    """Give freed memory back to the system: idle workers hold on to what a stage's arrays took, while the next stage's need room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def balanced(batches, limit: int = BLOCK_BYTES):
    """Regroups Arrow batches so that each holds about `limit` bytes: one long text, or many short ones. Tidies up at the end."""
    try:
        yield from _regrouped(batches, limit)
    finally:
        tidy()


def _regrouped(batches, limit: int):
    held, size = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            room = limit - size
            to = batch.num_rows
            if batch.slice(at).nbytes > room:
                low, high = at + 1, batch.num_rows
                while low < high:
                    mid = (low + high) // 2
                    low, high = (mid + 1, high) if batch.slice(at, mid - at).nbytes <= room else (low, mid)
                to = low
            part = batch.slice(at, to - at)
            held.append(part)
            size += part.nbytes
            at = to
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held and (rows := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield rows[0]
