"""SentencePiece encoding and decoding: batched numpy Viterbi over equal-length units.

The public model at hand is a BPE model, for which the best sum of scores is not what the library gives. So the dynamic
program keeps its shape, but its step is exact for BPE: the last piece of each prefix is the one piece for which the pair
(last piece of the rest, piece) survives merging, and there is one such piece. All units of a length advance together;
hashes of their substrings probe the sorted hashes of the pieces, longest first, and the vectorised pair test sets the
backpointers. Units with several blanks in a row (whose pieces have equal scores) and very long ones are merged one by
one.

For a unigram model the step is the maximum itself: of all pieces that end at a place, the one with the best sum of
scores, the longest of equals. Sums are taken within a unit, so on long texts the library's own rounding of ever larger
sums isn't copied.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mergelake.llm.common import small_batches
from mergelake.llm.units import UnitEncoder, balanced, held

#: The library's mark for a blank.
BLANK = "▁"
#: Units of more code points are merged one by one.
LONG = 64
FACTOR = np.uint64(0x9E3779B97F4A7C15)
NEVER = np.int64(1) << 40


class Pieces:
    """A sentencepiece BPE or unigram model as arrays."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normalizer, trainer = model.normalizer_spec, model.trainer_spec
        plain = not normalizer.precompiled_charsmap and normalizer.add_dummy_prefix and normalizer.escape_whitespaces and not normalizer.remove_extra_whitespaces
        if trainer.model_type not in (1, 2) or not trainer.byte_fallback or not plain or trainer.treat_whitespace_as_suffix or any(p.type == 4 for p in model.pieces):
            raise ValueError("only BPE and unigram models with byte fallback, identity normalisation and no user-defined pieces are supported")
        self.unigram = trainer.model_type == 1
        self.names = [p.piece for p in model.pieces]
        normal = [i for i, p in enumerate(model.pieces) if p.type == 1]
        self.ids = {self.names[i]: i for i in normal}
        self.score = {self.names[i]: model.pieces[i].score for i in normal}
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.ids) or any(a.isalpha() and b in ",." for p in self.ids for a, b in zip(p, p[1:])):
            raise ValueError("pieces span what units are cut at")
        byte_ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 6}
        self.bytes = np.asarray([byte_ids[f"<0x{b:02X}>"] for b in range(256)], np.uint32)
        self.unknown = len(self.names)
        self._tables(normal)
        if not self.unigram:
            self._merge_tables(normal)
        # What each id decodes to; control pieces decode to nothing.
        said = [b""] * len(self.names)
        for i in normal:
            said[i] = self.names[i].replace(BLANK, " ").encode()
        for b, i in enumerate(self.bytes):
            said[i] = bytes([b])
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_length = np.asarray([len(x) for x in said], np.int64)
        self.said_begin = np.cumsum(self.said_length) - self.said_length

    def _tables(self, normal: list[int]) -> None:
        self.width = max(len(self.names[i]) for i in normal)
        hashes = np.asarray([self._hash(self.names[i]) for i in normal], np.uint64)
        by_hash = np.argsort(hashes)
        self.piece_hashes, self.piece_ids = hashes[by_hash], np.asarray(normal, np.int64)[by_hash]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("hashes of pieces collide")
        self.piece_scores = np.asarray([self.score[self.names[i]] for i in self.piece_ids], np.float32)
        #: What a code point without a piece costs: the library's penalty, below the least score.
        self.unknown_score = self.piece_scores.min() - np.float32(10)

    def _merge_tables(self, normal: list[int]) -> None:
        rank = np.full(self.unknown + 1, NEVER)
        order = sorted(normal, key=lambda i: (-self.score[self.names[i]], i))
        rank[order] = np.arange(len(order))
        pairs, parts = {}, {}
        for i in normal:
            name = self.names[i]
            for k in range(1, len(name)):
                left, right = self.ids.get(name[:k]), self.ids.get(name[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank[i]
        for i in normal:
            if len(self.names[i]) > 1:
                parts[i] = self._last_merge(self.names[i])
        keys = np.fromiter(pairs, np.int64, len(pairs))
        by_key = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[by_key], np.fromiter(pairs.values(), np.int64, len(pairs))[by_key]
        # Spines: what stands at a piece's right (left) edge from its outermost code point on, and the rank at which that is merged on.
        self.edges = []
        for side in (1, 0):
            spine, merged = np.full((self.unknown + 1, self.width + 1), self.unknown, np.int64), np.full((self.unknown + 1, self.width + 1), NEVER)
            for i in [*normal, self.unknown]:
                own = [i]
                while parts.get(own[-1]):
                    own.append(parts[own[-1]][side])
                own.reverse()
                spine[i, : len(own)] = own
                merged[i, : len(own) - 1] = rank[own[1:]]
            self.edges.append((spine, merged))

    @staticmethod
    def _hash(name: str) -> int:
        h = 0
        for c in name:
            h = (h * int(FACTOR) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _merges(self, text: str):
        """Symbols left after merging, and the last merge: best score first, leftmost of equals."""
        symbols, following, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap, last = [], None

        def offer(a: int) -> None:
            b = following[a]
            if b < len(symbols) and (score := self.score.get(symbols[a] + symbols[b])) is not None:
                heapq.heappush(heap, (-score, a, symbols[a], symbols[b]))

        for a in range(len(symbols) - 1):
            offer(a)
        while heap:
            _, a, left, right = heapq.heappop(heap)
            b = following[a] if symbols[a] == left else len(symbols)
            if b >= len(symbols) or symbols[b] != right:
                continue
            last, symbols[a], symbols[b] = (left, right), left + right, ""
            following[a] = following[b]
            if following[b] < len(symbols):
                before[following[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [s for s in symbols if s], last

    def _last_merge(self, name: str) -> tuple[int, int] | None:
        symbols, last = self._merges(name)
        return (self.ids[last[0]], self.ids[last[1]]) if len(symbols) == 1 and last and last[0] in self.ids and last[1] in self.ids else None

    def one_by_one(self, unit: str) -> list[int]:
        out: list[int] = []
        for symbol in self._merges(unit)[0]:
            out += [self.ids[symbol]] if symbol in self.ids else self.bytes[list(symbol.encode())].tolist()
        return out

    def survives(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the two pieces' text keeps them apart: up their facing edges, in order of rank, no merge across comes first."""
        (spine_l, merged_l), (spine_r, merged_r) = self.edges
        good = np.ones(len(left), bool)
        i, j, open_ = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64), np.arange(len(left))
        while len(open_):
            a, b = left[open_], right[open_]
            own_l, own_r = merged_l[a, i[open_]], merged_r[b, j[open_]]
            key = spine_l[a, i[open_]] << 32 | spine_r[b, j[open_]]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)
            broken = (across < own_l) & (across <= own_r) & (across < NEVER)
            good[open_[broken]] = False
            up_l = own_l <= own_r
            going = ~broken & ((own_l < NEVER) | (own_r < NEVER))
            i[open_[going & up_l]] += 1
            j[open_[going & ~up_l]] += 1
            open_ = open_[going]
        return good

    @staticmethod
    def _prefixes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all prefixes, and the powers by which a substring's comes of two of them."""
        count, length = points.shape
        prefix = np.zeros((length + 1, count), np.uint64)
        for e in range(length):
            prefix[e + 1] = prefix[e] * FACTOR + points[:, e].astype(np.uint64) + np.uint64(1)
        return prefix, np.concatenate([[np.uint64(1)], np.cumprod(np.full(length, FACTOR))])

    def _probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For hashes of substrings their places among the sorted pieces, and whether there is such a piece."""
        at = np.minimum(np.searchsorted(self.piece_hashes, hashes), len(self.piece_hashes) - 1)
        return at, self.piece_hashes[at] == hashes

    def _by_score(self, points: np.ndarray, prefix: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpointers of a unigram model: last piece of each prefix's best segmentation, and its length."""
        count, length = points.shape
        last, size = np.full((length + 1, count), self.unknown, np.int64), np.ones((length + 1, count), np.int64)
        best = np.zeros((length + 1, count), np.float32)
        for e in range(1, length + 1):
            best[e] = -np.inf
            for n in range(min(self.width, e), 0, -1):
                at, hit = self._probe(prefix[e] - prefix[e - n] * power[n])
                total = best[e - n].astype(np.float64) + np.where(hit, self.piece_scores[at], self.unknown_score if n == 1 else -np.inf)
                better = total > best[e]
                last[e] = np.where(better, np.where(hit, self.piece_ids[at], self.unknown), last[e])
                size[e], best[e] = np.where(better, n, size[e]), np.where(better, total, best[e])
        return last, size

    def _by_merges(self, points: np.ndarray, prefix: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpointers of a BPE model: the one last piece of each prefix that merging keeps apart from the rest, and its length."""
        count, length = points.shape
        last, size = np.full((length + 1, count), self.unknown, np.int64), np.ones((length + 1, count), np.int64)
        for e in range(1, length + 1):
            left = np.arange(count)
            for n in range(min(self.width, e), 0, -1):
                if not len(left):
                    break
                at, hit = self._probe(prefix[e, left] - prefix[e - n, left] * power[n])
                if not hit.any():
                    continue
                rows, piece = left[hit], self.piece_ids[at[hit]]
                good = np.ones(len(rows), bool) if n == e else self.survives(last[e - n, rows], piece)
                last[e, rows[good]], size[e, rows[good]] = piece[good], n
                done = np.zeros(len(left), bool)
                done[np.flatnonzero(hit)[good]] = True
                left = left[~done]
        return last, size

    def viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For units of equal length (rows of code points): pieces from the last to the first, and the number of each unit's."""
        count, length = points.shape
        last, size = (self._by_score if self.unigram else self._by_merges)(points, *self._prefixes(points))
        taken = np.zeros((count, length), np.int64)
        number, at, rows = np.zeros(count, np.int64), np.full(count, length), np.arange(count)
        while len(rows):
            taken[rows, number[rows]] = last[at[rows], rows]
            number[rows] += 1
            at[rows] -= size[at[rows], rows]
            rows = rows[at[rows] > 0]
        return taken, number

    def encode_units(self, units: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(units)
        by_length: dict[int, list[int]] = {}
        marked = [u.replace(" ", BLANK) for u in units]
        for k, u in enumerate(marked):
            if not self.unigram and (len(u) > LONG or BLANK * 2 in u):
                out[k] = np.asarray(self.one_by_one(u), np.uint32)
            else:
                by_length.setdefault(len(u), []).append(k)
        for length, places in by_length.items():
            if not length:
                continue
            points = np.frombuffer("".join(marked[k] for k in places).encode("utf-32-le"), "<u4").reshape(len(places), length)
            taken, number = self.viterbi(points)
            for row, (k, n) in enumerate(zip(places, number.tolist())):
                ids = taken[row, n - 1 :: -1] if n else taken[row, :0]
                if (ids == self.unknown).any():
                    ids = self._with_bytes(ids, marked[k])
                out[k] = ids.astype(np.uint32)
        return out

    def _with_bytes(self, ids: np.ndarray, unit: str) -> np.ndarray:
        out, at = [], 0
        for i in ids.tolist():
            if i == self.unknown:
                out += self.bytes[list(unit[at].encode())].tolist()
                at += 1
            else:
                out.append(i)
                at += len(self.names[i])
        return np.asarray(out)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of runs of ids: what the pieces say, without the blank put before each text; broken bytes become U+FFFD."""
        from mergelake.llm.units import gathered

        length = self.said_length[ids]
        data = gathered(self.said, self.said_begin[ids], length).tobytes()
        ends = np.concatenate([[0], np.cumsum(length)])[bounds]
        return [data[a + (data[a : a + 1] == b" " and b > a) : b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


class PieceEncoder(UnitEncoder):
    """Encodes Arrow string arrays with the pieces of a model, unit by unit."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self._reset()

    def _library(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = self.pieces.encode_units(units)
        return np.concatenate(each), np.asarray([len(x) for x in each], np.int64)

    def encode(self, texts: pa.Array):
        """As the library does, a blank goes before each text that isn't empty."""
        import pyarrow.compute as pc

        texts = texts.cast(pa.large_string()).fill_null("")
        blank = pa.scalar(" ", pa.large_string())
        return super().encode(pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(blank, texts, pa.scalar("", pa.large_string()))))


def piece_encoder(path: str) -> PieceEncoder:
    return held(path, PieceEncoder)


def encode_and_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode every whole text, decode the ids again: doc_id, n_pieces, ids_crc32, decoded_sha256, restored.

    One pass, no shuffle. ids_crc32 is over the ids as little-endian unsigned 32-bit integers; restored says whether the
    decoded text is the text. That fails for texts that hold the model's blank mark itself.

    Null and empty texts have no pieces and are restored as the empty text. Null doc_ids and repeated rows are encoded
    like others; an empty table gives an empty result; columns besides doc_id and text aren't read.
    """
    small_batches(docs.sparkSession)

    def rows(batches):
        own = piece_encoder(model_path)
        for batch in balanced(batches):
            counts, crcs, hashes, decoded = [], [], [], []
            for ids, bounds in own.encode(batch.column(1)):
                counts += np.diff(bounds).tolist()
                whole = np.ascontiguousarray(ids, "<u4")
                crcs += [zlib.crc32(whole[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                decoded += own.pieces.decode(ids, bounds)
            hashes = [hashlib.sha256(t.encode()).hexdigest() for t in decoded]
            restored = [(a or "") == b for a, b in zip(batch.column(1).to_pylist(), decoded)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array(hashes, pa.string()), pa.array(restored, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "restored"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, restored boolean")
