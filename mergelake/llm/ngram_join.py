"""N-gram Jaccard self-join with token-combination prefixes, exact, and its connected components.

Tokens are distinct word shingles of a document. A global order puts rare tokens first and frequent ones (held by
FREQUENT documents or more) last, lighter before heavier. Documents whose likeness reaches the threshold share a token
in their prefixes; if neither's prefix is all rare, the prefixes are extended until k tokens must be shared: a rare one
of these is found by the index of single tokens, and of k frequent ones two fall in the same of k - 1 hash classes, so
combinations of two tokens of a class are indexed. Every candidate is verified on whole token sets.

Links are needed only as far as they decide components: first a few edges for each document are verified, then just the
candidates that still join different components. So a group of near copies costs its size, not its square.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelake.llm.common import small_batches, staged
from mergelake.llm.components import components
from mergelake.llm.units import balanced, release, text_bytes, tidy

#: Holders from which a token is frequent, and the most tokens that are ever broadcast as such (8 bytes each); of more, the most frequent.
FREQUENT, MOST_FREQUENT = 64, 1 << 20
#: Text bytes for each token class that one task of the counting and indexing steps holds.
CLASS_BYTES = 4 << 20
#: Identifiers that may be broadcast (8 bytes and the table's overhead each).
BROADCAST_IDS = 250_000
#: Documents of a key's largest component that each of its other documents is tried with, before all that may be linked are.
TRIES = 4
#: Documents that one list of a key's outsiders holds on average; more are dealt out to several lists.
LISTED = 4096
#: Text bytes shingled at once (one text at least), and bytes whose words are hashed at once.
BLOCK, WINDOW = 1 << 20, 512 << 10

_M1, _M2, _M3 = np.uint64(0x7FB5D329728EA185), np.uint64(0x81DADEF4BC2DD44D), np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; A-Z count as lower case; with fewer words, one of all; without words, none."""
    data, offsets, _ = text_bytes(texts)
    out: list[np.ndarray] = []
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        out += _sets(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], width)
        at = to
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all words; no word spans an offset. Windows end at white space or at an offset, so a very long
    text takes no more working memory than a window besides its words (one word is never cut)."""
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + WINDOW)
        while b < n and not _SPACE[data[b]]:
            step = _SPACE[data[b : b + WINDOW]]
            b += int(step.argmax()) if step.any() else len(step)
        at, h = _hashed(data[a:b], offsets[(offsets > a) & (offsets < b)] - a)
        starts.append(at + a)
        hashes.append(h)
        a = b
    return np.concatenate(starts), np.concatenate(hashes)


def _hashed(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges] = inside[edges]
    place = np.flatnonzero(inside)
    if not len(place):
        return place, np.zeros(0, np.uint64)
    low = data[place]
    low = np.where((low >= 65) & (low <= 90), low + 32, low).astype(np.uint64) + np.uint64(1)
    starts = np.flatnonzero(begins[place])  # of words, among the bytes that words have
    length = np.diff(np.append(starts, len(place)))
    within = np.arange(len(place)) - np.repeat(starts, length)
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(length.max()), np.uint64(_BASE)))])
    return place[starts], _mix(np.add.reduceat(low * powers[within], starts) + length.astype(np.uint64))


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    empty = np.zeros(0, np.uint64)
    starts, words = _words(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    shingles = empty
    if len(words) >= width:
        shingles = words[: len(words) - width + 1].copy()
        for d in range(1, width):
            shingles = shingles * _M3 + words[d : len(words) - width + 1 + d]
        shingles = _mix(shingles)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(shingles[a : b - width + 1]))
        elif b > a:
            h = np.asarray([b - a], np.uint64)
            for k in range(a, b):
                h = h * _M3 + words[k : k + 1]
            out.append(_mix(h))
        else:
            out.append(empty)
    return out


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 8 bytes, byte planes together, compressed; the first one, ascending, as differences."""
    import zstandard

    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = [np.ascontiguousarray(c.astype(c.dtype.newbyteorder("<"))).view(np.uint8).reshape(-1, c.dtype.itemsize).T.tobytes() for c in (first, *columns[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(blob: bytes, count: int, *kinds) -> list[np.ndarray]:
    import zstandard

    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, count * size, at).reshape(size, count).T).view(kind).reshape(-1))
        at += count * size
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


def _by_class(keys: np.ndarray, classes: int, *more: np.ndarray):
    """For ascending 64-bit keys: (class, rows of it) by equal ranges of the key."""
    owner = (keys >> np.uint64(32)) * np.uint64(classes) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
        yield int(owner[a]), slice(a, b)


class Prefixes:
    """Index rows of a document under the global order, for likeness of at least percent / 100."""

    def __init__(self, heavy: np.ndarray, holders: np.ndarray, percent: int):
        self.heavy, self.holders, self.percent = heavy, holders, percent
        self.step = math.log(100 / percent)

    def overlap(self, n: int) -> int:
        """Tokens that a document of n tokens shares at least with any that is like it."""
        return -(-self.percent * n // 100)

    def _shared(self, level: int) -> int:
        """k of a level of sizes; the same for both documents of a pair, as their sizes lie in the same or in neighbouring levels."""
        return max(2, int(math.exp(level * self.step) / 8))

    def rows(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Single tokens, keys of combinations for the document's own level of sizes and for the next, and how many tokens
        are frequent. If the prefix holds a frequent token, the single tokens are all rare ones; if not, there are no
        combinations and the number is given as 0."""
        n = len(tokens)
        none = np.zeros(0, np.uint64)
        if not n:
            return none, none, none, 0
        weight = np.zeros(n, np.int64)
        if len(self.heavy):
            short = (tokens >> np.uint64(32)).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.heavy, short), len(self.heavy) - 1)
            weight = np.where(self.heavy[at] == short, self.holders[at], 0)
        order = np.lexsort((tokens, weight))
        tokens, weight = tokens[order], weight[order]
        rare = int(np.searchsorted(weight, 1))
        need = self.overlap(n)
        prefix = n - need + 1
        if prefix <= rare:
            return tokens[:prefix], none, none, 0
        level = int(math.floor(math.log(n) / self.step + 1e-9))
        keys = []
        for tag in (level, level + 1):
            k = min(self._shared(tag), need)
            extended = n - need + k
            keys.append(np.unique(self._combinations(tokens[rare:extended], tag, self._shared(tag), k)))
        return tokens[:rare], *keys, n - rare

    def _combinations(self, tokens: np.ndarray, tag: int, shared: int, k: int) -> np.ndarray:
        """Keys of pairs of tokens of a class; with overlaps too small for the level's k, of the single tokens too."""
        salt = _mix(np.asarray([tag * 4 + 1], np.uint64))[0]
        keys = [np.zeros(0, np.uint64)]
        if k < shared or tag <= 16:  # small sets: whatever k comes out on the other side, one shared token is a key
            keys.append(_mix(tokens ^ salt))
            return np.concatenate(keys)
        classes = (tokens >> np.uint64(7)) % np.uint64(max(1, shared - 1))
        order = np.lexsort((tokens, classes))
        tokens, classes = tokens[order], classes[order]
        for gap in range(1, len(tokens)):
            same = classes[gap:] == classes[:-gap]
            if not same.any():
                break
            keys.append(_mix(_mix(tokens[:-gap][same] ^ salt) * _M3 + tokens[gap:][same]))
        return np.concatenate(keys)


def token_sets(docs: DataFrame, width: int, classes: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, key of the whole set) of all rows, and packed 32-bit tokens by class (class, n, blob): the distinct ones
    of a batch and how many of its rows hold each, so a token that a third of all rows hold is one entry for each batch."""
    small_batches(docs.sparkSession)

    def rows(batches):
        release()
        for batch in balanced(batches):
            sets = shingle_sets(batch.column(1), width)
            keys = [hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            size = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array(["set"] * size), batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())], names)
            tokens = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32) if sets else np.zeros(0, np.uint32)
            if len(tokens):
                tokens, held = np.unique(tokens, return_counts=True)
                own = [(c, s.stop - s.start, _packed(tokens[s], held[s].astype(np.uint32))) for c, s in _by_class(tokens.astype(np.uint64) << np.uint64(32), classes)]
                yield pa.RecordBatch.from_arrays([pa.array(["tokens"] * len(own)), *(pa.array([o[i] for o in own], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary())))], names)

    names = ["kind", "id", "n", "data"]
    both = docs.select("doc_id", "text").mapInArrow(rows, "kind string, id long, n long, data binary")
    both.write.partitionBy("kind").parquet(path := _path(docs, "token-sets"))
    both = docs.sparkSession.read.schema("id long, n long, data binary, kind string").parquet(path)
    return both.filter("kind = 'set'").select(F.col("id").alias("doc_id"), "n", F.col("data").alias("key")), both.filter("kind = 'tokens'").select("id", "n", "data")


def _path(df: DataFrame, name: str) -> str:
    from mergelake.llm.common import fresh_path

    return fresh_path(df.sparkSession, name)


def frequent_tokens(blobs: DataFrame, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """32-bit tokens of `frequent` holders or more, ascending, and their holders; MOST_FREQUENT at most, by a higher bound on holders if need be."""

    def counted(group: pa.Table) -> pa.Table:
        parts = [_unpacked(b, n, np.uint32, np.uint32) for n, b in zip(group["n"].to_pylist(), group["data"].to_pylist())]
        tokens, held = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(tokens, kind="stable")
        tokens, held = tokens[order], held[order]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        tokens, holders = tokens[first], np.add.reduceat(held.astype(np.int64), first)
        many = holders >= frequent
        del parts, held, order
        tidy()
        return pa.table({"token": pa.array(tokens[many], pa.int64()), "holders": pa.array(holders[many], pa.int64())})

    found = staged(blobs.groupBy("id").applyInArrow(counted, "token long, holders long"), "frequent-tokens")
    sizes = found.groupBy(F.floor(F.log2("holders") * 8).alias("size")).agg(F.count("*").alias("n"), F.min("holders").alias("least")).orderBy(F.desc("size")).collect()
    bound, total = None, 0
    for r in sizes:
        total += r["n"]
        if total > MOST_FREQUENT:
            break
        bound = r["least"]
    if bound is None:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    rows = found.filter(F.col("holders") >= bound).toArrow().sort_by("token")
    return np.asarray(rows["token"]).astype(np.uint32), np.asarray(rows["holders"])


def without_ids(docs: DataFrame, ids: DataFrame, keep: bool = False) -> DataFrame:
    """Rows of docs whose doc_id is not (keep: is) among ids; these are broadcast if few."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(ids, "doc_id", "left_semi" if keep else "left_anti")


def index_rows(docs: DataFrame, prefixes: Prefixes, width: int, classes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Single tokens packed by class (class, n, blob of token and doc_id), combinations (key, doc_id, own: whether the key
    is of the document's own level of sizes), and documents whose prefix is not all rare (doc_id, heavy: their frequent tokens)."""
    order = docs.sparkSession.sparkContext.broadcast((prefixes.heavy, prefixes.holders, prefixes.percent))

    def rows(batches):
        release()
        own = Prefixes(*order.value)
        for batch in balanced(batches):
            ids = np.asarray(batch.column(0), np.int64)
            found = [own.rows(s) for s in shingle_sets(batch.column(1), width)]
            tokens = np.concatenate([f[0] for f in found])
            of = np.repeat(ids, [len(f[0]) for f in found])
            by_token = np.argsort(tokens, kind="stable")
            tokens, of = tokens[by_token], of[by_token]
            if len(tokens):
                packs = [(c, s.stop - s.start, _packed(tokens[s], of[s])) for c, s in _by_class(tokens, classes)]
                yield pa.RecordBatch.from_arrays([pa.array(["single"] * len(packs)), *(pa.array([o[i] for o in packs], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary())))], names)
            for level, kind in ((1, "several"), (2, "several-next")):
                keys = np.concatenate([f[level] for f in found]).view(np.int64)
                if len(keys):
                    of = np.repeat(ids, [len(f[level]) for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys)), pa.array(keys), pa.array(of), pa.nulls(len(keys), pa.binary())], names)
            mixed = [(i, f[3]) for i, f in zip(ids.tolist(), found) if f[3]]
            if mixed:
                yield pa.RecordBatch.from_arrays([pa.array(["mixed"] * len(mixed)), *(pa.array(c, pa.int64()) for c in zip(*mixed)), pa.nulls(len(mixed), pa.binary())], names)

    names = ["kind", "id", "n", "data"]
    docs.select("doc_id", "text").mapInArrow(rows, "kind string, id long, n long, data binary").write.partitionBy("kind").parquet(path := _path(docs, "token-index"))
    both = docs.sparkSession.read.schema("id long, n long, data binary, kind string").parquet(path)
    return both.filter("kind = 'single'").select("id", "n", "data"), both.filter("kind IN ('several', 'several-next')").select(F.col("id").alias("key"), F.col("n").alias("doc_id"), (F.col("kind") == "several").alias("own")), both.filter("kind = 'mixed'").select(F.col("id").alias("doc_id"), F.col("n").alias("heavy"))


def single_pairs(singles: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b, c: tokens found in both prefixes), and postings (key, doc_id) of lists too long to be paired."""

    def paired(group: pa.Table) -> pa.Table:
        parts = [_unpacked(b, n, np.uint64, np.int64) for n, b in zip(group["n"].to_pylist(), group["data"].to_pylist())]
        tokens, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((ids, tokens))
        tokens, ids = tokens[order], ids[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1])
        tokens, ids = tokens[new], ids[new]
        starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        size = np.diff(np.append(starts, len(tokens)))
        each = np.repeat(size, size)
        long = each > most
        out_a, out_b, out_c = [tokens[long].view(np.int64)], [ids[long]], [np.zeros(int(long.sum()), np.int64)]
        few = (each > 1) & ~long
        tokens, ids = tokens[few], ids[few]
        a, b = [], []
        for gap in range(1, int(size[size <= most].max(initial=0))):
            same = tokens[gap:] == tokens[:-gap]
            a.append(ids[:-gap][same])
            b.append(ids[gap:][same])
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
            out_a.append(a[first])
            out_b.append(b[first])
            out_c.append(np.diff(np.append(first, len(a))))
        del parts, order, tokens, ids, a, b
        tidy()
        return pa.table({"a": pa.array(np.concatenate(out_a), pa.int64()), "b": pa.array(np.concatenate(out_b), pa.int64()), "c": pa.array(np.concatenate(out_c), pa.int64())})

    found = staged(singles.groupBy("id").applyInArrow(paired, "a long, b long, c long"), "single-pairs")
    pairs = found.filter("c > 0").groupBy("a", "b").agg(F.sum("c").alias("c"))
    return pairs, found.filter("c = 0").select(F.col("a").alias("key"), F.col("b").alias("doc_id"))


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are linked, by whole token sets of 64-bit hashes."""
    needed = staged(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "needed")

    def sets(batches):
        for batch in balanced(batches):
            blobs = [s.astype("<u8").tobytes() for s in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["doc_id", "tokens"])

    def linked(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))
        tidy()

    whole = without_ids(docs.select("doc_id", "text"), needed, True).mapInArrow(sets, "doc_id long, tokens binary")
    whole = staged(whole, "needed-sets")
    one, other = (whole.select(F.col("doc_id").alias(x), F.col("tokens").alias(f"{x}_tokens")) for x in "ab")
    return staged(pairs.join(one, "a").join(other, "b").select("a", "b", "a_tokens", "b_tokens").mapInArrow(linked, "a long, b long"), "links")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Words are runs of bytes other than white space, with A-Z in lower case; a document with fewer than `width` words is
    one shingle; one without words is empty and linked with nothing. Equal token sets are one class from the start, by a
    128-bit hash of the set; tokens are 64-bit hashes.

    Null texts are empty. A null doc_id has the component of its class's other documents, or null; it links nothing.
    Rows that repeat a doc_id are one node: their links join. An empty table gives an empty result. Columns besides
    doc_id and text aren't read.
    """
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    classes = max(16, -(-size // CLASS_BYTES))
    sets, blobs = token_sets(docs, width, classes)
    heavy = frequent_tokens(blobs, frequent)

    groups = staged(sets.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first")), "set-classes")
    members = sets.filter("key IS NOT NULL").join(groups, "key").select("doc_id", F.col("n").alias("n_shingles"), "first", "key")
    members = staged(members.unionByName(sets.filter("key IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("first"), "key")), "members")
    leads = groups.filter("first IS NOT NULL").select(F.col("first").alias("doc_id")).distinct()
    copies = members.filter("doc_id IS NOT NULL AND (n_shingles = 0 OR doc_id <> first)").select("doc_id").distinct().join(leads, "doc_id", "left_anti")
    firsts = without_ids(docs.filter("doc_id IS NOT NULL"), staged(copies, "copies"))

    singles, several, mixed = index_rows(firsts, Prefixes(*heavy, percent), width, classes)
    # Tokens of this many holders are frequent, unless MOST_FREQUENT was reached; longer lists then go the way of combinations.
    pairs, long_lists = single_pairs(singles, 2 * frequent)
    # Rows that repeat a doc_id with different sets have no size: nothing bounds their pairs, and all are verified. Classes
    # whose rows share a doc_id are linked by it.
    nodes = members.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n_shingles").alias("n"), (F.min("key") < F.max("key")).alias("sets"), (F.min("first") < F.max("first")).alias("apart"), F.max(F.expr("doc_id = first AND key IS NOT NULL")).alias("leads"))
    nodes = staged(nodes, "nodes")
    info = nodes.filter("leads").select("doc_id", F.when(~F.col("sets"), F.col("n")).alias("n"))
    same = without_ids(members.filter("doc_id <> first"), staged(nodes.filter("apart").select("doc_id"), "repeated"), True)
    same = staged(same.select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct(), "same-node")
    # A document's frequent tokens and those of its long lists: all that documents with mixed prefixes share besides what
    # their pair counts. Documents with long lists but all-rare prefixes are indexed in part only: they may share all their
    # tokens (heavy = n), and what they share with a mixed document isn't bounded by that one's heavy either.
    extra = long_lists.groupBy("doc_id").agg(F.count("*").alias("long"))
    mixed = mixed.groupBy("doc_id").agg(F.max("heavy").alias("heavy")).join(extra, "doc_id", "full_outer").join(info, "doc_id")
    mixed = mixed.select("doc_id", "n", F.least("n", F.coalesce(F.col("heavy") + F.coalesce("long", F.lit(0)), "n")).alias("heavy"), (F.col("heavy").isNull() | F.col("n").isNull()).alias("partial"))
    mixed = staged(mixed, "mixed")
    info = staged(info, "sizes")

    # Where both prefixes are all rare, c counts all common tokens up to the earlier of their ends; beyond lie overlap - 1
    # at most. Where both are mixed, c counts all common rare tokens. A heavy of n bounds nothing, nor does its partner's.
    na, nb = F.col("na"), F.col("nb")
    alike = (100 * na >= percent * nb) & (100 * nb >= percent * na)
    for x in "ab":
        pairs = pairs.join(info.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}")), x).join(mixed.select(F.col("doc_id").alias(x), F.col("heavy").alias(f"heavy_{x}")), x, "left")
    needs = F.ceil(percent * (na + nb) / (100 + percent) - 1e-9)
    beyond = F.ceil(F.greatest(na, nb) * percent / 100) - 1
    ha, hb = F.col("heavy_a"), F.col("heavy_b")
    most = F.when(ha.isNull() & hb.isNull(), F.col("c") + beyond).when((ha < na) & (hb < nb), F.col("c") + F.least(ha, hb)).otherwise(needs)
    pairs = staged(pairs.filter(F.coalesce(alike & (most >= needs), F.lit(True))).select("a", "b", "c"), "pairs")

    # Pairs that combinations alone find share frequent tokens only; so each limits the size of its partner. Not so where
    # one of them is indexed in part: it has no reach, and documents of any reach stay in the long lists that it is in.
    reach = F.when(~F.col("partial"), F.floor(F.col("heavy") * (100 + percent) / percent + 1e-9) - F.col("n"))
    wide = long_lists.join(mixed.filter("partial"), "doc_id").select("key").distinct().withColumn("wide", F.lit(True))
    wide = long_lists.join(wide, "key", "left").select("key", "doc_id", F.coalesce("wide", F.lit(False)).alias("wide"))
    # Two documents of a level meet under its own keys, those of neighbouring levels under the larger one's own; so a key
    # that no document holds for its own level joins nothing that isn't met elsewhere.
    owned_keys = several.filter("own").select("key").distinct()
    several = several.filter("own").unionByName(several.filter("NOT own").join(owned_keys, "key", "left_semi")).select("key", "doc_id", F.lit(False).alias("wide"))
    postings = several.unionByName(wide).groupBy("key", "doc_id").agg(F.max("wide").alias("wide"))
    postings = postings.join(mixed.withColumn("reach", reach), "doc_id").filter(F.col("wide") | F.col("reach").isNull() | (100 * F.col("reach") >= percent * F.col("n")))
    postings = staged(postings.drop("wide", "partial"), "postings")
    # Leaders: the smallest document, and the one with most frequent tokens for its size, which a group's copies differ least from.
    lead = postings.groupBy("key").agg(F.min("doc_id").alias("smallest"), F.max(F.struct(F.floor(F.col("heavy") * 10_000 / F.col("n")).alias("share"), (-F.col("doc_id")).alias("minus"))).alias("central"), F.count("*").alias("m"))
    lead = staged(lead.filter("m > 1").select("key", F.explode(F.array_distinct(F.array("smallest", -F.col("central.minus")))).alias("lead")), "posting-leads")
    star = postings.join(lead, "key").filter("doc_id <> lead").select(F.least("lead", "doc_id").alias("a"), F.greatest("lead", "doc_id").alias("b"))

    best = pairs.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("minus_a"))).alias("most"), F.min("a").alias("least"))
    edges = staged(best.select(F.col("least").alias("a"), "b").unionByName(best.select((-F.col("most.minus_a")).alias("a"), "b")).unionByName(star).distinct(), "first-edges")
    links = verified(edges, firsts, width, percent).unionByName(same)
    label = components(links)

    def labelled(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(label.select(F.col("node").alias(column), F.col("component").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))

    def minor(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of postings those whose keys join several components, with c; and of these the rows outside their key's largest component, with its documents to try."""
        # A document's keys (no more than its length) are labelled in one row, so the join has a row for each document.
        own = rows.groupBy("doc_id", "n", "heavy", "reach").agg(F.collect_list("key").alias("keys"))
        owned = staged(labelled(own, "doc_id", "c").select(F.explode("keys").alias("key"), "doc_id", "n", "heavy", "reach", "c"), "owned-postings")
        sizes = owned.groupBy("key", "c").agg(F.count("*").alias("m"), *[F.min(F.struct(F.xxhash64("doc_id", F.lit(r)).alias("h"), "doc_id"))["doc_id"].alias(f"try_{r}") for r in range(TRIES)])
        top = sizes.groupBy("key").agg(F.max(F.struct("m", "c", *[f"try_{r}" for r in range(TRIES)])).alias("top"), F.count("*").alias("k"), F.sum("m").alias("total")).filter("k > 1").select("key", "top", "total")
        top = staged(top, "open-keys")
        mixed_keys = owned.join(top, "key")
        return mixed_keys.drop("top", "total"), mixed_keys.filter(F.col("c") != F.col("top.c"))

    def tried(pairs_now: DataFrame) -> DataFrame:
        """Verify pairs not verified before; their links join the others."""
        nonlocal label, links, edges
        fresh = staged(pairs_now.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(edges, ["a", "b"], "left_anti"), "more-edges")
        if not fresh.isEmpty() and not (more := verified(fresh, firsts, width, percent)).isEmpty():
            links = links.unionByName(more)
            label = components(links)
        edges = edges.unionByName(fresh)

    # A few documents of each key's largest component first: most of a group of near copies joins it there.
    opened, outside = minor(postings)
    tried(outside.select(F.explode(F.array(*[F.col(f"top.try_{r}") for r in range(TRIES)])).alias("a"), F.col("doc_id").alias("b")).filter("a <> b"))
    # Then whatever still joins different components. Each key brings the list of its outsiders to all its documents, which
    # keep those of fitting size; what remains is united by document, so a pair is made once, not once for each shared key.
    across = labelled(labelled(pairs, "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")
    # Components only grow, so keys that joined one component before need no second look.
    inside, outside = minor(opened.drop("c"))
    block = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("total") / LISTED)).alias("block")
    outsiders = staged(outside.groupBy("key", block).agg(F.collect_list(F.struct("doc_id", "c", "n", "reach")).alias("others")), "outsiders")
    n, reach = F.col("n"), F.col("reach")
    within = lambda o: reach.isNull() | o["reach"].isNull() | ((o["n"] <= reach) & (n <= o["reach"]))
    fits = lambda o: within(o) & (o["c"] != F.col("c")) & F.coalesce((100 * o["n"] >= percent * n) & (100 * n >= percent * o["n"]), F.lit(True))
    met = inside.join(outsiders, "key").select("doc_id", F.transform(F.filter("others", fits), lambda o: o["doc_id"]).alias("others")).filter(F.size("others") > 0)
    met = met.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    tried(across.unionByName(met.select(F.col("doc_id").alias("a"), F.explode("others").alias("b"))))
    named = label.select(F.col("node").alias("first"), "component")
    return members.join(named, "first", "left").select("doc_id", "n_shingles", F.coalesce("component", "first").alias("component_id"))
