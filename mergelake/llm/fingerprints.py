"""Document fingerprints: closed syncmers as context-free anchors, compared by content and position."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelake.llm.common import small_batches
from mergelake.llm.sstable import _range_of
from mergelake.llm.units import balanced, release

#: Code points of a k-mer and of its inner substrings; K is a multiple of S.
K, S = 12, 4
#: Texts of fewer code points keep too few such k-mers of an edit; theirs are of these sizes.
SHORT_TEXT, SHORT_K, SHORT_S = 32, 4, 2
#: Anchors in a fingerprint: those of the smallest hashes. A sketch of fixed size, as its purpose asks.
ANCHORS = 32
#: Matching anchors agree in place if their shifts differ by no more than that.
DRIFT = 64
#: Code points handled at once, and text bytes that a task takes on average.
BLOCK, TASK_BYTES = 2 << 20, 16 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def syncmers(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the closed syncmers in an array of code points: k-mers whose smallest inner substring is the first or the last."""
    if len(points) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = points.astype(np.uint64)
    inner = x[: len(x) - s + 1].copy()
    for d in range(1, s):
        inner = inner * np.uint64(0x9E3779B97F4A7C15) + x[d : len(x) - s + 1 + d]
    inner = _mix(inner)
    width, reach, least = k - s + 1, 1, inner
    while reach < width:  # minimum over `reach` neighbours, doubled until it spans the k-mer
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    starts = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
    hashes = inner[starts]
    for d in range(s, k, s):
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + inner[starts + d]
    return starts, _mix(hashes)


def _short(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text without any k-mer is one anchor as a whole; an empty one has none."""
    if not text:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    return np.frombuffer(hashlib.sha256(text.encode()).digest()[:4], "<u4"), np.zeros(1, np.uint32)


def fingerprints(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each whole text its anchors: ascending 32-bit hashes, and the code points at which they lie."""
    out, at = [], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK):
            size += len(texts[to])
            to += 1
        out += _block(texts[at:to])
        at = to
    return out


def _block(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out: list = [None] * len(texts)
    for k, s, own in ((K, S, [i for i, t in enumerate(texts) if len(t) >= SHORT_TEXT]), (SHORT_K, SHORT_S, [i for i, t in enumerate(texts) if len(t) < SHORT_TEXT])):
        for i, anchors in zip(own, _anchors([texts[i] for i in own], k, s)):
            out[i] = anchors
    return out


def _anchors(texts: list[str], k: int, s: int) -> list[tuple[np.ndarray, np.ndarray]]:
    lengths = np.asarray([len(t) for t in texts])
    ends = np.cumsum(lengths)
    starts, hashes = syncmers(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), k, s)
    of = np.searchsorted(ends, starts, "right")
    whole = starts + k <= ends[of] if len(starts) else np.zeros(0, bool)
    starts, hashes, of = starts[whole], hashes[whole], of[whole]
    # The n-th occurrence of a k-mer in a text is an anchor of its own, so repeated passages weigh what they span.
    order = np.lexsort((starts, hashes, of))
    starts, hashes, of = starts[order], hashes[order], of[order]
    at = np.arange(len(of))
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    hashes = (_mix(hashes + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    # Only hashes under a bound can be among the smallest; where the bound leaves too few, all take part.
    count = np.bincount(of, minlength=len(texts))
    low = hashes < (np.minimum(1.0, 4.0 * ANCHORS / np.maximum(count, 1)) * 2.0**32)[of]
    low |= (np.bincount(of[low], minlength=len(texts)) < np.minimum(count, ANCHORS))[of]
    starts, hashes, of = starts[low], hashes[low], of[low]
    order = np.lexsort((starts, hashes, of))
    starts, hashes, of = starts[order], hashes[order], of[order]
    edges, begins = np.searchsorted(of, np.arange(len(texts) + 1)), ends - lengths
    out = []
    for i, text in enumerate(texts):
        a, b = edges[i], min(edges[i + 1], edges[i] + ANCHORS)
        out.append((hashes[a:b], (starts[a:b] - begins[i]).astype(np.uint32)) if a < b else _short(text))
    return out


def as_string(anchors: tuple[np.ndarray, np.ndarray]) -> str:
    return base64.b64encode(np.stack(anchors, 1).astype("<u4").tobytes()).decode()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the smaller fingerprint's anchors that the other has at the same place, but for one common shift; 1 for two empty texts."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    places = dict(zip(a[0].tolist(), a[1].tolist()))
    shifts = sorted(places[h] - p for h, p in zip(b[0].tolist(), b[1].tolist()) if h in places)
    best = low = 0
    for high, shift in enumerate(shifts):
        while shift - shifts[low] > DRIFT:
            low += 1
        best = max(best, high - low + 1)
    return best / min(len(a[0]), len(b[0]))


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, whose last third comes from the next document's beginning.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next document is
    the one of the next smaller doc_id; after the last comes the first. Texts are shuffled once, to ranges of doc_id
    between quantiles, which are doc_ids themselves: a range's last document has the lower bound as its next, so bounding
    rows (one for each range) go to both ranges. Within a range, neighbours are met in sort order.

    A null text is empty: its fingerprint is empty, and like only another empty one. Null doc_ids come last; rows that
    repeat a doc_id are ordered by a hash of their texts, then the texts. A table of one row is its own next document; an
    empty table gives an empty result. Columns besides doc_id and text aren't read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    about = docs.agg(F.sum(F.octet_length("text")).alias("size"), F.max("doc_id").alias("last")).first()
    ranges = max(1, -(-(about["size"] or 0) // TASK_BYTES))
    bounds = [] if ranges < 2 else sorted({*(docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0] or [])})
    own = docs.withColumns({"range": _range_of("doc_id", bounds), "guest": F.lit(False)})
    edge = docs.filter(F.col("doc_id").isin(bounds)) if bounds else docs.limit(0)
    edge = edge.withColumns({"range": _range_of("doc_id", bounds) + 1, "guest": F.lit(True)})
    if about["last"] is not None:
        edge = edge.unionByName(docs.filter(F.col("doc_id") == about["last"]).withColumns({"range": F.lit(0), "guest": F.lit(True)}))
    placed = own.unionByName(edge).repartitionById(len(bounds) + 1, F.col("range"))
    placed = placed.sortWithinPartitions("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text").select("doc_id", "text", "guest")

    def rows(ids, texts, prints):
        """Rows of all documents but the last, which is only a next one."""
        taken = [len(t) // 3 for t in texts[:-1]]
        edited = [t[: len(t) - n] + after[:n] for t, n, after in zip(texts, taken, texts[1:])]
        edited_prints = fingerprints(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([as_string(p) for p in prints[:-1]], pa.string()),
                pa.array([as_string(p) for p in edited_prints], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(prints, edited_prints)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(prints, prints[1:])], pa.float64()),
            ],
            names,
        )

    def fingerprinted(batches):
        release()
        first, ids, texts, prints, over = None, [], [], [], False
        for batch in balanced(batches, 4 << 20):
            new_ids, new_texts, guests = (batch.column(i).to_pylist() for i in range(3))
            if over:
                continue
            if True in guests:  # one guest, the first, is the next document of the last own row
                at = guests.index(True)
                over, new_ids, new_texts = True, new_ids[: at + 1], new_texts[: at + 1]
            if first is None:
                first = new_texts[:1]
            ids, texts, prints = ids + new_ids, texts + new_texts, prints + fingerprints(new_texts)
            if len(ids) > 1:
                yield rows(ids[:-1], texts, prints)
                ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]
        if ids and not over:
            yield rows(ids, texts + first, prints + fingerprints(first))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return placed.mapInArrow(fingerprinted, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
