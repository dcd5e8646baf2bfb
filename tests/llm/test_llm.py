"""The training-data operators against brute force on tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("mergelake.llm")
P = pytest.importorskip("public_tokenizers")

SF = "/root/testdata/sf0.001"
LONG = "the anea tionst and eaernd. " * 6000
PASSAGE = "This passage of several words is shared by many of the documents here"
TEXTS = [
    (0, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (2, ""), (3, None), (4, "one"), (5, "ONE"),
    (6, f"{PASSAGE}\nfirst own line of this document"), (7, f"  {PASSAGE.upper()}\t\nshort\n\n"), (8, f"{PASSAGE}\n{PASSAGE}\nlast"), (9, LONG), (10, LONG + "end"),
    (11, "é" * 50), (12, "Ünïcode <|endoftext|> text\r\n\tand 日本語 — “quotes”"), (13, "a\n\n\nb   c\n"), (20, "alpha beta gamma delta epsilon zeta"), (-5, "negative identifier"),
]
REPEATED = [*TEXTS, (4, "one"), (None, "alpha beta gamma delta epsilon zeta"), (None, None)]


def frame(spark, rows):
    """Documents with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "k", 0, -1) for i, t in rows], "doc_id long, text string, hash string, length int, key string, size int, range int")


def empty(spark):
    return frame(spark, [])


def said(t):
    return t or ""


def tokens(name, text):
    from tokenizers import Tokenizer

    global _T
    _T = globals().get("_T", {})
    if name not in _T:
        _T[name] = Tokenizer.from_file(P.path(name))
    return _T[name].encode(said(text), add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_encode_as_the_library(name):
    from mergelake.llm.units import UnitEncoder

    own, rng = UnitEncoder(P.path(name)), random.Random(7)
    parts = ["a", "Zé", " ", "  ", "\n", "\t", "\xa0", "　", ".", ",", "'s", "3", "<|endoftext|>", "—", "日", "́", "\x85", "\r\n", "word", "×", "\x01"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)] + [None, "", LONG, "x" * 5000]
    got = []
    for ids, bounds in own.encode(pa.array(texts)):
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [e.ids for e in own.tokenizer.encode_batch([said(t) for t in texts], add_special_tokens=False)]
    assert own.counts(pa.array(texts)).tolist() == [len(g) for g in got]


def test_encoder_forgets_without_harm(monkeypatch):
    from mergelake.llm import units

    monkeypatch.setattr(units, "KEPT_UNITS", 5)
    own = units.UnitEncoder(P.path("byte_bpe_50k.json"))
    for text in ("a b c d e f g", "h i j", "x" * 60 + " a b"):
        assert [i for ids, _ in own.encode(pa.array([text])) for i in ids.tolist()] == tokens("byte_bpe_50k.json", text)


def test_quality(spark):
    from mergelake.llm.quality import Model, fit_quality, keep_good, score_quality

    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    model = fit_quality(docs, labels)
    rows = {r.doc_id: r for r in score_quality(docs, model).collect()}
    assert len(rows) == 1000
    truth = [(rows[r.doc_id], r.quality) for r in labels.collect()]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [(r.predicted, y) for r, y in truth if r.held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert all((r.predicted == 1) == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows.values())
    odd = score_quality(frame(spark, REPEATED), model).collect()
    assert len(odd) == len(REPEATED) and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id in (2, 3)}) == 1
    assert score_quality(empty(spark), model).count() == 0
    assert fit_quality(docs, labels.limit(0)) == Model() == fit_quality(empty(spark), labels)
    assert {r.score for r in score_quality(frame(spark, TEXTS), Model()).collect()} == {0.5}
    few = fit_quality(frame(spark, TEXTS), spark.createDataFrame([(k, k % 2) for k in range(10)] + [(None, 1), (3, None)], "doc_id long, quality int"))
    assert 0 <= score_quality(frame(spark, TEXTS), few).first().score <= 1
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in rows.items() if r.predicted}


def test_packing(spark):
    from mergelake.llm.packing import BITS, DIMENSIONS, hilbert_keys, pack

    rows = pack(frame(spark, REPEATED), P.path("byte_bpe_50k.json"), length=256).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i in {i for i, _ in REPEATED}:
        whole = [tokens("byte_bpe_50k.json", t) + [1] for j, t in REPEATED if j == i]
        if len(whole) == 1:
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(whole[0]), crc(whole[0][at : at + r.length]))
                at += r.length
            assert at == len(whole[0])
        else:
            assert sum(r.length for r in by_doc[i]) == sum(map(len, whole))
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    assert sorted(filled) == list(range(len(filled)))
    for s, parts in filled.items():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) == 256 or s == max(filled)
    assert pack(empty(spark), P.path("byte_bpe_50k.json")).count() == 0
    grid = np.stack(np.meshgrid(*[np.arange(4)] * DIMENSIONS, indexing="ij"), -1).reshape(-1, DIMENSIONS)
    order = grid[np.argsort(hilbert_keys(grid))]
    assert len(set(hilbert_keys(grid).tolist())) == len(grid) and (abs(np.diff(order, axis=0)).sum(1) == 1).all()
    assert hilbert_keys(np.asarray([[(1 << BITS) - 1] * DIMENSIONS])).max() < 1 << BITS * DIMENSIONS


def jaccard_brute(rows, width=5, percent=75):
    sets, parent = defaultdict(list), {}
    for i, t in rows:
        words = [w.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for w in re.findall(rb"[^\x20\x09-\x0D]+", said(t).encode())]
        sets[i].append(frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else []))

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    keys = sorted(k for k in sets if k is not None)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: (sets[k], root(k)) for k in keys}


@pytest.mark.parametrize("frequent", [2, 5, 64])
def test_jaccard_components(spark, frequent):
    from mergelake.llm.ngram_join import jaccard_components

    rng = random.Random(frequent)
    words, rows = [f"w{k}" for k in range(50)], list(TEXTS)
    for g in range(8):
        base = rng.choices(words, k=rng.choice([6, 12, 40, 120, 260]))
        for _ in range(rng.choice([2, 4, 20])):
            rows.append((100 + len(rows), " ".join(rng.choice(words) if rng.random() < 0.02 else w for w in base)))
    got = jaccard_components(frame(spark, rows), frequent=frequent).collect()
    assert len(got) == len(rows)
    want = jaccard_brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (len(s[0]), c) for k, (s, c) in want.items()}


def capped_rows(rng):
    """Pairs (all-rare prefix, mixed prefix) of just enough likeness that share a long list, among short documents that hold it too."""
    frequent, low, high = [f"f{k}" for k in range(70)], [], []
    pairs = []
    for g in range(12):
        shared, a, b = [f"s{g}x{k}" for k in range(11)], [f"a{g}x{k}" for k in range(18)], [f"b{g}x{k}" for k in range(8)]
        for words in ([f"t{g}", *shared, *a, *frequent], [f"t{g}", *shared, *b, *frequent]):
            rng.shuffle(words)
            pairs.append((1000 + len(pairs), " ".join(words)))
        for k in range(16):
            (low if k % 2 else high).append(" ".join([f"t{g}", *(f"o{g}x{k}x{j}" for j in range(3))]))
    return [*enumerate(low), *pairs, *((2000 + k, t) for k, t in enumerate(high))]


def test_jaccard_beyond_most_frequent(spark, monkeypatch):
    """Tokens that the cap on broadcast ones leaves as rare have long lists; links must not depend on the cap."""
    from mergelake.llm import ngram_join

    rows = capped_rows(random.Random(5))
    want = {k: c for k, (_, c) in jaccard_brute(rows, 1).items()}
    assert sum(k != c for k, c in want.items()) == 12
    for most in (70, 1 << 20):
        monkeypatch.setattr(ngram_join, "MOST_FREQUENT", most)
        got = ngram_join.jaccard_components(frame(spark, rows), width=1, frequent=2).collect()
        assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("frequent, most", [(64, 1 << 20), (2, 30)])
def test_jaccard_repeated_ids_of_different_texts(spark, monkeypatch, frequent, most):
    """A doc_id's rows are one node, whatever their sizes and whether each is a copy of another's."""
    from mergelake.llm import ngram_join

    rng = random.Random(11)
    text = lambda n: " ".join(f"v{rng.randrange(400)}" for _ in range(n))
    near = lambda t: t + " last"
    t, x, y, z = text(100), text(40), text(40), text(60)
    rows = [(7, t), (7, text(1000)), (8, near(t)), (3, x), (4, y), (9, x), (9, y), (12, ""), (12, z), (11, z), (13, None)]
    for g in range(15):
        base = text(rng.choice([30, 60, 200]))
        rows += [(20 + rng.randrange(60), " ".join([base, f"end{k}"])) for k in range(3)]
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", most)
    got = ngram_join.jaccard_components(frame(spark, rows), frequent=frequent).collect()
    want = jaccard_brute(rows)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((k, len(s)) for k, (sets, _) in want.items() for s in sets)
    assert {(r.doc_id, r.component_id) for r in got} == {(k, c) for k, (_, c) in want.items()}


def test_jaccard_odd_rows(spark):
    from mergelake.llm.ngram_join import jaccard_components

    got = jaccard_components(frame(spark, REPEATED)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in REPEATED)
    assert {r.component_id for r in got if r.doc_id is None} == {0, None}
    assert jaccard_components(empty(spark)).count() == 0


def test_sstable(spark):
    from mergelake.llm import sstable
    from mergelake.llm.sstable import Reader, read_shards, write_shards

    rows = [*REPEATED, *((1000 + k, f"document number {k} " * (k % 7)) for k in range(400))]
    old, sstable.SHARD_BYTES, sstable.BLOCK_BYTES = sstable.SHARD_BYTES, 40_000, 2_000
    try:
        manifest = write_shards(frame(spark, rows), P.path("word_bpe_49k.json"))
    finally:
        sstable.SHARD_BYTES, sstable.BLOCK_BYTES = old, 64 << 10
    files = manifest.orderBy("shard").collect()
    assert len(files) > 2 and sum(f.n_docs for f in files) == len(rows)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens, r.ids_crc32) for r in read_shards(spark, manifest).collect())
    at = 0
    for (key, start, n, _), (i, _) in zip(sorted(got, key=lambda g: g[1]), sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))):
        assert start == at and key == (i is not None, i or 0)
        at += n
    whole = {i: tokens("word_bpe_49k.json", t) + [1] for i, t in rows if i is not None and sum(j == i for j, _ in rows) == 1}
    assert {k[1]: (n, c) for k, _, n, c in got if k[0] and k[1] in whole} == {i: (len(x), crc(x)) for i, x in whole.items()}
    found = {i: [x.tolist() for f in files for x in Reader(f.path).get(i)] for i in (-5, 9, 1003, 1399, 77777)}
    assert found == {i: [whole[i]] if i in whole else [] for i in found}
    assert sum(len(Reader(f.path).get(4)) for f in files) == 2 and sum(len(Reader(f.path).get(None)) for f in files) == 2
    assert read_shards(spark, write_shards(empty(spark), P.path("word_bpe_49k.json"))).count() == 0


def test_exact_dedup(spark, monkeypatch):
    from mergelake.llm import exact_dedup

    for limit in (10**6, 0):  # broadcast, and the way beyond
        monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", limit)
        rows = [*REPEATED, (30, "x" * 400 + "a"), (31, "x" * 400 + "b"), (32, "x" * 400 + "a")]
        got = exact_dedup.exact_dedup(frame(spark, rows), digest=True).collect()
        groups = defaultdict(list)
        for i, t in rows:
            groups[said(t)].append(i)
        assert len(got) == len(rows)
        want = Counter()
        for i, t in rows:
            ids = groups[said(t)]
            keep = max((x for x in ids if x is not None), default=None)
            want[i, keep, len(ids), i == keep, hashlib.sha256(said(t).encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in got) == want
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("limit", [10**6, 0])
def test_exact_dedup_hashes_only_survivors(spark, monkeypatch, limit):
    """Which rows each level hashes: prefixes where a length repeats, full texts where length and prefix do."""
    from mergelake.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", limit)
    long = "p" * exact_dedup.PREFIX_BYTES
    rows = [(1, "alone"), (2, "ab"), (3, "cd"), (4, "same"), (5, "same"), (6, long + "a"), (7, long + "b"), (8, "q" * (len(long) + 1)), (9, None), (10, ""), (11, "é"), (12, "ab\x00")]
    raw = {i: said(t).encode() for i, t in rows}
    lengths = Counter(len(b) for b in raw.values())
    prefixes = Counter((len(b), b[: exact_dedup.PREFIX_BYTES]) for b in raw.values())
    want = {i: 1 if lengths[len(b)] < 2 else 2 if prefixes[len(b), b[: exact_dedup.PREFIX_BYTES]] < 2 else 3 for i, b in raw.items()}
    assert {r.doc_id: r.level for r in exact_dedup.exact_dedup(frame(spark, rows), level=True).collect()} == want
    assert set(want.values()) == {1, 2, 3}


def minimax_brute(sizes, shards):
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, 0
        room = mid
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(6))
def test_minimax_cuts(seed):
    from mergelake.llm.sharding import Unit, minimax_cuts

    rng = random.Random(seed)
    groups = sorted((rng.randrange(-(1 << 63), 1 << 63), rng.choice([1, 5, 50, 3000])) for _ in range(rng.choice([1, 3, 40, 3000])))

    def units(own, shift):
        sums = defaultdict(lambda: [0, 0])
        for h, s in own:
            sums[h >> shift][0] += s
            sums[h >> shift][1] += 1
        return [Unit(p, shift, s, n) for p, (s, n) in sums.items()]

    def refine(coarse):
        return [u for c in coarse for u in units([g for g in groups if g[0] >> c.shift == c.prefix], max(0, c.shift - 8))]

    starts, capacity = minimax_cuts(units(groups, 60), 16, refine)
    assert capacity == minimax_brute([s for _, s in groups], 16)
    loads = Counter()
    for h, s in groups:
        loads[sum(h >= c for c in starts)] += s
    assert max(loads.values()) <= capacity


def test_sharding(spark):
    from mergelake.llm.sharding import minimax_shards

    rows = [*REPEATED, *((1000 + k, f"text {k % 90}") for k in range(300))]
    got = minimax_shards(frame(spark, rows), 16).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(said(t).encode()) + 1, zlib.crc32(said(t).encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = defaultdict(set)
    for r in got:
        texts[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in texts.values())
    assert minimax_shards(empty(spark)).count() == 0
    # One group of a third of all bytes takes a shard; the others stay even.
    rows = [(k, "y" * 99 if k % 3 == 0 else f"{k:099d}") for k in range(3000)]
    loads = Counter()
    for r in minimax_shards(frame(spark, rows), 16).collect():
        loads[r.shard] += r.size
    assert len(loads) == 16 and sorted(loads.values())[-2] < 1.3 * 200_000 / 15


def test_sharding_runs_as_many_jobs_over_any_number_of_partitions(spark):
    from mergelake.llm.sharding import minimax_shards

    docs, jobs, conf = frame(spark, [(k, f"text {k}") for k in range(400)]), {}, {"spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for partitions in ("2", "24"):
            for k, v in (conf | {"spark.sql.shuffle.partitions": partitions}).items():
                spark.conf.set(k, v)
            spark.sparkContext.setJobGroup(f"shards-{partitions}", "")
            assert minimax_shards(docs).count() == 400
            jobs[partitions] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"shards-{partitions}"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs["24"] <= jobs["2"] + 5


def test_fingerprints(spark, monkeypatch):
    from mergelake.llm import fingerprints as fp

    for task_bytes in (1 << 30, 50_000):
        monkeypatch.setattr(fp, "TASK_BYTES", task_bytes)
        rows = [*TEXTS, *((50 + k, f"{k} " + " ".join(random.Random(k).choices(LONG.split(), k=200))) for k in range(40))]
        got = {r.doc_id: r for r in fp.fingerprint_with_edits(frame(spark, rows)).collect()}
        order = sorted(rows, key=lambda r: -r[0])
        assert len(got) == len(rows)
        prints = fp.fingerprints([said(t) for _, t in order])
        for k, (i, t) in enumerate(order):
            t, after = said(t), said(order[(k + 1) % len(order)][1])
            edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
            assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            own = fp.fingerprints([edited])[0]
            assert (got[i].fingerprint, got[i].edited_fingerprint) == (fp.as_string(prints[k]), fp.as_string(own))
            assert got[i].near_edited == fp.likeness(prints[k], own) and got[i].near_next == fp.likeness(prints[k], prints[(k + 1) % len(order)])
            if i >= 50 and i < 89:
                assert got[i].near_edited > 0.45 and got[i].near_next < 0.35
    assert fp.fingerprint_with_edits(frame(spark, REPEATED)).count() == len(REPEATED)
    assert fp.fingerprint_with_edits(frame(spark, [(None, "a"), (None, "b")])).count() == 2
    one = fp.fingerprint_with_edits(frame(spark, [(1, "abcdef" * 9)])).first()
    assert one.near_next == 1.0
    assert fp.fingerprint_with_edits(empty(spark)).count() == 0


def test_syncmers_by_definition():
    from mergelake.llm.fingerprints import K, syncmers

    text = "".join(random.Random(3).choices("abcd ", k=400))
    points = np.asarray([ord(c) for c in text], np.uint32)
    starts, hashes = syncmers(points)
    assert len({text[s : s + K] for s in starts}) == len(set(hashes.tolist()))
    assert 0.1 < len(starts) / len(text) < 0.5
    # Context-free: whether a k-mer is chosen depends on it alone.
    chosen = {text[s : s + K] for s in starts}
    assert all((text[s : s + K] in chosen) == (s in set(starts.tolist())) for s in range(len(text) - K + 1))


def test_syncmers_have_their_least_substring_at_an_edge():
    """The definition in plain Python, k-mer by k-mer."""
    from mergelake.llm.fingerprints import K, S, SHORT_K, SHORT_S, syncmers

    word = 2**64 - 1

    def mixed(x):
        x = ((x ^ (x >> 31)) * 0x7FB5D329728EA185) & word
        x = ((x ^ (x >> 27)) * 0x81DADEF4BC2DD44D) & word
        return x ^ (x >> 33)

    def value(part):
        h = 0
        for c in part:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) & word
        return mixed(h)

    for seed, letters in ((1, "ab"), (2, "abcdefgh "), (3, "aé漢😀z ")):
        text = "".join(random.Random(seed).choices(letters, k=700))
        for size, part in ((K, S), (SHORT_K, SHORT_S)):
            want = []
            for s in range(len(text) - size + 1):
                inner = [value(text[s + j : s + j + part]) for j in range(size - part + 1)]
                if min(inner) in (inner[0], inner[-1]):
                    want.append(s)
            assert syncmers(np.asarray([ord(c) for c in text], np.uint32), size, part)[0].tolist() == want


def test_fingerprints_of_short_texts():
    """A text and the same with its last third replaced share anchors from seven code points on, and unrelated texts few."""
    from mergelake.llm.fingerprints import SHORT_TEXT, fingerprints, likeness

    rng, near, far = random.Random(6), [], []
    for n in range(7, 2 * SHORT_TEXT):
        for _ in range(20):
            text, other = ("".join(rng.choices("abcdefghijklmnop ", k=n)) for _ in range(2))
            a, b, c = fingerprints([text, text[: n - n // 3] + other[: n // 3], other])
            near.append((n, likeness(a, b)))
            far.append(likeness(a, c))
    assert all(x > 0 for n, x in near if 12 <= n < SHORT_TEXT) and np.mean([x for _, x in near]) > 0.4 and np.mean(far) < 0.05
    whole = fingerprints(["abc", "abc", "abd", ""])
    assert likeness(whole[0], whole[1]) == 1 and likeness(whole[0], whole[2]) == 0 == likeness(whole[0], whole[3])


def test_likeness_by_definition():
    """The most common anchors whose shifts lie within DRIFT, over the smaller fingerprint; every shift tried as the least."""
    from mergelake.llm.fingerprints import DRIFT, likeness

    rng = random.Random(4)
    for _ in range(200):
        def some():
            hashes = sorted(rng.sample(range(40), rng.randint(0, 32)))
            return np.asarray(hashes, np.uint32), np.asarray([rng.randint(0, 400) for _ in hashes], np.uint32)

        a, b = some(), some()
        of_a, of_b = dict(zip(*(x.tolist() for x in a))), dict(zip(*(x.tolist() for x in b)))
        shifts = [of_a[h] - of_b[h] for h in of_a.keys() & of_b.keys()]
        most = max((sum(low <= x <= low + DRIFT for x in shifts) for low in shifts), default=0)
        want = most / min(len(of_a), len(of_b)) if of_a and of_b else float(not of_a and not of_b)
        assert likeness(a, b) == pytest.approx(want)


def test_token_counts(spark):
    from mergelake.llm.token_counts import token_counts

    got = token_counts(frame(spark, REPEATED), P.path("byte_bpe_50k.json"), limit=6).collect()
    want = Counter((i, len(said(t).encode()), n := len(tokens("byte_bpe_50k.json", t)), n > 6) for i, t in REPEATED)
    assert Counter(tuple(r) for r in got) == want
    assert token_counts(empty(spark), P.path("byte_bpe_50k.json")).count() == 0


def lines_brute(rows, min_chars=20, min_docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, t in rows:
        for x in said(t).split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    out = {}
    for i, t in rows:
        all_lines = said(t).split("\n")
        kept = [x for x in all_lines if len(held.get(key(x), ())) < min_docs or i == max(held[key(x)])]
        out[i] = (len(all_lines), len(all_lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches, fanout, broadcast", [(4, 4, 10**6), (1, 2, 10**6), (5, 2, 0)])
def test_line_dedup(spark, monkeypatch, batches, fanout, broadcast):
    from mergelake.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", broadcast)
    rng = random.Random(batches)
    pool = [f"line number {k} of the common pool" for k in range(30)] + ["short", "É" * 25, "é" * 25, ""]
    rows = [*TEXTS, *((100 + k, "\n".join(rng.choices(pool, k=rng.randint(1, 9)))) for k in range(60))]
    got = line_dedup.dedup_lines(frame(spark, rows), batches=batches, fanout=fanout, carry=("hash", "key")).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in got} == lines_brute(rows) and len(got) == len(rows)
    assert {(r.hash, r.key) for r in got} == {("x", "k")}
    assert line_dedup.dedup_lines(frame(spark, REPEATED)).count() == len(REPEATED)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_runs_levels(spark):
    from mergelake.llm.line_dedup import LineRuns

    runs = LineRuns(spark, fanout=2)
    batches = [[(9, b"a"), (8, b"a"), (8, b"b")], [(7, b"a"), (6, b"c")], [(5, b"b"), (4, b"d")]]
    added = [runs.add(spark.createDataFrame(b, "doc_id long, hash binary")) for b in batches]
    assert [len(level) for level in runs.levels] == [1, 1]
    assert {(bytes(r.hash), r.n, r.holder) for r in added[1].collect()} == {(b"a", 1, None), (b"c", 1, 6)}
    state = runs.state()
    assert {(bytes(r.hash), r.n, r.holder) for r in state.collect()} == {(b"a", 3, 9), (b"b", 2, 8), (b"c", 1, 6), (b"d", 1, 4)}
    assert "Exchange" not in state._jdf.queryExecution().executedPlan().toString()
    tables = [r.table for r in runs.runs()]
    runs.drop()
    assert not any(spark.catalog.tableExists(t) for t in tables)


def test_sentencepiece(spark):
    import sentencepiece

    from mergelake.llm.pieces import PieceEncoder, encode_and_decode

    path, rng = P.path("piece_bpe_32k.model"), random.Random(5)
    own, library = PieceEncoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    parts = ["a", "Zé", " ", "   ", "\n", "\t", "　", ".", ",", "'s", "3", "<s>", "—", "日", "́", "word", "the", "▁", "=", "😀"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)] + ["".join(rng.choices("etaoinshr", k=rng.randint(1, 70))) for _ in range(3000)]
    texts += ["a" * k for k in range(80)] + [None, "", " ", LONG]
    got, decoded = [], []
    for ids, bounds in own.encode(pa.array(texts)):
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        decoded += own.pieces.decode(ids, bounds)
    want = library.encode([said(t) for t in texts])
    assert got == want and decoded == library.decode(want)
    rows = encode_and_decode(frame(spark, REPEATED), path).collect()
    assert Counter((r.doc_id, r.n_pieces, r.ids_crc32, r.decoded_sha256, r.restored) for r in rows) == Counter(
        (i, len(x := library.encode(said(t))), crc(x), hashlib.sha256(said(t).encode()).hexdigest(), True) for i, t in REPEATED
    )
    assert encode_and_decode(empty(spark), path).count() == 0


def unigram_model(path, rng):
    """A model made by rule, not trained: pieces of a small alphabet with scores in eighths, so that sums are exact and ties occur."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model, letters = pb.ModelProto(), "abcdeé日"
    names = {"▁", ".", ",", *letters}
    while len(names) < 150:
        names.add(rng.choice(["▁", ""]) + "".join(rng.choices(letters, k=rng.randint(1, 5))))
    names.discard("e")  # a letter that only longer pieces hold
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    for name, score, kind in [*pieces, *((n, -rng.randint(8, 80) / 8, 1) for n in sorted(names))]:
        model.pieces.add(piece=name, score=score, type=kind)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback, model.trainer_spec.vocab_size = 1, True, len(model.pieces)
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix = "identity", True
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = False, True
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.mark.parametrize("seed", range(4))
def test_sentencepiece_unigram(tmp_path, seed):
    import sentencepiece

    from mergelake.llm.pieces import PieceEncoder

    rng = random.Random(seed)
    path = unigram_model(tmp_path / "unigram.model", rng)
    own, library = PieceEncoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["".join(rng.choices("aabbccddeé日  .,x\n😀", k=rng.randint(0, 40))) for _ in range(2000)] + ["abcde" * 60, None, "", " ", "x" * 100]
    got, decoded = [], []
    for ids, bounds in own.encode(pa.array(texts)):
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        decoded += own.pieces.decode(ids, bounds)
    assert got == library.encode([said(t) for t in texts])
    assert decoded == [said(t) for t in texts]


def test_components(spark):
    from mergelake.llm.components import components

    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(len(parent)):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in parent.items() if k not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from mergelake.llm.quality import fit_quality, score_quality

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id]]
    rows = [(i, v[2]) for i, v in lines_brute(rows).items()]
    want = jaccard_brute(rows)
    rows = [(i, t) for i, t in rows if want[i][1] == i]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(tokens("byte_bpe_50k.json", t)) + 1 for i, t in rows}
    assert sum(r.length for r in got) == sum(len(tokens("byte_bpe_50k.json", t)) + 1 for _, t in rows)
    stage, now = None, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, hash string, key string, line string"
    line = "a line that several of the documents hold\n"
    texts = [(1, None), (2, ""), (3, line + "x"), (4, line), (4, line), (5, line + "y"), (None, line), (None, None), (7, "long words " * 300_000 + "\n" + line)]
    for rows in ([(i, t, None, "s", 0, "h", "k", "l") for i, t in texts], []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, SF)
            assert got.columns == corpus_pipeline.COLUMNS
            out = got.collect()
            if name == "lines":
                assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
                want = lines_brute([(r[0], r[1]) for r in rows if r[0] is not None and r[0] != 4])
                assert {r.doc_id: r.text for r in out if r.doc_id in (1, 2)} == {i: want[i][2] for i in (1, 2) if i in want}
                assert all(not r.text for r in out if r.doc_id in (None, 4)) and all("several of" not in r.text for r in out if r.doc_id != 7)
            if name == "near_duplicates":
                assert sum(r.doc_id is None for r in out) == sum(r[0] is None for r in rows)
                assert {1, 2, 7} <= {r.doc_id for r in out} or not rows
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert sum(p.length for p in pieces) == sum(len(tokens("byte_bpe_50k.json", r[1])) + 1 for r in rows)
