"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most 4 bits, cut into 3 segments, have a
segment that differs in at most one bit. Every segment is indexed once for each of its
bits with that bit wiped out, 64 variants a fingerprint: two segments at most one bit
apart agree in a variant. Fingerprints with an equal variant are compared in full.

Only distinct fingerprints are indexed, so exact copies cost nothing. A bucket of equal
variants emits its links as a spanning forest, never all pairs: a link between two
fingerprints that the bucket has already connected adds nothing to a component. Buckets
above a size are cut again by the variants of the bits that they don't share.

Near copies of a given Jaccard similarity need more bits: at 0.8 a bit differs with
probability 0.15, and few pairs are within 4 of 64. ``near_copies`` takes fingerprints of
``WORDS`` words, each cut into ``PIECES`` pieces. Two texts meet under every piece that is
the same in both, and are compared there if a variant of another piece of that word, one
bit wiped out, agrees too. Whole shingle sets decide in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivane.llm.common import column_or_null, written

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Runs up to this size compare all their members at once; larger ones grow components.
SMALL_RUN = 64
#: Buckets of more distinct fingerprints than this are cut again.
LARGE_BUCKET = 20_000
#: With fewer open bits than this a bucket isn't cut: it can't hold many fingerprints.
LEAST_FREE = 16
SALTS = 16
#: Near copies: 64-bit words of a fingerprint and pieces of a word. At a similarity of 0.8 a bit differs
#: with probability acos(8 / 9) / pi = 0.15, and a pair meets in none of the words with 0.0002.
WORDS, PIECES = 8, 6
#: Bits of a routing key that hold a piece, and those of the whole key.
PIECE_BITS, ROUTE_BITS = 11, 17
#: Candidates differ in at most so many bits of so many words. At 0.8 the mean is 29, of unrelated texts 96.
CHECKED, RADIUS = 3, 48
#: Rows of one routing key that a task compares; larger ones are dealt to blocks.
ROUTED = 50_000
_draw = np.random.default_rng(SEED)
_FACTORS, _TERMS = (_draw.integers(0, 1 << 64, WORDS, dtype=np.uint64) for _ in range(2))
_FACTORS |= np.uint64(1)
#: Shingles of one block of candidates; a task compares two blocks at most.
BLOCK_SHINGLES = 2_000_000
#: Up to so many candidates are sent to the texts, not joined by a shuffle of all texts.
SENT = 200_000


def segments(bits: int = 64, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most a bit."""
    n = max_bits // 2 + 1
    cuts = [bits * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def shingle_hashes(words: list[bytes], width: int, seed: int = SEED) -> list[int]:
    """XXH64 of each run of ``width`` words, repeats included; of all words if they are fewer."""
    import xxhash

    joined = b" ".join(words)
    if len(words) < width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """Bit-wise majority of the XXH64 of all word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    hashes = shingle_hashes(words, width, seed)
    values, counts = np.array(hashes, dtype="<u8"), np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), 65_536):
        part = values[i : i + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        found = np.array([fingerprint(t or b"") for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["id", "key", "fp"])


def row_key() -> Column:
    """128 bits that stand for an id and a text: the name of a row, or of rows that repeat both."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(":"), F.coalesce("text", F.lit("")))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, key, fp long) of (id long, text); the key stands for both."""
    return docs.select("id", row_key().alias("key"), "text").mapInArrow(_fingerprints, "id long, key binary, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def variants(fp: Column) -> Column:
    """The 64 one-wildcard keys of a fingerprint: the wiped bit, and its segment without it."""
    keys = []
    for first, width in segments():
        mask = ((1 << width) - 1) << first
        for bit in range(first, first + width):
            rest = F.shiftrightunsigned(fp.bitwiseAND(F.lit(_signed(mask & ~(1 << bit)))), first)
            keys.append(F.shiftleft(rest, 6).bitwiseOR(F.lit(bit).cast("long")))
    return F.array(*keys)


def segment_mask(key: Column) -> Column:
    """The bits that the variant ``key`` says nothing about: those outside its segment."""
    out = F.lit(None).cast("long")
    for first, width in segments():
        wiped = key.bitwiseAND(63)  # the last six bits of a variant
        out = F.when((wiped >= first) & (wiped < first + width), F.lit(_signed((1 << 64) - 1 - (((1 << width) - 1) << first)))).otherwise(out)
    return out


def _cut_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, mask) to the one-wildcard variants of the three pieces that ``mask``'s bits make.

    Two fingerprints of a bucket that differ in at most ``MAX_BITS`` bits have such a
    piece in common, but for one bit at most. A new mask is what the piece leaves.
    """
    import xxhash

    for batch in batches:
        key, fps, masks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        out = [], [], []
        for mask in np.unique(masks):
            own = masks == mask
            free = [b for b in range(64) if int(mask) >> b & 1]
            f, k = fps[own].view(np.uint64), key[own]
            for a, w in segments(len(free)):
                whole = sum(1 << b for b in free[a : a + w])
                for wiped in free[a : a + w]:
                    kept = f & np.uint64(whole & ~(1 << wiped))
                    keys = [xxhash.xxh64_intdigest(x + y, wiped) for x, y in zip(map(bytes, k.view("V8")), map(bytes, kept.view("V8")), strict=True)]
                    out[0].append(np.array(keys, dtype=np.uint64).view(np.int64))
                    out[1].append(f.view(np.int64))
                    out[2].append(np.full(len(f), _signed(int(mask) & ((1 << 64) - 1) & ~whole), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in out], ["key", "fp", "mask"])


def _forest(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints within ``MAX_BITS`` of each other."""
    left, right = [], []
    unseen = f
    while len(unseen):
        todo, unseen = [unseen[:1]], unseen[1:]
        while todo and len(unseen):
            for x in todo.pop():
                if not len(unseen):
                    break
                near = np.bitwise_count(unseen ^ x) <= MAX_BITS
                if near.any():
                    got = unseen[near]
                    left.append(np.full(len(got), x))
                    right.append(got)
                    todo.append(got)
                    unseen = unseen[~near]
    return (np.concatenate(left), np.concatenate(right)) if left else (f[:0], f[:0])


def _links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys (sorted); of long runs, a spanning forest."""
    if not len(keys):
        return fps, fps
    edges = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate([[0], edges])
    lengths = np.diff(np.concatenate([starts, [len(keys)]]))
    left, right = [fps[:0]], [fps[:0]]
    for s, n in zip(starts[lengths > SMALL_RUN].tolist(), lengths[lengths > SMALL_RUN].tolist(), strict=True):
        a, b = _forest(fps[s : s + n])
        left.append(a)
        right.append(b)
    few = np.repeat((lengths > 1) & (lengths <= SMALL_RUN), lengths)
    k, f = keys[few], fps[few]
    for d in range(1, SMALL_RUN):
        same = k[d:] == k[:-d]
        if not same.any():
            break
        a, b = f[:-d][same], f[d:][same]
        near = np.bitwise_count(a ^ b) <= MAX_BITS
        left.append(a[near])
        right.append(b[near])
    return np.concatenate(left), np.concatenate(right)


def _linker(large: int):
    """Reads (key, fp) sorted by key; gives links, and the key of every bucket above ``large``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The open bucket is the last key's; its rows wait in parts.
        parts, waiting, dropped = [], 0, None

        def out(a, b, over):
            n, m = len(a), len(over)
            nothing = lambda x, k: pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(k, pa.int64())])
            return pa.RecordBatch.from_arrays([nothing(a.view(np.int64), m), nothing(b.view(np.int64), m), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(over, pa.int64())])], ["a", "b", "large"])

        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if dropped is not None:
                more = k != dropped
                k, f = k[more], f[more]
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1])) if k[0] <= k[-1] and np.all(k[1:] >= k[:-1]) else int(np.max(np.flatnonzero(k != k[-1]), initial=-1) + 1)
            if last or (parts and parts[0][0][0] != k[-1]):
                parts.append((k[:last], f[:last]))
                yield out(*_links(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])), [])
                parts, waiting = [], 0
            parts.append((k[last:], f[last:]))
            waiting += len(k) - last
            if large and waiting > large:
                dropped = int(k[-1])
                yield out(f[:0], f[:0], [dropped])
                parts, waiting = [], 0
        if parts:
            yield out(*_links(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])), [])

    return run


def links(distinct: DataFrame, large: int = LARGE_BUCKET) -> DataFrame:
    """Links (a, b) that connect all that is within ``MAX_BITS`` bits, of distinct ``fp``.

    Buckets above ``large`` are cut again, and again, by pieces of the bits that their
    keys leave open, until too few bits are left for a bucket to be large.
    """
    index = distinct.select("fp", F.explode(variants(F.col("fp"))).alias("key"))
    keyed = index.withColumn("mask", segment_mask(F.col("key")))
    free, pairs = 64 - min(width for _, width in segments()), None
    while True:
        limit = large if free >= LEAST_FREE else 0
        sorted_ = keyed.select("key", "fp").repartition("key").sortWithinPartitions("key")
        found = written(sorted_.mapInArrow(_linker(limit), "a long, b long, large long"), "simhash-links")
        here = found.where(F.col("a").isNotNull()).select("a", "b")
        pairs = here if pairs is None else pairs.unionByName(here)
        over = found.where(F.col("large").isNotNull()).select(F.col("large").alias("key")).distinct()
        if over.isEmpty():
            return pairs
        again = keyed.join(over, "key").select("key", "fp", "mask")
        keyed = written(again.mapInArrow(_cut_again, "key long, fp long, mask long"), "simhash-cut")
        free -= min(w for _, w in segments(free))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link, by alternating large and small stars.

    Every round links each node to the least node known around it; rounds grow with the
    logarithm of a component's diameter. Each is written, so lineage stays short. Hubs
    are salted: a node's neighbours meet its minimum in ``SALTS`` places.
    """

    def salted(edges, least):
        spread = least.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(spread, ["u", "salt"]).drop("salt")

    state = None
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or (now["n"], now["h"]) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = (now["n"], now["h"])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = salted(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(id, key, fp, root, component_id) of every row of (id long, text).

    ``component_id`` is the smallest id that is reachable over links; a component of
    null ids only has null. Null and empty texts have fingerprint 0 and are linked like
    any other; repeated rows each keep their row; an empty table gives no rows.
    """
    prints = written(fingerprints(docs), "simhash-fp")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    stars = components(links(distinct.select("fp")))
    rooted = distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "simhash-roots")
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(rooted.join(of_root, "root").select("fp", "root", "component_id"), "simhash-classes")
    return prints.join(classes, "fp").select("id", "key", "fp", "root", "component_id")


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The different shingles of a text, sorted; one of an empty text."""
    return np.unique(np.array(shingle_hashes(text.lower().split(), width), dtype=np.uint64))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """``WORDS`` words of SimHash: bit-wise majorities of as many mixes of the shingles' hashes."""
    counts = np.zeros(WORDS * 64, dtype=np.int64)
    for i in range(0, len(shingles), 4080):
        mixed = shingles[i : i + 4080, None] * _FACTORS + _TERMS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            # Sums of 255 bits fit a byte.
            counts += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(shingles), bitorder="little").view("<u8")


def pieces() -> list[tuple[int, int]]:
    """(first bit, width) of each piece of a word."""
    cuts = [64 * k // PIECES for k in range(PIECES + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def routes(words: Column) -> Column:
    """(route, w0, ...) for each piece of each word: word, piece and its value, and the words to check."""
    out = []
    for w in range(WORDS):
        checked = [words[(w + k) % WORDS].alias(f"w{k}") for k in range(CHECKED)]
        for p, (first, width) in enumerate(pieces()):
            value = F.shiftrightunsigned(words[w], first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            out.append(F.struct(value.bitwiseOR(F.lit((w * PIECES + p) << PIECE_BITS).cast("long")).alias("route"), *checked))
    return F.array(*out)


def _span(words: np.ndarray) -> tuple[list[int], list[int]]:
    """Rows that link a spanning forest of the fingerprints within ``RADIUS`` of each other."""
    left, right = [], []
    unseen = np.arange(len(words))
    while len(unseen):
        todo, unseen = [unseen[0]], unseen[1:]
        while todo and len(unseen):
            x = todo.pop()
            near = np.bitwise_count(words[unseen] ^ words[x]).sum(axis=1) <= RADIUS
            got = unseen[near].tolist()
            left += [x] * len(got)
            right += got
            todo += got
            unseen = unseen[~near]
    return left, right


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, the least node known of each node's component, after the links from a to b."""
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _meet(route: np.ndarray, fps: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the least ``fp`` of each component to its others.

    Rows of one route are linked if they agree in a variant of another piece and are
    within ``RADIUS``; pairs that are connected already are not compared.
    """
    piece = ((route & ((1 << ROUTE_BITS) - 1)) >> PIECE_BITS) % PIECES
    local = np.unique(route, return_inverse=True)[1].astype(np.int64)
    nodes, node = np.unique(fps, return_inverse=True)
    label, n = np.arange(len(nodes)), len(route)
    for j, (first, width) in enumerate(pieces()):
        rows = np.flatnonzero(piece != j)
        value = (words[rows, 0] >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
        for bit in range(width):
            keyed = np.sort(((local[rows] << PIECE_BITS) + (value & ~(1 << bit))) * n + rows)
            keys, at = keyed // n, keyed % n
            same = keys[1:] == keys[:-1]
            if not same.any():
                continue
            several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            keys, at = keys[several], at[several]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
            lengths = np.diff(np.concatenate([starts, [len(keys)]]))
            for s, k in zip(starts[lengths > SMALL_RUN].tolist(), lengths[lengths > SMALL_RUN].tolist(), strict=True):
                own = at[s : s + k]
                if len(np.unique(label[node[own]])) > 1:
                    a, b = _span(words[own])
                    label = _joined(label, node[own[a]], node[own[b]])
            few = np.repeat(lengths <= SMALL_RUN, lengths)
            keys, at = keys[few], at[few]
            for d in range(1, SMALL_RUN):
                same = keys[d:] == keys[:-d]
                if not same.any():
                    break
                a, b = at[:-d][same], at[d:][same]
                apart = label[node[a]] != label[node[b]]
                a, b = a[apart], b[apart]
                close = np.bitwise_count(words[a] ^ words[b]).sum(axis=1) <= RADIUS
                label = _joined(label, node[a[close]], node[b[close]])
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[linked]], nodes[linked]


def _matcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(route, fp, w0, ...) sorted by route to candidate links (a, b)."""
    parts: list[tuple[np.ndarray, ...]] = []

    def out():
        route, fps, words = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _meet(route, fps, words)], ["a", "b"])

    for batch in batches:
        route, fps, *words = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2 + CHECKED))
        words = np.stack([w.view(np.uint64) for w in words], axis=1)
        if not len(route):
            continue
        # The last route may go on in the next batch.
        last = int(np.searchsorted(route, route[-1]))
        if last or (parts and parts[-1][0][-1] != route[-1]):
            parts.append((route[:last], fps[:last], words[:last]))
            yield out()
            parts.clear()
        parts.append((route[last:], fps[last:], words[last:]))
    if parts:
        yield out()


def similar_links(distinct: DataFrame, routed: int = ROUTED) -> DataFrame:
    """Candidate links (a, b) of distinct (fp, words): rows that agree in a piece and a variant.

    A route of more than ``routed`` rows is dealt to blocks and every two blocks meet, so no
    pair is left out.
    """
    index = distinct.select("fp", F.explode(routes(F.col("words"))).alias("r")).select("fp", "r.*")
    # There are at most 2^17 routes, however many rows.
    sizes = index.groupBy("route").agg(F.count("*").alias("n")).where(F.col("n") > routed)
    large = written(sizes.select("route", F.ceil(F.col("n") / routed).alias("parts")), "copies-routes")
    if not large.isEmpty():
        dealt = index.join(F.broadcast(large), "route", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(SEED)), F.col("parts")))
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: (x != F.col("own")) | (F.col("parts") == 1))
        dealt = dealt.withColumn("other", F.explode(others))
        pair = F.shiftleft(F.least("own", "other"), 23).bitwiseOR(F.greatest("own", "other"))
        index = dealt.withColumn("route", F.shiftleft(pair, ROUTE_BITS).bitwiseOR(F.col("route")))
    sorted_ = index.select("route", "fp", *[f"w{k}" for k in range(CHECKED)]).repartition("route").sortWithinPartitions("route")
    return sorted_.mapInArrow(_matcher, "a long, b long")


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [shingle_set(t or b"", width) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            fps = [_signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) for x in sets]
            sizes = pa.array([len(x) for x in sets], pa.int64())
            words = pa.array([wide_fingerprint(x).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), sizes, words], ["id", "key", "fp", "size", "words"])

    return run


def similar_groups(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the first of its group; sets of at least that Jaccard similarity are linked."""
    lengths = np.array([len(x) for x in sets])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(codes, np.cumsum(lengths)[:-1])
    group, unseen = np.arange(len(sets)), np.arange(len(sets))
    while len(unseen):
        first, unseen = unseen[0], unseen[1:]
        todo = [first]
        flat = codes[np.repeat(np.isin(np.arange(len(sets)), unseen), lengths)]
        while todo and len(unseen):
            x = todo.pop()
            mark = np.zeros(len(values), dtype=np.int64)
            mark[parts[x]] = 1
            own = lengths[unseen]
            shared = np.add.reduceat(mark[flat], np.cumsum(own) - own)
            near = shared >= similarity * (own + lengths[x] - shared) - 1e-9
            if near.any():
                group[unseen[near]] = first
                todo += unseen[near].tolist()
                flat, unseen = flat[np.repeat(~near, own)], unseen[~near]
    return group


def _verifier(width: int, similarity: float):
    """Reads (block, fp, text) sorted by the first two; gives (fp, root) of similar sets of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fps, sets = None, [], []

        def out():
            group = similar_groups(sets, similarity)
            return pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array([fps[g] for g in group], pa.int64())], ["fp", "root"])

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for n, (of, fp) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if fps and of != now:
                    yield out()
                    fps, sets = [], []
                now = of
                fps.append(fp)
                sets.append(shingle_set(texts[n].as_py() or b"", width))
        if fps:
            yield out()

    return run


def near_copies(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(id, key, fp, root) of every row of (id long, text): texts of equal ``root`` are linked.

    Links are pairs whose sets of ``width``-word shingles have at least that Jaccard
    similarity. Texts whose wide SimHash fingerprints meet in ``similar_links`` are candidates;
    the sets of a component of candidates are compared whole. A component of more than ``BLOCK_SHINGLES`` is dealt to
    blocks, and every two blocks meet in a task of their own: no task holds more, and no
    pair is left out. ``fp`` stands for a set, so exact copies are compared once. Null and
    empty texts are copies of each other.
    """
    keyed = docs.select("id", row_key().alias("key"), "text")
    signed = written(keyed.mapInArrow(_signatures(width), "id long, key binary, fp long, size long, words array<long>"), "copies-prints")
    distinct = signed.groupBy("fp").agg(F.min("key").alias("key"), F.first("size").alias("size"), F.first("words").alias("words"))
    distinct = written(distinct, "copies-distinct")
    stars = written(components(similar_links(distinct.select("fp", "words"))), "copies-candidates")
    asked = distinct.join(stars, distinct["fp"] == stars["node"]).select("key", "fp", "size", F.col("root").alias("candidates"))
    asked = written(asked, "copies-asked")
    parts = asked.groupBy("candidates").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).alias("parts"))
    asked = written(asked.join(parts, "candidates").drop("size"), "copies-parts")
    several = not asked.where("parts > 1").isEmpty()
    sent = F.broadcast(asked) if asked.count() <= SENT else asked
    texts = keyed.join(sent, "key").select("candidates", "parts", "fp", "text")
    # One text of each set; Spark drops copies in every task before rows move.
    nth = F.row_number().over(Window.partitionBy("candidates", "fp").orderBy(F.length("text")))
    texts = texts.withColumn("nth", nth).where("nth = 1").drop("nth")
    own = F.pmod(F.xxhash64("fp", F.lit(SEED)), F.col("parts"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: (x != F.col("own")) | (F.col("parts") == 1))
    texts = texts.withColumn("own", own).withColumn("other", F.explode(others))
    block = F.struct("candidates", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).alias("block")
    texts = texts.select(block, "fp", "text").repartition("block").sortWithinPartitions("block", "fp")
    named = texts.select(F.concat_ws(":", "block.candidates", "block.a", "block.b").alias("block"), "fp", "text")
    roots = written(named.mapInArrow(_verifier(width, similarity), "fp long, root long"), "copies-roots")
    if several:
        # Blocks overlap: what they link is put together.
        stars = components(roots.where("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b")))
        roots = written(stars.select(F.col("node").alias("fp"), "root"), "copies-joined")
    return signed.join(roots, "fp", "left").select("id", "key", "fp", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, width: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each near-duplicate component, the one of the smallest id.

    Near duplicates are those of ``near_duplicates``, or with a ``similarity`` those of
    ``near_copies``. Rows without an id come last in their component. Of rows that repeat
    the id, the one with the smallest digest of its text stays, and of those that repeat
    the text too, the one with the smallest hash of the row.
    """
    text = F.coalesce(column_or_null(docs, "text", "string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), column_or_null(docs, "doc_id", "long").alias("id"), text.alias("text"))
    found = near_duplicates(rows.select("id", "text")) if similarity is None else near_copies(rows.select("id", "text"), width, similarity)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    chosen = written(first.select("first.key"), "simhash-chosen")
    # Of rows that repeat id and text one stays, which Spark sees to in every task before rows
    # move; the join finds them dealt by key.
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))
    single = rows.select("row", row_key().alias("key")).withColumn("nth", nth).where("nth = 1")
    return single.join(chosen, "key", "left_semi").select("row.*")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
