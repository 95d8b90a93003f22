"""Exact Jaccard join of word n-gram sets by universe partitioning.

Sets are put into size bands such that linked sets lie in one band or neighbouring ones.  For a band
the largest symmetric difference H of linked sets is known.  The universe of shingle hashes is cut into
segments, for each band its own number.  If more than H segments of a set are occupied, a linked set
agrees with it in one of them (pigeonhole); a segment allocated one deletion counts twice, as it is
also found when one shingle is too many on either side.  So a set is indexed by a signature for every
occupied segment (and its one-deletion neighbours where allocated); sets with too few occupied segments
index their empty ones too, which completes the argument for pairs of such sets.  Segments and
deletions are allocated for each band by expected cost.

There are more segments than H needs, so a set with k occupied segments to spare shares at least k + 1
signatures with every linked set.  Therefore every set leaves out its k most common signatures, by one
order for all: two linked sets then still have one in common (prefix filter).  What is left out are
signatures of passages that many documents share, which would join unrelated sets to one cluster.

Sets that share a signature form clusters.  A cluster may be a family of documents made from one
template, in which hardly any pair links.  So every set of a cluster gets a parity sketch, one bit for
each bucket of the shingles' hashes.  Two sketches differ in no more bits than the sets in shingles, so
pairs whose sketches differ in more than a link allows are ruled out for certain.  Sets connected by
pairs that are not ruled out form the smaller clusters that are verified exactly, block against block,
by products of their occupancy matrices.  A task returns a spanning forest of what it finds, never
pairs.  Equal sets are one class throughout.  Sets are held as 64-bit hashes of their shingles, and
told apart by a 64-bit hash of those.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabledoc.llm.arrow_text import in_small_batches, list_array, slices
from tabledoc.llm.bloom import bits_for, build
from tabledoc.llm.components import components, forest
from tabledoc.session import materialise

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Assumed chance that an unrelated set has a given shingle; only the cost of an allocation depends on it.
SHARED = 0.01
#: Part of the segments that a set can do without, about.
SPARE = 0.1
#: Sets and shingles of a block of a cluster, about.
BLOCK_SETS, BLOCK_SHINGLES = 256, 200_000
#: Sets and sketch bits of a block of a cluster of shared signatures, about.
SKETCH_SETS, SKETCH_BITS = 512, 1 << 23
#: Longest sketch; larger sets are told apart less well.
LARGEST_SKETCH = 1 << 20
#: Classes that a task remembers in order to index copies once; more only cost space.
SEEN = 200_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a UTF-8 text, A-Z lower-cased.

    Words are runs of anything but ASCII white space.  A text with fewer words is one shingle; one
    without words has none.
    """
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, text.translate(_LOWER).split()), np.uint64)
    n = len(h)
    if not n:
        return h
    width = min(words, n)
    x = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        x = _mix(x * _A + h[i : n - width + 1 + i])
    return np.unique(x)


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    raw, at = data.tobytes(), offsets.tolist()
    return [shingle_set(raw[a:b], words) for a, b in zip(at, at[1:])]


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of each set; 0 for empty ones."""
    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)


class Bands:
    """Size bands and their allocations for a similarity of ``num / den``."""

    def __init__(self, num: int, den: int, sets: int):
        self.num, self.den, self.sets = num, den, sets
        self.first = [1]
        self.plan: list[tuple[int, int, int, int]] = []  # H, segments, of which with a deletion, largest size

    def _grow(self, size: int) -> None:
        while self.first[-1] <= size:
            lo = self.first[-1]
            nxt = lo * self.den // self.num + 1
            small = nxt - 1
            large = small * self.den // self.num
            h = (self.den - self.num) * (small + large) // (self.den + self.num)
            self.plan.append((h, *self._allocate(h, lo), large))
            self.first.append(nxt)

    def _allocate(self, h: int, size: int) -> tuple[int, int]:
        """Segments and deletions with the least expected index rows and chance matches."""
        best = None
        for deletions in range((h + 1) // 2 + 1):
            exact = h + 1 - 2 * deletions
            if exact < 0:
                continue
            held = size / (exact + deletions)  # shingles of a segment
            rows, more = 1 + self.sets * SHARED**held, (held + 1) * (1 + self.sets * SHARED ** max(held - 1, 0))
            cost = exact * rows + deletions * more
            if best is None or cost < best[0]:
                best = (cost, exact, deletions)
        _, exact, deletions = best
        # a few more exact segments, so that hardly any set has too few occupied
        while exact + deletions < 2 * (h + 1):
            m = exact + deletions
            empty = (1 - 1 / m) ** size
            if exact * (1 - empty) - 3 * np.sqrt(exact * empty * (1 - empty)) + 2 * deletions * (1 - empty) >= (h + 1) * (1 + SPARE):
                break
            exact += 1
        return exact + deletions, deletions

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """Band of each size."""
        self._grow(int(sizes.max(initial=1)))
        return np.searchsorted(self.first, sizes, "right") - 1


@lru_cache(4)
def bands(num: int, den: int, sets: int) -> Bands:
    return Bands(num, den, sets)


def signatures(sets: list[np.ndarray], plan: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of all sets, the set of each, whether it is of the band below, and how many the set can spare there.

    Linked unequal sets share one that is of the same band.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    own = plan.of(np.maximum(sizes, 1))
    mixed = _mix(flat + _B)
    got, owner, lower, spare = [], [], [], []
    for step, band in enumerate((own, own - 1)):
        ok = (band >= 0) & (sizes > 0)
        table = np.array(plan.plan)[np.maximum(band, 0)] if len(sets) else np.zeros((0, 4), int)
        h, m, deletions, largest = table.T if len(table) else (np.zeros(0, np.int64),) * 4
        ok &= (h > 0) & (sizes <= largest)  # without any difference allowed there are only equal sets
        use = np.flatnonzero(ok)
        if not len(use):
            continue
        of = np.repeat(use, sizes[use])  # the set of each shingle in use
        at = np.arange(len(of)) - np.repeat(np.cumsum(sizes[use]) - sizes[use], sizes[use]) + starts[of]
        segment = ((flat[at] >> np.uint64(32)) * m[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        place = of * (1 << 32) + segment  # ascending, as sets are sorted
        edge = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        total = np.add.reduceat(mixed[at], edge)
        set_of, segment_of = of[edge], segment[edge]

        def sign(total: np.ndarray, band: np.ndarray, segment: np.ndarray) -> np.ndarray:
            return _mix(total + _mix((band.astype(np.uint64) << np.uint64(32)) + segment.astype(np.uint64) + _A))

        before = len(got)
        got.append(sign(total, band[set_of], segment_of))
        owner.append(set_of)
        with_deletion = segment_of < deletions[set_of]
        worth = np.bincount(set_of, 1 + with_deletion, len(sets))
        short = use[worth[use] <= h[use]]
        # empty segments: of sets with too few occupied ones, and wherever a deletion may empty one
        for s in np.union1d(short, use[deletions[use] > 0]):
            lo, hi = np.searchsorted(set_of, [s, s + 1])
            free = np.setdiff1d(np.arange(m[s] if s in short else deletions[s]), segment_of[lo:hi])
            got.append(sign(np.zeros(len(free), np.uint64), np.full(len(free), band[s]), free))
            owner.append(np.full(len(free), s))
        inside = segment < deletions[of]
        if inside.any():  # one shingle left out
            run = np.searchsorted(edge, np.flatnonzero(inside), "right") - 1
            got.append(sign(total[run] - mixed[at[inside]], band[of[inside]], segment[inside]))
            owner.append(of[inside])
        # a signature left out costs as much as its segment counts
        left = np.where(deletions > 0, (worth - h - 1) // 2, worth - h - 1).astype(np.int64)
        for of_part in owner[before:]:
            lower.append(np.full(len(of_part), bool(step)))
            spare.append(left[of_part])
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    return np.concatenate(got), np.concatenate(owner), np.concatenate(lower), np.concatenate(spare)


def tile_forest(sets: list[np.ndarray], left: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among sets; between different sides if ``left`` has both."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    held = count[token] > 1  # a shingle of one set alone is in no intersection
    token, owner = token[held], owner[held]
    _, token = np.unique(token, return_inverse=True)
    both = np.zeros((n, n))
    width = int(token.max(initial=-1)) + 1
    step = max(1, (4 << 20) // n)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    for at in range(0, width, step):
        lo, hi = np.searchsorted(token, [at, at + step])
        occupied = np.zeros((n, min(step, width - at)), np.float32)
        occupied[owner[lo:hi], token[lo:hi] - at] = 1
        both += occupied @ occupied.T
    common = np.rint(both).astype(np.int64)
    link = den * common >= num * (sizes[:, None] + sizes[None, :] - common)
    if left.any() and not left.all():
        link &= left[:, None] != left[None, :]
    a, b = np.nonzero(np.triu(link, 1))
    return forest(a, b, n)


def sketch_bits(size: int) -> int:
    """Bits of the sketch of a set: a power of two, two to four times its size."""
    return min(LARGEST_SKETCH, 1 << max(6, (2 * size - 1).bit_length()))


def sketch(s: np.ndarray) -> bytes:
    """For each bucket of hashes, whether the set has an odd number of shingles in it."""
    bits = sketch_bits(len(s))
    bucket = (s >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch_forest(sketches: list[bytes], sizes: np.ndarray, left: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs whose sketches do not rule out a link; between different sides if ``left`` has both.

    Sketches of different lengths are compared at the shorter one's, to which the longer is folded.
    """
    n = len(sketches)
    bits = np.array([8 * len(s) for s in sketches], np.int64)
    a, b = [], []
    for level in np.unique(bits):
        # a linked set is at most den / num times as large
        use = np.flatnonzero((bits >= level) & (bits * num < 2 * level * den))
        rows = np.zeros((len(use), level), np.uint8)
        for i, at in enumerate(use):
            folded = np.unpackbits(np.frombuffer(sketches[at], np.uint8))
            rows[i] = np.bitwise_xor.reduce(folded.reshape(level, -1), 1)
        own = bits[use] == level
        product = np.zeros((int(own.sum()), len(use)), np.float32)
        for at in range(0, level, 4096):
            part = 1 - 2 * rows[:, at : at + 4096].astype(np.float32)
            product += part[own] @ part.T
        differ = (level - np.rint(product).astype(np.int64)) // 2
        x, y = sizes[use[own]][:, None], sizes[use][None, :]
        most = (den - num) * (x + y) // (den + num)
        p, q = np.nonzero((differ <= most) & (abs(x - y) <= most))
        p, q = use[own][p], use[q]
        keep = p != q
        if left.any() and not left.all():
            keep &= left[p] != left[q]
        a.append(p[keep])
        b.append(q[keep])
    return forest(np.concatenate(a), np.concatenate(b), n) if a else []


def _meet(members: DataFrame, sets: DataFrame, column: str, weight, most_sets: int, most_weight: int, find) -> DataFrame:
    """Edges ``a, b`` that ``find`` returns for the clusters of ``members``, block against block.

    ``members`` has ``cluster, set_id, rep, n``; ``column`` of ``sets`` is what a block holds of a set and
    ``weight`` its size.  Clusters of one block share tasks; a block's sets and weights are bounded.
    """
    members = members.withColumn("w", weight)
    per = members.groupBy("cluster").agg(F.count("*").alias("g"), F.sum("w").alias("s"))
    blocks = F.greatest(F.ceil(F.col("g") / most_sets), F.ceil(F.col("s") / most_weight)).cast("int")
    total = members.agg(F.count("*"), F.sum("w")).first()
    groups = max(1, -(-total[0] // most_sets), -(-(total[1] or 0) // most_weight))
    dealt = members.join(per.select("cluster", blocks.alias("blocks")), "cluster")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    whole = dealt.join(sets.select("rep", "set_id", F.col(column).alias("held")), ["rep", "set_id"])
    alone = F.col("blocks") == 1
    tiles = whole.select(
        "cluster", "set_id", "n", "held", "own", alone.alias("alone"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"),
    ).select(
        F.when(F.col("alone"), F.pmod(F.xxhash64("cluster"), F.lit(groups))).otherwise(F.col("cluster")).alias("k"), "alone",
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cluster", "set_id", "own", "n", "held",
    )

    def run(t: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, part in t.sort_values(["cluster", "set_id"]).groupby("cluster", sort=False):
            part = part.drop_duplicates("set_id")
            if len(part) > 1:
                ids = part["set_id"].to_numpy()
                for x, y in find(list(part["held"]), part["n"].to_numpy(np.int64), (part["own"] == part["i"]).to_numpy()):
                    a.append(int(ids[x]))
                    b.append(int(ids[y]))
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return tiles.groupBy("k", "alone", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (4, 5), key: str = "doc_id", text: str = "text",
    block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per row: ``doc_id, n_shingles, component_id`` (smallest id reached by links, itself included).

    A document's set are its distinct ``words``-word shingles (see ``shingle_set``).  Two documents link
    when den * |intersection| >= num * |union| for ``similarity`` (num, den) below 1.  Null and empty texts
    have an empty set and link with nothing; rows without id have no component and link with nothing;
    repeated rows are copies.  An empty table gives no rows; other columns are ignored.
    """
    num, den = similarity
    df = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    many = df.count()  # for the cost of an allocation

    def name_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, offsets, data in slices(batch, "text"):
                sets = _sets(data, offsets, words)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(_names(sets)), pa.array([len(s) for s in sets], pa.int64())],
                    names=["doc_id", "set_id", "n_shingles"],
                )

    def index(filt):
        """Signature rows of all texts, or of those signatures that the filter holds."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plan, seen = bands(num, den, many), set()
            for batch in batches:
                for _, offsets, data in slices(batch, "text"):
                    sets = {}
                    for s in _sets(data, offsets, words):
                        if len(s):
                            sets.setdefault(xxhash.xxh3_64_intdigest(s.tobytes()), s)
                    sets = {name: s for name, s in sets.items() if name not in seen}
                    seen.update(sets)
                    if len(seen) > SEEN:
                        seen.clear()
                    names = np.array(list(sets), np.uint64).view(np.int64)
                    got, owner, lower, spare = signatures(list(sets.values()), plan)
                    if filt is not None:
                        hit = filt.value.holds(got.view(np.int64), (got >> np.uint64(32)).view(np.int64))
                        got, owner, lower, spare = got[hit], owner[hit], lower[hit], spare[hit]
                    columns = [pa.array(got.view(np.int64)), pa.array(names[owner])]
                    if filt is not None:
                        columns += [pa.array(lower), pa.array(spare)]
                    yield pa.RecordBatch.from_arrays(columns, names=["sig", "set_id", "lower", "spare"][: len(columns)])

        texts = df.where("doc_id is not null").select("text")
        return texts.mapInArrow(run, "sig long, set_id long" + (", lower boolean, spare long" if filt is not None else ""))

    found = materialise(in_small_batches(df).mapInArrow(name_sets, "doc_id long, set_id long, n_shingles long"), "sets")
    owned = found.where("doc_id is not null and n_shingles > 0")
    # signatures of more than one class; only rows with one of them are made again and exchanged
    shared = index(None).groupBy("sig").agg(F.min("set_id").alias("a"), F.max("set_id").alias("z"), F.count("*").alias("n"))
    shared = materialise(shared.where("a < z").select("sig", "n"), "shared")
    halves = shared.select(F.col("sig").alias("h1"), F.shiftrightunsigned("sig", 32).alias("h2"))
    filt = docs.sparkSession.sparkContext.broadcast(build(halves, bits_for(shared.count(), 10, 1 << 26), 4))  # 8 MB at most
    met = index(filt).join(shared, "sig").dropDuplicates(["sig", "set_id", "lower"])
    order = Window.partitionBy("set_id", "lower").orderBy(F.desc("n"), "sig")  # the signatures of one set
    kept = materialise(met.withColumn("_at", F.row_number().over(order)).where("_at > spare").select("sig", "set_id"), "met")
    least = kept.groupBy("sig").agg(F.min("set_id").alias("a"), F.max("set_id").alias("z")).where("a < z").select("sig", "a")
    edges = kept.join(least, "sig")
    alike = edges.where("set_id != a").select("a", F.col("set_id").alias("b")).distinct()
    clusters = components(alike).select(F.col("id").alias("set_id"), F.col("component").alias("cluster"))
    classes = owned.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    members = materialise(clusters.join(classes, "set_id"), "clusters")

    # the sets of cluster members, written once; a filter of bounded size spares the others' hashing
    needed = members.select(F.xxhash64("rep").alias("h1"), F.xxhash64(F.lit(1), F.col("rep")).alias("h2"))
    filt = build(needed, bits_for(members.count(), 12, 1 << 26), 5)
    shared_filter = docs.sparkSession.sparkContext.broadcast(filt)  # 8 MB at most
    tested = df.select("doc_id", F.xxhash64("doc_id").alias("h1"), F.xxhash64(F.lit(1), F.col("doc_id")).alias("h2"), "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = shared_filter.value.holds(batch.column(1).to_numpy(), batch.column(2).to_numpy())
            for rows, offsets, data in slices(batch.filter(pa.array(hit)), "text"):
                sets = _sets(data, offsets, words)
                size = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), pa.array(_names(sets)), pa.array([sketch(s) for s in sets], pa.binary()),
                        list_array(flat, size, pa.int64()),
                    ],
                    names=["rep", "set_id", "sketch", "shingles"],
                )

    texts = tested.where("doc_id is not null")
    sets = materialise(texts.mapInArrow(sets_of, "rep long, set_id long, sketch binary, shingles array<long>"), "members")

    def possible(held: list, sizes: np.ndarray, left: np.ndarray) -> list[tuple[int, int]]:
        return sketch_forest(held, sizes, left, num, den)

    def certain(held: list, sizes: np.ndarray, left: np.ndarray) -> list[tuple[int, int]]:
        return tile_forest([np.asarray(s).view(np.uint64) for s in held], left, num, den)

    bits = F.least(F.lit(LARGEST_SKETCH), F.col("n") * 4)
    near = components(_meet(members, sets, "sketch", bits, SKETCH_SETS, SKETCH_BITS, possible))
    near = materialise(near.select(F.col("id").alias("set_id"), F.col("component").alias("cluster")).join(classes, "set_id"), "clusters")
    links = _meet(near, sets, "shingles", F.col("n"), block_sets, block_shingles, certain)
    joined = components(links).select(F.col("id").alias("set_id"), "component")
    # the smallest document of each component, then of each class
    least = classes.join(joined, "set_id").groupBy("component").agg(F.min("rep").alias("least"))
    linked = joined.join(least, "component").select("set_id", "least")
    own = found.select("doc_id", "set_id", "n_shingles")
    placed = classes.join(linked, "set_id", "left").select("set_id", F.coalesce("least", "rep").alias("component_id"))
    empty = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    rest = own.where(empty).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return own.where(~empty).join(placed, "set_id").select("doc_id", "n_shingles", "component_id").unionByName(rest)
