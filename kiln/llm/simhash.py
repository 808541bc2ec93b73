"""SimHash near-duplicates: fingerprints of word shingles, linked by the generalised pigeonhole principle."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import few, mapped, materialize, small_batches, tidy
from kiln.llm.components import components
from kiln.llm.shingles import shingles, word_hashes

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: A bucket of more fingerprints than this isn't one task's work; its links are found by shared neighbours instead.
BUCKET = 20_000
#: In smaller buckets: up to here all distances are computed at once, beyond it shared neighbours are sorted.
DENSE = 256
#: Shingles whose bits are counted at a time.
BATCH = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit majority of the XXH64 hashes of the shingles, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    begin = starts[:n].tolist()
    for i in range(0, n, BATCH):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[i : i + BATCH], last[i : i + BATCH], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BATCH):
        counts += np.unpackbits(hashes[i : i + BATCH].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the fingerprint as a signed number."""

    def made(batch: pa.RecordBatch):
        fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
        yield {"doc_id": batch.column(0), "fp": fp.view(np.int64)}

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(source, made, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, share of ones per bit, correlation of bits, over all of them; 64 x 64 sums reach the driver."""

    def summed(batch: pa.RecordBatch):
        x = np.unpackbits(batch.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        co = x.T @ x
        yield {"k": np.arange(4097), "x": np.append(co.ravel(), len(x)).astype(np.int64)}

    sums = np.zeros(4097)
    for r in mapped(nodes.select("fp"), summed, "k long, x long", 1 << 20).groupBy("k").agg(F.sum("x").alias("x")).collect():
        sums[r["k"]] = r["x"]
    n = int(sums[4096])
    co = sums[:4096].reshape(64, 64) / max(n, 1)
    p = co.diagonal().copy()
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return n, p, (co - np.outer(p, p)) / np.outer(sd, sd)


def partition_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits: each begins with the bit least correlated with those before, and takes in turn the bit most
    correlated with its own; so what one group says tells little of the others."""
    r = np.abs(correlation)
    seeds = [int(r.sum(0).argmax())]
    while len(seeds) < m:
        rest = [b for b in range(64) if b not in seeds]
        seeds.append(min(rest, key=lambda b: (r[b, seeds].max(), b)))
    groups = [[s] for s in seeds]
    free = set(range(64)) - set(seeds)
    while free:
        for g in sorted(groups, key=len):
            if free:
                best = max(free, key=lambda b: (r[b, g].mean(), -b))
                g.append(best)
                free.remove(best)
    return [sorted(g) for g in groups]


def candidate_estimates(n: int, p: np.ndarray, group: list[int], most: int) -> list[float]:
    """Cost of threshold -1, 0, .., most for a group: expected pairs within it, plus keys that are dealt out."""
    near = np.zeros(most + 1)
    near[0] = 1.0
    for b in group:
        q = 2 * p[b] * (1 - p[b])
        near[1:] = near[1:] * (1 - q) + near[:-1] * q
        near[0] *= 1 - q
    keys = [1.0]
    for k in range(1, most + 1):
        keys.append(keys[-1] * (len(group) - k + 1) / k)
    return [0.0] + [float(n * n / 2 * near[: t + 1].sum() + 20 * n * sum(keys[: t + 1])) for t in range(most + 1)]


def allocate(costs: list[list[float]], most: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost that add up to most - m + 1, by dynamic programming over the groups.

    By the generalised pigeonhole principle a pair within `most` bits is then within the threshold in some group.
    """
    total = most + 1  # of (threshold + 1) over the groups
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, picks) in best.items():
            for t in range(-1, most + 1):
                to = used + t + 1
                if to <= total and (to not in after or cost + c[t + 1] < after[to][0]):
                    after[to] = (cost + c[t + 1], [*picks, t])
        best = after
    return best[total]


def plan(n: int, p: np.ndarray, correlation: np.ndarray, most: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the groups in use; of two to six groups, what is estimated to be cheapest."""
    found = []
    for m in range(2, 7):
        groups = partition_bits(correlation, m)
        cost, picks = allocate([candidate_estimates(n, p, g, most) for g in groups], most)
        found.append((cost, [(g, t) for g, t in zip(groups, picks, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _mask(bits: Iterable[int]) -> int:
    return sum(1 << b for b in bits)


def _ball(group: list[int], radius: int) -> list[int]:
    """Masks of up to radius bits of the group."""
    out = [0]
    level = [(0, -1)]
    for _ in range(radius):
        level = [(m | 1 << b, k) for m, last in level for k, b in enumerate(group) if k > last]
        out += [m for m, _ in level]
    return out


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.up
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            while up[y] != y:
                up[y] = up[up[y]]
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        while True:
            to = self.up[self.up]
            if (to == self.up).all():
                return to
            self.up = to


@functools.cache
def _flips(most: int) -> np.ndarray:
    return np.array(_ball(list(range(64)), (most + 1) // 2), np.uint64)


def linked(fps: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Links that connect, among these distinct fingerprints, all within `most` bits; as few as connect them.

    Small sets by all distances. Larger ones by neighbours: two fingerprints are within two bits exactly if they share
    one within one bit; for other bounds, shared neighbours are candidates, which are verified against the first.
    """
    fps = np.unique(fps.view(np.uint64))
    n = len(fps)
    sets = _Union(n)
    if n <= DENSE or most not in (0, 2):
        for i in range(n - 1):
            j = i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= most)
            sets.link(np.full(len(j), i), j)
    elif most:
        flips = _flips(most)
        keys = (fps[:, None] ^ flips).ravel()
        order = np.argsort(keys, kind="stable")
        same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
        sets.link(order[same] // len(flips), order[same + 1] // len(flips))
    roots = sets.roots()
    signed = fps.view(np.int64)
    for i in np.flatnonzero(roots != np.arange(n)).tolist():
        yield int(signed[i]), int(signed[roots[i]])


def near_links(nodes: DataFrame, most: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that connect all which differ in at most `most` bits.

    Every fingerprint is put under its own key and those within the threshold, for each group of bits; two within
    `most` bits share a key in some group. Keys with up to `bucket` fingerprints are worked on in one task each;
    the fingerprints of larger ones are dealt out by their neighbours within one bit (for `most` 2 sharing one is the
    same as being linked), so that no key's fingerprints need be in one task and no pairs are written out.
    """
    n, p, correlation = bit_statistics(nodes)
    parts = plan(n, p, correlation, most) if n > 1 else [(list(range(64)), 0)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keyed = None
    for k, (bits, radius) in enumerate(parts):
        own = F.col("fp").bitwiseAND(F.lit(signed(_mask(bits))))
        masks = [signed(x) for x in _ball(bits, radius)]
        key = F.explode(F.transform(F.array(*map(F.lit, masks)), lambda x: F.col("fp").bitwiseAND(F.lit(signed(_mask(bits)))).bitwiseXOR(x))) if len(masks) > 1 else own  # noqa: B023
        one = nodes.select("fp", F.lit(k).alias("part"), key.alias("key"))
        keyed = one if keyed is None else keyed.unionByName(one)
    keyed = materialize(keyed, "keys")
    sizes = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(sizes, ["part", "key"]), "buckets")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done(u: list, v: list) -> None:
            for a, b in linked(np.concatenate(held), most):
                u.append(a)
                v.append(b)

        for batch in batches:
            u, v = [], []
            part, key, fp = (batch.column(i).to_numpy() for i in range(3))
            if not len(fp):
                continue
            edge = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
            for a, b in zip(np.append(0, edge).tolist(), np.append(edge, len(fp)).tolist(), strict=True):
                if now != (part[a], key[a]):
                    if held:
                        done(u, v)
                    now, held = (part[a], key[a]), []
                held.append(fp[a:b].copy())
            yield pa.RecordBatch.from_pydict({"u": u, "v": v}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        if held:
            u, v = [], []
            done(u, v)
            yield pa.RecordBatch.from_pydict({"u": u, "v": v}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    small = shared.where(F.col("n") <= bucket).select("part", "key", "fp")
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = small.repartition(partitions, "part", "key").sortWithinPartitions("part", "key").mapInArrow(tidy(work), "u long, v long")
    hot = shared.where(F.col("n") > bucket).select("fp").distinct()
    if most == 2:
        keys = F.array(*(F.col("fp").bitwiseXOR(F.lit(signed(int(x)))) for x in _flips(2)))
        at = hot.select("fp", F.explode(keys).alias("z"))
        near = at.groupBy("z").agg(F.min("fp").alias("m"))
        return links.unionByName(at.join(near, "z").where("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v")).distinct())
    if hot.isEmpty():
        return links
    # Other bounds: the masked forms with `most` bits cleared are equal for exactly the pairs within the bound.
    masks = F.array(*(F.lit(signed(~x & (1 << 64) - 1)) for x in _ball(list(range(64)), most)[-_choose(64, most) :]))
    at = hot.select("fp", F.posexplode(F.transform(masks, lambda x: F.col("fp").bitwiseAND(x))).alias("b", "z"))
    near = at.groupBy("b", "z").agg(F.min("fp").alias("m"))
    return links.unionByName(at.join(near, ["b", "z"]).where("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v")).distinct())


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id that can be
    reached over links of at most `most` differing bits.

    Null and empty texts have fingerprint zero and are linked like others. Rows with equal texts share a fingerprint
    and so a component. Null ids are passed through and never name a component, unless it has no other. An empty
    table gives an empty result. Other columns are not read.
    """
    made = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(near_links(nodes, most, bucket))
    labels = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = labels.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = labels.join(names, "root").select("fp", "component_id")
    return made.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies: word shingles and the similarity that counts; bands of min-hashes. Two sets of Jaccard similarity 0.8
#: have no band in common with probability (1 - 0.8 ** 4) ** 24 = 3e-6.
COPY_SHINGLE, COPY_SIMILARITY, COPY_BANDS, COPY_ROWS = 5, 0.8, 24, 4
#: Texts that are compared with each other in one task; larger buckets are dealt out by pairs of blocks of this size.
COPY_BLOCK = 1024
#: Keys (8 bytes each, 16 with what they map to) are broadcast up to this many, else both sides are shuffled.
BROADCAST_KEYS = 1_000_000


def min_hashes(shingles: np.ndarray, n: int) -> np.ndarray:
    """The least values of n hash functions over a set of shingles."""
    least = np.full(n, ~np.uint64(0))
    odd = np.array([0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & (1 << 64) - 1 for k in range(n)], np.uint64)
    for i in range(0, len(shingles), BATCH // 16):
        h = odd[:, None] * shingles[i : i + BATCH // 16]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, h.min(1))
    return least


def band_keys(least: np.ndarray, bands: int = COPY_BANDS) -> list[int]:
    """One key for each band, a hash of the band's number and its min-hashes."""
    return [xxhash.xxh3_64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least.reshape(bands, -1))]


def sketch(least: np.ndarray) -> bytes:
    """A byte of each min-hash: the share of equal bytes estimates the similarity of two sets."""
    return (least >> np.uint64(5)).astype(np.uint8).tobytes()


def may_be_alike(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether so many bytes of sketches (rows) are equal that the similarity may reach the bound: all but the last 1e-5 of
    what two sets at the bound have (4.3 standard errors)."""
    n = a.shape[-1]
    return (a == b).sum(-1) >= n * similarity - 4.3 * np.sqrt(n * similarity * (1 - similarity))


def shingle_set(text: str | None, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """The set of shingles, sorted; a text with fewer words is one shingle, one without words none."""
    h = shingles(text, shingle)
    return np.unique(h if len(h) else shingles(text, max(1, len(word_hashes(text)))))


def short(shingles: np.ndarray) -> bytes:
    """A set of shingles as it is moved to be compared: the upper halves of the hashes. Of two sets of n shingles, n * n / 2**32
    unlike ones fall together, so the similarity is off by less than 1e-5 up to 20,000 words."""
    return np.unique((shingles >> np.uint64(32)).astype("<u4")).tobytes()


def set_links(sets: list[np.ndarray], roots: np.ndarray, sides: np.ndarray, across: bool, similarity: float) -> Iterator[tuple[int, int]]:
    """Index pairs that connect, beyond the components in roots, all sets whose Jaccard similarity reaches the bound; with
    across, of different sides only. Every pair of different components is computed, so none is left to chance."""
    sizes = np.array([len(x) for x in sets])
    starts = np.append(0, np.cumsum(sizes)[:-1])
    values, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    now = np.unique(roots, return_inverse=True)[1]
    flags = np.zeros(len(values), np.int64)
    for i in range(len(sets) - 1):
        open_ = (now != now[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9)
        open_[: i + 1] = False
        if across:
            open_ &= sides != sides[i]
        if not open_.any():
            continue
        own = tokens[starts[i] : starts[i] + sizes[i]]
        flags[own] = 1
        same = np.add.reduceat(flags[tokens], starts)
        flags[own] = 0
        for j in np.flatnonzero(open_ & (same > 0) & (same >= similarity * (sizes + sizes[i] - same) - 1e-9)).tolist():
            if now[j] != now[i]:
                now[now == now[j]] = now[i]
                yield i, j


def probed_pairs(prints: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """(u, v) marks of texts, of (mark, fp), whose fingerprints are the same or within `most` bits: of each fingerprint the
    first text with every other, and the first texts of fingerprints that the pigeonhole links."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("mark").alias("first")), "prints")
    same = prints.join(nodes, "fp").where("mark <> first").select(F.col("first").alias("u"), F.col("mark").alias("v"))
    links = near_links(nodes, most)
    near = links.join(nodes.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(nodes.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    return same.unionByName(near.select(F.col("a").alias("u"), F.col("b").alias("v")))


def copy_links(docs: DataFrame, keyed: DataFrame, sketches: DataFrame, similarity: float, shingle: int, block: int, probed: DataFrame | None = None) -> DataFrame:
    """(u, v) marks: links that connect all texts (doc_id, text, mark) that share a key of keyed (key, mark) and whose
    Jaccard similarity reaches the bound. Pairs of probed (u, v) are verified, too.

    Each bucket's texts are first compared with the one that meets most other texts in all its buckets, which is likely
    what the others were copied from. Where that leaves a bucket in several components, all
    its pairs of different components are compared: the texts outside its largest component with each other and with
    that one, in blocks, so that no key's texts need be in one task. Buckets with the same texts are one. All comparisons
    are first made on sketches (mark, sketch), and sets of shingles are moved for those texts only that have some other
    one that may be alike.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Keys of one text are most of all; they are left out by their counts before anything else is shuffled. Tables that are
    # joined by key are written first, so that the joins are plain shuffles, of which hot keys can be split.
    repeated = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "bucket-keys")
    members = materialize(keyed.join(few(repeated, BROADCAST_KEYS), "key", "left_semi").distinct(), "bucket-all")
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("mark").alias("low"), F.bit_xor("mark").alias("s"), F.bit_xor(F.xxhash64("mark")).alias("t")).where("n > 1")
    sizes = materialize(sizes.groupBy("n", "low", "s", "t").agg(F.min("key").alias("key")).select("key", "n"), "bucket-sizes")
    members = materialize(members.join(sizes, "key").select("key", "n", "mark"), "bucket-members")
    weight = members.groupBy("mark").agg(F.sum("n").alias("weight"))
    firsts = members.join(weight, "mark").groupBy("key").agg(F.max(F.struct("weight", "mark")).alias("top")).select("key", F.col("top.mark").alias("first"))
    shared = materialize(members.join(materialize(firsts, "bucket-firsts"), "key"), "buckets")

    pairs = shared.where("first <> mark").select(F.col("first").alias("u"), F.col("mark").alias("v"))
    if probed is not None:
        pairs = pairs.unionByName(probed)
    pairs = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs-all")
    wanted = shared.select("mark").unionByName(pairs.select(F.explode(F.array("u", "v")).alias("mark"))).distinct()
    sketches = materialize(sketches.join(few(wanted, BROADCAST_KEYS), "mark", "left_semi").dropDuplicates(["mark"]), "sketches")
    drawn = lambda column: np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(len(column), -1)

    def likely(batch: pa.RecordBatch):
        ok = may_be_alike(drawn(batch.column(2)), drawn(batch.column(3)), similarity)
        yield {"u": batch.column(0).to_numpy()[ok], "v": batch.column(1).to_numpy()[ok]}

    of = lambda table, name, at: table.select(F.col("mark").alias(at), F.col(name).alias(f"{name}_{at}"))
    sketched = pairs.join(of(sketches, "sketch", "u"), "u").join(of(sketches, "sketch", "v"), "v").select("u", "v", "sketch_u", "sketch_v")
    pairs = materialize(mapped(sketched, likely, "u long, v long"), "pairs")

    def sets(batch: pa.RecordBatch):
        yield {"mark": batch.column(0), "set": [short(shingle_set(t.as_py(), shingle)) for t in batch.column(1)]}

    def sets_of(marks: DataFrame) -> DataFrame:
        texts = docs.select("mark", "text").join(few(marks.distinct(), BROADCAST_KEYS), "mark", "left_semi").dropDuplicates(["mark"])
        return materialize(mapped(texts, sets, "mark long, set binary"), "sets")

    found = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("mark")))
    both = pairs.join(of(found, "set", "u"), "u").join(of(found, "set", "v"), "v").select("u", "v", "set_u", "set_v")

    def verified(batch: pa.RecordBatch):
        u, v = [], []
        for i in range(batch.num_rows):
            x, y, a, b = (batch.column(k)[i] for k in range(4))
            x, y, a, b = x.as_py(), y.as_py(), np.frombuffer(a.as_buffer(), "<u4"), np.frombuffer(b.as_buffer(), "<u4")
            same = len(np.intersect1d(a, b, assume_unique=True))
            if same >= similarity * (len(a) + len(b) - same) - 1e-9 and same:
                u.append(x)
                v.append(y)
        yield {"u": u, "v": v}

    links = materialize(mapped(both, verified, "u long, v long"), "links")
    # Buckets of two are settled; larger ones that are in several components yet are compared whole.
    roots = components(links).withColumnRenamed("node", "mark")
    rest = shared.where("n > 2").join(roots, "mark", "left").select("key", "mark", F.coalesce("root", "mark").alias("root"))
    parts = rest.groupBy("key", "root").agg(F.count("*").alias("c"))
    parts = parts.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("top")).where("n > top.c")
    parts = materialize(parts, "bucket-parts")
    blocks = lambda c: F.ceil(c / F.lit(block)).cast("int")
    dealt = rest.join(parts.select("key", F.col("top.root").alias("top"), blocks(F.col("n") - F.col("top.c")).alias("few"), blocks(F.col("top.c")).alias("many")), "key")
    at = lambda n: F.pmod(F.xxhash64("mark"), F.col(n)).cast("int")
    inside = F.col("root") == F.col("top")
    dealt = dealt.withColumn("side", F.when(inside, F.col("few") + at("many")).otherwise(at("few")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)))
    dealt = dealt.select("key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "mark", "root")

    def tasks(table: DataFrame, name: str, work, schema: str) -> DataFrame:
        """work(across, sides, marks, roots, bodies) of each (key, lo, hi), which is held as a whole; it returns columns."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held_ = None, []

            def done() -> pa.RecordBatch:
                side, mark, root, body = zip(*held_, strict=True)
                return pa.RecordBatch.from_pydict(work(now, np.array(side), np.array(mark), np.array(root), body))

            for batch in batches:
                for *task, side, mark, root, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if now != task:
                        if len(held_) > 1:
                            yield done()
                        now, held_ = task, []
                    held_.append((side, mark, root, body))
            if len(held_) > 1:
                yield done()

        table = table.select("key", "lo", "hi", "side", "mark", "root", name).repartition(partitions, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        return small_batches(table).mapInArrow(tidy(run), schema)

    def sift(task: list, side: np.ndarray, mark: np.ndarray, root: np.ndarray, body: tuple) -> dict:
        """The texts that have some other one, of another component, that may be alike; only their sets are moved."""
        x = drawn(pa.array(body, pa.binary()))
        ok = np.zeros(len(x), bool)
        for i in range(len(x)):
            other = root != root[i]
            if task[1] != task[2]:
                other &= side != side[i]
            ok[i] = other.any() and may_be_alike(x[other], x[i], similarity).any()
        n = int(ok.sum())
        return {"key": [task[0]] * n, "lo": pa.array([task[1]] * n, pa.int32()), "hi": pa.array([task[2]] * n, pa.int32()), "side": pa.array(side[ok], pa.int32()), "mark": mark[ok], "root": root[ok]} if n else {"key": pa.array([], pa.int64()), "lo": pa.array([], pa.int32()), "hi": pa.array([], pa.int32()), "side": pa.array([], pa.int32()), "mark": pa.array([], pa.int64()), "root": pa.array([], pa.int64())}

    def compare(task: list, side: np.ndarray, mark: np.ndarray, root: np.ndarray, body: tuple) -> dict:
        got = list(set_links([np.frombuffer(x, "<u4") for x in body], root, side, task[1] != task[2], similarity))
        return {"u": pa.array([int(mark[i]) for i, _ in got], pa.int64()), "v": pa.array([int(mark[j]) for _, j in got], pa.int64())}

    sifted = materialize(tasks(dealt.join(sketches, "mark"), "sketch", sift, "key long, lo int, hi int, side int, mark long, root long"), "sifted")
    return links.unionByName(tasks(sifted.join(sets_of(sifted.select("mark")), "mark"), "set", compare, "u long, v long"))


def near_copies(docs: DataFrame, similarity: float = COPY_SIMILARITY, shingle: int = COPY_SHINGLE, bands: int = COPY_BANDS, rows: int = COPY_ROWS, block: int = COPY_BLOCK) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, mark (hash of the text), keep_id, the smallest id of its group.

    Candidates: texts whose SimHash fingerprints over the word shingles are within two bits, found by the generalised
    pigeonhole; and, as a similarity of 0.8 allows for ten differing bits and more, which no pigeonhole can probe, texts that
    agree in all min-hashes of one of the bands over the same shingles. They are linked if the Jaccard similarity of the
    shingles, computed over the whole texts, reaches the bound; groups are the connected components. Texts without words
    are in no group, texts shorter than a shingle are one shingle; null text is empty. Rows that repeat an id and a text,
    and different ids with equal texts, share a group. Null ids are never the one that stays unless all are. An empty
    table gives an empty result; other columns are not read.
    """
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))

    def made(batch: pa.RecordBatch):
        fp, keys, drawn = np.zeros(batch.num_rows, np.uint64), [], []
        for i in range(batch.num_rows):  # one set at a time
            x = shingle_set(batch.column(2)[i].as_py(), shingle)
            fp[i] = majority(x)
            least = min_hashes(x, bands * rows)
            keys.append(band_keys(least, bands) if len(x) else [])
            drawn.append(sketch(least))
        yield {"doc_id": batch.column(0), "mark": batch.column(1), "fp": fp.view(np.int64), "keys": keys, "sketch": drawn}

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", mark.alias("mark"), F.col("text").cast("string").alias("text"))
    slim = materialize(mapped(texts, made, f"doc_id {kind}, mark long, fp long, keys array<bigint>, sketch binary"), "bands")
    # Equal texts are one node; the mark stands for the text.
    nodes = slim.where(F.size("keys") > 0)
    links = copy_links(texts, nodes.select("mark", F.explode("keys").alias("key")), nodes.select("mark", "sketch"), similarity, shingle, block, probed_pairs(nodes.select("mark", "fp")))
    roots = components(links).withColumnRenamed("node", "mark")
    labels = slim.select("doc_id", "mark", (F.size("keys") > 0).alias("worded")).join(few(roots, BROADCAST_KEYS), "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    keep = labels.where("worded").groupBy("root").agg(F.min("doc_id").alias("keep_id"))
    return labels.join(keep, "root", "left").select("doc_id", "mark", F.when(F.col("worded"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"))
