"""Substring deduplication: bytes covered by a long string that also starts earlier are removed.

Every stretch of `length` bytes has an anchor: of the GRAM-byte grams in it, the one with the least hash (the first
of equals). Consecutive stretches with the same anchor are a segment. Equal stretches have equal anchors, so only
segments whose anchors are equal need be compared, and each such collection is small strings of its own: its
Burrows-Wheeler transform and common prefixes are built column by column, in external files (kiln.llm.bwt). Rows of
the transform that share `length` symbols are equal stretches; all but the earliest of them are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.llm.bwt import LONGEST, build
from kiln.llm.common import few, materialize, numbered, slices, tidy

LENGTH = 100
GRAM = 32
#: Starts of stretches that are worked on at a time.
BLOCK = 1 << 17
#: The segments of an anchor with more different ones than this are dealt out stretch by stretch.
HOT = 2000
#: Segments of one collection, before what repeats is cut out of them; it is cut between anchors when it gets larger, so it
#: has at most HOT more.
COLLECTION = 16_000
#: Parts of a partition of segments that are sorted and settled one by one.
PARTS = 8
_BASE = 0x9E3779B97F4A7C15
_MIX = 0xBF58476D1CE4E5B9

#: A segment: anchor, content, document (id and hash of the text), first start, number of stretches.
SEGMENT = np.dtype([("key", "<u8"), ("seg", "<u8"), ("doc", "<i8"), ("tie", "<u4"), ("start", "<u8"), ("n", "<u2")])
SPAN = np.dtype([("doc", "<i8"), ("tie", "<u4"), ("start", "<u8"), ("n", "<u8")])
_NAMELESS = 1 << 62


def _pack(x: np.ndarray) -> bytes:
    """Field by field, so that it compresses."""
    return b"".join(np.ascontiguousarray(x[f]).tobytes() for f in x.dtype.names)


def _unpack(b: bytes, dtype: np.dtype) -> np.ndarray:
    n = len(b) // dtype.itemsize
    out, at = np.empty(n, dtype), 0
    for f in dtype.names:
        size = dtype[f].itemsize * n
        out[f] = np.frombuffer(b, dtype[f], n, at)
        at += size
    return out


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    return [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 2**64))]


_powers = _power_tables(BLOCK + LONGEST)


def segments(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, content hash, first start, number of stretches) of all segments of a text."""
    digest = xxhash.xxh3_64_intdigest
    for base in range(0, len(text) - length + 1, BLOCK):
        part = text[base : base + BLOCK + length - 1]
        x = np.frombuffer(part, np.uint8).astype(np.uint64)
        run = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x + np.uint64(1)) * np.uint64(_MIX) * _powers[0][: len(x)], out=run[1:])
        h = (run[gram:] - run[:-gram]) * _powers[1][: len(run) - gram]
        h ^= h >> np.uint64(31)
        h *= np.uint64(_MIX)
        h ^= h >> np.uint64(29)
        low = (h & np.uint64(~0x3FFFF & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the first
        width, k = length - gram + 1, 1
        while 2 * k <= width:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        if k < width:
            low = np.minimum(low[: len(low) - (width - k)], low[width - k :])
        anchor = (low & np.uint64(0x3FFFF)).astype(np.int64)
        first = np.append(0, np.flatnonzero(anchor[1:] != anchor[:-1]) + 1)
        end = np.append(first[1:], len(anchor))
        for a, s, e in zip(h[anchor[first]].tolist(), first.tolist(), end.tolist(), strict=True):
            yield a, digest(part[s : e - 1 + length]), base + s, e - s


def _sorted(x: np.ndarray, *by: str) -> np.ndarray:
    return x[np.lexsort(tuple(x[f] for f in reversed(by)))]


def _same(x: np.ndarray, *by: str) -> np.ndarray:
    """Whether each row but the first equals the one before in these fields."""
    out = np.ones(max(len(x) - 1, 0), bool)
    for f in by:
        out &= x[f][1:] == x[f][:-1]
    return out


def _first_of_content(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments with the same content: the earliest of each, and the spans that the others are. The same place twice
    (a row that repeats) is one."""
    if not len(x):
        return x, np.empty(0, SPAN)
    x = _sorted(x, "key", "seg", "doc", "tie", "start")
    x = x[np.append(True, ~_same(x, "key", "seg", "doc", "tie", "start"))]
    later = np.append(False, _same(x, "key", "seg"))
    return x[~later], _spans(x[later])


def _spans(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), SPAN)
    for f in SPAN.names:
        out[f] = x[f]
    return out


def _identity(keys: list, texts: list[bytes]) -> list[tuple[int, int]]:
    """Number and tie of documents: 32 bits of the text's hash; a document without an id is numbered by the other bits,
    behind all others. `_identified` does the same in columns."""
    hashes = (xxhash.xxh64_intdigest(t, 42) for t in texts)
    return [(h >> 2 | _NAMELESS if k is None else k, h & 0xFFFFFFFF) for k, h in zip(keys, hashes, strict=True)]


def _identified(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with doc and tie, by which each text of an id is found on its own."""
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.withColumn("doc", F.coalesce("doc_id", F.shiftrightunsigned(h, 2).bitwiseOR(F.lit(_NAMELESS)))).withColumn("tie", h.bitwiseAND(F.lit(0xFFFFFFFF)))


def _utf8(texts: list[str | None]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def repeated(docs: DataFrame, length: int = LENGTH, hot: int = HOT, gram: int = GRAM) -> DataFrame:
    """(doc, tie, start, n): runs of stretches that also start earlier, of documents (doc_id, text)."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bins = PARTS * partitions

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, rows=4000):
                body = _utf8(texts[a:b])
                rows = [(*s[:2], d, t, *s[2:]) for (d, t), x in zip(_identity(keys[a:b], body), body, strict=True) for s in segments(x, length, gram)]
                if not rows:
                    continue
                kept, spans = _first_of_content(np.array(rows, SEGMENT))  # copies within the slice are settled here
                where = (kept["key"] % np.uint64(bins)).astype(np.int64)
                order = np.lexsort((kept["start"], kept["doc"], where))
                kept, where = kept[order], where[order]
                edge = np.flatnonzero(np.append(np.append(True, where[1:] != where[:-1]), True))
                out = {"bin": [], "kind": [], "blob": []}
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    out["bin"].append(int(where[x]))
                    out["kind"].append(0)
                    out["blob"].append(_pack(kept[x:y]))
                if len(spans):
                    out["bin"].append(int(spans["doc"][0]) % bins)
                    out["kind"].append(1)
                    out["blob"].append(_pack(spans))
                yield pa.RecordBatch.from_pydict(out, schema=blob_schema)

    blob_schema = pa.schema([("bin", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
    sent = docs.select("doc_id", "text").mapInArrow(tidy(found), "bin int, kind int, blob binary")

    def settled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 1: spans; 2: segments to compare; 3: segments of hot anchors to compare in parts. One bin is held at a time."""
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            reps, spans = _first_of_content(np.concatenate(held))
            same = _same(reps, "key")
            reps = reps[np.append(False, same) | np.append(same, False)]  # an anchor with several contents
            if len(reps):
                first = np.flatnonzero(np.append(True, ~_same(reps, "key")))
                many = np.repeat(np.diff(np.append(first, len(reps))) > hot, np.diff(np.append(first, len(reps))))
            for kind, x in ((1, spans), *(((2, reps[~many]), (3, reps[many])) if len(reps) else ())):
                for i in range(0, len(x), 100_000):
                    yield pa.RecordBatch.from_pydict({"bin": [0], "kind": [kind], "blob": [_pack(x[i : i + 100_000])]}, schema=blob_schema)

        for batch in batches:
            for bin_, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind:
                    yield pa.RecordBatch.from_pydict({"bin": [0], "kind": [1], "blob": [blob]}, schema=blob_schema)
                    continue
                if bin_ != now and held:
                    yield from done()
                    held = []
                now = bin_
                held.append(_unpack(blob, SEGMENT))
        if held:
            yield from done()

    settled_ = materialize(sent.repartition(partitions, "bin").sortWithinPartitions("bin").mapInArrow(tidy(settled), "bin int, kind int, blob binary"), "segments")

    def as_spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                x = _unpack(blob, SPAN)
                yield pa.RecordBatch.from_arrays([pa.array(x["doc"]), pa.array(x["tie"].astype("i8")), pa.array(x["start"].astype("i8")), pa.array(x["n"].astype("i8"))], names=["doc", "tie", "start", "n"])

    spans = settled_.where("kind = 1").select("blob").mapInArrow(tidy(as_spans), "doc long, tie long, start long, n long")

    def as_segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = _unpack(blob, SEGMENT)
                signed = lambda f: pa.array(np.ascontiguousarray(x[f]).view("i8"))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(x["doc"]), pa.array(x["tie"].astype("i8")), signed("key"), signed("start"), pa.array(x["n"].astype("i4")), pa.array(np.full(len(x), kind == 3))], names=["doc", "tie", "key", "start", "n", "hot"])

    wanted = settled_.where("kind > 1").select("kind", "blob").mapInArrow(tidy(as_segments), "doc long, tie long, key long, start long, n int, hot boolean")
    wanted = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("key", "start", "n", "hot")).alias("list"))
    strings = _identified(docs).join(wanted, ["doc", "tie"]).select("doc", "tie", "text", "list")

    # Strings to compare; those of hot anchors are single stretches, dealt out by their content. What is known to be later
    # already goes through the same shuffle without its bytes.
    string_schema = pa.schema([("key", pa.int64()), ("hot", pa.bool_()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            best: dict[bytes, tuple] = {}  # of the single stretches of this batch, the earliest of each content
            rows = []
            for doc, tie, text, list_ in zip(x["doc"], x["tie"], _utf8(x["text"]), x["list"], strict=True):
                for r in list_:
                    if not r["hot"]:
                        rows.append((r["key"], False, doc, tie, r["start"], r["n"], text[r["start"] : r["start"] + r["n"] - 1 + length]))
                        continue
                    for s in range(r["start"], r["start"] + r["n"]):
                        place = (doc, tie, s)
                        before = best.setdefault(text[s : s + length], place)
                        if before != place:
                            best[text[s : s + length]] = min(before, place)
                            rows.append((doc, True, *max(before, place), 1, None))
            rows += ((int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True), True, *place, 1, body) for body, place in best.items())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 7, string_schema, strict=True)], schema=string_schema)

    cutted = strings.mapInArrow(tidy(cut), "key long, hot boolean, doc long, tie long, start long, n long, body binary")

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs_, bodies = [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            best: dict[bytes, tuple] = {}
            later = []
            # Copies of a string are settled first; the earliest one goes on into the transform.
            for body, place in _shared(bodies, docs_, length):
                if best.get(body) == place:  # a repeated row
                    continue
                if body in best:
                    later.append((*max(place, best[body]), len(body) - length + 1))
                    place = min(place, best[body])
                best[body] = place
            if later:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*later, strict=True)], names=["doc", "tie", "start", "n"])
            if len(best) > 1:
                yield _later(list(best), np.array(list(best.values()), np.dtype([("doc", "<i8"), ("tie", "<i8"), ("start", "<i8")])), length)

        def spans_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["doc", "tie", "start", "n"])

        same: dict[bytes, tuple] = {}  # of one key of single stretches, the earliest of each content (one, but for equal hashes)
        last = None
        for batch in batches:
            gone = []
            for key, hot_, doc, tie, start, n, body in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if hot_:
                    if body is None:
                        gone.append((doc, tie, start, n))
                        continue
                    if key != last:
                        last, same = key, {}
                    place = (doc, tie, start)
                    before = same.setdefault(body, place)
                    if before != place:  # else a repeated row
                        same[body] = min(before, place)
                        gone.append((*max(before, place), 1))
                    continue
                if keys and key != keys[-1] and len(keys) >= COLLECTION:
                    yield from done()
                    keys, docs_, bodies = [], [], []
                keys.append(key)
                docs_.append((doc, tie, start))
                bodies.append(body)
            yield spans_of(gone)
        if keys:
            yield from done()

    more = cutted.repartition(partitions, "hot", "key").sortWithinPartitions("hot", "key").mapInArrow(tidy(compared), "doc long, tie long, start long, n long")
    return spans.unionByName(more)


def _shared(bodies: list[bytes], places: list[tuple], length: int) -> Iterator[tuple[bytes, tuple]]:
    """The strings cut down to what may be equal elsewhere: from the first to the last stretch whose hash some other
    stretch of these strings has, too. Strings without such a stretch hold nothing that repeats and are left out."""
    sizes = np.array([len(b) for b in bodies])
    x = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint64)
    start = np.cumsum(sizes) - sizes
    p, q = _power_tables(len(x) + 1)
    run = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x + np.uint64(1)) * np.uint64(_MIX) * p[: len(x)], out=run[1:])
    n = sizes - length + 1
    string = np.repeat(np.arange(len(bodies)), n)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
    at = start[string] + offset
    h = (run[at + length] - run[at]) * q[at]
    _, which, counts = np.unique(h, return_inverse=True, return_counts=True)
    some = np.flatnonzero(counts[which] > 1)
    if not len(some):
        return
    of = string[some]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    last = np.append(first[1:], len(of)) - 1
    for k, a, b in zip(of[first].tolist(), offset[some[first]].tolist(), offset[some[last]].tolist(), strict=True):
        doc, tie, begin = places[k]
        yield bodies[k][a : b + length], (doc, tie, begin + a)


def _later(bodies: list[bytes], where: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of stretches of these strings that are equal to an earlier one."""
    groups, strings, offsets = [], [], []
    group = 0
    for s, size, common in build(bodies):
        cut = np.cumsum(common < length) + group
        if len(cut):
            group = int(cut[-1])
        long = size >= length
        groups.append(cut[long])
        strings.append(s[long].astype(np.int64))
        offsets.append(size[long].astype(np.int64))
    group, string = np.concatenate(groups), np.concatenate(strings)
    offset = np.array([len(b) for b in bodies])[string] - np.concatenate(offsets)
    place = where["start"][string] + offset
    order = np.lexsort((place, where["tie"][string], where["doc"][string], group))
    later = np.append(False, group[order][1:] == group[order][:-1])
    bad = order[later]
    bad = bad[np.lexsort((offset[bad], string[bad]))]
    new = np.append(True, (string[bad][1:] != string[bad][:-1]) | (offset[bad][1:] != offset[bad][:-1] + 1)) if len(bad) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(bad)))
    x = where[string[bad[at]]]
    return pa.RecordBatch.from_arrays([pa.array(x["doc"]), pa.array(x["tie"]), pa.array(place[bad[at]]), pa.array(n.astype(np.int64))], names=["doc", "tie", "start", "n"])


def substring_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds the bytes that are left.

    Texts are UTF-8; null counts as empty. A byte goes if a string of `length` bytes over it also starts earlier: in
    a document of smaller id, or in the same one before. Texts shorter than `length` stay as they are. Rows that
    repeat both id and text are one document (both are treated alike); of rows with one id and different texts, and of
    rows without an id, which come last, the hash of the text decides. Ids that aren't numbers are compared as they sort. An empty table gives an empty result. Other columns are not read.
    """
    if not 8 <= length <= LONGEST:
        raise ValueError(f"length must be 8 to {LONGEST}")
    source, numbers = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), None
    if not isinstance(source.schema["doc_id"].dataType, T.IntegralType):
        numbers = numbered(source, "doc_id")
        source = source.withColumnRenamed("doc_id", "named").join(few(numbers, 500_000), F.col("named") == F.col("doc_id"), "left").select(F.col("number").alias("doc_id"), "text", "named")
    else:
        source = source.withColumn("doc_id", F.col("doc_id").cast("long"))
    gram = max(8, min(GRAM, length // 3))
    spans = repeated(source.select("doc_id", "text"), length, hot, gram).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = _identified(source).join(spans, ["doc", "tie"], "left").select(F.col("named") if numbers is not None else "doc_id", "text", "spans")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def removed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in arrow}
            for key, text, of in zip(batch.column(0).to_pylist(), _utf8(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True):
                spans = sorted((s["start"], s["start"] + s["n"] - 1 + length) for s in of or [])
                runs: list[list[int]] = []
                for a, b in spans:
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                at, left = 0, []
                for a, b in runs:
                    left.append(text[at:a])
                    at = b
                left = b"".join([*left, text[at:]])
                for c, v in zip(out.values(), (key, len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left), strict=False):
                    c.append(v)
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return joined.mapInArrow(tidy(removed), schema)
