import random
import zlib

import numpy as np
import pytest
import xxhash

from kiln.llm import language_id as lang
from kiln.llm import simhash as sim
from kiln.llm import toxicity as tox
from kiln.llm.components import components
from kiln.llm.packing import PieceCoder, cut, pack, pack_block, step_groups
from kiln.llm.token_counts import Transducer, token_counts

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

PARTS = ["'s", "'re", "'", "'ll", "''s", " ", "  ", "\n", "\n\n", " \t", "a", "The", "straße", "é", "É", "ñ", "12", "٣", "½", "日本語", "。", "!", "...", "___", "<|endoftext|>", "<|startoftext|>", "<|end", "𝔘", "é", "Σ", "ΑΣ", "İ", "\x1c", "　", "thing", "nation", "xqzv", "'v", "'r", "'ve", "don't", "it's", "I'LL", "ﬁ", "\x00", "-", "#"]
DOCS = "doc_id long, text string, lang string, fp long, u long, node string"


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "\n", "'", "x" * 5000, "日本" * 3000, "word " * 4000]


def docs(spark, rows):
    return spark.createDataFrame([(*r[:2], r[2] if len(r) > 2 else None, 1, 2, "x") for r in rows], DOCS)


def test_piece_coder_against_the_library():
    path = P.path("byte_bpe_50k.json")
    want = [e.ids for e in tokenizers.Tokenizer.from_file(path).encode_batch(texts(1500), add_special_tokens=False)]
    coder = PieceCoder(path)
    for _ in range(2):  # unknown pieces, then known ones
        ids, n = coder.encode(texts(1500))
        ends = np.cumsum(n)
        assert [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == want


def test_cut_keeps_text_and_ids():
    path = P.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    for t in texts(200, 4):
        parts = list(cut(t, 16))
        assert "".join(parts) == t
        if "<|endoftext|>" not in t:
            assert sum((tok.encode(x, add_special_tokens=False).ids for x in parts), []) == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("lengths", [[], [1], [2048], [5, 3000, 2048, 7, 1], [700] * 9, [1] * 5000, [100_000], list(range(1, 400))])
def test_pack_block(lengths):
    sequences = pack_block(lengths)
    seen = sorted((d, s, n) for x in sequences for d, s, n in x)
    for d, n in enumerate(lengths):
        at = 0
        for _, s, k in [x for x in seen if x[0] == d]:
            assert s == at
            at += k
        assert at == n
    sizes = [sum(n for *_, n in x) for x in sequences]
    assert all(n & (n - 1) == 0 and n <= 2048 for n in sizes)  # no padding at all
    assert sum(n < 256 for n in sizes) <= 8  # below the shortest tier: one rest of the block, dealt into powers of two


def test_step_groups_are_balanced():
    sequences = pack_block([random.Random(2).randint(1, 3000) for _ in range(900)])
    groups = step_groups(sequences)
    cost = np.bincount(groups, [sum(n * n for *_, n in x) for x in sequences])
    assert np.bincount(groups).max() <= 16
    assert cost.max() < 1.3 * cost.mean()


@pytest.mark.parametrize("seed", range(4))
def test_tiers_hold_what_was_routed_to_them(seed):
    rng = random.Random(seed)
    lengths = [rng.choice((rng.randint(1, 60), rng.randint(1, 700), rng.randint(1, 6000))) for _ in range(1500)]
    sequences = pack_block(lengths)
    sizes = [sum(n for _, _, n in s) for s in sequences]
    assert set(sizes) <= {2**k for k in range(12)} and sum(sizes) == sum(lengths)
    assert sum(n for n in sizes if n < 256) < 256 and sizes.count(128) < 2  # what is below the shortest tier is one rest
    cuts = [0] * len(lengths)
    for s in sequences:
        for d, _, _ in s:
            cuts[d] += 1
    rest = next((k for k in range(len(sizes)) if all(a > b for a, b in zip(sizes[k:], sizes[k + 1 :], strict=False)) and sum(sizes[k:]) < 2048), len(sizes))
    opened = [(s[0][2], size) for s, size in zip(sequences[:rest], sizes, strict=False)]
    # the first piece opens a window of the smallest tier that holds it, tier after tier
    assert all(size // 2 < n <= size or size == 256 for n, size in opened) and [x for _, x in opened] == sorted((x for _, x in opened), reverse=True)
    whole = [n for n, c in zip(lengths, cuts, strict=True) if n <= 2048 and c == 1]
    assert len(whole) >= 0.8 * sum(n <= 2048 for n in lengths)  # documents are seldom cut


def test_pack_round_trip(spark):
    path = P.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(texts(100))] + [(None, "no id"), (-1, None), (3, "again")]
    got = pack(docs(spark, rows).repartition(3), path, block_tokens=20_000, with_ids=True).collect()
    by, sequences = {}, {}
    for r in got:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    made = sorted(((k[0] is None, k[0] or 0, b"".join(bytes(r.ids) for r in sorted(v, key=lambda r: r.start))) for k, v in by.items()))
    want = sorted((i is None, i or 0, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows)
    assert made == want
    for x in sequences.values():
        at = 0
        for r in sorted(x, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and x[0].tier == at
    assert pack(docs(spark, []), path).count() == 0


def test_transducer_against_the_library():
    path = P.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    machine = Transducer(path)
    given = texts(1500)
    want = [len(e.ids) for e in tok.encode_batch(given, add_special_tokens=False)]
    assert machine.count(given).tolist() == want
    machine.clear()
    assert [machine.count([t])[0] for t in given[-7:]] == want[-7:]


def test_transducer_rare_characters():
    path = P.path("word_bpe_49k.json")
    given = ["".join(map(chr, range(a, a + 40))) + "abc" for a in range(0x100, 0x3000, 40)]
    tok = tokenizers.Tokenizer.from_file(path)
    assert Transducer(path).count(given).tolist() == [len(e.ids) for e in tok.encode_batch(given, add_special_tokens=False)]


def test_unspaced_texts_compose_chunk_maps():
    """Runs of many chunks without white space, with and without ends of words inside, beside spaced ones."""
    rng = random.Random(9)
    path = P.path("word_bpe_49k.json")
    tok, machine = tokenizers.Tokenizer.from_file(path), Transducer(path)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    given = [draw("abcdeéß", 5000), draw("abc'dt1!-", 9000), draw("日本語中文字", 7000), "a" * 3000, draw("ab ", 4000), draw("xyz", 192), draw("xyz", 193), draw("xyz", 383), draw("xyz", 384), "é" * 1000 + " " + draw("abc", 1000), "'" * 500, "don't" * 300]
    want = [len(tok.encode(t, add_special_tokens=False).ids) for t in given]
    assert machine.count(given).tolist() == want
    assert [int(machine.count([t])[0]) for t in given] == want


def test_token_counts(spark):
    rows = [(1, None), (2, ""), (3, "Hello é"), (None, "word " * 3000), (3, "Hello é")]
    got = sorted(tuple(r)[1:] for r in token_counts(docs(spark, rows), P.path("word_bpe_49k.json")).collect())
    assert got == [(0, 0, False), (0, 0, False), (8, 2, False), (8, 2, False), (15000, 3000, True)]
    assert token_counts(docs(spark, []), P.path("word_bpe_49k.json")).count() == 0


def plain_fingerprint(text, k=3):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for t in [*texts(200), None, "one", "One two", "É é a b c"]:
        assert sim.fingerprint(t) == plain_fingerprint(t)


def brute_components(pairs_of, n):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs_of:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def clustered(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            out.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)[:n]


@pytest.mark.parametrize(("most", "bucket", "dense"), [(2, 20_000, 256), (2, 20_000, 2), (2, 3, 256), (1, 20_000, 256), (1, 3, 256), (0, 20_000, 256), (5, 20_000, 256)])
def test_near_links_against_all_pairs(spark, monkeypatch, most, bucket, dense):
    monkeypatch.setattr(sim, "DENSE", dense)
    fps = clustered(400, most + bucket)
    want = brute_components(((i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= most), len(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = sim.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), most, bucket).collect()
    at = {x: i for i, x in enumerate(signed)}
    assert all((fps[at[r.u]] ^ fps[at[r.v]]).bit_count() <= 64 for r in links)
    assert brute_components(((at[r.u], at[r.v]) for r in links), len(fps)) == want


def test_allocation_covers_every_split():
    """Whatever way the differing bits fall into the groups, some group is within its threshold."""
    n, p = 1000, np.full(64, 0.5)
    groups = sim.plan(n, p, np.eye(64), 2)
    thresholds = [t for _, t in groups]
    assert sum(t + 1 for t in thresholds) == 3


def test_near_duplicates(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away " * 30
    rows = [(5, base), (3, base + "end"), (9, base.upper()), (1, "something else entirely different here"), (7, None), (6, ""), (None, ""), (8, "one")]
    got = {r.doc_id: r for r in sim.near_duplicates(docs(spark, rows)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    ids = [i for i, _ in rows if i is not None]
    want = brute_components(((a, b) for a in ids for b in ids if (fps[a] ^ fps[b]).bit_count() <= 2), 10)
    for i in ids:
        assert got[i].fingerprint == f"{fps[i]:016x}" and got[i].component_id == want[i]
    assert got[None].component_id == 6
    assert sim.near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(5, 5), (7, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = brute_components(((a, b) for a, b in edges if b is not None), 401)
    assert got == {n: want[n] for n in {x for a, b in edges if b is not None and a != b for x in (a, b)}}


def test_trigrams_over_segments(monkeypatch):
    t = "Hello,  wörld!! it's 42 o'clock. ΑΣ x " * 20
    whole = lang.trigrams(t)
    for n in (1, 2, 3, 7, 50):
        monkeypatch.setattr(lang, "SEGMENT", n)
        assert lang.trigrams(t).tolist() == whole.tolist()


def test_language_id(spark):
    rng = random.Random(1)
    words = {"en": "the and of that with thing people under never".split(), "de": "der und das nicht eine schule über immer".split(), "fr": "le les des qui une école toujours être".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(5, 60))), k) for i, k in enumerate(["en", "de", "fr"] * 60)]
    extra = [(1000, None, "en"), (1001, "", None), (1002, "123 !?", "en"), (1003, "und das ist nicht die schule", None), (None, "the people", None)]
    got = {r.doc_id: r for r in lang.language_id(docs(spark, rows + extra)).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "de", "en"]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert [r.lang_pred for r in lang.language_id(docs(spark, [(1, "abc", None)])).collect()] == ["und"]
    assert lang.language_id(docs(spark, [])).count() == 0


def test_language_vectors_are_bundles():
    """The score is the cosine of the sums of bound vectors, computed plainly."""
    a, b, c = lang._letter_vectors(lang.DIM)
    codes = [lang._letter_codes()[ord(x)] for x in " ab "]
    want = a[codes[0]] * b[codes[1]] * c[codes[2]] + a[codes[1]] * b[codes[2]] * c[codes[3]]
    assert (lang._bundles(["Ab"], lang.DIM)[0][0] == want).all()


def test_toxicity(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bad = ["vilewort", "gruntfool", "snarkpest"]

    def text(toxic):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad)
        return " ".join(w)

    rows = [(i, text(i % 10 == 0), None) for i in range(1500)] + [(5000, None, None), (5001, "", None), (None, "word", None)]
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(1500) if i // 10 % 2 == 0] + [(7000, None, 1), (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tox.toxicity(docs(spark, rows), labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    wrong = [i for i in range(1500) if got[i].held_out and got[i].predicted != (i % 10 == 0)]
    assert len(wrong) <= 5
    assert not got[5000].predicted and not got[5001].predicted
    none = labels.where("toxic = 5")
    assert not any(r.predicted for r in tox.toxicity(docs(spark, rows[:20]), none).collect())
    assert tox.toxicity(docs(spark, []), none).count() == 0
