"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.llm import bytebpe, embeddedup, hilbert, language, licences, packing, quality, simhash, substrings, vafile

SMALL = "/root/testdata/sf0.001"
WORDS = "the of and thion erly bleat onwhst ouèon eauier Straße cc by all rights reserved 日本 !! x".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source): copies, near copies, shared passages, nulls, repeated rows, one long text."""
    rng = random.Random(5)
    passage = words(rng, 30)
    base = [words(rng, rng.randint(0, 60)) for _ in range(40)]
    texts = base + base[:6] + [b.replace("thion", "erly", 1) for b in base[:12]] + [f"{words(rng, 5)} {passage} {words(rng, 5)}" for _ in range(8)]
    texts += ["", None, "   \n\t", "ab", "aaaa" * 200, "aaaa" * 90, words(rng, 30_000), "a\x00b" * 40, "😀é" * 40]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src0", "x", None])) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return [*out, out[0], out[0], (None, base[0], "en", "x"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names the operators might use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    return df.withColumns({c: F.lit(7) for c in ("id", "fp", "key", "blk", "score", "length", "_fp", "shard", "n")})


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


def brute_fingerprint(text, shingle):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return comp


@pytest.mark.parametrize("bucket", [64, 1])
@pytest.mark.parametrize("radius", [2, 3])
def test_simhash(spark, docs, rows, radius, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    found = as_set(simhash.near_duplicates(docs, radius))
    prints = {(i, t): brute_fingerprint(t, 3) for i, t, _, _ in rows}
    own = {i: p for (i, _), p in prints.items() if i is not None}
    linked = [(a, b) for a in own for b in own if a < b and (own[a] ^ own[b]).bit_count() <= radius]
    comp = brute_components(own, linked)
    want = [(i, prints[i, t] - (1 << 64) * (prints[i, t] >> 63), comp.get(i)) for i, t, _, _ in rows]
    assert found == sorted(want, key=str)
    assert len({c for _, _, c in want}) > 5 and linked


def test_simhash_thresholds_cover_every_pair():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for n in (100, 10**6, 10**10):
        for radius in (0, 1, 2, 3, 6):
            parts = simhash.plan(sample, n, radius)
            used = {b for bits, _ in parts for b in bits}
            for _ in range(200):
                flips = set(rng.choice(64, radius, replace=False).tolist())
                assert any(len(flips & set(bits)) <= t for bits, t in parts), (parts, flips)
            assert len(used) == sum(len(b) for b, _ in parts)


def test_simhash_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_of_a_long_path_and_a_star(spark, small, monkeypatch):
    """By stars, and by one task; too few rounds are an error."""
    from leafmill.llm import common

    monkeypatch.setattr(common, "JOINED_LINKS", small)
    components = common.components
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 4000), (4000, 5000), (7, 7)]
    random.Random(1).shuffle(edges)
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1200)} | {4000: 4000, 5000: 4000}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    if not small:
        with pytest.raises(RuntimeError):
            components(spark.createDataFrame(edges, "a long, b long"), 2)


def brute_licences(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in licences.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    names, best = {x for _, x in places}, 0.5 if places else 0.0
    for n, (label, template, _) in enumerate(licences.TEMPLATES):
        template = template.split()
        for at in range(-len(template), len(w)):
            if all(0 <= at + j < len(w) and w[at + j] == x for x, j in licences.mandatory(n)):
                names.add(label)
                best = max(best, sum(0 <= at + j < len(w) and w[at + j] == x for j, x in enumerate(template)) / len(template))
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(names)), round(best, 6)


def test_licences_in_long_texts(spark):
    """All licence words but one template's are in the text before it: none may be crowded out."""
    texts = ["You may copy it in any form; all of them are free for use and a person can share. Released under the MIT License."]
    every = [t for _, t, _ in licences.TEMPLATES]
    for template in every:
        others = sorted(set(" ".join(every).split()) - set(template.split()))
        texts.append(" ".join(others * 3) + ". " + template)
        cut = template.split()
        texts.append(" ".join(cut[:3] + ["other"] + cut[4:]) + " / " + " ".join(cut[2:]))
    texts.append(". ".join(every).upper())  # all licences in one text
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r)[2:] for r in got] == [brute_licences(t) for t in texts]
    assert "mit" in got[0]["labels"].split(",")


def test_licences(spark, docs, rows):
    extra = ["Licensed under CC BY-NC 4.0.", "X\nReleased under the MIT License.", "all rights reserved, ALL Rights\nReserved! cc BY", "général public license", "GNU General-Public license, version 3", "cc byé éall rights reserved", "version 2.0 apache license"]
    df = docs.select("doc_id", "text", "n", "score").unionByName(spark.createDataFrame([(900 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"), allowMissingColumns=True)
    got = licences.scan(df.select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    want = [(i, *brute_licences(t)) for i, t in [(r[0], r[1]) for r in rows] + [(900 + i, t) for i, t in enumerate(extra)]]
    assert as_set(got) == sorted(want, key=str)
    assert licences.scan(empty(spark)).count() == 0


@pytest.mark.parametrize("length,gram,hot", [(50, 26, 4096), (24, 12, 4096), (50, 26, 0), (24, 12, 1)])
def test_substrings(spark, docs, rows, length, gram, hot, monkeypatch):
    """``hot``: blocks above which an anchor's strings are dealt one by one, through lanes."""
    monkeypatch.setattr(substrings, "HOT_BLOCKS", hot)
    got = as_set(substrings.digest(substrings.repeated(docs, length, gram)))
    assert got == sorted(substrings.brute([(r[0], r[1]) for r in rows], length), key=str)
    assert any(r[2] and r[2] < r[1] for r in got)


def test_substrings_across_pieces(spark, monkeypatch):
    """Texts that are hashed in several pieces, and edits that split contexts."""
    monkeypatch.setattr(substrings, "PIECE", 100)
    rng = random.Random(3)
    text = "".join(rng.choice("abcd ") for _ in range(1500))
    rows = [(5, text), (3, text[200:700]), (9, text[:650] + "X" + text[651:]), (7, text[900:950]), (8, text[900:949])]
    found = substrings.anchors(text.encode(), 50, 26)
    assert sum(int(b - a + 1) for a, b in zip(found[2], found[3], strict=True)) == 1451
    got = as_set(substrings.digest(substrings.repeated(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert got == sorted(substrings.brute(rows), key=str)


def test_substrings_empty(spark):
    assert substrings.repeated(empty(spark)).count() == 0


def test_texts_that_repeat_themselves(spark):
    """Runs of one character, and of a short period, of some hundred thousand bytes."""
    rows = [(2, " " * 300_000), (1, "ab" * 1000), (3, "ab" * 150_000 + "c"), (4, " " * 60 + "x" + " " * 200_000), (5, " " * 49)]
    got = {r["doc_id"]: r for r in substrings.digest(substrings.repeated(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [(got[i]["n_removed"], got[i]["n_spans"]) for i in range(1, 6)] == [(0, 0), (0, 0), (300_000, 1), (200_060, 2), (0, 0)]


def test_a_common_line_with_other_neighbours(spark):
    """An anchor with as many contexts as documents, in and across blocks."""
    rng = random.Random(8)
    line = "the line that all of them have, of more than fifty bytes in all"
    rows = [(n, "".join(rng.choice("abc ") for _ in range(40)) + line * (1 + n % 2) + "".join(rng.choice("abc ") for _ in range(40))) for n in range(900)]
    got = as_set(substrings.digest(substrings.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))))
    assert got == sorted(substrings.brute(rows), key=str)


@pytest.mark.parametrize("length", [5, 12, 25, 32])
def test_interval_expansion(length):
    """Places share a number just if the same symbols begin there, in one group; small alphabets, repeats and runs of one symbol."""
    rng = np.random.default_rng(length)
    for letters in (2, 3, 250):
        contexts = [rng.integers(1, letters, rng.integers(1, 70)) for _ in range(30)]
        contexts += [contexts[0], np.r_[contexts[1], 5], contexts[2][3:], np.full(60, 1), np.full(50, 1)]
        rng.shuffle(contexts)
        s = np.concatenate([np.r_[c, 0] for c in contexts]).astype(np.uint16)
        group = np.repeat(np.arange(len(contexts)) // 6, [len(c) + 1 for c in contexts])
        same = substrings.expand_intervals(s, group, length)
        seen = {}
        for at in range(len(s) - length):
            w = tuple(s[at : at + length].tolist())
            if 0 not in w:
                assert seen.setdefault((group[at], w), same[at]) == same[at]
        assert len(set(seen.values())) == len(seen)


def test_byte_bpe(spark, docs, rows):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bytebpe.read_ranks(f.read())
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, _, _ in rows:
        ids = np.array(ref.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert as_set(bytebpe.digests(docs, path, P.PATTERN)) == sorted(want, key=str)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in bytebpe.encoded(docs, path, P.PATTERN).collect())


def test_byte_bpe_cache_that_starts_anew(monkeypatch):
    import public_tokenizers as P
    import tiktoken

    monkeypatch.setattr(bytebpe, "CACHE", 40)
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bytebpe.read_ranks(f.read())
    e, ref = bytebpe.Encoder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for _ in range(60):
        t = " ".join("".join(rng.choice("abthe'é 1\n") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 70)))
        ids = e.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(t) and e.decode(ids) == t.encode()


def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = [(i, [float(np.float32(x)) for x in base[i % 12] + rng.normal(size=8) * rng.choice([0, 0.02, 0.2])], [0, 1, None][i % 3]) for i in range(400)]
    rows += [(i, rows[0][1], 0) for i in range(1000, 1100)]  # copies
    rows += [(2000, None, 1), (2100, [0.0] * 8, 1), (2200, [float("nan")] + [1.0] * 7, 1), (2300, [float("inf")] + [1.0] * 7, 0), (2400, [1.0, None] + [1.0] * 6, 0), (None, base[0].tolist(), 0), (2500, [1.0, 2.0], 0), (2501, [1.0, 2.0], 0), (2600, [], 0), (2700, [-0.0] * 7 + [1.0], 1), (2701, [0.0] * 7 + [1.0], 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(1), "n": F.lit(2), "v": F.lit("x"), "score": F.lit(0)}).repartition(5)


def test_top_k(spark):
    rows, df = vectors(spark)
    sound = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    want = []
    for i, q in sound:
        if i % 100 == 0:
            best = sorted((-int(q @ v), j) for j, v in sound if j != i and len(v) == len(q))[:10]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert as_set(vafile.top_k(df)) == sorted(want, key=str)
    assert vafile.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [2.0**19, 2.0**27, 2.0**31])
def test_top_k_of_large_components(spark, size):
    """Scores beyond what a double holds are exact; repeated rows, and one component that outweighs all others."""
    rng = np.random.default_rng(9)
    rows = [(i, (rng.uniform(-1, 1, 6) * size / (1 if i % 3 else 1000)).tolist()) for i in range(400)] + [(7, [size] * 6), (7, [size] * 6), (200, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = [(i, [int(np.floor(x * 4)) for x in v]) for i, v in rows]
    want = []
    for i, q in whole:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i)[:10]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    if max(abs(w[3]) for w in want) < 1 << 63:
        assert as_set(vafile.top_k(df, scale=4)) == sorted(want, key=str)
    else:
        with pytest.raises(Exception, match="passes 64 bits"):
            vafile.top_k(df, scale=4).collect()


def test_bounds_hold_all_products():
    rng = np.random.default_rng(3)
    v, q = (rng.integers(-(10**6), 10**6, (n, 16)) for n in (300, 20))
    a = vafile.approximation(v)
    low, high = vafile.bounds(q.astype(float), a["cells"], a["middle"], a["half"])
    exact = q @ v.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < 0.05 * np.abs(exact).mean()


def test_tables_cover_the_radius():
    """At any size, codes within the radius agree in one substring but for its threshold."""
    rng = np.random.default_rng(4)
    for bits, radius in ((64, 9), (16, 9), (384, 20), (4, 9)):
        for rows in (10, 10**5, 10**9):
            tab = embeddedup.tables(bits, rows, radius)
            assert tab[0][0] == 0 and tab[-1][1] == bits
            for _ in range(100):
                flipped = rng.choice(bits, min(radius, bits), replace=False)
                assert any(t < 0 or ((flipped >= a) & (flipped < b)).sum() <= t for a, b, t in tab)


def test_embedding_recall_in_a_larger_table(spark):
    """20,000 vectors of one label, with pairs at a cosine from 0.98; labels may be text."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(15_000, 64))
    near = base[:5000] + rng.normal(size=(5000, 64)) * rng.uniform(0.02, 0.2, (5000, 1))
    v = np.concatenate([base, near]).astype(np.float32).astype(float)
    cos = (v[:5000] * v[15_000:]).sum(axis=1) / np.linalg.norm(v[:5000], axis=1) / np.linalg.norm(v[15_000:], axis=1)
    df = spark.createDataFrame([(i, x.tolist(), "one") for i, x in enumerate(v)], "vec_id long, embedding array<float>, label string").repartition(6)
    got = embeddedup.near_duplicates(df).where("n_links > 0").count() / 2
    want = int((cos >= 0.98).sum())
    assert want > 3000 and 0.97 * want <= got <= want


@pytest.mark.parametrize("part", [512, 7])
def test_embeddings(spark, part, monkeypatch):
    monkeypatch.setattr(embeddedup, "PART", part)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000" if part > 10 else "3")  # groups that go on over batches
    rows, df = vectors(spark)

    def unit(v):
        ok = v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))
        return np.array(v, np.float32).astype(float) if ok else None

    sound = [(i, unit(v), label) for i, v, label in rows if unit(v) is not None and label is not None and i is not None]
    linked = [(a, b) for a, v, x in sound for b, w, y in sound if a < b and x == y and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98]
    comp = brute_components([i for i, _, _ in rows if i is not None], linked)
    links = {i: sum(i in pair for pair in linked) for i in comp}
    got = {r["vec_id"]: r for r in embeddedup.near_duplicates(df).collect()}
    assert set(got) == {r[0] for r in rows} and linked
    found, all_links = sum(got[i]["n_links"] for i in comp), sum(links.values())
    assert found <= all_links and found >= 0.97 * all_links
    for i in comp:
        assert got[i]["n_links"] <= links[i] and got[i]["component_id"] >= comp[i] and got[i]["kept"] == (i == got[i]["component_id"])
    assert sum(got[i]["component_id"] == comp[i] for i in comp) >= 0.97 * len(comp)
    assert embeddedup.near_duplicates(df.limit(0)).count() == 0
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_embedding_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float), r["label"]) for r in df.collect()]
    pairs = sum(x == y and a < b and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98 for a, v, x in rows for b, w, y in rows)
    assert sum(r["n_links"] for r in embeddedup.near_duplicates(df).collect()) / 2 >= 0.97 * pairs


def test_hilbert_curve_is_a_walk(spark):
    """Every cell once, each step to a neighbour."""
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        df = spark.range(side**dims)
        cells = [(F.col("id") / side**k).cast("long") % side for k in range(dims)]
        walk = [tuple(r)[1:] for r in sorted(df.select(hilbert.index([c.cast("int") for c in cells], bits), *cells).collect())]
        assert [r[0] for r in sorted(df.select(hilbert.index([c.cast("int") for c in cells], bits)).collect())] == list(range(side**dims))
        assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for x, y in zip(walk, walk[1:]))  # noqa: B905


def hilbert_place(cells, bits):
    """The index on the curve, a level of bits at a time."""
    n, entry, turn, out = len(cells), 0, 0, 0

    def rotated(x, by):
        by %= n
        return (x << by | x >> (n - by)) & (1 << n) - 1

    for level in range(bits - 1, -1, -1):
        seen = sum((c >> level & 1) << k for k, c in enumerate(cells))
        gray = rotated(seen ^ entry, -(turn + 1))
        w = 0
        while gray:
            w, gray = w ^ gray, gray >> 1
        out = out << n | w
        even = 0 if w == 0 else (w - 1) // 2 * 2
        entry ^= rotated(even ^ even >> 1, turn + 1)
        low = w if w % 2 else w - 1  # the lowest bit that isn't set
        turn = (turn + (0 if w == 0 else next(k for k in range(9) if not low >> k & 1)) + 1) % n
    return out


def test_sharding_as_a_version_over_lists(spark, docs, rows):
    """Cells, places on the curve, shards and slots of each row; equal texts lie together."""
    texts = {}
    for i, t, lang, source in rows:
        g = texts.setdefault(t or "", [[], [], []])
        for own, x in zip(g, (i, lang or "", source or ""), strict=True):
            own.append(x)
    known = {t: (min(lang), min(source), len(t.encode()) + 1, min([i for i in ids if i is not None], default=(1 << 63) - 1)) for t, (ids, lang, source) in texts.items()}

    def common(values):
        a, b = min(values).encode(), max(values).encode()
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905

    skip = [common([known[t or ""][k] for _, t, _, _ in rows]) for k in range(2)]
    dims = {t: [int.from_bytes(v[k].encode()[skip[k] : skip[k] + 7].ljust(7, b"\0"), "big") for k in range(2)] + list(v[2:]) for t, v in known.items()}
    columns = [sorted(float(dims[t or ""][k]) for _, t, _, _ in rows) for k in range(4)]
    cuts = [[c[max(0, -(-i * len(c) // 32) - 1)] for i in range(1, 32)] for c in columns]
    hashes = dict(map(tuple, spark.createDataFrame([(t,) for t in known], "t string").select("t", F.xxhash64("t")).collect()))
    place = {t: hilbert_place([sum(x < d for x in cut) for cut, d in zip(cuts, map(float, own), strict=True)], 5) for t, own in dims.items()}
    order = sorted((place[t or ""], hashes[t or ""], zlib.crc32((t or "").encode()), len((t or "").encode()) + 1, i is not None, i or 0) for i, t, _, _ in rows)
    n, want, first = len(order), [], {}
    for r, (at, _, crc, size, known_id, i) in enumerate(order):
        shard = r * 16 // n
        want.append((i if known_id else None, size, crc, at, shard, r - first.setdefault(shard, r)))
    assert as_set(hilbert.placed(docs)) == sorted(want, key=str)
    shards = {}
    for _, _, crc, _, shard, _ in want:
        shards.setdefault(crc, set()).add(shard)
    assert all(max(x) - min(x) <= 1 for x in shards.values())


def test_sharding(spark, docs, rows):
    got = hilbert.placed(docs).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows), key=str)
    by_shard = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    order = [r["curve"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    assert hilbert.placed(empty(spark)).count() == 0
    few = hilbert.placed(docs.limit(3)).collect()
    assert len(few) == 3 and len({r["shard"] for r in few}) == 3


def test_packing(spark, docs, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path, cap = P.path("word_bpe_49k.json"), 64
    t = Tokenizer.from_file(path)
    want = []
    for i, text, _, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), cap)):
            part = ids[at : at + cap]
            want.append((i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    cut = packing.pieces(docs, path, cap)
    assert as_set(cut) == sorted(want, key=str)
    got = packing.packed(cut, cap).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= cap
    loads = []
    for n in sorted((w[3] for w in want), reverse=True):
        fit = [(cap - s - n, k) for k, s in enumerate(loads) if s + n <= cap]
        if fit:
            loads[min(fit)[1]] += n
        else:
            loads.append(n)
    assert len(bins) == len(loads)
    assert packing.packed(packing.pieces(empty(spark), path)).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scored(docs.drop("lang", "source"), labels).join(labels, "doc_id").where("held_out").collect()
    ones, zeros = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros])
    assert auc > 0.9 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_quality_edge_cases(spark, docs, rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (3, 0), (4, None), (None, 1)], "doc_id long, quality int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert quality.scored(docs, labels.limit(0)).count() == len(rows)
    assert quality.scored(empty(spark), labels).count() == 0


def test_quality_as_a_version_over_lists(spark):
    """Contexts, pooling and features by loops; the network is the same, trained on them."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(10**6, ""), (10**6 + 1, None), (None, "a b")], "doc_id long, text string"))
    rows = docs.withColumn("h", F.xxhash64("doc_id", F.lit(7))).collect()
    words, shapes = quality._index()
    tokens = {r["text"]: [(zlib.crc32(t.lower().encode()) % quality.BUCKETS, quality._shape(t)) for t in quality.TOKEN.findall(r["text"] or "")] for r in rows}
    table = np.zeros((quality.BUCKETS, quality.DIM))
    for r in rows:
        seq = [w for w, _ in tokens[r["text"]]]
        for i, w in enumerate(seq):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(seq):
                    table[w] += words[seq[j]]
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)

    def features(text):
        seq = tokens[text]
        if not seq:
            return np.zeros(quality.FEATURES)
        a, b, c = (np.mean([m[x] for x in xs], axis=0) for m, xs in ((table, [w for w, _ in seq]), (words, [w for w, _ in seq]), (shapes, [s for _, s in seq])))
        return np.r_[a, b, c, np.linalg.norm(a), np.linalg.norm(b), np.linalg.norm(c), np.log1p(len(seq)) / 10, len(set(seq)) / len(seq)]

    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = {r["doc_id"]: r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows}
    known = sorted((r["h"], r["doc_id"], r["text"]) for r in rows if not held[r["doc_id"]] and marks.get(r["doc_id"]) is not None)
    net = quality.train(np.array([features(t) for _, _, t in known], np.float32).astype(float), np.array([float(marks[i] == 1) for _, i, _ in known]))
    got = {r["doc_id"]: r for r in quality.scored(docs, labels).collect()}
    want = net.probability(np.array([features(r["text"]) for r in rows]))
    assert len(known) > 50 and all(abs(got[r["doc_id"]]["score"] - p) < 0.02 and got[r["doc_id"]]["held_out"] == held[r["doc_id"]] for r, p in zip(rows, want, strict=True))


def test_quality_counts_contexts():
    pairs = np.zeros((quality.BUCKETS + 1) ** 2, np.int32)
    seq = np.array([1, 2, 3, quality.BUCKETS, quality.BUCKETS, 1, 1])
    quality.add_contexts(pairs, seq)
    table = quality.context_vectors(pairs)
    index = quality._index()[0]
    for w in range(4):
        near = [j for i, x in enumerate(seq) if x == w for j in range(max(0, i - 2), min(len(seq), i + 3)) if j != i]
        assert np.allclose(table[w], sum((index[seq[j]] for j in near), np.zeros(quality.DIM)))


def test_language(spark):
    rows = [(i, t, "en", "a.example.com", "com") for i, t in enumerate(["the and this with there"] * 30)]
    rows += [(100 + i, "der und nicht eine sich", "de", "b.example.de", "de") for i in range(30)]
    rows += [(200, "der und nicht", "en", "b.example.de", "de"), (201, "", "de", "b.example.de", "de"), (202, None, None, None, None), (203, "123 !!", "en", "zz", ""), (204, "the with", "xx", "b.example.de", "de"), (205, "the with this there and the", None, "b.example.de", "de")]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string").withColumns({"lang": F.lit(1), "n": F.lit(1), "kept": F.lit(2)})
    got = {r["id"]: r for r in language.identified(df).collect()}
    assert len(got) == len(rows) and all(got[i]["lang"] == ("en" if i < 100 else "de") and got[i]["kept"] for i in [*range(30), *range(100, 130)])
    assert got[200]["lang"] == "de" and got[201]["lang"] == "de" and not got[201]["kept"] and not got[202]["kept"] and not got[203]["kept"] and got[205]["lang"] == "en"
    assert language.identified(df.limit(0)).count() == 0
    assert {r["lang"] for r in language.identified(df.withColumn("declared", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_as_a_version_over_lists(spark):
    """All evidence by loops over rows: trigrams, hosts, suffixes, declarations."""
    rng = random.Random(12)
    speech = {"en": "the and this with there of", "de": "der und nicht eine sich das", "fr": "le la les des une est"}
    rows = []
    for i in range(160):
        lang = rng.choice(list(speech))
        text = " ".join(rng.choice(speech[lang].split()) for _ in range(rng.randint(0, 90)))
        host = rng.choice(["a.com", "b.de", "c.fr", None, f"{lang}.org"])
        rows.append((i, rng.choice([text, text, text.upper(), None]), rng.choice([lang, lang, lang, "en", "xx", "", None]), host, host and host[-2:]))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string").repartition(5)

    def grams(t):
        s = re.sub(rb"[^a-z\x80-\xff]+", b" ", (t or "").lower().encode())
        if not s.strip():
            return []
        s = b" " + s.lstrip() + b" "  # a run that ends the text counts once more, as one space each
        return [(int.from_bytes(s[i : i + 3], "big") * 2654435761 & 0xFFFFFFFF) >> 19 for i in range(len(s) - 2)]

    counts = {}
    for r in rows:
        if r[2]:
            counts[r[2]] = counts.get(r[2], 0) + 1
    names = sorted(x for x, n in counts.items() if n >= language.LEAST)
    table = np.full((len(names), language.TRIGRAMS), 0.5)
    for _, t, d, _, _ in rows:
        if d in names:
            for g in grams(t):
                table[names.index(d), g] += 1
    log_p = np.log(table / table.sum(axis=1, keepdims=True))
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    like = [sum((log_p[:, g] for g in grams(t)), np.zeros(len(names))) * min(1.0, language.WEIGHT / max(1, len(grams(t)))) for _, t, *_ in rows]
    sums = [{}, {}, {}, {}]
    for r, x in zip(rows, like, strict=True):
        if grams(r[1]):
            for s, key in zip(sums, (r[2] or "", r[3] or "", r[4] or "", "all"), strict=True):
                s[key] = s.get(key, 0) + soft(x)
    said, hosts, suffixes, (overall,) = *sums[:3], sums[3].values()
    want = []
    for r, x in zip(rows, like, strict=True):
        level = (overall + 1) / (overall.sum() + len(names))
        for s, key in ((suffixes, r[4] or ""), (hosts, r[3] or "")):
            own = s.get(key, np.zeros(len(names)))
            level = (own + language.SMOOTH * level) / (own.sum() + language.SMOOTH)
        declared = (said.get(r[2], np.zeros(len(names))) + 0.5) / (overall + 1) if r[2] else 1.0
        p = soft(x + np.log(level) + np.log(declared))
        want.append((r[0], names[p.argmax()], p.max(), bool(grams(r[1])) and bool(p.max() >= 0.5)))
    got = sorted((r["id"], r["lang"], r["confidence"], r["kept"]) for r in language.identified(df).collect())
    assert [(i, n, k) for i, n, _, k in got] == [(i, n, k) for i, n, _, k in sorted(want)]
    assert np.allclose([c for _, _, c, _ in got], [c for _, _, c, _ in sorted(want)]) and len({n for _, n, _, _ in got}) == 3


def test_long_texts_in_one_pass(spark):
    """A text of some MB beside short ones, in the operators that read texts."""
    long = " ".join(f"w{n % 5000} the and" for n in range(400_000))
    df = spark.createDataFrame([(1, long), (2, "the and this"), (3, "the and this there with")], "doc_id long, text string")
    rows = df.select(F.col("doc_id").alias("id"), "text", F.lit("en").alias("declared"), F.lit("h").alias("host"), F.lit("s").alias("suffix"))
    assert [r["lang"] for r in language.identified(rows).collect()] == ["en"] * 3
    found = licences.scan(df.withColumn("text", F.concat("text", F.lit(" Released under the MIT License")))).orderBy("doc_id").collect()
    assert [r["labels"] for r in found] == ["mit"] * 3 and found[0]["n_words"] == 1_200_005


def test_names_that_clash(spark):
    """Columns called as an operator's own: its own take their place, others stay."""
    df = spark.createDataFrame([(1, "x all rights reserved", 5, 6, 7)], "doc_id long, text string, score int, labels int, _words int")
    found = licences.scan(df)
    assert found.columns == ["doc_id", "text", "_words", *licences.OWN] and found.first()["labels"] == "proprietary,reserved"
    pieces = spark.createDataFrame([(1, 3, 8, 9, 4), (2, 5, 8, 9, 4)], "doc_id long, length long, sequence_id int, _part int, _rank int")
    packed = packing.packed(pieces, 16)
    assert packed.columns == ["doc_id", "length", "_part", "_rank", "sequence_id", "offset"] and sorted(r["offset"] for r in packed.collect()) == [0, 5]
    rows = spark.createDataFrame([(1, "a b c", "en", "h", "s", 3)], "id long, text string, declared string, host string, suffix string, lang int")
    assert language.identified(rows, carry=("id", "declared", "lang")).columns == ["id", "declared", "lang", "confidence", "kept"]
    import public_tokenizers as P

    coded = bytebpe.encoded(df.withColumns({"ids": F.lit(1), "_c": F.lit(2)}), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert coded.columns == ["doc_id", "text", "score", "labels", "_words", "_c", "ids", "decoded"] and bytes(coded.first()["decoded"]) == b"x all rights reserved"


def test_rare_languages(spark):
    """40 languages of 6 rows each beside 7,000 rows of another: all have a model."""
    rng = random.Random(8)

    def text(n):
        letters = random.Random(n).sample("abcdefghijklmnopqrstuvwxyzéèüößñ", 6)
        return " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(12))

    rows = [(i, text(99), "en", "h", "s") for i in range(7000)]
    rows += [(7000 + 6 * n + k, text(n), f"x{n}", "h", "s") for n in range(40) for k in range(6)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string").repartition(4)
    assert language.languages(df, "declared") == sorted({r[2] for r in rows})
    got = language.identified(df).collect()
    assert sum(r["lang"] == r["declared"] for r in got if r["declared"] != "en") >= 236
    assert sum(r["lang"] == "en" for r in got) >= 6990


def test_language_on_the_tables(spark):
    from leafmill.llm import queries

    got = queries.language_id(spark, SMALL).where("doc_id is not null").collect()
    assert np.mean([r["lang"] == r["declared"] for r in got]) > 0.97 and np.mean([r["kept"] for r in got]) > 0.99


def test_page_rows(spark):
    page = '<!DOCTYPE html><HTML class="x" lang=\'FR-ca\'><script>var t="</p>";</script><body><!-- a --><p>Bon&nbsp;jour</p></body></html>'
    r = language.page_rows(spark.createDataFrame([(1, "https://u@M.a.example.FR:80/x?y#z", page), (2, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert (r[0]["declared"], r[0]["host"], r[0]["suffix"], r[0]["text"].split()) == ("fr", "m.a.example.fr", "fr", ["Bon", "jour"])
    assert (r[1]["declared"], r[1]["host"], r[1]["text"]) == ("", "", "")


def test_word_encoder_as_the_tokenizer():
    """Texts that are split here, and those that aren't."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), random.Random(6)
    e, t = packing.WordEncoder(path), Tokenizer.from_file(path)
    assert e.splits
    some = "aebzÉßñøŒ'sllre''dtm019²½_-.,!?<|>|§ªº©«»\xa0\xad\x1cΣςİıſſKǅ日é̂ \t\n\r  "
    plain = "".join(c for c in some if not packing.ODD.search(c))
    assert len(plain) > 30
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for pool in (some, plain) for _ in range(600)] + ["<|endoftext|> x<|startoftext|>", "a <|endoftext|> b", "<|ENDOFTEXT|> <|endoftext |>", "it's I'LL we'Re 'sx", ""]
    texts += ["".join(map(chr, range(a, a + 64))) for a in range(0, 0x250, 64)] + [chr(c) + "a" + chr(c) for c in range(0x250)]
    for x in texts:
        assert np.frombuffer(e.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_bodies_are_added_in_a_tree(spark):
    """More tasks than one group adds at a time."""
    from leafmill.llm.common import FAN, tree_added

    def bodies(frames):
        for pdf in frames:
            for n in pdf["id"]:
                yield pd.DataFrame({"part": [n % 2], "body": [int(n).to_bytes(8, "little")]})

    def add(found):
        assert len(found) <= FAN
        return sum(int.from_bytes(b, "little") for b in found).to_bytes(8, "little")

    rows = spark.range(0, 300, numPartitions=300).mapInPandas(bodies, "part int, body binary")
    got = {r["part"]: int.from_bytes(r["body"], "little") for r in tree_added(rows, add).collect()}
    assert got == {k: sum(n for n in range(300) if n % 2 == k) for k in (0, 1)}


def test_packing_writes_its_pieces_once(spark, monkeypatch):
    """Ranks come with the pieces, so that the shared folder takes them in one pass, and a file for each task once."""
    passes = []
    monkeypatch.setattr(packing, "checkpointed", lambda df, f=packing.checkpointed: passes.append(df.columns) or f(df))
    pieces = spark.range(0, 40, 1, 5).selectExpr("id AS doc_id", "cast(id % 3 + 1 AS int) AS length")
    got = packing.packed(pieces, 8).collect()
    assert len(passes) == 1 and sorted(r["doc_id"] for r in got) == list(range(40))
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(bins) == 10 and all(sum(n for _, n in own) <= 8 and sorted(own)[0][0] == 0 for own in bins.values())


def test_packing_keeps_one_worker_a_task(spark, monkeypatch):
    """Pieces are made and written by one step in Python: a second one in the same stage would keep a second worker for each core of an executor."""
    import public_tokenizers as P

    plans = []
    monkeypatch.setattr(packing, "checkpointed", lambda df, f=packing.checkpointed: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df))
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(30)], "doc_id long, text string").repartition(4)
    got = packing.packed(packing.pieces(docs, P.path("word_bpe_49k.json"), 16), 16)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert [len(re.findall(r"ArrowEvalPython|MapInPandas|FlatMap\w+InPandas", p)) for p in plans] == [1, 1]
    rows = [(r["doc_id"], r["piece"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) == sum(-(-(2 * i + 1) // 16) for i in range(30))
