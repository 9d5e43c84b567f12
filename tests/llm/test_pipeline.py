"""The pipeline and its near-copy stage against versions over lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import quality, simhash, substrings

SMALL = "/root/testdata/sf0.001"


def jaccard(a, b, k=5):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def keepers(rows):
    """The (id, text) that stay: the least id, nulls last, of each group of equal or near texts."""
    texts = sorted({t or "" for _, t in rows})
    group = {t: {t} for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if group[a] is not group[b] and jaccard(a, b) >= 0.8:
                group[a] |= group[b]
                for t in group[a]:
                    group[t] = group[a]
    least = {}
    for i, t in rows:
        g = min(group[t or ""])
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    return group, least


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("aeioust") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(40, 300))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:30]:
        for _ in range(3):
            c = list(b)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            texts.append(" ".join(c))
    hot = base[0]
    for n in range(150):  # one large group of near copies
        c = list(hot)
        c[n % len(c)] = f"x{n}"
        texts.append(" ".join(c))
    texts += [texts[0]] * 40 + ["", None, "  ", "one", "One", "one two", " ".join(["w"] * 3000)]
    rows = list(enumerate(texts)) + [(None, texts[1]), (None, None), (5, "another text with the id of one that is there"), (7, texts[7]), (7, texts[7])]
    rng.shuffle(rows)
    return rows


def test_without_copies(spark, near_rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in near_rows], "doc_id long, text string, node int, id string").repartition(4)
    got = [(r["doc_id"], r["text"]) for r in simhash.without_copies(df).collect()]
    group, least = keepers(near_rows)
    groups = {min(g) for g in group.values()}
    seen = [min(group[t or ""]) for _, t in got]
    assert len(seen) <= len(groups) * 1.03 and set(seen) == groups
    assert sum((i is None, i or 0) == least[min(group[t or ""])] for i, t in got) >= 0.97 * len(got)
    assert simhash.without_copies(df.limit(0)).count() == 0


def many_of_one(n):
    """An original and copies that are near it but not near each other."""
    rng = random.Random(3)
    original = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(original)]
    for k in range(n):
        c = list(original)
        for part in range(3):
            c[part * 66 + rng.randrange(5, 60)] = f"x{k}y{part}"
        texts.append(" ".join(c))
    return texts


def test_copies_of_one_original_are_one_group(spark):
    texts = many_of_one(300)
    assert 0.8 < jaccard(texts[0], texts[1]) < 0.9 and jaccard(texts[1], texts[2]) < 0.8
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert [r["doc_id"] for r in simhash.without_copies(df).collect()] == [0]


def test_hot_keys_lose_no_link(spark, monkeypatch):
    """Parts of a few texts each: groups that only single links join, and texts between two groups."""
    monkeypatch.setattr(simhash, "PART", 8)
    rng = random.Random(7)
    rows, texts = [], []
    for family in range(3):
        base = [f"w{family}x{n}" for n in range(120)]
        for n in range(60):
            c = list(base)
            for at in rng.sample(range(120), rng.randint(0, 5)):
                c[at] = f"y{rng.randrange(10**6)}"
            texts.append(" ".join(c))
    rows = list(enumerate(texts))
    group, least = keepers(rows)
    nodes = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(simhash, "keys_of", lambda grams: [1, 2])  # all texts in one key
    got = sorted(r["doc_id"] for r in simhash.without_copies(nodes).collect())
    assert got == sorted(i for _, i in least.values()) and len(got) > 3


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 20_000, n).astype(np.uint64)) for n in (0, 1, 50, 9000, 9000, 12_000)]
    got = simhash.overlaps(sets)
    assert (got * (1 - np.eye(6))).tolist() == [[float(len(np.intersect1d(a, b))) if i != j else 0.0 for j, b in enumerate(sets)] for i, a in enumerate(sets)]


def test_near_texts_share_a_key():
    """At a similarity of 0.8, whatever the table's size; unlike texts don't."""
    rng = np.random.default_rng(4)
    words = [f"w{n}" for n in range(5000)]
    found = far = 0
    for _ in range(150):
        a = list(rng.choice(words, 200))
        b = list(a)
        for at in (30, 80, 120, 170):
            b[at] = "other"
        a, b, c = (simhash.shingles(" ".join(t)) for t in (a, b, list(rng.choice(words, 200))))
        keys = [set(simhash.keys_of(x)) for x in (a, b, c)]
        prints = [simhash.long_fingerprint(x) for x in (a, b, c)]
        apart = sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(*prints[:2], strict=True))
        found += bool(keys[0] & keys[1]) and apart <= simhash.most_bits(0.8)
        far += bool(keys[0] & keys[2])
    assert found >= 147 and far == 0


def test_recall_against_an_exact_join(spark):
    """All pairs at 0.8 or more among the documents of sf0.1, found by an inverted index over all shingles, end in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = sorted({r["text"] or "" for r in docs.select("text").collect()})
    sets = [set(simhash.shingles(t).tolist()) for t in texts]
    index, met = {}, {}
    for i, s in enumerate(sets):
        for x in s:
            for j in index.setdefault(x, []):
                met[j, i] = met.get((j, i), 0) + 1
            index[x].append(i)
    pairs = [(j, i) for (j, i), n in met.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-6]
    told = simhash.same_texts(docs).where("keeper").count()
    comp = list(range(len(texts)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for j, i in pairs:
        comp[max(root(i), root(j))] = min(root(i), root(j))
    want = len({root(i) for i in range(len(texts))})
    assert len(pairs) > 20 and want <= told <= want + 0.02 * len(pairs)


def test_cut_texts(spark):
    text = "é" * 20 + "the passage that is here twice, with ünïcödé letters in it and more words than fifty bytes " * 2
    rows = [(1, text, "en", "s", 3), (2, "Ü" + text[5:] + "Ω end", "de", None, None), (3, None, None, None, 1), (4, "short", "en", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in substrings.without_repeats(df).collect()}
    assert got[1]["text"] == text and got[2]["text"] == "ÜΩ end" and got[3]["text"] is None and got[4]["text"] == "short"
    assert got[2]["lang"] == "de" and got[2]["n_chars"] is None and got[1]["n_chars"] == 3


def test_single_links_fingerprints_too(spark, monkeypatch):
    """Texts within 2 bits that share few five-word shingles are one group, whether found in a small bucket or a hot one; those farther apart aren't."""
    rng = random.Random(11)
    texts = ["", "  ", "one", "two"]
    for _ in range(120):
        line = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        tails = [[f"w{rng.randrange(10**6)}" for _ in range(rng.randint(15, 60))] for _ in range(rng.randint(1, 3))]
        texts += [" ".join(line * 4 + tail) for tail in tails]
    rng.shuffle(texts)
    group, _ = keepers(list(enumerate(texts)))
    prints = simhash.fingerprints(texts)
    apart = [[(int(a) ^ int(b)).bit_count() for b in prints] for a in prints]
    root, near = list(range(len(texts))), [0, 0, 0]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if (close := a.strip() and b.strip() and apart[i][j] <= 2) or group[a] is group[b]:
                if close and group[a] is not group[b]:
                    near[apart[i][j]] += 1
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    want = sorted({min(i for i, r in enumerate(root) if r == own) for own in root})
    assert min(near[1:]) > 1 and len({min(g) for g in group.values()}) > len(want) > 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for bucket in (64, 1):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        assert sorted(r["doc_id"] for r in corpus_pipeline.single(spark, docs, SMALL).collect()) == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.collect()
    stages = {n: f for n, f in corpus_pipeline.STAGES}
    assert len(stages) == 5
    kept = stages["quality"](spark, docs, SMALL)
    want = quality.scored(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).where("predicted = 1").select("doc_id")
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in want.collect())
    kept = stages["language"](spark, docs, SMALL)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * len(before)
    single = stages["near copies"](spark, docs, SMALL).collect()
    group, _ = keepers([(r["doc_id"], r["text"]) for r in before])
    assert len(single) == len({min(g) for g in group.values()})
    cut = stages["repeated passages"](spark, docs, SMALL)
    assert cut.columns == docs.columns and cut.schema == docs.schema and cut.where(F.col("n_chars") != F.length("text")).count() == 0
    sizes = {i: n - gone for i, n, gone, *_ in substrings.brute([(r["doc_id"], r["text"]) for r in before])}
    assert all(len((r["text"] or "").encode()) in range(sizes[r["doc_id"]] - 40, sizes[r["doc_id"]] + 1) for r in cut.collect())


def test_pipeline_as_a_version_over_lists(spark):
    """The whole of ``run`` on the smallest tables: what stays after each stage, and the pieces, by plain lists."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from leafmill.llm import language

    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    good = {r["doc_id"] for r in quality.scored(docs, labels).where("predicted = 1").collect()}  # tests of its own hold this against lists
    kept = docs.where(F.col("doc_id").isin(sorted(good)))
    rows = kept.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit("").alias("suffix"))
    told = {r["id"] for r in language.identified(rows).where("kept").collect()}
    texts = [(r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] in told]
    group, least = keepers(texts)
    single = sorted((i, t) for i, t in texts if least[min(group[t or ""])] == (i is None, i or 0))
    first, want = {}, []
    for i, t in single:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)  # ids rise
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in single:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = True
        edges = np.flatnonzero(np.diff(np.r_[True, gone[:-1], True].astype(int)))
        text = "".join(b[x:y].decode("utf-8", "ignore") for x, y in zip(edges[::2], edges[1::2], strict=True))
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        want += [(i, n, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 2048))]
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want) and 50 < len(single) < docs.count()
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    rooms = []  # best-fit decreasing, one piece after the other
    for n in sorted((w[3] for w in want), reverse=True):
        fit = min((k for k, room in enumerate(rooms) if room >= n), key=lambda k: rooms[k], default=None)
        if fit is None:
            rooms.append(2048 - n)
        else:
            rooms[fit] -= n
    assert len(bins) == len(rooms)


def test_stages_take_clashing_columns(spark):
    """Columns that the stages might use themselves stay as they are."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).withColumns({c: F.lit(7) for c in ("_node", "_key", "__id", "__node", "id", "node", "_x", "other", "blk", "keeper", "declared", "host")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SMALL)
        assert docs.where("_node = 7 and _key = 7 and __id = 7 and __node = 7 and id = 7").count() == docs.count() > 0
        docs = docs.select(*docs.columns)
    assert corpus_pipeline.packed(spark, docs, SMALL).count() > 0


def test_pipeline_on_nothing(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
