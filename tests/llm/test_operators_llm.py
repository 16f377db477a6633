"""The training-data operators against brute force and on odd inputs."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from rankspark.llm import exact_dedup, fingerprints, language, line_dedup, mixing, near_dedup, packing, pii, quality, toxicity
from rankspark.llm.queries_text import tokenizer_path
from rankspark.session import cut_lineage
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id int, key string, label string, size string"


def make(spark, rows, lang="en", source="s"):
    full = [(i, t, lang, source, None, 1, "k", "l", "z") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, white-space variants, near copies, shared lines, odd texts; unique ids."""
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a", "A  a", "é😀  x", "x\n\n", "\nx"]
    base = [sentence(rng, rng.randint(30, 90)) for _ in range(12)]
    line = "This Exact line of more than forty characters repeats."
    for b in base:
        w = b.split()
        texts += [b, b.replace(" ", "\n", 3), b.upper()]
        for k in (1, 3, 8, 15):
            edited = list(w)
            for _ in range(k):
                edited[rng.randrange(len(w))] = "zz" + str(rng.randrange(99))
            texts.append(" ".join(edited))
        texts.append(sentence(rng, 10) + "\n" + line + "\n" + line.upper() + "  \n" + sentence(rng, 10))
    texts.append("word " * 20000)
    texts.append("x" * 100000)
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts))


def collect(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_dedup(spark, corpus):
    for bits in (64, 3):  # three bits make nearly every hash ambiguous
        got = collect(exact_dedup.exact_dedup(make(spark, corpus), least=8, most=64, bits=bits))
        groups = collections.defaultdict(list)
        strip = lambda t: "".join(c for c in t or "" if c not in brute.SPACE)
        for i, t in corpus:
            groups[strip(t)].append((-len(t or ""), i))
        for i, t in corpus:
            g = groups[strip(t)]
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(g)[1], len(g), min(g)[1] == i, brute.sha(strip(t)))


def test_exact_dedup_ties_and_repeats(spark):
    rows = [(5, "a b"), (4, "ab "), (5, "a b"), (None, "x"), (None, "x")]
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(make(spark, rows)).collect())
    assert got == [("4", 4, 3, True), ("5", 4, 3, False), ("5", 4, 3, False), ("None", None, 2, True), ("None", None, 2, True)]


def test_exact_dedup_chunks_each_text_once(spark, corpus, monkeypatch):
    plans = []

    def plan_of(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    def cut(df):
        plans.append(plan_of(df))
        return cut_lineage(df)

    monkeypatch.setattr(exact_dedup, "cut_lineage", cut)
    plans.append(plan_of(exact_dedup.exact_dedup(make(spark, corpus))))
    for work in ("regexp_extract_all(", "regexp_replace(", "collect_set("):
        assert sum(plan.count(work) for plan in plans) == 1, work


def test_line_dedup(spark, corpus):
    got = collect(line_dedup.line_dedup(make(spark, corpus)))
    want = brute.line_dedup(corpus)
    assert {i: (r._n_lines, r._n_dropped, r._kept) for i, r in got.items()} == want
    assert sum(x[1] for x in want.values()) > 10
    assert got[corpus[0][0]].key == "k"


def test_line_runs_are_merged(spark, corpus):
    lines = line_dedup.document_lines(make(spark, corpus), "doc_id", "text", 10, 7)
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=3)
    for b in range(7):
        runs.add(lines.where(f"batch = {b}").drop("batch"))
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    keys = [r for run in runs.runs() for r in run.select("a", "b").collect()]
    assert len(keys) == len(set(keys))
    direct = {(r.a, r.b): (r.n, r.m) for r in lines.groupBy("a", "b").agg({"doc_id": "max", "*": "count"}).selectExpr("a", "b", "`max(doc_id)` AS m", "`count(1)` AS n").collect()}
    assert {(r.a, r.b): (r.n_docs, r.last_doc) for r in runs.frequent(1).collect()} == direct


def test_line_dedup_null_and_repeated_ids(spark):
    line = "forty characters of the very same line here"
    rows = [(None, line), (None, line), (1, line), (1, line + "\nx"), (2, line), (3, line), (4, line)]
    got = sorted((str(r.doc_id), r._n_dropped, r._kept) for r in line_dedup.line_dedup(make(spark, rows)).collect())
    assert got == [("1", 1, ""), ("1", 1, "x"), ("2", 1, ""), ("3", 1, ""), ("4", 0, line), ("None", 1, ""), ("None", 1, "")]


def test_near_components(spark, corpus):
    got = collect(near_dedup.near_components(make(spark, corpus)))
    want = brute.components(corpus)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(brute.shingles(t)) for i, t in corpus}
    assert all(r.kept == (i == want[i]) for i, r in got.items())
    assert sum(i != c for i, c in want.items()) > 20


def test_near_components_beyond_the_star(spark):
    """A chain in which only neighbours are linked, beside a large group: comparing with a bucket's smallest member is not enough."""
    rng = random.Random(5)
    w = sentence(rng, 200).split()
    rows = []
    for k in range(40):
        rows.append((k, " ".join(w[k * 2 : k * 2 + 100])))
    star = sentence(rng, 120).split()
    for k in range(60):
        t = list(star)
        for j in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = f"q{k}x{j}"
        rows.append((100 + k, " ".join(t)))
    got = collect(near_dedup.near_components(make(spark, rows)))
    assert {i: r.component_id for i, r in got.items()} == brute.components(rows)


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    limit = near_dedup.allowed_difference(0.75)
    for share in (0.0, 0.3, 0.75, 0.95):
        both = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        n = int(1000 * 2 * share / (1 + share))
        a, b = both, np.concatenate([both[:n], rng.integers(0, 2**63, 1000 - n, dtype=np.uint64)])
        x, y = [near_dedup.odd_sketch(near_dedup.minhash(s)) for s in (a, b)]
        differ = int(np.bitwise_count(x ^ y).sum())
        assert (differ <= limit) if share >= 0.75 else share == 0.3 or differ > limit


def test_fingerprints(spark, corpus):
    got = collect(fingerprints.edited_fingerprints(make(spark, corpus), buckets=6))
    order = sorted(corpus)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(t[: len(t) - half] + nxt[:half]))
        edited = fingerprints.fingerprint([(t[: len(t) - half] + nxt[:half]).encode()])
        assert r.edited_fingerprint == fingerprints.written(edited)[0]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_text = collections.defaultdict(set)
    for i, t in corpus:
        by_text[t or ""].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprints_are_homomorphic():
    a, b, c = [fingerprints.fingerprint([x]) for x in (b"one two three four\nfive", b"six seven eight", b"five\nsix seven eight\none two three four")]
    total = fingerprints.plus(a, b)
    assert fingerprints.written(total) == fingerprints.written(c)
    assert fingerprints.written(fingerprints.minus(total, b)) == fingerprints.written(a)
    assert fingerprints.likeness(total, c)[0] == 1.0


def test_fingerprints_of_long_repetitive_texts_are_alike():
    for many in (40_000, 70_000, 200_000):
        whole, half = [fingerprints.fingerprint([b"word " * n]) for n in (many, many // 2)]
        assert fingerprints.likeness(whole, half)[0] == pytest.approx(1.0)
    _, own, changed = fingerprints.edits(["word " * 70_000], ["short next text"])
    assert fingerprints.likeness(own, changed)[0] > 0.99


def test_fingerprints_of_one_row_and_null_ids(spark):
    one = fingerprints.edited_fingerprints(make(spark, [(7, "abcd")])).collect()[0]
    assert one.edited_sha256 == brute.sha("abab") and one.near_next == 1.0
    rows = [(None, "aa"), (None, "aa"), (3, "bbbb"), (3, "bbbb")]
    got = fingerprints.edited_fingerprints(make(spark, rows), buckets=3).collect()
    assert sorted(r.edited_sha256 for r in got) == sorted(map(brute.sha, ["aa", "ab", "bbbb", "bbaa"]))


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(k, sentence(rng, rng.choice([0, 1, 5, 40, 400])), rng.choice(["a", "b", "B", "é", None, "hot", "hot", "hot"])) for k in range(900)]
    rows += [(1000 + k, None, "nulls") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = collect(mixing.mix_sources(docs))
    again = collect(mixing.mix_sources(docs.repartition(7)))
    assert {i: r.taken for i, r in got.items()} == {i: r.taken for i, r in again.items()}
    sizes, taken = collections.Counter(), collections.Counter()
    for i, t, s in rows:
        assert got[i]["size"] == len(brute.words(t)) and 0 <= got[i].taken <= 2 * got[i]["size"]
        sizes[s] += got[i]["size"]
        taken[s] += got[i].taken
    for s, target in brute.targets(sizes).items():
        r = next(got[i] for i, _, x in rows if x == s)
        assert r.source_size == sizes[s] and r.target == pytest.approx(target)
        assert abs(taken[s] - target) <= 0.01 * target + 10


def test_mixing_solves_the_dual(spark):
    counts = spark.createDataFrame([("a", 10, 5), ("a", 100, 3), ("b", 7, 4)], "csource string, size bigint, n bigint")
    targets = spark.createDataFrame([("a", 8, 350, 10, 200.0), ("b", 4, 28, 7, 56.0)], "source string, n_docs bigint, source_size bigint, least bigint, target double")
    got = {r.source: r for r in mixing.solve_multipliers(counts, targets).collect()}
    assert got["b"].lam is None
    rate = lambda size: min(2, np.exp(got["a"].lam * size / got["a"].unit))
    assert 50 * rate(10) + 300 * rate(100) == pytest.approx(200, rel=1e-5)


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = corpus + [(2000, "<|endoftext|> and <|ENDOFTEXT|>"), (2001, "It's 3.5% Ωμέγας ΣΑΣ naïve é́ \x1c\x85 a b")]
    pieces = packing.pack(make(spark, rows).repartition(3), tokenizer_path()).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.asarray(p.ids, dtype="<u4").tobytes())
    for i, t in rows:
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[i], key=lambda p: p.start)
        assert [x for p in own for x in p.ids] == want and all(p.doc_tokens == len(want) for p in own)
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
    padding = tokens = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        total = sum(p.length for p in own)
        assert [p.offset for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1]) and total <= 4096
        padding += 0 if total & (total - 1) == 0 else 4096 - total
        tokens += total
    assert padding < 0.02 * tokens


def test_word_cache_forgets_and_still_agrees():
    cache = packing.WordCache(tokenizer_path(), limit=5)
    texts = ["one two three four", "five six seven, eight", "nine ten one two", ""]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in cache.encode(texts)] == [cache._plain(t).tolist() for t in texts]


def test_harmonic_classes():
    rng = random.Random(4)
    for n in [1, 63, 64, 4095, 4096, 4097, 20000] + [rng.randint(1, 9000) for _ in range(200)]:
        sizes = packing.cut_sizes(n)
        assert sum(sizes) == n and all(s == 4096 or s in (64, 128, 256, 512, 1024, 2048) for s in sizes[:-1]) and sizes[-1] > 0


def test_language(spark):
    rng = random.Random(6)
    alphabets = {"xx": "abcdef", "yy": "fghijk", "zz": "äöüéèñ"}
    rows = []
    for k in range(300):
        lang = rng.choice(list(alphabets))
        rows.append((k, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(5)) for _ in range(rng.randint(3, 60))), lang))
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 !?", "xx"), (1003, "ÄÖ ÜÉ", None), (1004, "abc " * 30000, "xx"), (None, "fgh fgh", "yy")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language.identify_languages(docs).collect()}
    for i, t, lang in rows:
        r = got[i]
        assert r.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0)
        if i in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif lang:
            assert r.lang_pred == lang and r.score > 0.5
    assert got[1003].lang_pred == "zz"


def labelled(spark, n=160):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(n):
        w = sentence(rng, rng.randint(20, 150)).split()
        bad = k % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["horrid", "horridly", "vileness"]))
        docs.append((k, " ".join(w)))
        if k % 8 != 5:
            labels.append((k, 1, int(bad)))
    docs += [(1000, None), (1001, ""), (1002, "..."), (1003, sentence(rng, 3000) + " horrid " + sentence(rng, 3000)), (None, "abc")]
    labels += [(None, 1, 1), (1001, None, None), (4, 0, 0)]
    return docs, make(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity(spark):
    rows, docs, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [i for i, _ in rows if i is not None and i < 1000 and zlib.crc32(str(i).encode()) % 3 == 1]
    right = [got[i].predicted == (i % 4 == 0) for i in held]
    assert np.mean(right) >= 0.9 and all(got[i].held_out for i in held)
    assert got[1000].score == got[1001].score == got[1002].score == 0.0 and got[1003].predicted == 1
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).select("doc_id", "key").collect()}
    assert kept == {i for i, r in got.items() if r.predicted == 0}
    none = toxicity.score_toxicity(docs, labels.where("toxic = 0"))
    assert none.where("score <> 0").isEmpty()


def test_toxicity_gradient_matches_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.start_params(rng).items()}
    p["v"] = rng.normal(0, 0.3, p["v"].shape)
    vectors = rng.normal(0, 1, (5, 2 * toxicity.EMBED))
    at = np.array([[0, 1, 2, 3], [4, 0, -1, -1]])
    label = np.array([1.0, 0.0])

    def loss(q):
        x = toxicity.logits(q, at, vectors)
        return np.mean(np.logaddexp(0, x) - label * x)

    g, _ = toxicity.gradients(p, at, vectors, label)
    for name in ("fu", "bx", "v", "out"):
        flat = p[name].ravel()
        for j in range(0, flat.size, max(1, flat.size // 5)):
            e = 1e-3
            up, down = [p | {name: (flat + s * e * (np.arange(flat.size) == j)).reshape(p[name].shape)} for s in (1, -1)]
            assert (loss(up) - loss(down)) / (2 * e) == pytest.approx(g[name].ravel()[j], abs=2e-4)


def test_every_word_lies_in_a_window():
    edges = np.cumsum([0, 0, 1, 31, 32, 33, 56, 57, 500])
    first, length, text = toxicity.windows(edges)
    for i in range(len(edges) - 1):
        covered = set()
        for f, n in zip(first[text == i], length[text == i]):
            covered |= set(range(f, f + n))
        assert covered == set(range(edges[i], edges[i + 1]))


def test_toxicity_does_not_depend_on_the_place_of_a_passage():
    rng = random.Random(12)
    p = toxicity.start_params(np.random.default_rng(3))
    p["v"] = np.random.default_rng(4).normal(0, 2, p["v"].shape).astype(np.float32)
    p["out"] *= 10
    for size in (20, 31):
        passage, around = sentence(rng, size).split(), sentence(rng, 90).split()
        texts = [around[:k] + passage + around[k:] for k in range(91)]
        apart = toxicity.score_texts(p, [" ".join(w[j : j + 32]) for w in texts for j in range(len(w) - 31)])
        want = apart.reshape(len(texts), -1).max(axis=1)
        assert toxicity.score_texts(p, [" ".join(w) for w in texts]) == pytest.approx(want, abs=1e-4)
    mixed = ["", "one two", " ".join(around[:31]), " ".join(around[:32]), " ".join(around)]
    assert toxicity.score_texts(p, mixed) == pytest.approx([toxicity.score_texts(p, [t])[0] for t in mixed], abs=1e-5)


def test_quality(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for k in range(400):
        good = k % 5 != 0
        t = sentence(rng, rng.randint(40, 120))
        docs.append((k, t if good else " ".join(w.upper() + "!!" for w in t.split()[:8] * 8)))
        if k % 2:
            labels.append((k, int(good), 0))
    docs += [(1000, None), (1001, ""), (1002, "é" * 50000)]
    frame, known = make(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(frame, known).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([got[k].predicted == (k % 5 != 0) for k in held]) > 0.95
    assert got[1000].score == got[1001].score and all(0 <= r.score <= 1 for r in got.values())
    assert quality.score_quality(frame, known.where("quality = 0")).where("score <> 0").isEmpty()


def test_class_prior():
    rng = np.random.default_rng(2)
    good = lambda n: rng.normal(0, 1, (n, 6)).astype(np.float32)
    bad = lambda n: rng.normal(3, 1, (n, 6)).astype(np.float32)
    assert quality.estimate_prior(good(1500), np.concatenate([good(1400), bad(600)])) == pytest.approx(0.7, abs=0.07)


def test_private_spans(spark):
    rng = random.Random(10)
    odd = [
        "a@b.c_d@e.f x@y a@b@c.de 1.2.3.4.5.6.7.8 999.1.1.1 300.1.1.1",
        "4111 1111 1111 1111 and 4111-1111-1111-1112 5 5555555555554444 1  23",
        "+1 (555) 123-4567 +1 +12345678901234567890 ++1 23 45 67 89.", "é😀 mail: Ünï@x.org, me@x.org 10.0.0.255",
        "1" * 20000, "a." * 20000 + "@b.c", "x@" + "a." * 20000, "1.2.3." * 5000, None, "", "+" * 5000,
    ]
    rows = [(k, t) for k, t in enumerate(odd)]
    # The nickname stands near one address in different contexts and nowhere else; common words stand everywhere.
    for k in range(6):
        rows.append((100 + k, f"{sentence(rng, 30)}\n{sentence(rng, 4)} wizzlebang {sentence(rng, 2)} boss@corp.example {sentence(rng, 4)}\n{sentence(rng, 20)} Wizzlebang"))
    rows += [(200 + k, "\n".join(sentence(rng, 12) for _ in range(8))) for k in range(40)]
    got = collect(pii.private_spans(make(spark, rows)).selectExpr("doc_id", "base", "terms"))
    names = [k for k, _ in brute.PATTERNS] + ["term"]
    for i, t in rows:
        assert [f"{names[s['rank']]}:{s.start}:{s.end}" for s in got[i].base] == brute.base_spans(t)
        assert all((t or "")[s.start : s.end].lower() == "wizzlebang" for s in got[i].terms)
        assert len(got[i].terms) == (2 if 100 <= i < 200 else 0)


def test_terms_are_found_without_their_value(spark):
    rng = random.Random(13)
    rows = [(k, f"{sentence(rng, 4)} wizzlebang {sentence(rng, 2)} boss@corp.example {sentence(rng, 4)}") for k in range(6)]
    rows += [(100, "somebody saw Wizzlebang again"), (101, "wizzlebangs are not meant"), (None, "x wizzlebang"), (None, "y")]
    rows += [(200 + k, "\n".join(sentence(rng, 12) for _ in range(8))) for k in range(40)]
    got = [(r.doc_id, r.base, [(s.start, s.end) for s in r.terms]) for r in pii.private_spans(make(spark, rows)).collect()]
    by = {i: t for i, _, t in got if i is not None}
    assert by[100] == [(13, 23)] and by[101] == [] and all(len(by[k]) == 1 for k in range(6))
    assert sorted(t for i, _, t in got if i is None) == [[], [(2, 12)]]
    assert not any(by[200 + k] for k in range(40))


def test_two_texts_are_evidence_and_copies_are_not(spark):
    rng = random.Random(14)
    rows = [(k, f"{sentence(rng, 9)}\nContact: Wizzlebang jane@corp.example\n{sentence(rng, 9)}") for k in range(2)]
    rows += [(10 + k, "once copied Zappleton joe@corp.example") for k in range(5)]
    rows += [(100 + k, "\n".join(f"contact {sentence(rng, 12)}" for _ in range(8))) for k in range(40)]
    got = collect(pii.private_spans(make(spark, rows)))
    named = {i: [(rows[k][1][s.start : s.end]) for s in got[i].terms] for k, (i, _) in enumerate(rows)}
    assert named[0] == named[1] == ["Wizzlebang"] and not any(v for i, v in named.items() if i > 1)


def test_sanitise(spark):
    from pyspark.sql import functions as F

    docs = make(spark, [(1, "write to é me@x.org or 10.0.0.1 now"), (2, None)])
    out = docs.select(pii.sanitise(F.coalesce("text", F.lit("")), pii.base_spans(F.coalesce("text", F.lit("")))).alias("t")).collect()
    assert [r.t for r in out] == ["write to é [EMAIL] or [IP] now", ""]


def test_empty_tables(spark):
    docs = make(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for out in (
        exact_dedup.exact_dedup(docs), fingerprints.edited_fingerprints(docs), mixing.mix_sources(docs), toxicity.score_toxicity(docs, labels),
        packing.pack(docs, tokenizer_path()), line_dedup.line_dedup(docs), language.identify_languages(docs), near_dedup.near_components(docs),
        pii.private_spans(docs), quality.score_quality(docs, labels),
    ):
        assert out.count() == 0


def test_set_hash_is_stable():
    got = dict(near_dedup.shingle_sets([b"A b c d e f", b"a B C d e f", b"", b"one two"]))
    assert (got[0] == got[1]).all() and len(got[0]) == 2 and len(got[2]) == 0 and len(got[3]) == 1
    assert hashlib.blake2b(got[0].tobytes(), digest_size=16).digest()
