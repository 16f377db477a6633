"""Whitening, web archives and token alignment against brute force and on odd inputs."""

import base64
import hashlib
import random

import numpy as np
import pytest

from rankspark.llm import token_alignment, warc, whitening
from rankspark.llm.queries_records import tokenizer_paths

# ---- whitening ---------------------------------------------------------------------


def vectors(spark, rows):
    full = [(i, v, None, 7, "n", 0.5) for i, v in rows]
    return spark.createDataFrame(full, "vec_id bigint, embedding array<float>, label int, n int, component string, whitened double")


def brute_whitening(vs, components=32):
    x = np.floor(64 * np.array(vs, dtype=np.float64)).astype(np.int64) + 1_000_000
    n = len(x)
    v = n * x.astype(object) - x.astype(object).sum(axis=0)
    y = v.astype(np.float64) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    return (v * v).sum(axis=1), y @ q[:, :components], e


def whitened_table(spark, rows, **k):
    made = whitening.whitened_components(whitening.whiten(vectors(spark, rows), **k)).collect()
    out = {}
    for r in made:
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(1)
    vs = (rng.normal(size=(300, 40)) * np.linspace(3, 0.5, 40)).astype(np.float32).tolist()
    odd = [(900, None), (901, []), (902, [None] * 40), (903, [float("nan")] * 40), (904, [float("inf")] * 40), (905, [1.0, 2.0])]
    got = whitened_table(spark, [*enumerate(vs), *odd])
    deviation, projected, e = brute_whitening(vs)
    assert sorted(got) == list(range(300)) and all(sorted(r) == list(range(1, 33)) for r in got.values())
    w = np.array([[got[i][c].whitened for c in range(1, 33)] for i in range(300)])
    want = projected / np.sqrt(e[:32])
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w - sign * want).max() < 1e-9
    assert [got[i][1].deviation for i in range(300)] == deviation.tolist()
    assert all(abs(got[0][c].explained / (e[c - 1] / e.sum()) - 1) < 1e-9 for c in range(1, 33))
    assert {r.n for r in got[5].values()} == {300} and got[5][1].identity_error < 1e-9
    assert np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() < 1e-9


def test_refined_eigenvectors():
    rng = np.random.default_rng(0)
    spectra = {
        "apart": np.arange(1, 31.0), "one cluster": np.r_[1, 1 + 1e-9, 1 + 2e-9, 1 + 3e-12, np.arange(2, 30)],
        "zeros": np.r_[np.zeros(8), 1e-9, 1e3], "equal": np.r_[np.ones(10), 2, 2, 2 + 1e-13], "two clusters": np.r_[5 + 1e-7 * np.arange(9), 9 + 1e-8 * np.arange(9)],
    }
    for name, values in spectra.items():
        q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        e, x = whitening.refined_eigen(a)
        size = values.max()
        assert np.abs(e - np.sort(values)[::-1]).max() < 1e-13 * size, name
        assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-14, name
        assert np.abs(a @ x - x * e).max() < 1e-14 * size, name
    # Axes inside a cluster are those of the matrix, not any of the space: float32 alone cannot tell them.
    a = np.diag([1.0, 1 + 1e-9, 3.0])
    _, x = whitening.refined_eigen(a)
    assert np.abs(np.abs(x) - np.eye(3)[:, [2, 1, 0]]).max() < 1e-6
    _, rough = np.linalg.eigh(a.astype(np.float32))
    assert whitening.clusters(np.array([1.0, 3.0, 1 + 1e-9]), 1e-6)[0].tolist() == [0, 2]


def test_whitening_of_few_equal_and_large_vectors(spark):
    assert whitening.whitened_components(whitening.whiten(vectors(spark, []))).count() == 0
    one = whitened_table(spark, [(1, [0.5, 0.25])])
    assert [(r.component, r.whitened, r.deviation, r.explained, r.identity_error) for r in one[1].values()] == [(1, None, 0, 0.0, 0.0), (2, None, 0, 0.0, 0.0)]
    flat = whitened_table(spark, [(None, [1.0, 2.0, 0.0]), (None, [1.0, 2.0, 0.0]), (3, [1.0, 3.0, 0.0]), (4, [2.0, 3.0, 0.0])])
    assert flat[3][3].whitened is None and flat[3][2].whitened is not None and flat[3][1].n == 4
    big = [[3e9, 1.0], [-3e9, 2.0], [1.0, 5.0]]
    got = whitened_table(spark, list(enumerate(big)))
    exact, _, _ = brute_whitening(np.array(big, dtype=np.float32).tolist())
    assert [got[i][1].deviation for i in range(3)] == [v if v < 1 << 63 else None for v in exact.tolist()]
    made = whitening.whiten(vectors(spark, list(enumerate(big)))).collect()
    assert sorted(int(r.deviation) for r in made) == sorted(exact.tolist())


# ---- web archives ------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "a", 9, "r") for i, u, h in rows], "page_id bigint, url string, html string, archive string, place int, record_type string")


def some_pages(n=120):
    rng = random.Random(2)
    hosts = ["http://www.b.example.org", "https://a.example.net", "https://b.example.org:443"]
    rows = [(5, None, None), (3, "", ""), (9, "not a url", ""), (11, "http://x.example/\r\nX: y", "é😀" * 50_000), (None, "http://x.example/a", "solo")]
    ids = rng.sample(range(100, 10_000), n)
    for i in ids:
        rows.append((i, f"{rng.choice(hosts)}/p{rng.randrange(4)}?b=2&a=1#top", rng.choice(["<p>same</p>", "other", f"own {i}", "<p>same</p>"])))
    return rows


def test_archives_against_plain_python(spark, tmp_path):
    rows = some_pages()
    made = warc.archive_pages(pages(spark, rows).repartition(5), archive_bytes=2000, folder=str(tmp_path / "w"))
    got = {r.page_id: r for r in made.collect()}
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    assert len(got) == len(rows)
    for i, u, h in rows:
        body = (h or "").encode()
        r = got[i]
        lead = first.get(h or "")
        want = ("response", None) if lead in (None, i) else ("revisit", lead)
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == want
        back = warc.read_record(str(tmp_path / "w"), r.archive, r.offset, r.length)
        assert back["payload"] == (body if want[0] == "response" else b"") and back["page_id"] == (None if i is None else str(i))
    assert got[11].url == "http://x.example/%0D%0AX:%20y"


def test_index_is_one_order_over_many_runs(spark, tmp_path):
    """Archives of a few records give many runs, and ranges of a few rows cut through the captures of one URL."""
    rows = some_pages(300)
    folder = str(tmp_path / "w")
    captured = warc.F.timestamp_seconds(warc.F.coalesce("page_id", warc.F.lit(0)))
    archives = warc.write_archives(warc.with_revisits(pages(spark, rows).repartition(6), "page_id", "url", "html", captured, 0), folder, 3000).collect()
    assert len(archives) > 20 and sum(a.records for a in archives) == len(rows)
    listed = spark.createDataFrame(archives)
    runs = warc.read_runs(listed, folder).collect()
    merged = sorted(warc.merge_runs(spark.createDataFrame(runs, f"{warc.CAPTURE_DDL}, place bigint"), range_rows=25).collect(), key=lambda r: (r.range_no, r.place))
    keys = [tuple(r[c] for c in warc.ORDER) for r in merged]
    assert keys == sorted(tuple(r[c] for c in warc.ORDER) for r in runs) and len({r.range_no for r in merged}) > 5
    for a in archives:
        run = sorted((r for r in runs if r.archive == a.archive), key=lambda r: r.place)
        assert [r.offset for r in sorted(run, key=lambda r: r.offset)][0] == 0 and sum(r.length for r in run) == a.bytes
        assert [(r.url_key, r.captured) for r in run] == sorted((r.url_key, r.captured) for r in run)


def test_revisits_of_repeated_rows_small_and_null(spark, tmp_path):
    rows = [(7, "u", "abcd"), (7, "u", "abcd"), (8, "u", "abcd"), (None, "u", "abcd"), (1, "u", "ab"), (2, "u", "ab"), (None, "u", "zz"), (None, "v", "zz")]
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archive_pages(pages(spark, rows), min_bytes=3).collect())
    assert got == sorted([("7", "response", None)] * 2 + [("8", "revisit", 7), ("None", "revisit", 7), ("1", "response", None), ("2", "response", None)] + [("None", "response", None)] * 2)
    whole = [(r.page_id, r.record_type, r.refers_to) for r in warc.archive_pages(pages(spark, rows)).where("payload_bytes = 2 AND page_id IS NOT NULL").collect()]
    assert sorted(whole) == [(1, "response", None), (2, "revisit", 1)]
    assert warc.archive_pages(pages(spark, [])).count() == 0


def test_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 8, 33):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(1, 9))) for _ in range(k)]
        at = [0] * k

        def advance(i):
            at[i] += 1
            return runs[i][at[i]] if at[i] < len(runs[i]) else None

        out = [(runs[i][at[i]], i) for i in warc.loser_tree([r[0] for r in runs], advance)]
        assert out == sorted((v, i) for i, r in enumerate(runs) for v in r)


@pytest.mark.parametrize(("url", "key"), [
    ("https://WWW.Example.org:443/A/b/?z=1&a=2#f", "org,example)/a/b?a=2&z=1"), ("http://www2.example.org", "org,example)/"),
    ("http://user@example.org:8080/%7Ex", "org,example:8080)/~x"), ("mailto:x", "mailto:x"), (None, ""), ("http://", ")/"),
])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


# ---- token alignment ---------------------------------------------------------------

ODD_TEXTS = [
    None, "", " ", "a", "a  b", "  a", " a ", "a\n b", "a\n\n  b \n", "<|endoftext|> <s> <unk> <0x41>", "é́ ﬁ", "x▁y", "a\x00b", "don't they'll  we've", "　全角 テスト",
    "😀 👍🏽 ok", "a\x1c b", "tab\t b", " " * 50 + "x" + " " * 7, "١٢٣ 12,345.6", "a ́b", "supercalifragilistic " * 400, "x" * 30_000,
]


def brute_alignment(rows):
    from collections import Counter

    cache = token_alignment.PairCache(*tokenizer_paths())
    docs = []
    for i, t in rows:
        none = (i, 0, 0, 0, [], "")
        if not t:
            docs.append(none)
            continue
        whole = b" " + t.encode()
        ids = cache.a.encode(" " + t, add_special_tokens=False).ids, cache.b.encode(t)
        parts = [cache.a_bytes[x] for x in ids[0]], [cache.b_bytes[x] for x in ids[1]]
        if any(b"".join(p) != whole for p in parts):
            docs.append(none)
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        spans = [[(e - len(x), e) for e, x in zip(ends[s], parts[s])] for s in (0, 1)]
        linked, j = [], 0
        for x, (lo, hi) in enumerate(spans[0]):
            while spans[1][j][1] <= lo:
                j += 1
            y = j
            while y < len(spans[1]) and spans[1][y][0] < hi:
                linked.append((ids[0][x], ids[1][y]))
                y += 1
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            sides = []
            for s in (0, 1):
                stop = ends[s].index(cut, at[s]) + 1
                sides.append(",".join(map(str, ids[s][at[s] : stop])))
                at[s] = stop
            groups.append("|".join(sides))
        docs.append((i, len(ids[0]), len(ids[1]), len(groups), linked, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    held = Counter(p for d in docs for p in set(d[4]))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(
        ((str(i), a, b, g, len(k), sum(held[p] == best[p[0]] for p in k), sum(held[p] for p in k), h) for i, a, b, g, k, h in docs), key=repr
    )


def alignment_rows(df):
    return sorted(((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=repr)


def test_alignment_against_brute_force(spark):
    rng = random.Random(6)
    syllables = ["ab", "cion", "ä", "ñe", "schw", "ou", "ing", "th", "é", "0", "!?"]
    texts = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))) for _ in range(60)) for _ in range(30)]
    rows = [*enumerate(ODD_TEXTS + texts), (3, "a"), (3, "a"), (None, texts[0]), (None, texts[0])]
    docs = spark.createDataFrame([(i, t, "en", 1, 2.0) for i, t in rows], "doc_id bigint, text string, codes string, n_a int, n_best double")
    want = brute_alignment(rows)
    assert alignment_rows(token_alignment.align_tokens(docs, *tokenizer_paths())) == want
    assert alignment_rows(token_alignment.align_tokens(docs.repartition(3), *tokenizer_paths(), block_rows=200)) == want
    assert sum(r[6] for r in want) > 1000 and any(r[5] < r[4] for r in want)


def test_group_stops_jump_and_walk():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randrange(1, 120)
        common = sorted(rng.sample(range(1, 400), n))
        a = sorted({*common, *rng.sample(range(1, common[-1] + 1), rng.randrange(0, min(12, common[-1])))})
        b = sorted({*common, *rng.sample(range(1, common[-1] + 1), rng.randrange(0, min(12, common[-1])))})
        both = sorted(set(a) & set(b))
        assert token_alignment.group_stops(a, b) == ([a.index(e) + 1 for e in both], [b.index(e) + 1 for e in both])
    assert token_alignment.group_stops([], []) == ([], [])


def test_alignment_caches_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "CACHE_WORDS", 5)
    cache = token_alignment.PairCache(*tokenizer_paths())
    plain = token_alignment.PairCache(*tokenizer_paths())
    for k in range(40):
        words = {f"word{i}" for i in range(k, k + 4)}
        got = cache.look_up(words)
        assert all(got[w] == plain.learn([w])[0] for w in words) and len(cache.known) + len(cache.older) < 20


def test_alignment_of_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert token_alignment.align_tokens(docs, *tokenizer_paths()).count() == 0
