"""Each operator against brute force on small tables with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrine.llm import line_dedup, mixing, ngram_join, quality, repeats, tokens, url_filter, vectors

random.seed(4)
VOCAB = [f"w{i}" for i in range(60)]


def text(n):
    return " ".join(random.choice(VOCAB) for _ in range(n))


BASE = [text(60) for _ in range(6)]
TEXTS = [None, "", "  \n ", "one two", "One TWO", *BASE, *BASE[:2], BASE[0] + " tail", BASE[1].replace("w1 ", "zz ", 1), "a " * 400, "a " * 401, BASE[2] + "\n" + BASE[3], BASE[3] + "\nlast line of all here", text(3000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, component string, score string, part string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "b", "a"][i % 3], 0, "k", "c", "s", "p") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [(None, "no id here", "en", None, 0, "k", "c", "s", "p")], SCHEMA).cache()


def grams(t, n):
    w = (t or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
def test_ngram_join(docs, n, num):
    sets = {i: grams(t, n) for i, t in enumerate(TEXTS)}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = ngram_join.jaccard_components(docs, n, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {i: (len(s), comp[i]) for i, s in sets.items()}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = ngram_join.keep_one(docs, n, num, 100)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in sets if comp[i] == i} | {None}


def test_ngram_join_repeated_ids_in_any_order(spark):
    a, b = text(60), text(60)
    rows = [(3, a), (3, b), (10, a + " tail"), (11, b + " tail"), (3, a)]
    for order in (rows, [rows[1], rows[0], *rows[:1:-1]]):
        got = ngram_join.jaccard_components(spark.createDataFrame(order, "doc_id long, text string"), 4, 85, 100, all_links=False).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (3, 3), (3, 3), (10, 3), (11, 3)]


def test_lines_against_all_pairs(spark):
    def near(x):
        i = random.randrange(len(x))
        return random.choice([x[:i] + "Q" + x[i:], x[:i] + x[i + 1 :], x[:i] + "Q" + x[i + 1 :]])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    base = [text(8)[: random.randrange(14, 30)].strip() for _ in range(12)]
    crowd = [base[0] + f" {i:02d}{i:02d} " + base[1] for i in range(50)]  # more lines than are tried pairwise share a half
    lines_ = list(dict.fromkeys([*base, *crowd, *map(near, base), *map(near, map(near, base)), *map(near, crowd[:10])]))
    df = spark.createDataFrame(list(enumerate(lines_)), "doc_id long, text string")
    for edits in (1, 2):
        comp = {x: x for x in lines_}
        links = [(a, b) for a in lines_ for b in lines_ if a < b and min(len(a), len(b)) >= 16 and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits]
        for _ in lines_:
            for a, b in links:
                comp[a] = comp[b] = min(comp[a], comp[b])
        got = line_dedup.line_classes(df, edits).join(df.select(F.unhex(F.md5("text")).alias("id"), "text"), "id").collect()
        groups = lambda c: sorted(sorted(x for x in lines_ if c[x] == k) for k in set(c.values()))
        assert groups({r.text: bytes(r.class_id) for r in got}) == groups(comp) and len(links) > 10


def test_lines_clashing_names_and_repeated_ids(spark):
    rows = [(1, "one line of some length\nb", "x", 7), (1, "another line of some length\nb", "y", 8), (2, "one line of some length\nc", "z", 9)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, _doc string, kept int"))
    assert out.columns == ["doc_id", "text", "_doc", "kept", "n_lines", "n_removed"]
    got = {r._doc: (r.text, r.kept, r.n_removed) for r in out.collect()}
    assert got["z"] == ("c", 9, 1) and sorted(got[k][2] for k in "xy") == [0, 1]
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines(spark, docs):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and out.count() == docs.count()
    rows = [(1, "the quick brown fox jumps\nshort"), (2, "the quick brown fix jumps\nshort\nanother quite long line"), (3, "short"), (3, "short"), (4, None), (5, "\n")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "the quick brown fox jumps\nshort", 2: "another quite long line", 3: "short", 4: None, 5: "\n"}


def test_edit_distance(spark):
    def edit(x):
        for _ in range(random.randrange(5)):
            i = random.randrange(len(x) + 1)
            x = random.choice([x[:i] + "b" + x[i:], x[:i] + x[i + 1 :], x[:i] + "c" + x[i + 1 :]])
        return x

    pairs = [(x, edit(x)) for x in ("".join(random.choice("abcé") for _ in range(random.randrange(25))) for _ in range(2000))]
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2):
        near = df.where(F.abs(F.char_length("a") - F.char_length("b")) <= k)
        assert near.where(line_dedup.edit_within(F.col("a"), F.col("b"), k) != (F.levenshtein("a", "b") <= k)).count() == 0


def removed(texts):
    """Byte by byte: length, bytes that go, maximal runs of them, digest of the rest."""
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest())
    return want


def test_repeats(spark, docs):
    def got(df, **sizes):
        return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, **sizes).collect() if r.doc_id is not None}

    assert got(docs) == removed(TEXTS)
    # a passage that many share with other text around it, far more slices than one task sorts; texts cut into many parts
    passage = text(30)[:130]
    many = [text(random.randrange(40)) + passage + text(random.randrange(40)) for _ in range(40)] + [text(900) + "é" * 150 + passage, "ab" * 300, "é" * 90]
    df = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")
    assert got(df) == got(df, chunk=333, block_size=64, crowd=8) == removed(many)
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, passage), (1, "short"), (2, passage + "x"), (None, passage)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in repeats.remove_repeats(twice).collect()) == [(0, 0), (1, 0), (1, 0), (2, len(passage))]


def test_equal_suffixes_by_cover_ranks():
    rng = np.random.default_rng(2)
    for _ in range(10):
        base = rng.integers(0, 3, 400).astype(np.uint8)
        t = np.concatenate([base[a : a + rng.integers(110, 200)] for a in rng.integers(0, 250, 20)] + [np.zeros(300, np.uint8)])
        starts, seen, raw = np.sort(rng.choice(len(t) - 100, 700, replace=False)), {}, t.tobytes()
        assert repeats.first_equal(t, starts).tolist() == [seen.setdefault(raw[s : s + 100], i) for i, s in enumerate(starts)]
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


def test_tokens(spark, docs):
    path = tokens.default_tokenizer()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    at = len(t.encode("no id here", add_special_tokens=False).ids) + 1
    want = {}
    for i, x in ids.items():
        want[i] = (at, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes()))
        at += len(x) + 1
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_token_files(tokens.write_token_files(docs, path)).collect() if r.doc_id is not None}
    assert got == want
    pieces = [r for r in tokens.pack_documents(docs, path).collect() if r.doc_id is not None]
    for i, x in ids.items():
        mine = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        full, pos = [*x, 1], 0
        for r in mine:
            assert r.start == pos and r.ids_crc32 == zlib.crc32(np.array(full[pos : pos + r.length], "<u4").tobytes())
            pos += r.length
        assert pos == len(full)
    same = spark.createDataFrame([(2, "b"), (1, "a a"), (1, "c"), (1, "a a"), (None, "d")], "doc_id long, text string")
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in tokens.read_token_files(tokens.write_token_files(same, path, segment_ids=2)).collect())
    assert [d for _, _, d in got] == [None, 1, 1, 1, 2] and [s for s, _, _ in got] == [sum(n for _, n, _ in got[:i]) for i in range(5)]
    empty = spark.createDataFrame([], SCHEMA)
    assert tokens.pack_documents(empty, path).count() == 0 and tokens.read_token_files(tokens.write_token_files(empty, path)).count() == 0


def test_dac_random_access():
    x = np.array([random.choice([0, 1, 255, 256, 50256, 70000, 2**31]) for _ in range(3000)], np.uint32)
    d = tokens.Dac(tokens.dac_encode(x))
    assert len(d) == 3000 and (d.slice(0, 3000) == x).all() and all(d[i] == x[i] for i in range(0, 3000, 37)) and (d.slice(511, 1025) == x[511:1025]).all()


def test_packing_fills_windows():
    pieces = [[i, 0, random.randrange(1, 2048)] for i in range(500)]
    seqs = tokens._pack(pieces, 2048)
    sizes = [sum(p[2] for p in s) for s in seqs]
    assert sum(sizes) == sum(p[2] for p in pieces) and sum(n & (n - 1) != 0 for n in sizes) <= 1 and max(sizes) <= 2048


def test_packing_tiers_mix_lengths():
    pieces = [[0, 0, 300], [1, 0, 112], [2, 0, 100], [3, 0, 700], [4, 0, 290], [5, 0, 34], [6, 0, 1500], [7, 0, 513], [8, 0, 35], [9, 0, 200], [10, 0, 56], [11, 0, 90]]
    seqs = tokens._pack(pieces, 2048)
    assert sorted(sum(p[2] for p in s) for s in seqs if len({p[2] for p in s}) > 1) == [256, 512, 1024, 2048]
    assert sorted(p[0] for s in seqs for p in s if not p[1]) == list(range(12))
    rng = random.Random(1)
    pieces = [[i, 0, rng.randrange(1, 2048)] for i in range(500)]
    seqs = tokens._pack(pieces, 2048)
    sizes = {w: [s for s in seqs if sum(p[2] for p in s) == w] for w in tokens.WINDOWS}
    assert all(len({p[2] for s in sizes[w] for p in s}) > 2 for w in (512, 1024))
    assert all(p[1] == 0 and p[2] == pieces[p[0]][2] for w in (256, 512, 1024) for s in sizes[w] for p in s)
    assert tokens._fill([7, 5, 3], 8) == [1, 2] and tokens._fill([7, 5], 8) is None and tokens._fill([], 0) == []
    assert sorted(sum(p[2] for p in s) for s in tokens._pack([[0, 0, 2900], [1, 0, 200]], 3000)) == [100, 3000]


def test_mixing(docs):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count() and sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    for source in {(r.source_size, r.target) for r in rows}:
        mine = [r for r in rows if (r.source_size, r.target) == source]
        assert all(r.taken in (0, r.size, 2 * r.size) for r in mine)
        assert abs(sum(r.taken for r in mine) - source[1]) <= max(r.size for r in mine)
    assert abs(sum({(r.source_size, r.target) for r in rows} and {r.source_size: r.target for r in rows}.values()) - 1.5 * sum({r.source_size for r in rows})) < 1e-6
    sizes = {n: random.randrange(1, 5) for n in range(3, 90)}
    for budget in (0, 1, 500, 4000):
        take = mixing.fit_counts(sizes, budget, 1)
        assert all(0 <= k <= sizes[n] for n, k in take.items()) and 0 <= budget - sum(n * k for n, k in take.items()) < 3


def test_mixing_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), rng.choice(["b", "a", "a", "a", None, "c"])) for i in range(400)] + [(None, "w w w", "a")] * 5 + [(1000, None, "c"), (1001, "", None)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + len((t or "").split())
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(total.values())
    while open_:  # what is over the cap is shared anew, round by round
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * total[s]}
        for s in full or open_:
            target[s] = 2 * total[s] if full else unit * weight[s]
            left -= target[s]
        open_ -= full or open_
    for s in order:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {total[s]} and all(abs(r.target - target[s]) < 1e-6 for r in mine)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in mine) and len({r.taken // r.size for r in mine if r.size}) <= 2
        assert abs(sum(r.taken for r in mine) - target[s]) <= 0.5  # so many lengths reach every sum
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_packing_contract(spark):
    rng = random.Random(3)
    rows = [(rng.choice([i, i, None]), text(rng.randrange(0, 900))) for i in range(300)] + [(7, "same text")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = tokens.pack_documents(df, tokens.default_tokenizer(), shard_bytes=1 << 18).collect()
    seqs = {}
    for r in pieces:
        seqs.setdefault(r.sequence_id, []).append(r)
    odd = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048 and {r.sequence_tokens for r in s} == {at}
        odd += at & (at - 1) != 0
    shards = {i >> 32 for i in seqs}
    assert odd <= len(shards) and sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    groups = {}
    for s in seqs.values():
        groups.setdefault(s[0].step_group, []).append(s[0].sequence_tokens)
    for shard in shards:
        mine = [g for k, g in groups.items() if k >> 32 == shard]
        assert max(map(len, mine)) - min(map(len, mine)) <= 1 and max(map(len, mine)) <= 32


def test_special_names_in_texts(spark):
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    model = Tokenizer.from_file(path)
    rng = random.Random(8)
    parts = [*"abAB12.,;:!?'()é\u0660中-_ \n\t", "<|endoftext|>", " don't", "\u3000", "½", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    want = [np.array(model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tokens.Encoder(path)(texts) == want and tokens.Encoder(path, most=5)(texts) == want
    assert 50256 in np.frombuffer(want[next(i for i, t in enumerate(texts) if "<|endoftext|>" in t)], "<u4")


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    rows = quality.op9_quality_votes(spark, sf).join(truth, "doc_id").where("held_out").collect()
    wrong = sum(r.predicted != r.quality for r in rows)
    assert len(rows) > 50 and wrong <= 0.03 * len(rows)


def vecs(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string")


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.2, (600, 16)).astype(np.float32)
    x[50:60] = x[40]
    rows = [(i, [float(y) for y in v], "c") for i, v in enumerate(x)]
    bad = [(900, None, "c"), (950, [None] + [0.1] * 15, "c"), (1000, [float("nan")] * 16, "c"), (None, [0.1] * 16, "c")]
    df = vecs(spark, rows + bad)
    q = np.floor(256 * x.astype(float)).astype(int)
    got = {}
    for r in vectors.exact_top_k(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for i in range(0, 600, 50):
        s = sorted((-int(q[i] @ q[j]), j) for j in range(600) if j != i)[:5]
        assert [got[i][k + 1] for k in range(5)] == [(j, -v) for v, j in s]
    assert set(got) == set(range(0, 600, 50))
    hit = 0
    found = vectors.multi_index_search(df, df.where("vec_id % 50 = 0")).collect()
    for i in range(0, 600, 50):
        d = sorted((float(((x[i].astype(float) - x[j]) ** 2).sum()), j) for j in range(600) if j != i)[:10]
        hit += len({j for _, j in d} & {r.vec_id for r in found if r.query_id == i})
    assert hit >= 0.9 * 120
    assert all(len({r.vec_id for r in found if r.query_id == i}) == 10 for i in range(0, 600, 50))
    # other lengths have neighbours of their own; sums beyond a long are held to its range
    mixed = vecs(spark, [(0, [1.0, 0.0, 0.0], "c"), (1, [1.0, 1.0, 0.0], "c"), (2, [1.0, 0.0, 9.0], "c"), (100, [1.0, 0.0], "c"), (101, [3.0, 0.0], "c")])
    got = vectors.multi_index_search(mixed, mixed.where("vec_id % 100 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 1.0), (0, 2, 2, 9.0), (100, 1, 101, 2.0)]
    huge = vecs(spark, [(0, [1e37, 1.0], "c"), (1, [1e37, 2.0], "c"), (2, [1.0, 1.0], "c"), (3, [-1e37, 0.0], "c"), (4, [2e37, 0.0], "c"), (50, [1.0, 1.0], "c")])
    got = vectors.exact_top_k(huge, huge.where("vec_id % 50 = 0")).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [1, 2, 4, 50, 3]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 50] == [0, 1, 4, 2, 3]
    assert {r.vec_id: r.score for r in got if r.query_id == 50}[2] == 2 * 256 * 256
    none = vecs(spark, bad[:3])
    assert vectors.exact_top_k(none, none).count() == 0 and vectors.multi_index_search(none, none).count() == 0


def test_urls(spark):
    rows = [(1, "https://A.Example.com/en/7x?q"), (2, "http://b.example.com/en/8"), (3, None), (4, "no scheme casino"), (5, "http://x.org/casinos/"), (6, "http://x.org/free-bet"), (7, "http://x.org/free/free"), (8, "http://com/en/"), (9, "http://notcom/en/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {
        1: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("b.example.com", "/en/8", "com/en/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "block"),
        5: ("x.org", "/casinos/", None, "allow"), 6: ("x.org", "/free-bet", None, "block"), 7: ("x.org", "/free/free", None, "allow"), 8: ("com", "/en/", "com/en/", "block"), 9: ("notcom", "/en/", None, "allow"),
    }


def test_url_rules_of_the_contract(spark):
    rows = [(1, "http://net/de/7"), (2, "http://a.Net/de/casino"), (3, "http://example.net/de/8"), (4, "http://a.example.net/de/81"), (5, "http://example.net/de/9"), (6, "http://a.org/es/"), (7, "http://net/en/casino"), (8, "http://example.com/en/6")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {
        1: ("net/de/", "allow"), 2: ("net/de/", "allow"), 3: ("example.net/de/8", "block"), 4: ("example.net/de/8", "block"),
        5: ("net/de/", "allow"), 6: ("org/es/", "block"), 7: (None, "block"), 8: ("com/en/", "block"),
    }


def test_quality(spark, docs):
    good = [(i, text(80)) for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in text(80).split())) for i in range(60)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("label"))
    out = quality.score_quality(df, labels.where("doc_id % 2 = 0")).where("doc_id % 2 = 1")
    assert out.where("predicted != int(doc_id < 100)").count() == 0
    whole = quality.score_quality(docs, labels.limit(0))
    assert whole.count() == docs.count() and whole.where("score != 1").count() == 0
    assert quality.score_quality(docs.union(df.select("doc_id", "text", *[F.lit(None).alias(c) for c in docs.columns[2:]])), labels).where("score < 0 or score > 1 or score is null").count() == 0


def test_quality_vectors(spark):
    """Against dense matrices of all features, which take several hundred MB of the driver."""
    marks = "aB7 .,!|'-\u00e9\n"
    texts = ["", None, "ab"] + ["".join(random.choices(marks, k=random.randrange(1, 90))) for _ in range(2997)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tracemalloc.start()
    origin, basis, z, _ = quality.fit(df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label")))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    x = np.array([quality.features(t) for t in texts], np.float64)
    share = x[:, : quality.WIDE**3] ** 2
    share /= np.maximum(share.sum(0), 1e-12)
    weight = np.ones(quality.SIZE)
    weight[: quality.WIDE**3] += (share * np.log(np.maximum(share, 1e-12))).sum(0) / np.log(len(x))
    left = x * weight - (x * weight).mean(0)
    values, vectors = np.linalg.eigh(left.T @ left)
    want, got = left @ vectors[:, ::-1][:, :48], (x @ basis - origin).astype(np.float64)
    assert np.abs((want**2).sum(0) - (got**2).sum(0)).max() < 1e-3 * values[-1]
    assert np.abs(want @ want[:50].T - got @ got[:50].T).max() < 1e-3  # whichever way an eigenvector points
    assert np.abs(z - got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)).max() < 1e-3
    assert peak < 150e6


def test_stages(spark, docs, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([(5, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    cur = docs
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, cur, str(tmp_path)).cache()
        assert out.columns == docs.columns and out.count() > 0, name
        cur = out
    assert c.STAGES[-1][1](spark, cur, str(tmp_path)).count() > 0
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in c.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_stage_copies_share_lines_with_an_earlier_document(spark, tmp_path):
    import corpus_pipeline as c

    shared, own, more = ["\n".join(text(20) for _ in range(4)) for _ in range(3)]
    rows = [(1, shared), (2, shared + "\n" + own), (3, shared + "\n" + own), (4, shared + "\n\n"), (5, more), (6, None), (7, "\n"), (None, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = c.fresh_lines(spark, docs, str(tmp_path)).cache()
    assert {r.doc_id: r.text for r in lines.collect()} == {1: shared, 2: own, 5: more, 6: None, 7: "\n", None: shared}
    assert {r.doc_id for r in c.distinct_documents(spark, lines, str(tmp_path)).collect()} == {1, 2, 5, 6, 7, None}
    emptied = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs, keep_whole=False).collect()}
    assert emptied[3] == ("", 8, 8) and emptied[4] == ("\n", 4, 4)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}[3] == shared + "\n" + own


def test_all_links_of_near_copies(spark):
    words_ = [f"v{i}" for i in range(120)]
    rows = [(i, " ".join([*words_[: 10 * i], f"x{i}", *words_[10 * i + 1 :]])) for i in range(10)]
    rows += [(20, rows[3][1]), (21, " ".join(words_)), (22, " ".join(words_[:100])), (23, text(80)), (24, None)]
    sets = {i: grams(t, 4) for i, t in rows}
    near = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    distinct = set(map(frozenset, sets.values()))
    want = {i: sum(bool(s) and o != s and near(s, o) for o in distinct) for i, s in sets.items()}
    assert want[21] == 10 and max(want[i] for i in range(10)) > 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_components(docs, 4, 85, 100).collect()
    assert {r.doc_id: r.n_links for r in got} == want
    fast = ngram_join.jaccard_components(docs, 4, 85, 100, all_links=False).collect()
    assert {r.doc_id: r.component_id for r in fast} == {r.doc_id: r.component_id for r in got} and {r.n_links for r in fast} == {None}
