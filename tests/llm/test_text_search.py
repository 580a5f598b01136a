"""Search, phrases and sentencepiece against plain loops over a few texts."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sentrine.llm import phrases, pieces, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, schema):
    """Rows with further columns, some of names that the operators use themselves."""
    return spark.createDataFrame(rows, schema).withColumns({"n": F.lit("x"), "m": F.lit(1), "block": F.lit("y"), "codes": F.lit(2), "rank": F.lit(3), "q": F.lit(4), "part": F.lit(5)})


def ranked(docs, items, k):
    bags = [(d, Counter(TERM.findall((t or "").translate(UPPER)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for doc, b in bags:
            m = 100 - 75 + (75 * sum(b.values()) * n) // length
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t, r in Counter(TERM.findall((text or "").translate(UPPER))).items() if t in b)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, i + 1, None if null else doc, -s) for i, (s, null, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_ranked_search_against_brute_force(spark):
    rng = random.Random(4)
    words = ["the", "of", "Él", "ñandú", "x1", "ring", "über", "Zoo", "a", "日本"] + [f"w{i}" for i in range(60)]
    say = lambda most: " ".join(rng.choice(words[: rng.choice([4, 12, 70])]) + rng.choice(["", ",", ".\n", "-b", "´"]) for _ in range(rng.randrange(most)))
    docs = [(i, say(rng.choice([3, 12, 12, 90]))) for i in range(240)]
    docs += [(500, None), (501, ""), (502, "... --"), (None, "the ring of"), (3, "the ring"), (3, "the ring"), (503, "the ring"), (504, "zoo " * 40_000)]
    items = [(i, say(14)) for i in range(17)] + [(90, None), (91, ""), (92, "nothing0here"), (5, "the the ring"), (93, "THE"), (94, "zoo ring")]
    d, q = frame(spark, docs, "doc_id long, text string").repartition(3), frame(spark, items, "item_id long, text string")
    want = ranked(docs, items, 10)
    for block, cell in ((1024, 512), (7, 5)):
        got = search.rank_documents(d, q, block=block, cell_docs=cell).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    assert search.rank_documents(d.limit(0), q).count() == 0 and search.rank_documents(d, q.limit(0)).count() == 0


def test_large_weights_stay_exact(spark):
    docs, items = [(1, "a b"), (2, "a a b c"), (3, "b")], [(1, "a " * 7 + "b")]
    q = search.Queries([Counter({"a": 10**7, "b": 3})], ["a", "b"], search.np.array([2000, 5]))
    assert q.exact == [False]
    (_, s), = q.scores(search.np.array([0]), 101, 2, *map(search.np.array, ([0, 1], [1, 1], [2, 3], [0, 1, 1])))
    assert s.tolist() == [2 * 10**10 * (10**9 // 1808), 2 * 10**10 * (10**9 // 1808) + 15 * (10**9 // 1808)]
    assert [tuple(r) for r in search.rank_documents(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")).orderBy("rank").collect()] == [x for x in ranked(docs, items, 10)]


def mined(docs, least, longest, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    f = {k: a for k, a in f.items() if a >= least}
    out = {}
    for (lang, p), a in f.items():
        inside = any(len(e) > len(p) and l2 == lang and b >= a and any(e[i : i + len(p)] == p for i in range(len(e))) for (l2, e), b in f.items())
        if len(p) > 1 and not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def test_collocations_against_brute_force(spark):
    rng = random.Random(8)
    words = ["the", "The", "of", "é", "ß", "a-b", "日本", "(x)", "\xa0", "zz"] + [f"w{i}" for i in range(25)]
    say = lambda: "".join(rng.choice(words[: rng.choice([3, 8, 35])]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "; "]) for _ in range(rng.randrange(60)))
    docs = [(rng.choice(["en", "en", "en", "de", None, "und"]), say()) for _ in range(120)]
    docs += [("en", None), ("fr", ""), ("fr", " .,;"), ("en", "one two three four five six. " * 30), ("en", "the the the the the the"), ("de", "w1 w2 " * 3000)]
    d = frame(spark, docs, "lang string, text string").repartition(3)
    for least, longest, top in ((4, 5, 2000), (9, 3, 7)):
        want = mined(docs, least, longest, top)
        for most in (1_000_000, 0):  # frequent groups broadcast, and joined
            got = phrases.collocations(d, least, longest, top, most)
            assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 10
    assert phrases.collocations(d, 10**6).count() == 0 and phrases.collocations(d.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    q = spark.createDataFrame([(10**13, 9 * 10**15, 10**13, 2 * 10**13)], "a long, n long, l long, r long")
    s = q.select(F.expr("(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")).first()[0]
    assert s == 1000 * 9 * 10**15 // (2 * 10**13)


TEXTS = [None, "", " ", "  a  b ", "a▁b ▁ c", "x\ny\t z", "é́ ☃ \U0001f600", "<s> </s> <unk> <0x0A>", "\x00 a", "ａ　b\xa0c", "the " * 30_000, "z" * 70_000, "\n", " \n ", "end "]


@pytest.fixture(scope="module")
def library():
    return pieces.load(pieces.default_model())


def test_sentencepiece_equals_the_library(spark, library):
    rng = random.Random(3)
    parts = [" ", " ", "  ", "\n", "▁", "a", "the", "é", "☃", ".", "ing", "😀", "12", "\r\n"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    rows = list(enumerate(texts)) + [(None, "no id"), (4, "again"), (4, "again")]
    out = pieces.decode_documents(pieces.encode_documents(frame(spark, rows, "doc_id long, text string").repartition(3), pieces.default_model()), pieces.default_model()).collect()
    want = sorted(((d, library.encode(t or ""), library.decode(library.encode(t or ""))) for d, t in rows), key=str)
    assert sorted(((r.doc_id, list(r.ids), r.text) for r in out), key=str) == want
    assert pieces.encode_documents(spark.createDataFrame([], "doc_id long, text string"), pieces.default_model()).count() == 0
    assert pieces.decode_documents(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), pieces.default_model()).first().text == ""


def test_models_that_cannot_be_cut_get_whole_texts(library, monkeypatch):
    assert pieces.cuts_at_marks(library)

    class Crossing:
        def __getattr__(self, name):
            return getattr(library, name)

        def id_to_piece(self, i):
            return "of▁the" if i == 9000 else library.id_to_piece(i)

    assert not pieces.cuts_at_marks(Crossing())
    monkeypatch.setattr(pieces, "cuts_at_marks", lambda _: False)
    table = pieces.ChunkTable(pieces.default_model(), most=2)
    texts = [t or "" for t in TEXTS]
    assert table.encode(pieces.pa.array(texts)).to_pylist() == library.encode(texts)


def test_queries_of_the_three(spark, library, tmp_path):
    docs = [(i, t, "en") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "the end")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [library.encode(t or "") for t in TEXTS]
    got = pieces.op13_sentencepiece(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(i, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for i, x in enumerate(ids)]
    assert [r.doc_id for r in search.op11_ranked_search(spark, str(tmp_path)).orderBy("rank").collect()] == [d for _, _, d, _ in ranked([x[:2] for x in docs], [(1, "the end")], 10)]
    assert [r.phrase for r in phrases.op12_collocations(spark, str(tmp_path)).collect()] == [p for _, _, p, *_ in mined([(x[2], x[1]) for x in docs], 100, 5, 2000)]


@pytest.mark.parametrize("name,cuts", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_library_with_any_tokenizer(name, cuts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from sentrine.llm import tokens

    rng = random.Random(2)
    parts = [" ", " ", " ", "\n", "  ", "a", "the", "The", "é", "☃", ".", ",", "?!", "ing", "😀", "12", "\r\n", "don't", "'ll", "<|endoftext|>", "x_y", "(", "\t", "word,", "\xa0", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(16))) for _ in range(4000)] + [None, "", " ", "\n", "a ", "the cat, the dog.\nThe end.", "y" * 50_000]
    encode, library = tokens.Encoder(public_tokenizers.path(name), 300), Tokenizer.from_file(public_tokenizers.path(name))
    assert encode.cuts == cuts
    got = [list(search.np.frombuffer(x, "<u4")) for i in range(0, len(texts), 700) for x in encode(texts[i : i + 700])]
    assert got == [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_whose_power_sums_meet(spark):
    """Two words of 2,048 letters built so that their sums of powers agree modulo 2 ** 64."""
    from sentrine.llm import common, ngram_join

    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    raw = [search.np.frombuffer(x.encode(), search.np.uint8) for x in (a, b)]
    assert len({int(common.prefix_sums(x, common.FOLDED)[0][-1]) for x in raw}) == 1  # the sums do meet
    rows = [(1, a), (2, b), (3, f"x y z {a}"), (4, f"x y z {b}"), (5, f"X Y Z {a.upper()}")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_token_files_give_any_id(spark):
    from tokenizers import Tokenizer

    from sentrine.llm import tokens

    path = tokens.default_tokenizer()
    rows = [(i * 3, f"document {i} of many, " * (i % 9)) for i in range(60)] + [(7, None)]
    files = tokens.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, segment_ids=300, part_bytes=2000)
    assert files.count() > 4
    library = Tokenizer.from_file(path)
    for doc, text in rows[::7] + rows[-1:]:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert tokens.tokens_at(files, doc, 0, 10**6) == ids and tokens.tokens_at(files, doc, len(ids) - 1) == [2]
        assert tokens.tokens_at(files, doc, 3, 4) == ids[3:7]
    assert tokens.tokens_at(files, 1) == [] and tokens.tokens_at(files, 10**9) == []
