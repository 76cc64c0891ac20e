"""Each corpus operator against brute force: nulls, empty and long texts, ties, repeated rows, extra columns."""

import math
import random

import numpy as np
import plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from eventloom.llm import bpe, fmindex, jaccard, langid, leaks, neighbours, pii, pll, quality, repeats, shared, tokenfile

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
LANGS = {"en": "the of and that with this from have water people house river morning", "de": "der die und das nicht mit ein sich haus wasser morgen fluss leute", "fr": "le la et les des une dans pour maison eau matin rivière gens"}


def sentence(rng, lang, n):
    words = LANGS[lang].split()
    return " ".join(rng.choice(words) + (rng.choice(words) if rng.random() < 0.5 else "") for _ in range(n))


def corpus():
    """Rows (doc_id, text, lang, source)."""
    rng = random.Random(3)
    rows = [(10, None, None, None), (11, "", "en", "s1"), (12, " \n\t ", "de", "s1"), (13, "12 34 !!", None, "s2"), (14, "word", "en", None), (15, "two words", "en", "s1")]
    passage, item = sentence(rng, "en", 40), sentence(rng, "en", 30)
    for i in range(20, 50):
        lang = rng.choice(list(LANGS))
        rows.append((i, sentence(rng, lang, rng.randint(5, 120)).capitalize() + ".\nx y", lang, f"s{i % 3}"))
    for i in range(50, 60):  # a passage that many share, in texts of their own
        rows.append((i, f"{sentence(rng, 'en', 20)} {passage} {sentence(rng, 'en', 20)}", "en", "hot"))
    base = sentence(rng, "fr", 200).split()
    for i in range(60, 80):  # near copies, of which some meet only through others
        copy = list(base)
        for j in range((i - 60) // 2):
            copy[7 * j + 3] = f"changed{i % 5}"
        rows.append((i, " ".join(copy), "fr", "hot"))
    for i in range(80, 90):  # exact copies, short near copies
        rows.append((i, " ".join(base) if i < 84 else f"a b c d e f g h i j k l m n {i // 3}", "fr", "hot"))
    rows.append((90, sentence(rng, "de", 3000), "de", "s1"))
    rows.append((91, "mail x.y@example.com._z@b.org, 10.0.0.1 and 999.1.1.1 or 1.2.3.4.5.6.7.8; 4111 1111-1111 1111 +49 (30) 1234.567 4111111111111112 😀 +1+2 " + "7" * 300, "en", "s1"))
    rows.append((92, f"{item} and more", "en", "s1"))
    rows.append((93, f"{' '.join(item.split()[5:20])} or less", "en", "s2"))
    rows.append((94, "z" * 3000 + " é" * 50 + "'s 're don't <|endoftext|>", "en", "s1"))
    return rows, item


@pytest.fixture(scope="module")
def rows():
    return corpus()[0]


@pytest.fixture(scope="module")
def items():
    item = corpus()[1]
    return [(1, item), (2, "word"), (3, None), (4, "!!"), (1, "two words"), (5, " ".join(item.split()[10:25]))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame([(*r, i, "extra") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, keys string")
    return shared.written(made.repartition(3, "n"), "docs")


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Null ids and repeated rows."""
    more = [*rows[:8], (None, rows[7][1], "en", "s1"), (None, None, None, None), rows[7], rows[60], rows[60]]
    return spark.createDataFrame(more, "doc_id long, text string, lang string, source string"), [(r[0], r[1]) for r in more]


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(df, expected, *columns):
    assert got(df, *columns) == sorted(expected, key=repr)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_codec(docs, odd, none, rows):
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    same(bpe.digests(docs, RANKS), plain.codec(pairs(rows)), *columns)
    same(bpe.digests(odd[0], RANKS), plain.codec(odd[1]), *columns)
    same(bpe.digests(none, RANKS), [], *columns)
    back = bpe.decode(bpe.encode(docs, RANKS), RANKS).select("text", "decoded", "source").collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back) and len(back) == len(rows)


def test_prefix_table():
    coder = bpe.PrefixCoder(bpe.load_ranks(open(RANKS, "rb").read()))
    table = bpe.PrefixTable(coder)
    for part in (b"inter", b"national", b"isations" * 40):
        table.append(part)
    assert table.ids() == coder.encode(table.data) and coder.decode(table.ids(9)) == table.data[:9]
    recomputed = table.replace(100, 104, b"Q")
    assert table.ids() == coder.encode(table.data) and recomputed < len(table.data) - 100
    table.replace(0, len(table.data), b"")
    assert table.ids() == []


def test_token_files(spark, docs, odd, none, rows):
    for i, (frame, expected) in enumerate(((docs, pairs(rows)), odd, (none, []))):
        path = shared.fresh(spark, f"test-{i}")
        tokenfile.write(frame, path, JSON)
        same(tokenfile.summary(spark, path), plain.token_files(expected), "doc_id", "start", "n_tokens", "ids_crc32")
        if i == 0:
            assert [r.doc_id for r in tokenfile.lookup(spark, path, [60]).collect()] == [60]


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard(docs, odd, none, rows, k, num):
    columns = ("doc_id", "n_shingles", "component_id")
    same(jaccard.classes(docs, k, num, 100), plain.classes(pairs(rows), k, num, 100), *columns)
    same(jaccard.classes(none, k, num, 100), [], *columns)
    if k == 3:
        same(jaccard.classes(odd[0], k, num, 100), plain.classes(odd[1], k, num, 100), *columns)
        assert got(jaccard.one_of_each(odd[0], k, num), "doc_id").count((rows[60][0],)) == 1


def test_jaccard_least_id_is_a_later_copy(spark):
    """Of equal sets in a task only the first makes entries; the least id may be another's."""
    base = [f"w{i}" for i in range(150)]
    near = [" ".join([*base[:i], "new", *base[i + 1 :]]) for i in (20, 90)]
    rows = [(9, " ".join(base)), (8, near[0]), (7, near[1]), (3, " ".join(base)), (1, near[0]), (2, "alone " * 5), (0, "alone " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    same(jaccard.classes(docs), plain.classes(rows, 3, 90, 100), "doc_id", "n_shingles", "component_id")


@pytest.mark.parametrize("others", [0.0, 2.0, 50.0])
def test_jaccard_entries_lose_no_link(others):
    """Linked sets of any size meet in a list or by a subset, whatever elements come last as frequent."""
    rng = np.random.default_rng(4)
    for num in (80, 90):
        plan = jaccard.planned(num, 100, others)
        assert plan.light < plan.least_heavy * 100 / num + 1
        for n in (*range(1, 60), 100, 333, 1000):
            for _ in range(6):
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                lost = int(rng.integers(0, len(a) - math.ceil(num * len(a) / 100) + 1))
                more = int(rng.integers(0, max(1, math.floor((len(a) - lost) * 100 / num) - len(a)) + 1))
                b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.integers(0, 2**64, more, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both < num * (len(a) + len(b) - both):
                    continue
                frequent = np.sort(rng.permutation(a)[: int(rng.integers(0, len(a) + 1))])
                if max(len(a), len(b)) <= plan.light:
                    assert set(jaccard._subsets(a, plan)[0]) & set(jaccard._subsets(b, plan)[0])
                    continue
                assert min(len(a), len(b)) >= plan.least_heavy
                x, y = (jaccard.first_elements(u, frequent, plan).tolist() for u in (a, b))
                least, i = plan.common(len(a), len(b)), next(i for i, e in enumerate(x) if e in y)
                assert len(a) - i >= least and len(b) - y.index(x[i]) >= least


def test_jaccard_sets_agree_by_their_words():
    texts = ["a b c d", "A b\tc d d", "b c", "C b", "b c", "", None, "a b c"]
    import pyarrow as pa

    sets = jaccard.exact_sets(pa.array(texts), 3)
    assert [len(u) for u in sets] == [2, 3, 1, 1, 1, 0, 0, 1]
    assert set(sets[0]) < set(sets[1]) and (sets[2] == sets[4]).all() and sets[2] != sets[3] and sets[7][0] in sets[0]


def test_private_data(docs, odd, none, rows):
    columns = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    same(pii.report(docs), plain.private_report(pairs(rows)), *columns)
    same(pii.report(odd[0]), plain.private_report(odd[1]), *columns)
    same(pii.report(none), [], *columns)
    same(pii.redact(docs), [(d, plain.redacted(t)) for d, t in pairs(rows)], "doc_id", "text")
    plans = pii.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plans and "Arrow" not in plans


def test_private_data_by_context(spark):
    """Seeds after one word teach that word; unseen identifiers after it are found, those after common words are not."""
    rows = [(i, f"call mailto: user{i}@mail.example.com on the day") for i in range(12)]
    rows += [(20, "the mailto: bob@localhost is new"), (21, "the 77 bottles and the x9 wall"), (22, None), (23, "mailto: <eve@intranet>, ok")]
    found = dict(got(pii.report(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "spans"))
    assert found[20] == "email:12:25" and found[23] == "email:9:21" and found[21] == "" and found[3] == "email:13:35"


def test_private_data_by_context_of_long_spans(spark):
    """Seeds of several words, and seeds glued to other text, teach the word before them."""
    rows = [(i, f"the phone: +1 (017) 555-77{i:02} rings") for i in range(12)]
    rows += [(20 + i, f"a card# 4111 1111 1111 1111, or e-mail <mailto:user{i}@mail.example.com> now") for i in range(12)]
    rows += [(50, "my phone: 555-7713 and 42"), (51, "an e-mail bob@localhost"), (52, "the 77 rings"), (53, "\ue120\ue355 phone: x7")]
    found = dict(got(pii.report(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "spans"))
    assert found[50] == "phone:10:18" and found[51] == "email:10:23" and found[52] == "" and found[53] == "phone:10:12"
    assert found[3] == "phone:11:28" and found[25] == "email:47:69,card:8:27"


def test_private_data_induces_further_patterns(spark):
    """Keys teach ``token =``; what that finds teaches ``pass:``, which finds what no seed has a pattern for."""
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    filler = lambda: sentence(rng, "en", 6)
    rows = [(i, f'{filler()} token = "{key()}" {filler()}') for i in range(60)]
    rows += [(70 + i, f'{filler()} token = "x{i}y"### {filler()} pass: x{i}y {filler()}') for i in range(12)]
    rows += [(90, "a pass: q77 here"), (91, f"the {key()} alone in the text"), (92, "the 12 and the 13")]
    found = dict(got(pii.report(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "spans"))
    text = dict(rows)
    assert all(found[i].split(",")[0] == f"secret:{text[i].index(chr(34)) + 1}:{text[i].rindex(chr(34))}" for i in range(60))
    assert all(len(found[70 + i].split(",")) == 2 for i in range(12)) and found[90] == "secret:8:11" and found[91] == found[92] == ""


def test_stages_keep_clashing_columns(spark):
    names = ["pii_flag", "extra", "tid", "_m_email", "c0", "pii_spans", "leak_words", "leak_items", "t", "ids", "lang_pred"]
    rows = [(1, "mail a@b.cd and 10.0.0.1", "en"), (2, "a b c d e f g h i", "en"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    for out, kept in ((pii.redact(docs), {1, 2, 3}), (leaks.clean(docs, bench), {1, 3}), (jaccard.one_of_each(docs), {1, 2, 3})):
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept
        assert all(r[c] == i for r in out.collect() for i, c in enumerate(names))
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()}[1] == "mail [email] and [ip]"


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((300, 24)).astype(np.float32)
    vectors[100:140] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(400, None), (420, [0.0] * 24), (440, [float("nan")] * 24), (460, [float("inf")] + [0.0] * 23), (480, [None] * 24), (500, []), (5, vectors[5].tolist()), (520, [1.0, 2.0]), (521, [3.0, 1.0])]
    exact = vectors.astype(np.float64)
    expected = []
    for q in range(0, 300, 20):
        best = sorted((-float(exact[j] @ exact[q]), j) for j in range(300) if j != q)[:20]
        expected += [(q, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(best)]
    expected.append((520, 1, 521, 5.0))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.search(table, F.col("vec_id") % 20 == 0, 20)
    same(found.withColumn("score", F.round("score", 9)), expected, "query_id", "rank", "vec_id", "score")
    assert neighbours.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 5)
    test_neighbours(spark)


def test_leaks(spark, docs, odd, none, rows, items, monkeypatch):
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    expected = plain.leaks(pairs(rows), items)
    same(leaks.report(docs, bench), expected, *columns)
    same(leaks.report(odd[0], bench), plain.leaks(odd[1], items), *columns)
    same(leaks.report(none, bench), [], *columns)
    same(leaks.report(docs, bench.limit(0)), plain.leaks(pairs(rows), []), *columns)
    assert dict(got(leaks.report(docs, bench), "doc_id", "longest"))[92] == 30
    same(leaks.clean(docs, bench), [(e[0],) for e in expected if not e[3]], "doc_id")
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 500)  # several blocks give the same
    same(leaks.report(docs, bench), expected, *columns)


def test_repeats(docs, odd, none, rows, monkeypatch):
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    expected = plain.repeats(pairs(rows))
    same(repeats.remove(docs), expected, *columns)
    same(repeats.remove(odd[0]), plain.repeats(odd[1]), *columns)
    same(repeats.remove(none), [], *columns)
    assert all(plain.sha(r.kept) == r.kept_sha256 for r in repeats.remove(docs).collect())
    monkeypatch.setattr(repeats, "HOT_DOCS", 2)
    monkeypatch.setattr(repeats, "SHARD_PIECES", 20)
    same(repeats.remove(docs, digest_only=True), expected, *columns)
    monkeypatch.setattr(repeats, "BROADCAST_KEYS", 0)
    same(repeats.remove(docs, digest_only=True), expected, *columns)


def test_fm_index():
    """Intervals, least owners and matching statistics against plain search."""
    rng = np.random.default_rng(2)
    lengths = rng.integers(0, 22, 120)
    words, owners = rng.integers(0, 5, lengths.sum()), rng.integers(0, 40, 120).astype(np.int32)
    index = fmindex.FMIndex(words, lengths, owners)
    texts = ["".join(map(str, words[a - n : a])) for a, n in zip(np.cumsum(lengths), lengths, strict=True)]
    for pattern in ("0123", "41", "3", "00000"):
        low, high = np.zeros(1, np.int64), np.full(1, index.length)
        for c in reversed(pattern):
            low, high = index.extend(np.array([int(c)]), low, high)
        where = [x for t, x in zip(texts, owners, strict=True) for i in range(len(t)) if t.startswith(pattern, i)]
        assert max(0, int(high[0] - low[0])) == len(where)
        assert not where or index.least(low, high)[0] == min(where)
    asked = ["0123401234", "", "77", *texts[:40]]
    own = np.array([50, 50, 50, *owners[:40]], np.int32)
    flat = np.array([int(c) for t in asked for c in t])
    got_ = list(zip(*(x.tolist() for x in index.statistics(flat, np.array([len(t) for t in asked]), own, 3)), strict=True))
    expected = []
    for i, t in enumerate(asked):
        for e in range(len(t)):
            sizes = [k for k in range(3, e + 2) if any(t[e + 1 - k : e + 1] in u for u, x in zip(texts, owners, strict=True) if x < own[i])]
            expected += [(i, e, max(sizes))] if sizes else []
    assert sorted(got_) == expected


def test_longest_common_runs():
    rng = np.random.default_rng(5)
    for size in (1, 30, 200):
        own, others = (rng.integers(-1, 3, size) for _ in range(2))
        best, where = leaks.longest(own, others)
        for i in range(size):
            runs = [next((k for k in range(size) if i + k >= size or j + k >= size or own[i + k] < 0 or own[i + k] != others[j + k]), size - max(i, j)) for j in range(size)]
            assert best[i] == max(runs) and (not best[i] or runs[where[i]] == best[i])
    same_ = np.zeros(100_000, np.int64)
    assert leaks.longest(same_, same_)[0][0] == 100_000


def test_leak_locations(spark):
    """The longest match goes on past windows that stand in several items, and its places are given."""
    w = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(w[:9])), (2, " ".join([*w[30:34], *w[:13]])), (None, " ".join(w[40:60])), (3, "w1 w1 w1")]
    docs = [(1, " ".join(["x", *w[:13], "y", *w[:9]])), (2, " ".join(w[:9])), (3, " ".join(["z z", *w[41:55]])), (4, "w1 w1 w1 w1"), (5, "nothing")]
    found = leaks.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()
    for r in found:
        text = dict(docs)[r.doc_id]
        size, at = plain.longest_leak(text, items)
        assert r.leak_longest == size and (r.leak_where is None) == (size == 0), r
        if size:
            assert r.leak_where.doc_word == min(at)
            item = next(t for i, t in items if (None if i is None else str(i)) == r.leak_where.item)
            own, other = plain.leak_words(text), plain.leak_words(item)
            assert own[r.leak_where.doc_word :][:size] == other[r.leak_where.item_word :][:size]


def twins():
    """Two words of 1,024 letters that polynomial hashes modulo a power of two cannot tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_are_told_apart(spark):
    one, two = twins()
    same_ = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"\n{one}\n{two}\n"), (2, f"p q {one}"), (3, f"p q {two}"), (4, f"{same_} {one}"), (5, f"{same_} {two}"), (6, f"{same_} {two} {one}")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), [(1, f"a b c d e f g {one}"), (2, two)]
    docs = docs.union(spark.createDataFrame([(7, f"a b c d e f g {two}")], docs.schema))
    rows.append((7, f"a b c d e f g {two}"))
    same(bpe.digests(docs, RANKS), plain.codec(rows), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    path = shared.fresh(spark, "twins")
    tokenfile.write(docs, path, JSON)
    same(tokenfile.summary(spark, path), plain.token_files(rows), "doc_id", "start", "n_tokens", "ids_crc32")
    same(jaccard.classes(docs), plain.classes(rows, 3, 90, 100), "doc_id", "n_shingles", "component_id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    same(leaks.report(docs, bench), plain.leaks(rows, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    same(repeats.remove(docs), plain.repeats(rows), "doc_id", "n_words", "n_removed", "kept_sha256")


def test_very_long_texts(spark):
    """Texts beyond every block, slice and shard; one of them a single word."""
    rng = random.Random(9)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(450_000)]
    long_ = " ".join(words)
    assert len(long_) > 2 << 20
    rows = [(1, long_), (2, f"new {long_}"), (3, "z" * 3_000_000), (4, " ".join(words[1000:1040])), (5, "short text"), (6, None), (7, "")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), [(1, " ".join(words[200_000:260_000])), (2, "short")]
    same(bpe.digests(docs, RANKS), plain.codec(rows), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    same(jaccard.classes(docs), plain.classes(rows, 3, 90, 100), "doc_id", "n_shingles", "component_id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = leaks.report(docs, bench)
    same(found, plain.leaks(rows, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert dict(got(found, "doc_id", "longest"))[2] == 60_000
    same(repeats.remove(docs), plain.repeats(rows), "doc_id", "n_words", "n_removed", "kept_sha256")
    private = [(1, ("mail a.b@c.de, 10.0.0.1 and " * 3000)), (2, "1" * 3000), (3, "+" * 3000)]
    same(pii.report(spark.createDataFrame(private, "doc_id long, text string")), plain.private_report(private), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def test_token_files_hold_runs_indexes_and_filters(spark, tmp_path):
    """The stripes' footers: run-length encoded ids, row indexes, a Bloom filter on the document id; lookups skip."""
    rng = random.Random(1)
    docs = spark.createDataFrame([(7 * i, sentence(rng, "en", 5)) for i in range(9000)], "doc_id long, text string").coalesce(1)
    path = shared.fresh(spark, "orc")
    tokenfile.write(docs, path, JSON)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = [f.getPath() for f in where.getFileSystem(conf).listStatus(where) if f.getPath().getName().endswith(".orc")]
    filters = runs = 0
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(f, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 2000
        rows = reader.rows()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            kinds = [(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()]
            filters += (1, "BLOOM_FILTER_UTF8") in kinds
            assert (1, "ROW_INDEX") in kinds
            runs += footer.getColumns(6).getKind().toString() == "DIRECT_V2"
    assert filters == runs >= len(files) >= 1
    assert [r.doc_id for r in tokenfile.lookup(spark, path, [700, 701]).collect()] == [700]
    plan = tokenfile.lookup(spark, path, [700])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id, [700])]" in plan or "EqualTo(doc_id,700)" in plan


def test_language(docs, odd, none, rows):
    found = langid.held_out_prediction(docs)
    by_id = {r.doc_id: r for r in found.collect()}
    truth = {r[0]: r[2] for r in rows if r[2] and 20 <= r[0] < 90 and len(r[1]) > 60}
    held = [d for d in truth if by_id[d].held_out]
    assert len(held) > 5 and sum(by_id[d].lang_pred == truth[d] for d in held) >= 0.9 * len(held)
    assert all(by_id[d].lang_pred == "und" and by_id[d].score == 0 for d in (10, 11, 12, 13))
    assert all(0 <= r.score <= 1 for r in by_id.values())
    assert langid.held_out_prediction(odd[0]).count() == len(odd[1]) and langid.held_out_prediction(none).count() == 0
    kept = {r.doc_id for r in langid.accepted(docs).collect()}
    assert set(truth) <= kept and not kept & {10, 11, 12, 13}
    assert langid.accepted(docs).columns == docs.columns


def test_quality(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        good, rude = i % 4 > 0, i % 7 == 0
        text = sentence(rng, "en", 40) if good else " ".join(["BUY!!"] * 20)
        rows.append((i, text + (" nastyword " if rude else " ") + "end", f"s{i % 5}", "en"))
        if i < 400:
            labels.append((i, int(good), int(rude)))
    rows += [(600, None, "s1", None), (601, "", None, None)]
    labels += [(9999, 1, 0), (None, 1, 1), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.posteriors(docs, known).collect()}
    assert len(found) == 602
    held = range(400, 600)
    assert sum((found[i].quality > 0.5) == (i % 4 > 0) for i in held) > 195 and sum((found[i].toxicity > 0.5) == (i % 7 == 0) for i in held) > 195
    assert sum(found[i].keep == (i % 4 > 0 and i % 7 != 0) for i in held) > 190
    assert quality.posteriors(docs.limit(0), known).count() == 0
    assert quality.posteriors(docs, known.limit(0)).count() == 602


def test_pseudo_likelihood(spark, docs, none, rows):
    rng = random.Random(6)
    texts = [(i, sentence(rng, "en", 80)) for i in range(150)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    model = pll.train(table)
    shuffled = [(i, "zq xv " * 40) for i in range(20)]
    mean = lambda df: df.agg(F.avg("mean_log_likelihood")).first()[0]
    own, other = mean(pll.scores(table, model)), mean(pll.scores(spark.createDataFrame(shuffled, "doc_id long, text string"), model))
    assert own > other and own > -math.log(1024)
    found = {r.doc_id: r for r in pll.scores(docs).collect()}
    assert len(found) == len(rows) and found[10].n_tokens == 0 and found[10].mean_log_likelihood is None and found[10].log_likelihood == 0
    assert pll.scores(none).count() == 0


def test_pseudo_likelihood_gradient():
    rng = np.random.default_rng(0)
    tokens, around = rng.integers(0, 1024, 300), rng.integers(0, 1025, (300, 4))
    network = pll.Network(pll.start())
    _, slope = network.run(tokens, around, gradient=True)
    for i in rng.choice(np.flatnonzero(np.abs(slope) > 0.5), 10, replace=False):
        ends = []
        for step in (1e-2, -1e-2):
            moved = network.flat.copy()
            moved[i] += step
            ends.append(pll.Network(moved).run(tokens, around).astype(np.float64).sum())
        assert abs((ends[0] - ends[1]) / 2e-2 - slope[i]) < 0.05 * max(1, abs(slope[i]))
    scores = [network.run(np.full(1, t), around[:1])[0] for t in range(1024)]
    assert abs(np.exp(scores).sum() - 1) < 1e-3


def plain_likelihood(model, text):
    """A text's score word by word, straight from the definition."""
    import re

    import pyarrow as pa

    p = pll.unpack(model.flat.astype(np.float64))
    place = {int(k): i for i, k in enumerate(model.words)}
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain.lower(text))
    keys = [int(pll._keys(next(pll._blocks(pa.array([w]))))[0]) for w in words]
    near = [place[k] if place.get(k, pll.WORDS) < pll.WORDS else pll.WORDS + (k & 127) for k in keys]
    padded = [pll.PADDING] * 2 + near + [pll.PADDING] * 2
    total = 0.0
    for i, (word, key) in enumerate(zip(words, keys, strict=True)):
        token = near[i] if key in place else pll.SPELLED
        x = np.concatenate([p["embed"][padded[i + 2 + j]] for j in (-2, -1, 1, 2)])
        hidden = np.tanh(x @ p["inner"] + p["bias"])
        c, m = divmod(token, 32)
        for weights, bias, at in ((p["classes"], p["class_bias"], c), (p["members"][c], p["member_bias"][c], m)):
            logits = weights @ hidden + bias
            total += logits[at] - np.log(np.exp(logits).sum())
        if key not in place:
            chain = [0, *(b + 1 for b in word.encode()), 0]
            total += sum(model.spelling[257 * a + b] for a, b in zip(chain, chain[1:], strict=False))
        elif place[key] >= pll.WORDS:
            total += model.share[place[key] - pll.WORDS]
    return len(words), total


def test_pseudo_likelihood_word_by_word(spark, docs, odd, rows):
    """Every kind of word against the plain loop; rows with null ids, repeated rows and clashing columns."""
    many = [(1000 + i, " ".join(f"w{j}" for j in range(i, 1500, 7))) for i in range(14)]
    table = spark.createDataFrame([*pairs(rows), *many], "doc_id long, text string")
    model = pll.train(table)
    assert len(model.words) > pll.WORDS and abs(np.exp(model.share).sum() - len({int(k) & 127 for k in model.words[pll.WORDS :]})) < 1e-6
    for frame, given in ((table, [*pairs(rows), *many]), odd):
        clashing = frame.withColumn("n_tokens", F.lit("x")).withColumn("word", F.lit(1)).withColumn("h", F.lit(2))
        found = got(pll.scores(clashing, model), "doc_id", "n_tokens", "log_likelihood")
        expected = sorted(((d, *plain_likelihood(model, t)) for d, t in given), key=lambda r: repr(r[:2]))
        for (d, n, score), (e, m, other) in zip(sorted(found, key=lambda r: repr(r[:2])), expected, strict=True):
            assert (d, n) == (e, m)
        assert np.allclose(sorted(r[2] for r in found), sorted(r[2] for r in expected), rtol=1e-4, atol=1e-2)
    assert abs(np.exp(model.spelling.reshape(257, 257)).sum(1) - 1).max() < 1e-9


def test_pseudo_likelihood_does_not_depend_on_the_split(spark, monkeypatch):
    monkeypatch.setattr(pll, "SHARD_DOCS", 20)
    rng = random.Random(8)
    texts = [(i if i % 9 else None, sentence(rng, rng.choice(list(LANGS)), 40)) for i in range(120)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    one, many = (got(pll.scores(table.repartition(n, "text")), "doc_id", "log_likelihood") for n in (1, 7))
    assert one == many


def test_pseudo_likelihood_knows_words_counted_twice(spark):
    """A text that occurs twice is likelier than its like that occurs once."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    texts = [(i, " ".join(word() for _ in range(60))) for i in range(60)]
    found = {r.doc_id: r.mean_log_likelihood for r in pll.scores(spark.createDataFrame([*texts, *((100 + i, t) for i, t in texts[:6])], "doc_id long, text string")).collect()}
    assert min(found[i] for i in range(6)) > max(found[i] for i in range(6, 60))


def test_unlearned_scripts_are_not_accepted(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, lang, 60), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    other = ["".join(chr(rng.randrange(0x10D0, 0x10F0)) if rng.random() > 0.15 else " " for _ in range(300)) for _ in range(60)]
    rows += [(100 + i, text, None) for i, text in enumerate(other)] + [(200, "the water", None), (201, "der fluss", None)]
    kept = {r.doc_id for r in langid.accepted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == {*range(60), 200, 201}
