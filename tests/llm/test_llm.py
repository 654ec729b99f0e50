"""The ten operators against plain versions, on small tables with nulls, empty, very long, tied and repeated rows."""

import base64
import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strata.llm import bpe, compression, fast_ids, langid, ngram_join, packing, quality, queries, secrets, shingles, token_store, topk, url_filter
from strata.llm.common import held_out

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, ids string"


def docs(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", ["en"] * len(texts))[i], columns.get("source", ["s"] * len(texts))[i], None, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"wörd{i % 977}x{i}" for i in range(30_000)) + "z" * 5000
    return ["", None, "Hello, World! It's <|endoftext|> 42", "  \n\t ", long, "same", "same", "ﬁ ÀÉ Σ İ 中文 🙂 \x1c\x85"]


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("library", [False, True])
def test_encoder_equals_the_library(path, library):
    theirs, ours = Tokenizer.from_file(path), bpe.Bpe(path, 1000, library)
    theirs.no_padding()
    theirs.no_truncation()

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.sampled_from("abcdeE  \n\t'sΣσİßéèЖ中文123.,!<|endoftext|>\x1c ́é🙂ﬁ\xa0\x85K²½"), max_size=60))
    def check(text):
        ids = theirs.encode(text, add_special_tokens=False).ids
        coded = ours.encode(text)
        assert np.frombuffer(coded, "<u4").tolist() == ids
        assert ours.decode(coded) == theirs.decode(ids, skip_special_tokens=False)

    check()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_fast_ids_equal_the_library(path):
    theirs, ours = Tokenizer.from_file(path), fast_ids.FastIds(path)

    def check(texts):
        want = [x.ids for x in theirs.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in ours.encode(texts)] == want

    # every entry is what its own bytes merge to, as the module's argument needs
    assert all(ours.coder._encode_single_piece(entry) == [rank] for entry, rank in ours.ranks.items())
    chars = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x12000), *range(0x1D000, 0x1FB00))]
    for i in range(0, len(chars), 5000):
        check([f"a{c}b 1{c}2!{c}{c} {c} x {c}  e{c}\n{c}s'{c}" for c in chars[i : i + 5000]])
    rng = random.Random(4)
    pieces = [" ", "  ", "\n", "'s", "'LL", "<|", "<|endoftext|>", "\0", "\x1c", "\x85", "\u2028", "\u0301", "\u0345", "Σ", "İ", "ﬁ", "가", "中", "🙂", "é", "٣", "²", "the", "Word", "x" * 700, "12", "...", "\u1DF8", "\U00011F42"]
    check(["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(4000)])


def test_codec_over_a_table(spark, odd):
    theirs = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs(spark, odd), WORD), WORD).collect()}
    for i, t in enumerate(odd):
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == ids and got[i].text == theirs.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs(spark, []), WORD).count() == 0


@pytest.mark.parametrize(
    ("url", "parts", "rule"),
    [
        (None, ("", ""), None),
        ("no scheme", ("", ""), None),
        ("http://A.Example.ORG/es/1?x#y", ("a.example.org", "/es/1"), ("example.org/es/", "block")),
        ("http://example.org/en/12", ("example.org", "/en/12"), ("example.org/en/1", "block")),
        ("http://example.org/en/2", ("example.org", "/en/2"), ("org/", "allow")),
        ("https://notexample.org?q=/de/", ("notexample.org", ""), None),
        ("https://x.com/de/#/fr/", ("x.com", "/de/"), ("com/de/", "block")),
        ("https://x.com/fr", ("x.com", "/fr"), None),
        ("a://b?c://d/e", ("b", ""), None),
    ],
)
def test_url_parts_and_rules(url, parts, rule):
    assert url_filter.split_url(url) == parts
    assert url_filter.matched(*parts, url_filter.index(url_filter.RULES)) == rule


def test_url_ratio_tells_kinds_apart(spark):
    good = [f"http://news{i}.org/reading/{i}" for i in range(120)]
    bad = [f"http://casino{i}.com/de/win/{i}" for i in range(120)]
    unknown = ["http://news7.net/reading/3", "http://casino7.net/win/3", None]
    pages = spark.createDataFrame(list(enumerate(good + bad + unknown)), "page_id long, url string").withColumn("score", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == 243 and (got[240].verdict, got[241].verdict) == ("allow", "block") and got[240].rule is None
    assert {got[i].verdict for i in range(120)} == {"allow"} and {got[i].verdict for i in range(120, 240)} == {"block"}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_model_counts_every_ngram(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789-_"
    word = lambda: "".join(rng.choices(letters, k=40))
    urls = [f"http://{word()}.org/{word()}" for _ in range(600)] + [f"http://{word()}.com/de/{word()}" for _ in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    parsed = url_filter.parsed(pages)
    model = url_filter.train(parsed)
    want: dict[int, list[int]] = {}
    text = {r.page_id: (r.host + r.path, r.ruled == "block") for r in parsed.where("ruled is not null").collect() if zlib.crc32(str(r.page_id).encode()) % 4 != 2}
    plain = collections.Counter((blocked, k, ("\0" * 4 + t)[i + 4 - k : i + 5]) for t, blocked in text.values() for i in range(len(t)) for k in range(5))
    for (blocked, k, g), n in plain.items():
        key = (2 * k + 1 << 40) + ord(g[-1]) + sum(ord(c) << 8 * (k - i) for i, c in enumerate(g[:-1]))
        want.setdefault(key, [0, 0])[blocked] = n
    got = {r.key: [r.allowed, r.blocked] for r in model.counts.collect() if r.key >> 40 & 1}
    assert got == want and sum(k >> 40 == 9 for k in got) > 1 << 15
    for r in url_filter.scored(parsed.limit(3), model, []).collect():
        t, total = r.host + r.path, 0.0
        for i in range(len(t)):
            logs = []
            for blocked in (False, True):
                p = 1 / 256
                for k in range(5):
                    g = ("\0" * 4 + t)[i + 4 - k : i + 5]
                    context = sum(plain[blocked, k, g[:-1] + c] for c in letters + "./")
                    p = (plain[blocked, k, g] + 2 * p) / (context + 2)
                logs.append(math.log(p))
            total += logs[0] - logs[1]
        assert abs(r.score - total / len(t)) < 1e-9


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(0, 1, 16)]) for i in range(300)]
    vectors += [(i, vectors[7][1]) for i in range(300, 340)] + [(340, None), (341, [float("nan")] * 16), (342, [None] * 16), (None, [1.0] * 16), (343, [float("inf")] * 16), (20, vectors[20][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ints = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors[:340]}
    assert set(got) == {i for i in ints if i % 20 == 0}
    for q, rows in got.items():
        want = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:20]
        assert rows == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert [r.vec_id for r in topk.top_k(df.where("vec_id in (1, 20)"), F.col("vec_id") % 20 == 0).collect()] == [1]


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = {w for w, n in collections.Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in many for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_base_counts_equal_plain_ones(spark):
    r = random.Random(2)
    texts = ["", None, "a b c", "x\n\nx\n \nx", "\x1c \u2003 é|#"] + [r.choice([" ", "\n"]).join(r.choice(["aa", "b", "C#", "ö$", "dd"]) for _ in range(r.randint(1, 120))) for _ in range(60)]
    texts += [" ".join(f"w{i % 9}" for i in range(200))]
    got = {x.doc_id: x for x in compression.quality_rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = slow_counts(t or "")
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == n
        assert x.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (x.base_failed and x.kept)


def test_bands_reject_noise_and_repetition(spark):
    r = random.Random(3)
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "en", "io", "urs", "eth")]
    prose = " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(3000))
    noise = " ".join(base64.b64encode(r.randbytes(9)).decode() for _ in range(700))
    texts = [prose, "buy now cheap pills here " * 400, prose[:400], noise, prose + " " + noise * 3]
    got = {x.doc_id: x.kept for x in compression.quality_rules(docs(spark, texts)).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: False}


def slow_join(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def families(seed, n=90):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randint(0, 4000)
    common = [word() for _ in range(40)]
    bases = [[word() for _ in range(r.choice([3, 8, 40, 120]))] for _ in range(8)]
    out = []
    for _ in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            w = common + w
        text = " ".join(w)
        out.append(text.upper() if r.random() < 0.1 else text)
    return out + ["", None, " \n", "one two", "ONE  two", "é É"]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_all_pairs(spark, seed):
    texts = families(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs(spark, texts)).collect()}
    assert got == slow_join(texts)


def test_join_keeps_one_and_takes_empty_tables(spark):
    texts = families(5, 40)
    kept = ngram_join.keep_one(docs(spark, texts))
    assert kept.columns == docs(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in slow_join(texts).items() if c == i}
    assert ngram_join.jaccard_join(docs(spark, [])).count() == 0


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y") for i, t in rows], DOCS)


def test_join_judges_repeated_ids_by_their_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(rows_of(spark, [(1, a), (1, b), (2, b + " bx"), (3, c)])).collect())
    assert got == [(1, 26, 1), (1, 26, 1), (2, 27, 1), (3, 26, 3)]
    kept = ngram_join.keep_one(rows_of(spark, [(1, a), (1, b), (2, b), (3, a), (4, c), (3, c)])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (1, b), (3, c)]
    kept = ngram_join.keep_one(rows_of(spark, [(7, a)] * 3 + [(None, b)] * 2 + [(None, a), (9, ""), (9, ""), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (0, b), (7, a), (9, ""), (9, "")]


def test_join_of_hot_classes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_CLASS", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    monkeypatch.setattr(ngram_join, "LOCAL_EDGES", 0)
    texts = families(3, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs(spark, texts)).collect()}
    assert got == slow_join(texts)


def test_join_takes_very_long_texts(spark):
    long = " ".join(f"w{i % 70_001}" for i in range(120_000))
    texts = [long, long + " end", "short text of five words", long[: len(long) // 2]]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs(spark, texts)).collect()} == slow_join(texts)


def test_hot_shingles_lose_no_link(spark, monkeypatch):
    texts = families(7, 60)
    real = ngram_join.prefixes
    monkeypatch.setattr(ngram_join, "prefixes", lambda d, c, hot: real(d, c, 2))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs(spark, texts)).collect()}
    assert got == slow_join(texts)


@pytest.mark.parametrize("n", range(7))
def test_short_texts_hash_alone_as_among_others(n):
    text = " ".join("abcdef"[:n])
    owner, key, sizes = shingles.shingle_sets([text])
    among = shingles.shingle_sets(["some other words " * 4, text, "and more of them after it"])
    assert key.tolist() == among[1][among[0] == 1].tolist() and sizes.tolist() == [min(n, 1) if n < 5 else n - 4]


def ids_of(path, text, end):
    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 1, "c": 1}])
def test_packing_holds_every_id_once(spark, odd, weights):
    texts = odd + ["more text of source b " * 300] * 3
    source = ["a", "b", None, "a", "a", "b", "b", "c", "b", "b", "b"]
    rows = packing.pack(docs(spark, texts, source=source), WORD, 1, weights).collect()
    of = {i: ids_of(WORD, t, 1) for i, t in enumerate(texts)}
    cells, total = set(), sum(map(len, of.values()))
    for i, ids in of.items():
        at = 0
        for p in sorted((p for p in rows if p.doc_id == i), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length]) and p.offset + p.length <= 2048
            at += p.length
            cells.update((p.sequence_id, p.offset + k) for k in range(p.length))
        assert at == len(ids)
    assert cells == {divmod(k, 2048) for k in range(total)}
    assert packing.pack(docs(spark, []), WORD, 1).count() == 0


def held(spark, sizes, weights=None):
    """Ids of each source in each window, from pieces of ranges cut anywhere; each place is filled once."""
    served = packing.phases(sizes, weights) if weights else [(0, q, 0, n) for q, n in sizes.items()]
    rows = packing.lanes(spark.createDataFrame(served, "phase int, queue string, first long, size long")).collect()
    total, rng = sum(sizes.values()), random.Random(1)
    out, filled = {q: np.zeros(-(-total // 2048), int) for q in sizes}, np.zeros(total, int)
    for r in rows:
        edges = np.array(sorted({0, r.size, *(rng.randrange(r.size + 1) for _ in range(20))}))
        zero = np.zeros(len(edges) - 1, int)
        _, first, length, sequence, offset = packing.Lanes([r.turns], [r.share], [r.second]).cut(zero, edges[:-1], edges[1:], zero + r.shift, zero + r.total)
        assert length.sum() == r.size and sorted(first)[0] == 0
        np.add.at(out[r.queue], sequence, length)
        for w, o, n in zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True):
            filled[w * 2048 + o : w * 2048 + o + n] += 1
    assert (filled == 1).all()
    return np.array([out[q] for q in sizes]), max(len(r.turns) for r in rows)


@pytest.mark.parametrize(
    ("sizes", "apart"),
    [
        ({"a": 100_000, "b": 300_001, "c": 600_007}, 0.002),
        ({f"s{i}": 20_011 for i in range(20)}, 0.01),
        ({"hot": 400_000, **{f"s{i}": 20_000 + i for i in range(19)}}, 0.01),
        ({f"s{i}": 700 for i in range(1100)}, 0.2),  # 1.9 ids each: whole ids can't come closer than about 0.12
        ({"hot": 500_000, **{f"s{i}": 1 + i * i % 2999 for i in range(500)}}, 0.2),
        ({"one": 5}, 0),
    ],
)
def test_each_window_holds_the_target_shares(spark, sizes, apart):
    windows, levels = held(spark, sizes)
    share = np.array(list(sizes.values()))[:, None] / sum(sizes.values()) * 2048
    assert (windows.sum(0)[:-1] == 2048).all()
    off = np.abs(windows[:, :-1] - share)
    assert (off.max(initial=0) < max(1, levels)) and (off.sum(0) / 2048).max(initial=0) <= apart


def test_given_weights_hold_until_a_source_runs_dry(spark):
    windows, _ = held(spark, {"a": 300_000, "b": 100_000, "c": 20_000}, {"a": 3, "b": 1, "c": 1})
    upto = 100_000 // 2048 - 1  # c, of a fifth, runs dry after 100,000 ids
    assert np.abs(windows[:, :upto] - 2048 * np.array([[0.6], [0.2], [0.2]])).max() <= 3
    after = windows[:, upto + 3 : 400_000 // 2048 - 1]
    assert np.abs(after - 2048 * np.array([[0.75], [0.25], [0]])).max() <= 3
    with pytest.raises(ValueError, match="whole numbers"):
        packing.phases({"a": 5}, {"a": 0})


def test_shares_of_huge_corpora_are_exact():
    n = np.array([10**13] * 4)
    p, a = np.array([1, 7, 10**13 // 3, 10**13 - 1]), np.array([10**13 // 7, 3, 10**13 - 1, 10**12])
    assert packing.times(p, a, n).tolist() == [int(x) * int(y) // 10**13 for x, y in zip(p, a, strict=True)]
    assert packing.times(a[2:], n[2:], p[2:], 1).tolist() == [(int(y) * 10**13 - 1) // int(x) for x, y in zip(p[2:], a[2:], strict=True)]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_store_gives_back_what_went_in(spark, odd, tmp_path, encoding):
    token_store.write_store(docs(spark, odd), f"{tmp_path}/s", BYTE, 2, encoding=encoding)
    got = {r.doc_id: r for r in token_store.digests(token_store.read_store(spark, f"{tmp_path}/s")).collect()}
    before = 0
    for i, t in enumerate(odd):
        ids = ids_of(BYTE, t, 2)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (before, len(ids), crc(ids))
        before += len(ids)


def test_empty_store(spark, tmp_path):
    token_store.write_store(docs(spark, []), f"{tmp_path}/e", BYTE, 2)
    assert token_store.digests(token_store.read_store(spark, f"{tmp_path}/e")).count() == 0


def test_base_secrets_follow_the_patterns():
    key = "AKIA" + "ABCDEFGH12345678"
    text = f"éé password=abc12 PassWord: 'abcdef' token={key} {key[:19]} deadbeefdeadbeefdeadbeef password=token:abcdefgh"
    plain, _ = secrets.scan(text)
    want = []
    for kind, pattern, ok in (
        (0, re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        (1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (2, re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ):
        want += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if ok(m)]
    assert plain == sorted(want) and len(plain) == 4


def test_weak_parts_need_each_other(spark):
    weak = "Zm9vYmFyQmF6UXV4MTIzNDU2Nzg5MEFCQ0RFRkdI"
    alone, both, far = f"see {weak} here", f"user: alice99 key {weak} at https://db.example.com/x", f"user: alice99 {'word ' * 200}{weak}"
    assert [secrets.written_out(secrets.scan(t)[1]) for t in (alone, far)] == ["", ""]
    kinds = [secrets.KINDS[k] for _, k, _ in secrets.scan(both)[1]]
    assert kinds == ["identifier", "secret", "endpoint"]
    d = secrets.redact(docs(spark, [both, None, "clean text"])).orderBy("doc_id").collect()
    assert weak not in d[0].text and "https://db" in d[0].text and d[1].text is None and d[2].text == "clean text"
    got = secrets.scan_documents(docs(spark, ["", None, "password=hunter22"])).orderBy("doc_id").collect()
    assert [(r.n_assign, r.spans) for r in got] == [(0, ""), (0, ""), (1, "assign:0:17")]


def sf(name):
    return f"/root/testdata/{name}"


def test_quality_on_held_out_rows(spark):
    d = queries.op9_quality_attention(spark, sf("sf0.01"))
    labels = spark.read.parquet(sf("sf0.01") + "/labels.parquet")
    rows = d.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    assert np.mean([a > b for a in good for b in bad]) > 0.97


def test_quality_without_labels(spark):
    d = docs(spark, ["some text", "", None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(d, none) == 0.5
    one = spark.createDataFrame([(0, 1), (1, None), (2, 7)], "doc_id long, quality int")
    assert quality.train(d, one) == 1.0
    assert [r.score for r in quality.score_documents(d, 0.5).collect()] == [0.5] * 3


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(7, 5)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    m = quality.fit(x, first, y, hidden=4, gate=3, epochs=1)
    loss = lambda: -np.mean(y * np.log(m.score(x, first)) + (1 - y) * np.log(1 - m.score(x, first)))
    grads = m.gradients(x, first, y)
    for name in ("w", "v", "u", "a", "c"):
        value = getattr(m, name)
        at = (0,) * value.ndim
        old = value[at]
        value[at] = old + 1e-6
        up = loss()
        value[at] = old - 1e-6
        down = loss()
        value[at] = old
        assert math.isclose((up - down) / 2e-6, grads[name][at], abs_tol=1e-6)


def test_language_on_held_out_rows(spark):
    d = queries.op10_string_kernel_language(spark, sf("sf0.01"))
    truth = spark.read.parquet(sf("sf0.01") + "/documents.parquet").select("doc_id", "lang")
    rows = d.where("held_out").join(truth, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98


def test_language_of_odd_texts(spark):
    texts = ["the quick brown fox jumps over the lazy dog"] * 8 + ["der schnelle braune fuchs springt über den faulen hund"] * 8 + [None, "", "123 !!"]
    d = docs(spark, texts, lang=["en"] * 8 + ["de"] * 8 + [None, "en", "fr"])
    model = langid.train(d)
    got = [r.lang_pred for r in langid.identify(d, model).orderBy("doc_id").collect()]
    assert got == ["en"] * 8 + ["de"] * 8 + ["und"] * 3
    assert langid.train(d.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(d, None).collect()} == {"und"}
    assert langid.keep_identified(d, model).count() == 16 and langid.keep_identified(d, None).count() == 16


def test_texts_in_no_learned_language_are_rejected(spark):
    d = spark.read.parquet(sf("sf0.01") + "/documents.parquet")
    model, rng = langid.train(d), random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    odd = ["我们今天去公园散步然后回家吃饭", "Сегодня мы пошли гулять в парк, а потом вернулись домой", "Σήμερα πήγαμε βόλτα στο πάρκο", "ذهبنا اليوم إلى الحديقة للتنزه"]
    odd += [base64.b64encode(rng.randbytes(k)).decode() for k in (60, 4000)] + ["".join(rng.choices(letters, k=k)) for k in (80, 4000)]
    odd += [" ".join("".join(rng.choices(letters, k=7)) for _ in range(400))]
    assert langid.keep_identified(docs(spark, odd), model).count() == 0
    clean = ["the weather is nice today", "das wetter ist heute schön", "il fait beau aujourd'hui dans la ville", "hoy hace buen tiempo en la ciudad"]
    assert langid.keep_identified(docs(spark, clean), model).count() == len(clean)
    rows = d.where(held_out() & F.col("text").rlike("[a-z]{3}"))
    assert langid.keep_identified(rows, model).count() >= 0.99 * rows.count()


def test_pipeline_equals_its_parts(spark):
    import corpus_pipeline

    where = sf("sf0.001")
    given_docs = spark.read.parquet(where + "/documents.parquet")
    at, sizes = given_docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, where)
        assert after.columns == given_docs.columns, name
        at = after.cache()
        sizes.append(at.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0
    texts = {r.doc_id: r.text for r in at.collect()}
    joined = slow_join([texts.get(i) for i in range(max(texts) + 1)])
    assert all(joined[i][1] == i for i in texts)
    assert not any(secrets.scan(t)[0] for t in texts.values())
    rows = corpus_pipeline.run(spark, where).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert {r.doc_id: sum(p.length for p in rows if p.doc_id == r.doc_id) for r in rows} == {i: len(ids_of(WORD, t, 1)) for i, t in texts.items()}
