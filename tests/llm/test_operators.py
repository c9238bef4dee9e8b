"""The operators against brute force, on small tables with nulls, empty and long texts, ties,
repeated rows, no rows at all, and extra columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lattica.llm import decontaminate, fingerprint, language, license_scan, ngram_join, packing, quality, sharding, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, comp long, token string"


def table(spark, rows):
    rows = [(i, t, lang, "s", len(t or ""), 0.5, 7, "x") for i, t, lang in rows]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    base = [prose(rng, rng.randint(1, 120), words) for _ in range(60)]
    out = [(i, t, "en") for i, t in enumerate(base)]
    out += [(100 + i, t, "en") for i, t in enumerate(base[:10])]  # exact copies
    for i, t in enumerate(base[:30]):  # near copies
        w = t.split()
        w[rng.randrange(len(w))] = "zzz"
        out.append((200 + i, " ".join(w), "en"))
    out += [(300, None, None), (301, "", "en"), (302, "  \n ", None), (303, "12 34", "en"), (304, prose(rng, 30_000, words), "en"), (305, "one", "en")]
    out += [(305, "one", "en"), (None, base[3], "en"), (306, "\u00c9cole  \u212bB \ufb01n", "fr")]
    return out


def components(rows):
    sets, ids = {}, [r[0] for r in rows if r[0] is not None]
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        sets.setdefault(i, []).append(s)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    known = sorted(set(ids))
    for n, a in enumerate(known):
        for b in known[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in known}, sets


def test_ngram_join(spark, rows):
    want, sets = components(rows)
    got = ngram_join.groups(table(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _, _ in rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


def test_ngram_join_keeps_one_of_each_group(spark, rows):
    docs = table(spark, rows)
    want, _ = components(rows)
    got = ngram_join.keep_one(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for c in want.values()})
    assert ids.count(None) == 1


def test_ngram_join_keeps_one_beside_clashing_columns(spark, rows):
    docs = table(spark, rows).withColumnsRenamed({"comp": "_GONE", "token": "_twice", "score": "component_id"})
    got = ngram_join.keep_one(docs)
    assert got.columns == docs.columns
    assert got.count() == len(set(components(rows)[0].values())) + 1
    with pytest.raises(TypeError, match="integer"):
        ngram_join.groups(docs.withColumn("doc_id", docs["doc_id"].cast("string")))


def test_components_of_a_long_chain_and_a_large_star(spark):
    from lattica.llm.components import components as connected

    rng = random.Random(13)
    names = list(range(3000))
    rng.shuffle(names)
    chain = list(zip(names[:300], names[1:301], strict=True))
    star = [(names[301], x) for x in names[302:2000]]
    got = {r.id: r.component for r in connected(spark.createDataFrame([*chain, *star, (5000, 5000)], "a long, b long")).collect()}
    assert got == {x: min(part) for part in (names[:301], names[301:2000]) for x in part}


def test_bitmaps_never_rule_out_a_link():
    rng = random.Random(5)
    for _ in range(300):
        x = {rng.getrandbits(64) for _ in range(rng.randint(1, 400))}
        y = set(rng.sample(sorted(x), max(1, int(len(x) * rng.uniform(0.7, 1))))) | {rng.getrandbits(64) for _ in range(rng.randint(0, len(x) // 4 + 1))}
        a, b = (ngram_join.np.array(sorted(s), ngram_join.np.uint64) for s in (x, y))
        truth = 100 * len(x & y) >= 80 * len(x | y)
        assert ngram_join.links(a, b) == truth
        if truth:
            levels = ngram_join.np.array([rng.randrange(4) for _ in range(1 << 10)], ngram_join.np.uint8).repeat(1 << 14)
            for o in (0, *ngram_join.FURTHER):  # partners share a prefix token under every order
                prefix = lambda s, o=o: ngram_join.ranks(s, levels, o)[: ngram_join.prefix_size(len(s))]
                assert set(prefix(a).tolist()) & set(prefix(b).tolist())
            assert ngram_join.may_link(len(a), ngram_join.bitmap(a), len(b), ngram_join.bitmap(b))


def test_parities_never_rule_out_a_link_and_drop_near_misses():
    """Sets of 800 tokens of which 632 are shared: likeness 0.65. A bitmap of 1,024 bits let them pass."""
    np = ngram_join.np
    rng = np.random.default_rng(7)
    differ = lambda x, y: sum((a ^ b).bit_count() for a, b in zip(*([v & (1 << 64) - 1 for v in ngram_join.signature(s)] for s in (x, y)), strict=True))
    dropped = 0
    for k in range(300):
        n = 800 if k < 100 else int(rng.integers(1, 3000))
        t = np.unique(rng.integers(0, 1 << 63, 2 * n + 10).astype(np.uint64))
        rng.shuffle(t)
        shift = 168 if k < 100 else int(rng.integers(0, max(1, n // 5)))
        x, y = np.sort(t[:n]), np.sort(t[shift : n + shift])
        assert differ(x, y) <= len(np.setxor1d(x, y))
        passes = len(x) + len(y) - differ(x, y) >= 2 * -(-80 * (len(x) + len(y)) // 180)
        assert passes or not ngram_join.links(x, y)
        dropped += k < 100 and not passes
    assert dropped >= 90


def test_near_misses_do_not_leave_the_pair_join(spark):
    """A family of near misses: a pair of every two shares prefix tokens, none links."""
    rng = random.Random(23)
    base = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(1000)]
    texts = []
    for i in range(60):
        w = list(base)
        for j in rng.sample(range(0, 1000, 10), 26):
            w[j] = f"own{i}x{j}"
        texts.append(" ".join(w))
    docs = table(spark, [(i, t, "en") for i, t in enumerate(texts)]).select("doc_id", "text", ngram_join.F.col("doc_id").alias("comp"))
    np = ngram_join.np
    sets = [ngram_join.shingles(t) for t in texts]
    cells = np.bincount((np.concatenate(sets) >> np.uint64(64 - ngram_join.CELL_BITS)).astype(np.int64), minlength=1 << ngram_join.CELL_BITS)
    levels = spark.sparkContext.broadcast(np.minimum(cells, 20).astype(np.uint8).tobytes())
    posted = ngram_join.staged(ngram_join.postings(docs, levels), "postings")
    got = ngram_join.candidates(ngram_join.shared_postings(posted.where("token is not null").drop("sig")), posted.where("token is null").select("doc_id", "sig"))
    assert not any(ngram_join.links(x, y) for n, x in enumerate(sets) for y in sets[n + 1 :])
    assert got.count() < 60 * 59 // 2 // 20


def test_cells_count_beyond_a_byte_in_a_byte_each():
    import tracemalloc

    np = ngram_join.np
    rng = np.random.default_rng(9)
    tokens = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    hot = np.repeat(tokens[:5], [255, 256, 300, 70_000, 1])
    tracemalloc.start()
    cells = ngram_join.Cells()
    for part in (tokens, hot, hot, tokens[:100]):
        cells.add(part)
    assert tracemalloc.get_traced_memory()[1] < 32 << 20  # four bytes a cell would take 64 MiB
    tracemalloc.stop()
    every = np.concatenate([tokens, hot, hot, tokens[:100]])
    want = np.bincount((every >> np.uint64(64 - ngram_join.CELL_BITS)).astype(np.int64), minlength=1 << ngram_join.CELL_BITS)
    got = np.zeros(1 << ngram_join.CELL_BITS, np.int64)
    for c, own in cells.chunks():
        got[c << ngram_join.CHUNK_BITS : (c + 1) << ngram_join.CHUNK_BITS] = own
    assert (got == want).all()


def test_components_leave_no_broadcast_tables(spark):
    import time

    from lattica.llm import common

    used = spark._jvm.org.apache.spark.SparkEnv.get().memoryManager().storageMemoryUsed
    common.sweep(spark)
    time.sleep(1)
    before = used()
    wide = common.staged(spark.range(300_000).selectExpr("id as a", "id + 1 as b"), "wide")
    edges = common.staged(spark.range(10).selectExpr("id as a").join(ngram_join.F.broadcast(wide), "a"), "edges")
    ngram_join.components(edges)
    for _ in range(20):
        time.sleep(0.5)
        if used() <= before + (1 << 20):
            break
    assert used() <= before + (1 << 20)


def test_packing_places_every_id_once(spark, rows):
    docs = table(spark, rows)
    path = packing.vocabulary_path()
    placed = packing.pack(docs, path).collect()
    encode = packing.tokens_of(path).tokenizer.encode
    want = sorted((i is None, i or 0, len(encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in rows)
    by_doc = defaultdict(list)
    for r in placed:
        by_doc[r.doc_id].append(r)
    assert {(i is None, i or 0) for i in by_doc} == {(a, b) for a, b, _ in want}
    assert sum(r.length for r in placed) == sum(n for _, _, n in want)
    one = next(t for i, t, _ in rows if i == 304)
    ids = [*encode(one, add_special_tokens=False).ids, 0]
    for k, r in enumerate(sorted(by_doc[304], key=lambda r: r.piece)):
        own = ids[2048 * k : 2048 * (k + 1)]
        assert (r.piece, r.start, r.length) == (k, 2048 * k, len(own))
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))
    sequences = defaultdict(list)
    for r in placed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.1 * sum(n for _, _, n in want) / 2048 + 2


def test_packing_reads_every_batch_row(spark):
    """More rows than one Arrow batch is cut into."""
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('word ', id) as text").coalesce(1)
    assert packing.pieces(docs, packing.vocabulary_path()).count() == 5000


def test_packing_plan_covers_the_histogram():
    rng = random.Random(1)
    hist = {rng.randint(1, 2048): rng.randint(1, 3000) for _ in range(600)}
    planned = packing.plan(hist)
    got = defaultdict(int)
    for lengths, times in planned:
        assert sum(lengths) <= 2048
        for n in lengths:
            got[n] += times
    assert dict(got) == hist
    # counts that hardly pair up, then a usual corpus
    least = lambda h: max(sum(n * c for n, c in h.items()) / 2048, sum(c for n, c in h.items() if n > 1024))
    assert sum(t for _, t in planned) <= 1.05 * least(hist) + 1
    usual = defaultdict(int)
    for _ in range(50_000):
        n = max(1, int(rng.lognormvariate(6.2, 1.0)))
        for k in range(0, n, 2048):
            usual[min(2048, n - k)] += 1
    assert sum(t for _, t in packing.plan(usual)) <= 1.001 * least(usual) + 1
    assert packing.plan({}) == []
    assert sum(t for _, t in packing.plan({1500: 10**9})) == 10**9


@pytest.mark.parametrize("hist", [{100: 1000}, {512: 1000}, {n: 1000 for n in range(20, 501)}, {682: 900, 683: 900, 300: 50}, {1000: 10, 900: 10, 7: 200}])
def test_packing_plan_fills_sequences_of_short_documents(hist):
    planned = packing.plan(hist)
    got = defaultdict(int)
    for lengths, times in planned:
        assert sum(lengths) <= 2048 and times > 0
        for n in lengths:
            got[n] += times
    assert dict(got) == hist
    assert sum(t for _, t in planned) <= 1.02 * sum(n * c for n, c in hist.items()) / 2048 + 1


def test_tokens_of_odd_words():
    tokens = packing.tokens_of(packing.vocabulary_path())
    for text in ["", " ", "a\nb\tc", "don't I'll x's", "A\u030angstr\u00f6m \u212b", "<|endoftext|> a<|endoftext|>", "12 3.5,", "x\x1cy", "\u65e5\u672c\u8a9e", "a## c_ e.'s", "\u0130 \u00df \u1e9e"]:
        got = packing.np.frombuffer(next(tokens.ids([text])), "<u4").tolist()
        assert got == [*tokens.tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_the_word_table_keeps_its_bound():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcDEF") for _ in range(9)) + rng.choice(["", ",", ".", "!?"])
    tokens = packing.WordTokens(packing.vocabulary_path(), 1)
    most = 0

    class Watched(packing.WordTokens):
        def learn(self, words):
            nonlocal most
            super().learn(words)
            most = max(most, len(self) + len(self.marks))

    watched = Watched(packing.vocabulary_path(), 1)
    assert watched.most == 3 * packing.SLICE + 1
    texts = [" ".join(word() for _ in range(n)) for n in (10, 0, 300, 2 * packing.SLICE + 5, 7, 20_000, 40)] + [None, "caf\u00e9 12 don't"]
    got = list(watched.ids(texts))
    assert most + sum(1 for w in set(" ".join(t or "" for t in texts).split()) if w not in watched) > watched.most  # it was emptied
    assert most <= watched.most and len(watched) + len(watched.marks) <= watched.most
    for text, ids in zip(texts, got, strict=True):
        assert ids == tokens.encoded(text or "") + b"\0\0\0\0"


def test_fingerprints(spark, rows):
    docs = [r for r in rows if r[0] is not None]
    order = sorted(((i, t or "") for i, t, _ in docs), key=lambda r: -r[0])
    want = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want[i] = (len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest())
    got = fingerprint.compare(table(spark, docs)).collect()
    assert len(got) == len(docs)
    by_text = defaultdict(set)
    for r in got:
        if r.doc_id != 305:  # repeated: its rows follow each other
            assert (r.n_chars, r.edited_sha256) == want[r.doc_id]
        by_text[dict(order)[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    single = {r.doc_id: r.fingerprint for r in fingerprint.fingerprint(table(spark, [(1, "\u00c9COLE  \u212bb \ufb01n", None), (2, "e\u0301cole \u00e5B\nfin ", None), (3, "ecole ab fin", None)])).collect()}
    assert single[1] == single[2] != single[3]


def test_decontamination(spark):
    item = [(1, "A b, c d e f g h i j"), (2, "c D e f g h i j k"), (3, "one two"), (4, None), (5, "..."), (1, "x y z x y z x y")]
    texts = ["", None, "a b c d e f g h", "zz a b c d e f g h i j k zz", "two one two one", "x y z x y z x y z x y", "a b c d e f g"]
    words = lambda t: "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in (t or "").lower()).split()
    for limit in (1000, 3):
        docs = table(spark, [(i, t, "en") for i, t in enumerate(texts)])
        bench = spark.createDataFrame(item, "item_id long, text string")
        got = {r.doc_id: r for r in decontaminate.report(docs, bench, limit).collect()}
        for i, t in enumerate(texts):
            w, hit, found = words(t), set(), set()
            for k, it in item:
                iw = words(it)
                for j in range(max(1, len(iw) - 7) if iw else 0):
                    win = iw[j : j + 8]
                    for p in range(len(w) - len(win) + 1):
                        if w[p : p + len(win)] == win:
                            hit |= set(range(p, p + len(win)))
                            found.add(str(k))
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (len(w), len(hit), len(found), len(found) >= 2)
            assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        kept = decontaminate.keep_clean(docs, bench, limit)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].contaminated}


def test_url_filter(spark):
    urls = [None, "", "example.net/en/", "http://EXAMPLE.net/en/x", "http://a.net/en/", "http://net/", "http://net", "http://xnet/", "https://a.example.com/de/1?q=/en/", "http://b.org/fr/#x", "http://b.org/x.net/", "http://c.org?x.net/", "x://y://z.net/a", "http://" + "a" * 5000 + ".net/" + "b" * 5000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i, u in enumerate(urls):
        host, path = url_filter.split_url(u)
        fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.text), default=None)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best and best.text, best.action if best else "allow")
    assert url_filter.split_url("HTTP://Ab.C:80/x?y#z") == ("ab.c:80", "/x")


def test_license_scan(spark):
    mit = license_scan.TEMPLATES[4][1]
    rng = random.Random(2)
    noise = lambda n: prose(rng, n, ["lorem", "ipsum", "dolor", "sit"])
    texts = [None, "", noise(5000) + " " + mit + " " + noise(5000), "Released under the MIT License.", "licensed under cc by-nc 4.0", noise(100), " ".join(mit.split()[:8])]
    got = {r.doc_id: r.licenses for r in license_scan.scan(table(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert got == {0: "", 1: "", 2: "MIT", 3: "MIT", 4: "CC-BY-NC-4.0", 5: "", 6: ""}


@pytest.mark.parametrize("t", range(len(license_scan.TEMPLATES)))
def test_license_scan_finds_every_copy(t):
    """Whole copies, and the first words that make up a containment of 0.8, against a search of every window."""
    name, text = license_scan.TEMPLATES[t]
    known = license_scan.Templates([(name, text)])
    every = license_scan.Templates(license_scan.TEMPLATES)
    own = license_scan.words_of(text)
    k = min(license_scan.SHINGLE, len(own))
    shingles = lambda w: [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
    want, m = set(shingles(own)), len(own) - k + 1
    rng = random.Random(t)
    found = 0
    for trial in range(500):
        noise = [b"w%d" % rng.randrange(10**6) for _ in range(150)]
        at = rng.randrange(150)
        part = own if trial % 2 else own[: -(-m * 4 // 5) + k - 1]
        words = noise[:at] + part + noise[at:]
        s = shingles(words)
        share = max(len(want.intersection(s[b : b + 2 * m])) / len(want) for b in range(0, len(s), m))
        text = b" ".join(words).decode()
        assert [x[2] for x in known.scan(text)] == ([pytest.approx(share)] if share >= 0.8 else [])
        assert share < 0.8 or name in [x[0] for x in every.scan(text)]
        found += share >= 0.8
    assert found >= 250


def test_sharding(spark, rows):
    got = sharding.shard(table(spark, rows), 4000).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _, _ in rows)
    size, count = defaultdict(int), defaultdict(int)
    for r in got:
        size[r.shard] += r.n_bytes
        count[r.shard] += 1
    assert all(n <= 4000 or count[s] == 1 for s, n in size.items())
    assert all(size[r.shard] == r.shard_bytes and r.oversized == (r.shard_bytes > 4000) for r in got)
    shards = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:], strict=False))
    assert len({r.shard for r in sharding.shard(table(spark, [(5, "x" * 100, "en")] * 500), 2000).collect()}) >= 25


def test_language(spark):
    rng = random.Random(4)
    vocabulary = {"aa": ["kato", "mira", "tolu", "sena"], "bb": ["strk", "wvlt", "prgh", "nmst"]}
    docs = [(i, prose(rng, 60, vocabulary["aa" if i % 2 else "bb"]), "aa" if i % 2 else "bb") for i in range(200)]
    extra = [(300, None, "aa"), (301, "", None), (302, "12 !", "bb"), (303, prose(rng, 40_000, vocabulary["aa"]), None), (None, "kato mira", "aa")]
    df = table(spark, docs + extra)
    got = {r.doc_id: r for r in language.identify(df, language.sample(df)).collect()}
    assert len(got) == 205
    assert all(got[i].lang_pred == lang for i, _, lang in docs)
    assert [got[i].lang_pred for i in (300, 301, 302, 303)] == ["und", "und", "und", "aa"]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in docs)
    assert {r.doc_id for r in language.keep_identified(df, language.sample(df)).collect()} == set(got) - {300, 301, 302}
    assert language.identify(df.limit(0), language.sample(df.limit(0))).count() == 0


def phrases(text, reference):
    """Greedy cross-parsing by search."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in reference:
            size += 1
        n, at = n + 1, at + size
    return n


def test_cross_parsing_counts_phrases():
    rng = random.Random(9)
    reference, text = ("".join(rng.choice("abc") for _ in range(n)) for n in (300, 400))
    parser = language.Parser({"x": reference})
    assert parser.phrases([text])[0, 0] == phrases(text, reference)


def test_language_tells_late_letters_apart():
    """Two languages of Han letters beside one that has 300 letters before them."""
    rng = random.Random(10)
    letters = {"aa": [chr(c) for c in range(0x400, 0x600) if chr(c).isalpha() and chr(c).islower()] + [chr(0xAC00 + i) for i in range(300)], "yy": [chr(0x4E00 + i) for i in range(900)], "zz": [chr(0x5E00 + i) for i in range(900)]}
    letters["aa"] += [chr(0x1200 + i) for i in range(300) if chr(0x1200 + i).isalpha()]
    word = lambda lang, n: "".join(rng.choice(letters[lang]) for _ in range(n))
    words = {lang: [word(lang, 3) for _ in range(400)] for lang in letters}
    samples = {lang: prose(rng, 3000, words[lang]) for lang in letters}
    parser = language.Parser(samples)
    want = list(letters) * 10
    assert [x for x, _ in parser.predict([prose(rng, 50, words[lang]) for lang in want])] == want
    for j, lang in enumerate(letters):
        text = prose(rng, 60, words[lang])
        assert parser.phrases([text])[0, j] == phrases(text, samples[lang])


def test_language_learns_every_value(spark):
    rng = random.Random(11)
    words = {f"l{j:02}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(20)] for j in range(70)}
    docs = table(spark, [(7 * j + i, prose(rng, 30, own), lang) for j, (lang, own) in enumerate(words.items()) for i in range(7)])
    samples = language.sample(docs)
    assert set(samples) == set(words)
    assert all(r.lang_pred == f"l{r.doc_id // 7:02}" for r in language.identify(docs, samples).collect())


@pytest.mark.parametrize(("module", "label", "bad"), [(quality, "quality", 0), (toxicity, "toxic", 1)])
def test_classifiers(spark, module, label, bad):
    rng = random.Random(6)
    good, odd = ["lovely", "garden", "morning", "walk", "river"], ["idiot!!!", "scum###", "garden&&&", "trash$$$"]
    docs = [(i, prose(rng, 80, good + (odd if i % 4 == 0 else [])), "en") for i in range(400)]
    df = table(spark, [*docs, (900, None, None), (901, "", "en"), (None, "x", "en")])
    labels = spark.createDataFrame([(i, bad if i % 4 == 0 else 1 - bad) for i, _, _ in docs] + [(None, 1), (5, None)], f"doc_id long, {label} int")
    got = {r.doc_id: r for r in module.score(df, module.fit(df, labels)).collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 for r in got.values())
    held = [r for r in got.values() if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.predicted == (bad if r.doc_id % 4 == 0 else 1 - bad) for r in held) >= 0.97 * len(held)
    nothing = module.fit(df.limit(0), labels.limit(0))
    assert module.score(df, nothing).count() == 403


def test_empty_tables(spark):
    docs = table(spark, [(1, "x", "en")]).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    path = packing.vocabulary_path()
    for df in (ngram_join.groups(docs), ngram_join.keep_one(docs), packing.pack(docs, path), fingerprint.compare(docs), decontaminate.report(docs, bench), license_scan.scan(docs), sharding.shard(docs), fingerprint.fingerprint(docs), url_filter.judge(spark.createDataFrame([], "page_id long, url string"))):
        assert df.count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        assert module.score(docs, module.fit(docs, labels)).count() == 0
    assert quality.keep_good(docs, quality.fit(docs, labels)).count() == 0


def test_the_label_model_follows_votes_not_labels():
    """A tenth of the labels is wrong; voters of unlike accuracy and two that copy one another are right of most rows."""
    np = toxicity.np
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.2
    rates = [(0.7, 0.01), (0.6, 0.02), (0.5, 0.01), (0.4, 0.01)]
    votes = np.stack([np.where(truth, rng.random(4000) < hit, rng.random(4000) < miss) for hit, miss in rates], 1).astype(float)
    votes = np.hstack([votes, votes[:, :1]])
    labels = np.where(rng.random(4000) < 0.1, ~truth, truth).astype(int)
    got = toxicity.label_model(votes, labels, 0.2) > 0.5
    assert (got == truth).mean() > 0.94 > (labels == truth).mean()
    assert got[(labels == 0) & truth].mean() > 0.7  # rows whose label is wrong


def test_decontamination_counts_shingles_of_every_row(spark):
    docs = spark.createDataFrame([("a b c d e f",), (None,), ("a b c d e a b c d e",), ("a b",)], "text string")
    h = decontaminate.Hashes()
    keys = sorted(decontaminate.runs(h.of(w.encode().split()), 5).item() for w in ("a b c d e", "b c d e f", "x y z u v"))
    got = dict(zip(keys, decontaminate.count_shingles(docs, decontaminate.np.array(keys, "u8")).tolist(), strict=True))
    key = lambda w: decontaminate.runs(h.of(w.encode().split()), 5).item()
    assert got == {key("a b c d e"): 3, key("b c d e f"): 1, key("x y z u v"): 0}
