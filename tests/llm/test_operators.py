"""The training-data operators against brute force, and on nulls, empty and long texts, repeated rows and empty tables."""

import base64
import hashlib
import json
import random
import re
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import ann, bpe, decontaminate, near_dup, quality, queries, secret_scan, sharding, token_count, url_rules, warc

TOK = queries.TOKENIZER
ODD = [(1, None), (2, ""), (3, " \n "), (4, "word"), (5, "a b c d e f g"), (5, "a b c d e f g"), (None, "x y"), (6, "é漢😀 <|endoftext|> " * 20), (7, "x" * 200_000), (8, "A B C D E F G")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None, 1, "a", "b", "c", "d", "e") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, rep string, part string, n_tokens string, score string")


def test_sharding():
    names = [f"s{i}" for i in range(7)]
    t = sharding.lookup_table(names, 1009)
    counts = np.bincount(t)
    assert counts.max() - counts.min() <= 1
    # brute force: take turns down the preference lists
    number = lambda n, w, b: int.from_bytes(hashlib.sha256(f"{w}:{n}".encode()).digest()[:8], "big") % b
    lists = {n: [(number(n, "offset", 1009) + j * (number(n, "skip", 1008) + 1)) % 1009 for j in range(1009)] for n in names}
    want, turn = {}, 0
    while len(want) < 1009:
        n = names[turn % 7]
        want[next(s for s in lists[n] if s not in want)] = n
        turn += 1
    assert [names[i] for i in t] == [want[s] for s in range(1009)]
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sum(names[a] != names[b] for a, b in zip(t, fewer, strict=True) if a != 6) < 1009 * 0.2


def test_sharding_rows(spark, odd):
    out = sharding.assign(odd, "doc_id")
    assert out.count() == len(ODD) and out.where("shard IS NULL").count() == 0
    assert sharding.assign(odd.limit(0), "doc_id").count() == 0


def test_sharding_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    table = sharding.lookup_table(sharding.SHARDS)
    got = {r["doc_id"]: (r["slot"], r["shard"]) for r in queries.sharded(spark, d).collect()}
    ids = [r["doc_id"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect()]
    slots = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) % sharding.SIZE for i in ids}  # noqa: S324
    assert got == {i: (s, sharding.SHARDS[table[s]]) for i, s in slots.items()}


def texts():
    random.seed(5)
    alphabet = ["a", "b", " ", "\n", "é", "漢", "1", "'", "s", "!", "<|endoftext|>", "'re", "  ", "the", "😀", "\u0378"]
    for _ in range(200):
        yield "".join(random.choice(alphabet) for _ in range(random.randint(0, 200)))
        yield "".join(random.choice("abet") for _ in range(random.randint(0, 600)))
        yield "".join(random.choice(["a" * 500, " ", "!" * 180, "é" * 100, "1" * 90, "<|endoftext|>", " " * 90]) for _ in range(random.randint(0, 6)))


def test_encoding_and_counts_are_the_librarys():
    t, c, e = bpe.load(TOK), token_count.counter(TOK), bpe.encoder(TOK)
    for x in texts():
        want = t.encode(x, add_special_tokens=False).ids
        assert e.ids(x) == want and c.of_text(x) == len(want)
        for leaf in (7, 40, 130):
            assert bpe.encode_long(TOK, x, leaf) == want


def test_encoding_rows(spark, odd):
    t = bpe.load(TOK)
    for leaf in (10, bpe.LEAF):
        got = bpe.encode(odd, TOK, leaf=leaf).collect()
        want = [(i, t.encode(x or "", add_special_tokens=False).ids, x or "") for i, x in ODD]
        key = lambda r: (str(r[0]), r[2])
        assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=key) == sorted(want, key=key)
    n = {(r[0], r[1], r[2], r[3]) for r in token_count.count_tokens(odd, TOK).collect()}
    assert n == {(i, len((x or "").encode()), len(y), len(y) > 512) for i, y, x in want}
    assert bpe.encode(odd.limit(0), TOK).count() == 0


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination():
    random.seed(2)
    for _ in range(60):
        letters = random.choice(["abcdefgh", "thandering "])
        items = [(i, "".join(random.choice(letters) for _ in range(random.randint(1, 100)))) for i in range(3)]
        docs = []
        for _ in range(3):
            z = list(random.choice(items)[1])
            for _ in range(random.randint(0, 7)):
                z[random.randrange(len(z))] = random.choice(letters)
            docs.append(decontaminate.normal("".join(random.choice(letters) for _ in range(40)) + "".join(z)))
        index = decontaminate.build(items)
        got = {(d, t): e for d, t, e, _, _ in decontaminate.search(index, docs)}
        want = {(d, t): n for d, x in enumerate(docs) for t, item in enumerate(index.texts) if (n := distance(item, x)) <= decontaminate.budget(len(item))}
        assert got == want


@pytest.mark.parametrize("small", [False, True])
def test_decontamination_of_periodic_texts(monkeypatch, small):
    """Equal to brute force, also when windows, pairs and waiting counts are cut very small."""
    if small:
        for name, n in (("WINDOW", 50), ("PAIRS", 7), ("WAITING", 5), ("WIDTH", 40)):
            monkeypatch.setattr(decontaminate, name, n)
    random.seed(8)
    hits = 0
    for _ in range(25):
        unit = "".join(random.choice("ab=-") for _ in range(random.randint(1, 5)))
        items = [(0, unit * random.randint(10, 60)), (1, (unit * 40)[: random.randint(20, 90)] + "xyz" * 10), (2, "a b " * 12)]
        docs = []
        for _ in range(4):
            z = list(random.choice(items)[1] + unit * random.randint(0, 40))
            for _ in range(random.randint(0, 9)):
                z[random.randrange(len(z))] = random.choice("ab=-x")
            docs.append(decontaminate.normal("q" * random.randint(0, 30) + "".join(z)))
        index = decontaminate.build(items)
        got = {(d, t): e for d, t, e, _, _ in decontaminate.search(index, docs)}
        want = {(d, t): n for d, x in enumerate(docs) for t, item in enumerate(index.texts) if (n := distance(item, x)) <= decontaminate.budget(len(item))}
        assert got == want
        hits += sum(0 < n for n in want.values())
    assert hits > 10


def test_decontamination_of_a_long_periodic_text_in_bounded_memory():
    import tracemalloc

    index = decontaminate.build([(0, "=-" * 1000), (1, "=-" * 500 + "=+" * 40)])
    text = "=-" * 1_000_000
    tracemalloc.start()
    found = decontaminate.search(index, [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(d, t, e, s) for d, t, e, s, _ in found] == [(0, 0, 0, 0), (0, 1, 40, 0)] and peak < 500e6


def test_decontamination_rows(spark, odd):
    bench = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, ""), (4, "nowhere to be found")], "item_id long, text string")
    assert sorted(r[0] for r in decontaminate.contaminated(odd, bench).collect()) == [5, 5, 8]
    assert decontaminate.clean(odd, bench).count() == len(ODD) - 3
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0 == decontaminate.contaminated(odd.limit(0), bench).count()


def test_near_duplicates(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [random.choice(words) for _ in range(random.randint(3, 90))]
        for _ in range(random.randint(1, 25)):
            x = list(base)
            for _ in range(random.randint(0, 6)):
                x[random.randrange(len(x))] = random.choice(words)
            rows.append((len(rows), " ".join(x)))
    sets = {i: {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} for i, t in rows if (w := t.split())}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {i: (len(s), top(i)) for i, s in sets.items()}


def test_near_duplicate_rows(spark, odd):
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(odd, 4).collect()), key=str)
    assert got == sorted([(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 4, 5, True), (5, 4, 5, True), (6, got[-3][1], 6, True), (7, 1, 7, True), (8, 4, 5, False)], key=str)
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0
    kept = near_dup.without_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 8").count() == 0


def test_near_duplicate_sketches_keep_links():
    """A pair at similarity 0.8 is over 5 deviations above the sketch's bound and over 7 above the finer one's."""
    assert 0.8 - near_dup.LEAST_EQUAL > 5 * (0.8 * 0.2 / near_dup.COORDINATES) ** 0.5
    equal, least = (x + (1 - x) / 16 for x in (0.8, near_dup.LEAST_FINE))
    assert equal - least > 7 * (equal * (1 - equal) / near_dup.FINE) ** 0.5


def copies_of_one(n, seed):
    """Rows of n texts that come from one by up to 16 changed words each, and the component of each by brute force."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(n):
        x = list(base)
        for at in rng.sample(range(150), rng.randint(0, 16)):
            x[at] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(x)))
    sets = [set(map(tuple, zip(w, w[1:], w[2:], w[3:], strict=False))) for w in (t.split() for _, t in rows)]
    label = list(range(n))
    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return rows, dict(enumerate(label))


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """Most copies are in one class and many in none. Pairs of texts that are compared follow the group's size, not its square."""
    compared = []
    verified = near_dup._verified
    monkeypatch.setattr(near_dup, "_verified", lambda pairs, *more: (compared.append(pairs.count()), verified(pairs, *more))[1])
    made = []
    for n in (250, 750):
        rows, want = copies_of_one(n, 5)
        compared.clear()
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert n / 4 < Counter(want.values()).most_common(1)[0][1] < 0.9 * n
        made.append(sum(compared))
    assert made[1] < 4.5 * made[0]  # three times the copies


def test_near_duplicates_in_several_blocks(spark, monkeypatch):
    rows, want = copies_of_one(250, 6)
    monkeypatch.setattr(near_dup, "BLOCK", 40)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 2000)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_near_duplicate_links_by_differences():
    """Differences from any set tell the links of all rows: as many as join the components, and none else."""
    rng = np.random.default_rng(4)
    base = np.arange(60)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(40, 61), replace=False), rng.integers(60, 75, rng.integers(0, 12))])) for _ in range(80)]
    centre = sets[0]
    apart = [np.setxor1d(centre, s) for s in sets]
    ends, comp, size = np.cumsum([0, *map(len, apart)]), np.arange(80) // 2, np.array([len(s) for s in sets])
    near = lambda x, y: 100 * len(np.intersect1d(sets[x], sets[y])) >= 80 * len(np.union1d(sets[x], sets[y]))

    def classes(links):
        label = comp.copy()
        for x, y in links:
            label[label == max(label[x], label[y])] = min(label[x], label[y])
        return label.tolist()

    for left, right in ((np.arange(80), np.arange(80)), (np.arange(30), np.arange(30, 80))):
        got = [(int(x), int(y)) for x, y in near_dup._joined(left, right, comp, size, ends, np.concatenate(apart), 80)]
        assert got and all(near(x, y) and comp[x] != comp[y] for x, y in got)
        want = classes([(x, y) for x in left for y in right if near(x, y)])
        assert classes(got) == want and len(got) == len(set(comp)) - len(set(want))


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one doc_id with other texts, equal, blank or null: they link what any of them is linked with, and nothing else."""
    rows, _ = copies_of_one(12, 8)
    other = " ".join(f"u{i}" for i in range(90))
    rows += [(3, None), (4, " "), (5, None), (5, ""), (6, other), (6, other), (40, other + " end"), (41, None), (42, "")]
    sets = [(i, {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if (w := (t or "").split()) else set()) for i, t in rows]
    label = {i: i for i, _ in rows}
    for i, x in sets:
        for j, y in sets:
            if x and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    want = [(i, label[i] if x else i) for i, x in sets]  # a row without words is its own component
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted(want)


def test_near_duplicates_leave_one_of_equal_rows(spark, odd):
    more = odd.unionAll(odd.where("doc_id = 5").withColumn("lang", F.lit("de"))).unionAll(odd.where("doc_id IN (2, 4) OR doc_id IS NULL"))
    got = sorted(((r["doc_id"], r["lang"]) for r in near_dup.without_near_duplicates(more).collect()), key=str)
    assert got == sorted([(1, "en"), (2, "en"), (2, "en"), (3, "en"), (4, "en"), (5, "en"), (5, "de"), (None, "en"), (None, "en"), (6, "en"), (7, "en")], key=str)


def test_quality_odd_signs():
    counted = lambda x: round(quality.make_up(x)[3] * len(x))
    assert counted("★★★ ■■■ ◆◆ \ufffd\ufffd\ufffd •••") == 14 and counted("### $$$ &&&") == 9
    assert counted("é漢 word, naïve; हिन्दी 100 (x) - y") == 0 and counted("→ 😀 # é") == 3
    assert counted("a\x00b\x7f") == 2 == counted("é\x00b\x7f")


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality.judged(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    got = {(r["good"], r["kept"]): r["count"] for r in out.groupBy((F.expr("quality = 1 AND toxic = 0")).alias("good"), F.col("_judged.kept").alias("kept")).count().collect()}
    assert got[True, True] / (got[True, True] + got.get((True, False), 0)) > 0.98
    assert got[False, False] / (got[False, False] + got.get((False, True), 0)) > 0.9


def test_quality_sites_against_brute_force(spark):
    """Posteriors of paths and hosts by the formulas, from all documents."""
    random.seed(13)
    rows = [(f"h{h}", f"p{random.randint(0, 3)}", random.gauss(h - 3, 1.0), random.gauss(1 - h, 0.5)) for h in range(7) for _ in range(random.choice([1, 2, 40, 300]))]
    df = spark.createDataFrame(rows, "host string, path string, q double, t double").select("host", "path", F.struct(F.col("q").alias("quality"), F.col("t").alias("toxic")).alias("own"))
    got = {(r["host"], r["path"]): (r["shift_quality"], r["shift_toxic"]) for r in quality.sites(df).collect()}
    logit = lambda x: np.log(x / (1 - x))
    want = defaultdict(list)
    for i in (2, 3):
        p = [1 / (1 + np.exp(-r[i])) for r in rows]
        mean = np.mean(p)

        def strength(of):
            groups = defaultdict(list)
            for r, x in zip(rows, p, strict=True):
                groups[of(r)].append(x)
            spread = sum(len(g) * (np.mean(g) - mean) ** 2 for g in groups.values())
            between = (spread - mean * (1 - mean) * (len(groups) - 1)) / len(p)
            return groups, min(1e6, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e6

        (hosts, up), (paths, down) = strength(lambda r: r[0]), strength(lambda r: r[:2])
        for k, g in paths.items():
            host = (sum(hosts[k[0]]) + up * mean) / (len(hosts[k[0]]) + up)
            path = (sum(g) + down * host) / (len(g) + down)
            want[k].append(max(-quality.MOST_SHIFT, min(quality.MOST_SHIFT, logit(path) - logit(mean))))
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_quality_of_repeated_labels_and_texts(spark):
    """A doc_id with very many rows counts once in the fitting; its rows are judged one by one."""
    docs = spark.createDataFrame([(1, f"good words number {i}", "en", "s") for i in range(50)] + [(2, "BAD", "en", "s"), (3, "other plain words", "en", "s")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1, 0)] * 5 + [(2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, 2)
    assert np.isfinite(model.weights).all()
    out = quality.judged(docs, labels, carried=["doc_id"])
    assert out.columns == ["doc_id", "_judged"] and out.count() == 52


def test_quality_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (99, None, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        assert quality.judged(odd, lab).count() == len(ODD)
    assert quality.judged(odd.limit(0), labels).count() == 0
    clash = odd.withColumns({c: F.lit(c) for c in ("_own", "_HOST", "_path", "_judged", "host", "own", "shift_quality", "_shift_toxic")})
    got = quality.judged(clash, labels)
    assert got.columns == [*clash.drop("_judged").columns, "_judged"]
    assert {(r["_own"], r["_HOST"], r["shift_quality"], r["_shift_toxic"]) for r in got.collect()} == {("_own", "_HOST", "shift_quality", "_shift_toxic")}


def test_url_rules(spark):
    urls = [(1, "http://A.Example.NET/en/x"), (2, "https://example.net"), (3, "x://net/"), (4, "http://example.com/de/?q"), (5, "http://a.org/fr/#z"), (6, None), (7, "no host"), (8, "http://notexample.net/en/"), (9, "http://xexample.com/de/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert got == {1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("example.net", "", None, "allow"), 3: ("net", "/", "net/", "block"), 4: ("example.com", "/de/", "example.com/de/", "block"), 5: ("a.org", "/fr/", "org/fr/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("notexample.net", "/en/", "net/", "block"), 9: ("xexample.com", "/de/", None, "allow")}
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_secret_base_spans():
    random.seed(4)
    parts = ["token", "Api_Key", "=", ":", " ", '"', "abc", "AKIA", "A1" * 9, "0f" * 12, "secret", "K", "password", "-"]
    for _ in range(500):
        x = "".join(random.choice(parts) for _ in range(14))
        want = [("assign", *m.span()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x) if len(m[2]) >= 6]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
        assert secret_scan.ordered(secret_scan.base_spans(x)) == secret_scan.ordered(want)


def test_secret_structures(spark, odd):
    code = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    token = f"{code({'alg': 'HS256'})}.{code({'sub': '1'})}.sig"
    assert secret_scan.confirmed_spans(f"x {token}") == [("jwt", 2, 2 + len(token))]
    assert secret_scan.confirmed_spans(f"x {code({'typ': 'JWT'})}.e30.x") == []
    assert secret_scan.redact(f"a {token} b") == "a [SECRET] b"
    assert secret_scan.scan(odd).count() == len(ODD) and secret_scan.redacted(odd).columns == odd.columns


def element(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | (k := (n.bit_length() + 7) // 8)]) + n.to_bytes(k, "big")) + body


def test_secret_keys_wherever_they_start():
    random.seed(6)
    algorithm = element(0x30, element(0x06, b"\x2a\x86\x48\xce\x3d\x02\x01") + element(0x06, b"\x2b\x81\x04\x00\x23"))
    inner = lambda n: element(0x30, element(2, b"\1") + element(4, random.randbytes(n)))
    keys = [element(0x30, element(2, b"\0") + algorithm + element(4, inner(n))) for n in (*range(32, 90), 200, 214, 215, 216, 1200)]  # PKCS #8, with SEC 1 inside
    keys += [element(0x30, element(2, b"\0") + b"".join(element(2, b"\x01" + random.randbytes(n)) for _ in range(8))) for n in (20, 64, 200)]  # PKCS #1
    keys += [element(0x30, element(2, b"\1") + element(4, random.randbytes(66)) + element(0xA0, element(0x06, b"\x2b\x81\x04\x00\x23")))]  # SEC 1
    name = "PRIVATE KEY-----"
    assert any(len(k) % 48 == 1 for k in keys) and any(len(k) % 48 == 2 for k in keys)
    for key in keys:
        assert secret_scan.is_private_der(key)
        text = base64.b64encode(key).decode()
        for newline in ("\n", "\r\n", "\\n", "\\r\\n", "\\\\n"):
            body = newline.join(text[i : i + 64] for i in range(0, len(text), 64))
            for before, after in (("-----BEGIN " + name + newline, newline + "-----END " + name), ('{"private_key": "-----BEGIN ' + name + newline, newline + "-----END " + name + newline + '"}'), ("-", " x"), ("_", ""), ("/", "\n"), ("abc", ".")):
                assert secret_scan.confirmed_spans(before + body + after) == [("der", len(before), len(before + body))], (len(key), newline, before)
        for before, after in (("-----BEGIN " + name, "-----END " + name), ("key=", "")):
            assert secret_scan.redact(before + text + after) == before + "[SECRET]" + after
        assert secret_scan.confirmed_spans("-----BEGIN " + name + text[: len(text) // 2] + "-----END " + name) == []
        assert len(key) % 3 or secret_scan.confirmed_spans(text + "abc") == []
    assert secret_scan.confirmed_spans("MII" * 5000 + "MIIEMIIE" * 5000) == []
    part = lambda x: len(x).to_bytes(4, "big") + x
    for n in (113, 136):  # 113: the last line is two characters and padding
        text = base64.b64encode(b"openssh-key-v1\0" + part(b"none") + part(b"none") + part(b"") + b"\0\0\0\1" + part(random.randbytes(51)) + part(random.randbytes(n))).decode()
        for newline in ("\n", "\\n", ""):
            body = newline.join(text[i : i + 70] for i in range(0, len(text), 70))
            before, after = "-----BEGIN OPENSSH " + name + newline, newline + "-----END OPENSSH " + name
            assert secret_scan.redact(before + body + after) == before + "[SECRET]" + after


def oid(hexed):
    return element(0x06, bytes.fromhex(hexed))


def rsa(n=64):
    return element(0x30, element(2, b"\0") + b"".join(element(2, b"\x01" + random.randbytes(n)) for _ in range(8)))


def sec1(n=32):
    return element(0x30, element(2, b"\1") + element(4, random.randbytes(n)) + element(0xA0, oid("2a8648ce3d030107")))


def pkcs8(algorithm, key, version=b"\0"):
    return element(0x30, element(2, version) + element(0x30, algorithm) + element(4, key))


def test_private_keys_and_lookalikes():
    random.seed(11)
    null = element(5, b"")
    rsa_id, ec_id, ed = oid("2a864886f70d010101") + null, oid("2a8648ce3d0201") + oid("2a8648ce3d030107"), oid("2b6570")
    pbes2 = element(0x30, oid("2a864886f70d01050d") + element(0x30, element(4, b"salt")))
    keys = [rsa(), sec1(), pkcs8(rsa_id, rsa()), pkcs8(ec_id, sec1()), pkcs8(ed, element(4, random.randbytes(32))), pkcs8(oid("2a8648ce380401") + element(0x30, b""), element(2, b"\x07" * 20)), pkcs8(oid("2a0304"), b"any" * 10), element(0x30, pbes2 + element(4, random.randbytes(64))), element(0x30, element(0x30, oid("2a864886f70d010c0103") + null) + element(4, random.randbytes(64)))]
    digest = element(0x30, element(0x30, oid("608648016503040201") + null) + element(4, random.randbytes(32)))  # DigestInfo of SHA-256
    public = element(0x30, element(0x30, rsa_id) + element(3, b"\0" + element(0x30, element(2, random.randbytes(128)) + element(2, b"\1\0\1"))))
    lookalikes = [digest, public, pkcs8(rsa_id, random.randbytes(300)), pkcs8(ec_id, random.randbytes(40)), pkcs8(ed, random.randbytes(34)), pkcs8(rsa_id, rsa(), b"\5"), rsa()[:-1], rsa() + b"\0", element(0x30, element(2, b"\0") + element(2, b"\1" * 20)), element(0x30, element(2, b"\2") + element(4, b"x" * 40))]
    for form in (lambda x: base64.b64encode(x).decode(), bytes.hex):
        for key in keys:
            text = f"key {form(key)} end"
            assert secret_scan.is_private_der(key) and [s for s in secret_scan.confirmed_spans(text) if s[0] == "der"] == ([("der", 4, len(text) - 4)] if len(key) >= 30 else [])
        for key in lookalikes:
            assert not secret_scan.is_private_der(key) and not secret_scan.confirmed_spans(f"key {form(key)} end")


def test_tokens_must_be_signed():
    code = lambda o: base64.urlsafe_b64encode(o if isinstance(o, bytes) else json.dumps(o).encode()).decode().rstrip("=")
    body, head = code({"sub": "1"}), code({"alg": "RS256", "typ": "JWT"})
    for h, b, s, good in ((head, body, code(b"signature"), True), (code({"alg": "none"}), body, "", False), (code({"alg": "None"}), body, code(b"x"), False), (head, body, "", False), (head, body, "x", False), (head, code([1]), code(b"sig"), False), (code({"typ": "JWT"}), body, code(b"sig"), False), (head, code(b"\xff\xfe{}"), code(b"sig"), False)):
        assert bool(secret_scan.confirmed_spans(f"{h}.{b}.{s}")) == good, (h, b, s)


def test_secret_query_against_brute_force(spark):
    """The query's columns from the base patterns by plain search, over documents with keys and tokens among them."""
    random.seed(12)
    code = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    extra = {"jwt": f"{code({'alg': 'HS256'})}.{code({'sub': '1'})}.c2ln", "der": base64.b64encode(sec1()).decode()}
    parts = ["token", "=", ":", '"', "abc ", "\n", "AKIA" + "Q7" * 9, "0f" * 13, "passwd", "hunter2", "é😀", "<|x|>"]
    rows = [(i, "".join(random.choice([*parts, f" {extra['jwt']} ", f" {extra['der']} "]) for _ in range(random.randint(0, 16)))) for i in range(300)] + [(300, None), (300, None), (None, "secret=abcdefgh")]
    patterns = (("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
    want, seen = [], 0
    for i, x in rows:
        base = [(k, *m.span()) for k, p, g, least in patterns for m in re.finditer(p, x or "") if len(m[g]) >= least]
        more = [(k, at, at + len(e)) for k, e in extra.items() for at in range(len(x or "")) if (x or "").startswith(f" {e} ", at - 1)]
        seen += len(more)
        told = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(s, key=lambda s: (s[1], ["assign", "access", "hex", "jwt", "der"].index(s[0]))))
        want.append((i, *(sum(k == s[0] for s in base) for k in ("assign", "access", "hex")), hashlib.sha256(told(base).encode()).hexdigest(), told(base + more)))
    spark.createDataFrame(rows, "doc_id long, text string").createOrReplaceTempView("_docs")
    assert seen > 50
    monkey = queries.table
    try:
        queries.table = lambda s, d, name: s.table("_docs")
        got = [tuple(r) for r in queries.secrets(spark, "").collect()]
    finally:
        queries.table = monkey
    assert sorted(got, key=str) == sorted(want, key=str)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.2, 2, size=(3000, 1))
    x[100:1100] = x[100]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3001, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [None] * 16), (3080, [1.0])]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 20)) and all(len(v) == 20 for v in got.values())
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -np.round(s, 9)))[:20]
        hits += len(set(want) & {i for i, _ in found})
        assert all(abs(v - x[i] @ x[q]) < 1e-9 for i, v in found) and found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits / 20 / len(got) >= 0.9
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_of_repeated_ids(spark, monkeypatch):
    rows = [(0, [1.0, 0.0]), (0, [9.0, 0.0]), (1, [1.0, 0.0]), (1, [5.0, 0.0]), (2, [0.5, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, row string, part int, chunk int")
    monkeypatch.setattr(ann, "CHUNK", 1)  # each query is a chunk of its own
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df).collect())
    first, second = [(0, 9.0), (1, 5.0), (1, 1.0), (2, 0.5)], [(1, 45.0), (0, 9.0), (1, 9.0), (2, 4.5)]
    assert got == sorted((0, i + 1, *x) for found in (first, second) for i, x in enumerate(found))


def test_share_is_small_for_clustered_vectors():
    rng = np.random.default_rng(3)
    plain = rng.normal(size=(6000, 32))
    groups = rng.normal(size=(60, 32))[rng.integers(60, size=6000)] * 3 + 0.1 * plain
    share = {}
    for name, x in (("plain", plain), ("groups", groups)):
        most = float(np.linalg.norm(x, axis=1).max())
        share[name] = ann.share_for(x, most, *(ann.kmeans(h, ann.CENTROIDS) for h in ann.halves(x, most)), 20)
    assert share["groups"] < 0.2 < share["plain"] < 0.8


def test_revisits(spark):
    c = "record_id long, url string, ts long, type string, status int, headers map<string,string>, payload string"
    day = 86_400
    rows = [(1, "http://www.A.com/x/", 10, "response", 200, {"etag": "e", "content-type": "t"}, "p"), (2, "https://a.com/x#f", 10 * day, "revisit", 304, {"etag": "W/e", "date": "d", "content-type": "no"}, None), (3, "http://a.com/x", 5, "revisit", 304, None, None), (4, "http://a.com/x", 20, "revisit", 304, {"etag": "other"}, None), (5, None, 9, "revisit", 304, None, None), (6, "http://a.com/x", None, "revisit", 304, None, None), (7, "http://a.com/x", 10, "revisit", 304, {}, None)]
    got = {r["record_id"]: r for r in warc.resolve(spark.createDataFrame(rows, c)).collect()}
    assert {k: r["resolution"] for k, r in got.items()} == {1: "full", 2: "resolved", 3: "no_earlier", 4: "mismatch", 5: "no_earlier", 6: "no_earlier", 7: "no_earlier"}
    assert got[2]["headers"] == {"etag": "W/e", "date": "d", "content-type": "t"} and got[2]["payload"] == "p" and got[2]["status"] == 200
    assert warc.resolve(spark.createDataFrame([], c)).count() == 0


def test_revisits_of_hot_urls_and_seconds(spark, monkeypatch):
    """A brute-force as-of join over repeated rows, ties and one URL with most of the captures, also with SPLIT so small that answers are broadcast."""
    random.seed(9)
    rows = []
    for i in range(600):
        url = random.choice(["http://hot.example/x"] * 3 + [f"http://h{random.randint(0, 5)}.example/"])
        full = random.random() < 0.2
        ts = random.choice([100, 100, random.randint(0, 400_000), random.randint(0, 50)])
        rows.append((i, url, ts, "response" if full else "revisit", 200 if full else 304, {"etag": random.choice("ab"), "n": str(i)} if full or i % 2 else {}, f"p{i}" if full else None, "clash", 5))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, type string, status int, headers map<string,string>, payload string, answer string, slice int")
    want = defaultdict(set)
    for i, url, ts, kind, _, headers, payload, *_ in rows:
        before = [r for r in rows if r[3] == "response" and r[1] == url and r[2] < ts] if kind == "revisit" else []
        last = max(before, key=lambda r: (r[2], r[0]), default=None)
        if kind == "response":
            want[i].add(("full", i, payload, headers.get("n")))
        elif last is None or ("etag" in headers and headers["etag"] != last[5]["etag"]):
            want[i].add(("mismatch" if last else "no_earlier", None, None, headers.get("n")))
        else:
            want[i].add(("resolved", last[0], last[6], last[5]["n"]))
    for split in (256, 2):
        monkeypatch.setattr(warc, "SPLIT", split)
        monkeypatch.setattr(warc, "HOT", 200)
        got = warc.resolve(df).collect()
        assert len(got) == len(rows)
        found = defaultdict(set)
        for r in got:
            found[r["record_id"]].add((r["resolution"], r["source_id"], r["payload"], r["headers"].get("n")))
        assert found == want


def test_pipeline(spark, odd):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, docs, d)
        assert after.columns == docs.columns and after.count() <= docs.count(), name
        seen.append({r["doc_id"] for r in after.collect()})
        docs = after
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not any(i in decontaminate.normal(t) for t in left.values() for i in items) and all(secret_scan.redact(t) == t for t in left.values())
    assert seen[3] == seen[2]
    t = bpe.load(p.TOKENIZER)
    assert {r["doc_id"]: r["ids"] for r in p.token_ids(spark, docs, d).collect()} == {i: t.encode(x, add_special_tokens=False).ids for i, x in left.items()}
    for _, stage in p.STAGES:
        assert stage(spark, odd.limit(0), d).count() == 0
        stage(spark, odd, d).collect()


def test_kept_words_are_bounded_by_bytes():
    """Thousands of long words, and very many short ones, leave little behind, and change no result."""
    random.seed(7)
    e, c, t = bpe.Encoder(TOK), token_count.Counter(TOK), bpe.load(TOK)
    long = ["".join(random.choice("abcdefgh") for _ in range(2_000)) for _ in range(500)]
    held = (e.known.held, c.known.held)
    for i in range(0, len(long), 10):
        text = " ".join(long[i : i + 10])
        assert len(e.ids(text)) == c.of_text(text) == len(t.encode(text, add_special_tokens=False).ids)
    assert (e.known.held, c.known.held) == held == (0, 0)
    e.known.most = c.known.most = 20_000
    for i in range(40):
        text = " ".join(str(random.random()) for _ in range(200))
        assert e.ids(text) == t.encode(text, add_special_tokens=False).ids and c.of_text(text) == len(e.ids(text))
        assert max(e.known.held, c.known.held) <= 20_000 and len(e.known) < 400 > len(c.known)


def test_queries_against_sql_side_by_side(spark, data):
    """All queries that SQL can express, run by several threads of one session at once."""
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")

    def found(name):
        df = queries.QUERIES[name](spark, data)
        return name, sorted(df.columns), sorted(map(str, ([r[x] for x in sorted(df.columns)] for r in df.collect())))

    with ThreadPoolExecutor(3) as pool:
        for name, columns, got in pool.map(found, queries.ORACLE_SQL):
            want = c.sql(queries.ORACLE_SQL[name])
            at = [want.columns.index(x) for x in columns]
            assert sorted(want.columns) == columns
            assert got == sorted(map(str, ([r[i] for i in at] for r in want.fetchall()))), name
