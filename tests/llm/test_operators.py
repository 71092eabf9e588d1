"""Each operator against a brute-force version, with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from striata.llm import decontaminate, labelled, language_model, license_scan, mixing, near_dup, quality, token_count, topk, toxicity, url_filter
from striata.llm.common import exact_shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, n string"


def frame(spark, rows):
    """(doc_id, text, source) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, 0, 0.5, "x", "y") for i, t, s in rows], DOCS)


def words(n, seed, size=400):
    r = np.random.RandomState(seed)
    return " ".join(f"w{x}" for x in r.randint(0, size, n))


def odd_rows():
    return [(1, None, "a"), (2, "", None), (3, "one", "a"), (None, words(40, 1), "b"), (5, words(30_000, 2, 9000), "a"), (6, words(60, 3), "b"), (6, words(60, 3), "b"), (7, " \t\n", "b")]


def test_license_scan(spark):
    rows = odd_rows() + [(10, "x Under the MIT-License, under the mit license", "a"), (11, "CC BY-NC 4.0 apache license version 2", "a"), (12, "Licensed under the GNU General Public License, version 3.", "a"), (13, "mit license under the", "a")]
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, rows)).collect()}
    assert len(license_scan.scan(frame(spark, rows)).collect()) == len(rows)
    assert (got[10].n_base, got[10].first_word, got[10].last_word, got[10].base_labels) == (2, 1, 5, "mit")
    assert got[11].base_labels == "apache-2,cc-by-nc" and got[11].n_words == 9
    assert got[12].labels == "gpl-3" and got[12].base_labels == "" and 0 < got[12].score <= 1
    assert (got[13].n_base, got[13].first_word, got[1].n_words, got[1].score) == (0, None, 0, 0.0)


@pytest.mark.parametrize("chunk", [1 << 20, 60])
def test_license_labels_against_brute_force(monkeypatch, chunk):
    """Every template whole, with altered words, twice, and overlapping others: all templates are tried at all places."""
    from striata.llm import common

    monkeypatch.setattr(common, "CHUNK", chunk)
    index, r = license_scan.Index(), np.random.RandomState(3)
    for n, (label, template, _) in enumerate(license_scan.TEMPLATES + [(x, p, []) for p, x in license_scan.BASE_PHRASES.items()]):
        whole = template.split()
        for alter in range(4):
            w = [x if alter == 0 or r.rand() > 0.12 * alter else f"other{r.randint(9)}" for x in whole]
            text = " ".join([words(r.randint(0, 30), n), *w, words(r.randint(0, 8), n), "Under the MIT-License,", *w[: r.randint(len(w) + 1)], words(5, n)])
            got, found = index.scan(text.encode()), license_scan.WORD.findall(text.lower().encode())
            labels, base, starts, best = set(), set(), [], 0.0
            for t, (kind, words_, keys, is_base) in enumerate(index.entries):
                for at in range(-len(words_), len(found) + 1):
                    here = found[max(0, at) : max(0, at + len(words_))]
                    holds = all(any(here[i : i + len(k)] == k for i in range(len(here))) for k in keys)
                    share = sum(index.idf[x] for p, x in enumerate(words_) if 0 <= at + p < len(found) and found[at + p] == x) / index.total[t]
                    if is_base and here == words_:
                        base.add(kind)
                        starts.append(at)
                        best = 1.0
                    elif not is_base and share >= 0.6 and holds:
                        labels.add(kind)
                        best = max(best, share)
            assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (len(found), len(starts), min(starts, default=None), max(starts, default=None))
            assert (got["base_labels"], got["labels"]) == (",".join(sorted(base)), ",".join(sorted(base | labels))) and got["score"] == pytest.approx(min(1, best))
            if alter == 0:
                assert label in got["labels"].split(",")


def test_long_texts_have_the_same_features_in_pieces(monkeypatch):
    from striata.llm import common

    texts = [words(3000, 4).encode(), b"", b"A b! " * 400]
    want, counts = quality.features(texts), [toxicity.Stems({"w1": 0, "w12": 1}).count(t) for t in texts]
    assert (want[:1] == quality.features(texts[:1])).all() and (want[2:] == quality.features(texts[2:])).all()
    monkeypatch.setattr(common, "CHUNK", 100)
    assert (want == quality.features(texts)).all() and counts == [toxicity.Stems({"w1": 0, "w12": 1}).count(t) for t in texts]


def test_token_count(spark):
    pieces = token_count.load_vocabulary()
    known, longest = set(pieces) | {bytes([b]) for b in range(256)}, max(map(len, pieces))

    def brute(text):
        total = 0
        for w in (text or "").encode().split():
            w, at = b" " + w, 0
            while at < len(w):
                end = min(len(w), at + longest)
                while w[at:end] not in known:
                    end -= 1
                at, total = end, total + 1
        return total

    rows = odd_rows() + [(20, "Straße ÉÀ 中文 " + "ab" * 3000, "a")]
    got = token_count.count_tokens(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((i or 0, brute(t)) for i, t, _ in rows)


def test_url_filter(spark):
    urls = [None, "nothing", "http://COM", "http://a.com/x", "http://example.com/en/1?q", "https://www.example.com/en/2", "http://b.net/es/3#t", "http://b.org/de/4", "http://b.org", "http://com/", "ftp://x.y/z?://w"]
    urls += [f"http://s{i}.com/de/{i}" for i in range(60)] + [f"http://t{i}.net/es/{i}" for i in range(60)] + ["http://s7.org/de/7", "http://t8.org/es/8"]
    pages = spark.createDataFrame([(i, u, "h", "w", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string, row string")
    got = [r for r in sorted(url_filter.filter_urls(pages).collect())]
    assert [(r.host, r.path, r.rule) for r in got[:11]] == [("", "", None), ("", "", None), ("com", "", None), ("a.com", "/x", "com/"), ("example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/2", "www.example.com/en/"), ("b.net", "/es/3", "net/es/"), ("b.org", "/de/4", None), ("b.org", "", None), ("com", "/", "com/"), ("x.y", "/z", None)]
    assert [r.verdict for r in got[-2:]] == ["allow", "block"] and got[4].verdict == "block" and got[5].verdict == "allow" and got[0].verdict == "allow"
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_url_model_against_brute_force(spark):
    urls = [f"http://s{i}.com/de/{'ab' * (i % 4)}{i}" for i in range(30)] + [f"http://t{i}.net/es/{'ca' * (i % 3)}{i}" for i in range(20)]
    free = ["http://s7.org/de/abca", "http://quux.org/zz/vwxyz", "http://t8.org/es/8"]
    pages = spark.createDataFrame(list(enumerate(urls + free)), "page_id long, url string")
    order, counts = url_filter.ORDER, (collections.Counter(), collections.Counter())
    signs = lambda u: "^" * order + "".join("0" if c.isdigit() else c for c in u.removeprefix("http://"))
    for u in urls:
        s = signs(u)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[".net" in u].update([("tail", s[i - k : i + 1]), ("context", k, s[i - k : i])])

    def p(n, context, c):
        lower = p(n, context[1:], c) if context else 1 / url_filter.ALPHABET
        return (n["tail", context + c] + url_filter.STRENGTH * lower) / (n["context", len(context), context] + url_filter.STRENGTH)

    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert len(got) == len(urls + free)
    mean = lambda n, s: np.mean([math.log2(p(n[1], s[i - order : i], s[i]) / p(n[0], s[i - order : i], s[i])) for i in range(order, len(s))])
    full = [mean(counts, signs(u)) for u in free]
    assert [got[len(urls) + j].log_ratio for j in range(len(free))] == pytest.approx(full, rel=1e-9)
    # the cut: each training URL by the models of the other half
    all_signs = spark.createDataFrame([(signs(u),) for u in urls], "s string")
    half = {r.s: r.h for r in all_signs.select("s", F.pmod(F.xxhash64("s"), F.lit(2)).alias("h")).collect()}
    halves = [(collections.Counter(), collections.Counter()) for _ in range(2)]
    for u in urls:
        s = signs(u)
        for i in range(order, len(s)):
            for k in range(order + 1):
                halves[half[s]][".net" in u].update([("tail", s[i - k : i + 1]), ("context", k, s[i - k : i])])
    held = [(".net" in u, mean(halves[1 - half[signs(u)]], signs(u))) for u in urls]
    (m0, s0), (m1, s1) = ((np.mean(x), np.std(x)) for x in ([r for b, r in held if b == side] for side in (False, True)))
    cut = (m0 * s1 + m1 * s0) / (s0 + s1)
    assert [got[len(urls) + j].verdict for j in range(len(free))] == ["block" if r > cut else "allow" for r in full]
    for limit in (0, 10**6):  # both ways of joining grams
        url_filter.BROADCAST_GRAMS, before = limit, url_filter.BROADCAST_GRAMS
        assert {r.page_id: r.verdict for r in url_filter.filter_urls(pages).collect()} == {i: r.verdict for i, r in got.items()}
        url_filter.BROADCAST_GRAMS = before


def test_language_model(spark):
    rows = odd_rows() + [(i, words(80, i % 7), "a") for i in range(30, 60)]
    got = language_model.score(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    toks = lambda t: (t or "").lower().split() + ["\0end"]
    train = collections.Counter(w for i, t, _ in rows if not held(i) for w in toks(t))
    n, v = sum(train.values()), len(train)
    want = sorted((i or 0, len(toks(t)), sum(w in train for w in toks(t)), sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(t))) for i, t, _ in rows)
    for w, r in zip(want, sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.base_score) for r in got), strict=True):
        assert w[:3] == r[:3] and w[3] == pytest.approx(r[3], rel=1e-9)
    assert all(r.train_tokens == n and r.held_out == held(r.doc_id) and r.score < 0 for r in got)


@pytest.mark.parametrize("small", [False, True])
def test_context_tree_weights_as_defined(spark, monkeypatch, small):
    """Every text's score by the recursive definition of the weighted mixture, over all contexts of the training texts."""
    if small:  # nothing is broadcast, blocks and pieces are small
        from striata.llm import common

        for name, value in (("FREQUENT", 5), ("KEYS_AT_ONCE", 3), ("ROWS_AT_ONCE", 2), ("HELD", 10)):
            monkeypatch.setattr(language_model, name, value)
        monkeypatch.setattr(common, "CHUNK", 7)
    texts = [b"abracadabra abracadabra", b"", "été à la mer".encode(), b"abra", b"zzz\x00 unseen", b"abracadabra"]
    rows = [(i, t.decode(), "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in language_model.score(frame(spark, rows), F.col("doc_id") < 4).collect()}
    depth, end = language_model.DEPTH, language_model.END
    symbols = lambda t: [end] * depth + list(t) + [end]
    counts = collections.Counter()  # (context nearest last, decision) -> [zeros, ones]
    for t in texts[:4]:
        s = symbols(t)
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                for known in range(8):
                    counts[tuple(s[i - d : i]), known, s[i] >> (8 - known), (s[i] >> (7 - known)) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    children = collections.defaultdict(set)
    for c, *_ in counts:
        if c:
            children[c[1:]].add(c)
    memo: dict = {}

    def weighted(c, known, prefix):
        if (key := (c, known, prefix)) not in memo:
            own = kt(counts[c, known, prefix, 0], counts[c, known, prefix, 1])
            if len(c) < depth:
                own = np.logaddexp(own, sum(weighted(k, known, prefix) for k in children[c])) - math.log(2)
            memo[key] = own
        return memo[key]

    def one(path, d, known, prefix):
        c = tuple(path[len(path) - d :])
        zeros, ones = counts[c, known, prefix, 0], counts[c, known, prefix, 1]
        own = (ones + 0.5) / (zeros + ones + 1)
        if d == depth:
            return own
        share = math.exp(kt(zeros, ones) - math.log(2) - weighted(c, known, prefix))
        return share * own + (1 - share) * one(path, d + 1, known, prefix)

    for i, t in enumerate(texts):
        s, total = symbols(t), 0.0
        for j in range(depth, len(s)):
            for known in range(8):
                p = one(s[j - depth : j], 0, known, s[j] >> (8 - known))
                total += math.log10(p if (s[j] >> (7 - known)) & 1 else 1 - p)
        assert got[i].score == pytest.approx(total, rel=1e-9) and got[i].held_out == (i >= 4)
        assert got[i].bits_per_byte == pytest.approx(-total * math.log2(10) / (len(t) + 1))


def test_mixing(spark):
    rows = odd_rows() + [(100 + i, words(5 + i % 50, i), f"s{i % 4}" if i % 9 else None) for i in range(900)]
    df = frame(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df).collect()))
    total = sum(len((t or "").split()) for _, t, _ in rows)
    assert sum(r.taken for r in got) <= total
    by = collections.defaultdict(list)
    for r in got:
        assert r.taken in {0, r.size, 2 * r.size, 3 * r.size}
        by[r.source].append(r)
    names = sorted(by, key=lambda s: (s is None, s))
    sizes = {s: sum(r.size for r in by[s]) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / max(sum(weight[s] for s in names if s not in full), 1e-9)
        more = {s for s in names if s not in full and weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        full |= more
    for s in names:
        target = 3 * sizes[s] if s in full else level * weight[s]
        assert by[s][0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in by[s]) - target) <= 2 * max(r.size for r in by[s])
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_divides_equal_finish_times(spark):
    """A source for each document: whole blocks of copies finish at the same time."""
    df = frame(spark, [(i, words(3 + i % 2, i), f"s{i:04}") for i in range(600)])
    got = sorted(map(tuple, mixing.mix(df, most=2).select("doc_id", "taken").collect()))
    assert got == sorted(map(tuple, mixing.mix(df, most=2, sort_rows=16).select("doc_id", "taken").collect()))
    assert 0 < sum(t for _, t in got) <= sum(3 + i % 2 for i in range(600))


@pytest.mark.parametrize("budget", [0, 400, 1700])
def test_mixing_cuts_among_equal_finish_times(spark, budget):
    rows = [(0.5, i % 2, i * 7919 % 11, None if i % 4 == 0 else i % 50, i, 1 + i % 6) for i in range(500)]
    want, total = None, 0
    for r in sorted(rows, key=lambda r: (*r[:3], -1 if r[3] is None else r[3], r[4])):
        total += r[5]
        if total > budget:
            want = r[:5]
            break
    df = spark.createDataFrame(rows, "t double, rank long, hash long, doc_id long, row long, size long")
    assert {tuple(mixing._first_beyond(df, 500, budget, limit)) for limit in (16, 1000)} == {want}


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, monkeypatch, small):
    if small:  # several passes, small tiles, lengths without pivots
        for name, value in (("QUERY_BYTES", 200), ("TILE", 7), ("TILES", 3), ("QUERIES", 2), ("PIVOT_BYTES", 30_000), ("SAMPLE", 30)):
            monkeypatch.setattr(topk, name, value)
    r = np.random.RandomState(5)
    x = [(i, r.randn(8).tolist()) for i in range(400)] + [(50, r.randn(8).tolist()), (900, [0.1] * 8), (901, [0.1] * 8), (100_000, [1.0, 2.0])]
    x += [(i, r.randn(3).round(1).tolist()) for i in range(500, 600)] + [(i, [0.5, 0.25] * 3) for i in range(700, 760)]
    x += [(i, [2.0**20 * (i % 7), 3.0, 1.0, 0.0]) for i in range(1000, 1060)]  # products beyond the doubles that are exact
    x += [(2, None), (3, [1.0, None] * 4), (4, [float("nan")] * 8), (None, [0.2] * 8), (50, []), (150, [])]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame([(i, v, 1, 2) for i, v in x], "vec_id long, embedding array<float>, n int, score int")).collect()))
    ok = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in x if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    want = []
    for q, v in ok:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v)))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    empty = spark.createDataFrame([(50, []), (51, [])], "vec_id long, embedding array<float>")
    assert topk.top_k(empty).count() == 0


def near_rows():
    rows = odd_rows()
    base = words(200, 77, 5000).split()
    r = np.random.RandomState(1)
    for i in range(120):  # near copies, some beyond the threshold, chained
        w = list(base)
        for p in r.choice(200, r.randint(0, 30), replace=False):
            w[p] = f"z{i}_{p}"
        rows.append((1000 + i, " ".join(w), "a"))
    passage = words(60, 78)
    rows += [(2000 + i, passage + " " + words(30, 500 + i, 100_000), "b") for i in range(80)]
    rows += [(3000 + i, "Same Text here", "c") for i in range(50)]
    return rows


@pytest.mark.parametrize(("k", "percent"), [(2, 80), (5, 80), (2, 50), (2, 95)])
def test_near_duplicates(spark, k, percent):
    rows = near_rows()
    sets = collections.defaultdict(list)
    for i, t, _ in rows:
        sets[i].append(exact_shingles((t or "").encode(), k))
    ids = [i for i in sets if i is not None]
    group = {i: i for i in ids}
    find = lambda i: i if group[i] == i else find(group[i])
    for a in ids:
        for b in ids:
            if a < b and find(a) != find(b) and any(s and 100 * len(s & t) >= percent * len(s | t) and t for s in sets[a] for t in sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    got = near_dup.near_duplicates(frame(spark, rows), k, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == find(r.doc_id) and r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(sets[r.doc_id][0])
    assert near_dup.near_duplicates(frame(spark, rows).limit(0), k, percent).count() == 0


def thue_morse(n):
    x = "a"
    for _ in range(n):
        x += x.translate({97: 98, 98: 97})
    return x


def test_near_duplicates_of_words_that_polynomial_hashes_confuse(spark):
    texts = [x for n in (10, 11, 12) for x in (thue_morse(n), thue_morse(n).translate({97: 98, 98: 97}))]
    got = near_dup.near_duplicates(frame(spark, [(i, t, "a") for i, t in enumerate(texts)]), 2).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got)


def test_near_duplicates_unite_rows_of_one_id(spark):
    a, b = words(50, 1), words(200, 2)
    rows = [(5, a, "s"), (6, a, "s"), (6, b, "s"), (7, b + " more", "s"), (8, words(50, 3), "s")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows), 2).collect())
    assert got == [(5, 5, True), (6, 5, False), (6, 5, False), (7, 5, False), (8, 8, True)]


def test_near_duplicates_at_the_threshold(spark):
    """Pairs of similarity 0.80 exactly (linked) and just below it, of equal sets in another order, and none else."""
    rows, linked = [], set()
    for p in range(300):
        w = [f"p{p}w{i}" for i in range(91)]  # 90 shingles of two words: cutting 10 at an end and adding 10 leaves 80 of 100
        extra = 10 if p % 2 == 0 else 11
        rows += [(2 * p, " ".join(w), "a"), (2 * p + 1, " ".join([*w[10:], *(f"p{p}x{i}" for i in range(extra))]), "a")]
        if p % 2 == 0:
            linked.add(2 * p + 1)
    loop = [f"c{i}" for i in range(30)]
    rows += [(900, " ".join([*loop, loop[0]]), "a"), (901, " ".join([*loop[7:], *loop[:8]]), "a")]
    got = near_dup.near_duplicates(frame(spark, rows), 2).collect()
    assert {r.doc_id for r in got if not r.kept} == linked | {901}


def test_texts_of_frequent_words_share_few_postings(spark):
    """Unlike texts have single minima in common wherever word pairs are frequent; such lists grow with the square of the corpus."""
    r = np.random.RandomState(3)
    rows = [(i, " ".join(f"v{x}" for x in r.randint(0, 40, 100)), "a") for i in range(400)]
    sets = [exact_shingles(t.encode(), 2) for _, t, _ in rows]
    assert 0.02 < np.mean([len(s & t) / len(s | t) for s, t in zip(sets, sets[1:])]) < 0.05
    tokens = near_dup.signatures(frame(spark, rows), 2).selectExpr("explode(tokens) as token")
    assert sum(n for _, n in tokens.groupBy("token").count().collect() if n > 1) < len(rows)
    assert near_dup.near_duplicates(frame(spark, rows), 2).where("kept").count() == len(rows)


def test_large_groups_meet_in_blocks_and_heavy_keys_are_dealt(spark, monkeypatch):
    from striata.llm import common

    monkeypatch.setattr(common, "HEAVY_ROWS", 5)
    monkeypatch.setattr(near_dup, "BLOCK_CLASSES", 7)
    test_near_duplicates(spark, 2, 80)


def test_one_of_each_takes_rows(spark):
    a, b = words(60, 1), words(60, 2)
    rows = [(1, a, "s"), (1, a, "s"), (1, a, "t"), (None, a, "s"), (None, b, "s"), (None, b, "s"), (2, None, "s"), (2, "", "s"), (0, a + " z", "s"), (7, b, "s"), (7, words(60, 3), "u")]
    df = frame(spark, rows)
    got = near_dup.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text or "", r.source) for r in got.collect()) == sorted([(0, a + " z", "s"), (7, b, "s"), (7, words(60, 3), "u"), (2, "", "s"), (2, "", "s")])
    assert near_dup.one_of_each(df.limit(0)).count() == 0


def test_decontaminate(spark):
    items = [(0, words(30, 900, 5000)), (1, words(6, 901, 5000)), (2, "too short"), (3, None), (None, words(12, 902, 5000)), (4, words(30, 900, 5000))]
    bench = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, doc_id string")
    rows = odd_rows() + [(50, words(4000, 9) + " " + items[0][1] + " " + words(4000, 10), "a"), (51, items[0][1][:90], "a"), (52, items[1][1].upper(), "a"), (53, items[4][1] + " " + words(300, 11), "a")]
    got = sorted((r.doc_id, -1 if r.item_id is None else r.item_id, r.shared) for r in decontaminate.find(frame(spark, rows), bench).collect())
    want = []
    for d, t, _ in rows:
        own = exact_shingles((t or "").encode(), 5, False)
        for i, u in items:
            s = exact_shingles((u or "").encode(), 5, False)
            if s and 100 * len(s & own) >= 80 * len(s):
                want.append((d, -1 if i is None else i, len(s & own)))
    assert got == sorted(want) and {x[0] for x in got} == {50, 52, 53}
    rows.append((None, rows[8][1], "a"))
    for size in (decontaminate.BLOCK_BYTES, 100):  # one index, several
        decontaminate.BLOCK_BYTES, before = size, decontaminate.BLOCK_BYTES
        kept = decontaminate.drop_contaminated(frame(spark, rows), bench)
        assert kept.columns == frame(spark, rows).columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t, _ in rows if i not in (50, 52, 53) and t != rows[8][1])
        decontaminate.BLOCK_BYTES = before


def test_sets_of_long_texts_are_compared_in_parts(monkeypatch):
    from striata.llm import common

    texts = [words(3000, 1, 500).encode(), words(3000, 2, 500).encode(), b"one two", b"", b"one  TWO"]
    want = [common.overlap(x, y, 5) for x in texts for y in texts]
    monkeypatch.setattr(common, "LONG_TEXT", 500)
    monkeypatch.setattr(common, "CHUNK", 300)
    assert want == [common.overlap(x, y, 5) for x in texts for y in texts]
    assert list(common.shingle_stream(texts[0], 5)) == [b" ".join(texts[0].split()[i : i + 5]) for i in range(2996)]
    monkeypatch.setattr(common, "BLOCK", 64)
    h, at = common.shingles_of(texts, 5)
    monkeypatch.undo()
    h2, at2 = common.shingles_of(texts, 5)
    assert (h == h2).all() and (at == at2).all()


def test_classifiers(spark):
    rows = [(i, words(80, i) + (" foulword vileword" if i % 3 == 0 else "") + (" ###" * 20 if i % 4 == 0 else ""), "a") for i in range(300)] + odd_rows()
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 3 == 0), "t") for i in range(200)] + [(None, 1, 1, "t"), (299, None, None, "t")], "doc_id long, quality int, toxic int, text string")
    tox = [r for r in toxicity.score(df, toxicity.fit(df, labels)).collect() if r.doc_id is not None and r.doc_id >= 200]
    assert all(r.toxic == (r.doc_id % 3 == 0) and 0 <= r.expected_severity <= 3 for r in tox)
    kept = toxicity.drop_toxic(df, toxicity.fit(df, labels))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect() if r.doc_id and 200 <= r.doc_id < 300} == {i for i in range(200, 300) if i % 3}
    q = [r for r in quality.score(df, quality.fit(df, labels)).collect()]
    assert len(q) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in q)
    held = [r for r in q if r.doc_id is not None and r.doc_id >= 200]
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.95
    model = toxicity.fit(df, labels)
    text_of = {i: t for i, t, _ in rows[:300]}
    for r in toxicity.score(df.where("doc_id > 9"), model).collect():
        text = text_of[r.doc_id].lower()
        n = collections.Counter(p for w in toxicity.WORD.findall(text) for p in toxicity.parts(w))
        s = sum(w for p, steps in model.weights.items() for level, w in steps if n[p] >= level)
        over = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        assert r.expected_severity == pytest.approx(sum(over)) and r.toxic == (over[0] >= toxicity.CUTOFF)
    few = labelled.labelled_sample(df.union(df), labels, "toxic", 10)
    assert few.count() == 10 and few.select("doc_id").distinct().count() == 10
    none = labels.limit(0)
    assert not any(r.toxic for r in toxicity.score(df, toxicity.fit(df, none)).collect())
    assert {r.score for r in quality.score(df, quality.fit(df, none)).collect()} == {0.5}


@pytest.mark.parametrize(("n", "few"), [(160, 100_000), (160, 5), (12_500, 1000)])
def test_quality_fit_takes_all_labelled_rows_and_pairs(spark, monkeypatch, n, few):
    monkeypatch.setattr(quality, "FEW_SCORES", few)
    r = np.random.RandomState(4)
    texts = [" ".join(r.choice(["ab", "Cd", "x1", "e,", "f."], r.randint(1, 12))) + "!" * r.randint(0, 5) for _ in range(n)]
    good = np.array([int(t.count("!") + r.randint(0, 4) > 3) for t in texts])
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    model = quality.fit(frame(spark, [(i, t, "a") for i, t in enumerate(texts)]), labels)
    x = quality.features([t.encode() for t in texts])
    assert np.allclose(model.mean, x.mean(0), rtol=1e-9, atol=1e-12)
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    raw = z @ model.w
    assert abs(model.cut - np.quantile(raw, (good == 0).mean())) < 1e-9
    if n < 1000:  # the gradient over all pairs is 0, and fewer pairs have another minimum
        d = (z[good == 1][:, None, :] - z[good == 0][None, :, :]).reshape(-1, x.shape[1])
        assert np.abs(d.T @ (1 / (1 + np.exp(-(d @ model.w))) - 1) / len(d) + 3e-3 * model.w).max() < 1e-5


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dup", "decontamination", "mixing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert name == "mixing" or out.columns == docs.columns
        assert 0 < out.count() <= docs.count()
        docs = out
    assert docs.where(F.col("taken") <= 0).count() == 0
