"""The pipeline and the queries without SQL, on a small fixture, against brute force; and every operator on empty tables."""

import collections
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from striata.llm import decontaminate, language_model, license_scan, mixing, near_dup, quality, queries, token_count, topk, toxicity, url_filter
from striata.llm.common import exact_shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SOURCES = ("web", "books", None, "code")


def prose(n, seed, size=3000):
    r = np.random.RandomState(seed)
    return " ".join(f"Word{x}," if x % 9 == 0 else f"word{x}" for x in r.randint(0, size, n))


def is_toxic(i):
    return i < 300 and i % 3 == 0


def fixture_rows():
    item = prose(30, 9000)
    rows = []
    for i in range(300):
        text = prose(40 + i % 60, i)
        text += " foulword vileword" * 3 if is_toxic(i) else ""
        text += " ### ||| $$$" * 15 if i % 4 == 1 else ""
        rows.append((i, text, SOURCES[i % 4 if i % 8 else 0]))
    base = prose(120, 7000).split()
    for i in range(20):  # near copies; the later ones too far off
        w = list(base)
        for p in range(i):
            w[p * 6] = f"other{i}x{p}"
        rows.append((400 + i, " ".join(w), "web"))
    rows += [(450 + i, prose(50, 7100), "books") for i in range(12)]
    rows += [(480, prose(300, 7200) + " " + item + " " + prose(300, 7201), "web"), (481, item, "books"), (482, " ".join(item.split()[:12]), "web")]
    rows += [(490, None, "web"), (491, "", None), (492, "few words", "code"), (493, prose(20_000, 7300), "web")]
    rows += [(494, prose(30, 7400), "web"), (494, prose(30, 7400), "web")]
    return rows, [(0, item), (1, "too short"), (2, None), (3, prose(12, 9001))]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rows, items = fixture_rows()
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    labels = [(i, int(i % 4 != 1), int(is_toxic(i))) for i in range(200)] + [(490, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def near_groups(rows, k):
    """doc_id -> smallest doc_id reachable."""
    sets = [(i, exact_shingles((t or "").encode(), k)) for i, t, _ in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for n, (a, s) in enumerate(sets):
        for b, t in sets[:n]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in root}


def fair_queue(spark, rows):
    """(doc_id, source, size, source_size, target, taken) by one sorted list of all copies."""
    size = [len((t or "").split()) for _, t, _ in rows]
    salts = [xxhash.xxh3_64_intdigest((t or "").encode()) - 2**63 for _, t, _ in rows]
    keyed = spark.createDataFrame([(n, i, s, salt) for n, ((i, _, _), s, salt) in enumerate(zip(rows, size, salts, strict=True))], "row long, doc_id long, size long, salt long")
    hashes = {r.row: r.h for r in keyed.select("row", mixing.shuffled(17).alias("h")).collect()}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[r % 3] for r, s in enumerate(names)}
    of = {s: sum(z for z, (_, _, x) in zip(size, rows, strict=True) if x == s) for s in names}
    total, target, open_sources = sum(size), {}, set(names)
    while True:
        left = total - sum(target.values())
        shares = {s: left * weight[s] / sum(weight[x] for x in open_sources) for s in open_sources}
        over = {s for s in open_sources if shares[s] > 3 * of[s]}
        if not over:
            target |= shares
            break
        target |= {s: 3.0 * of[s] for s in over}
        open_sources -= over
    copies = []
    for rank, s in enumerate(names):
        end = 0
        for n in sorted((n for n in range(len(rows)) if rows[n][2] == s), key=lambda n: (hashes[n], rows[n][0], size[n])):
            end += size[n]
            copies += [((end + e * of[s]) / target[s], rank, hashes[n], n) for e in range(3) if size[n] and end + e * of[s] - size[n] < target[s]]
    taken, used = collections.Counter(), 0
    for *_, n in sorted(copies):
        used += size[n]
        if used > total:
            break
        taken[n] += size[n]
    return [(i, s, size[n], of[s], target[s], taken[n]) for n, (i, _, s) in enumerate(rows)]


def same_mix(got, want):
    order = lambda r: (r[0], r[2], r[5])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert (g[:4], g[5]) == (w[:4], w[5]) and g[4] == pytest.approx(w[4])


def test_pipeline_against_brute_force(spark, sf):
    rows, items = fixture_rows()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = [r for r in rows if not is_toxic(r[0])]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in kept], DOCS)
    model = quality.fit(docs, labels)
    kept = [r for r in kept if model.score(quality.features([(r[1] or "").encode()]))[0] >= quality.CUT]
    assert not any(i < 300 and i % 4 == 1 for i, _, _ in kept) and sum(i < 300 for i, _, _ in kept) > 120
    group = near_groups(kept, 5)
    assert len(set(group.values())) < len(group)
    kept = [r for r in kept if group[r[0]] == r[0]]
    sets = [exact_shingles((u or "").encode(), 5, False) for _, u in items]
    clean = [r for r in kept if not any(s and 100 * len(s & exact_shingles((r[1] or "").encode(), 5, False)) >= 80 * len(s) for s in sets)]
    assert {r[0] for r in kept} - {r[0] for r in clean} == {480, 481}
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    same_mix([tuple(r) for r in got.collect()], [r for r in fair_queue(spark, clean) if r[5] > 0])


def test_mixing_query_against_brute_force(spark, sf, monkeypatch):
    key = lambda r: (r.doc_id, r["size"], r.source_size, r.target, r.taken)
    got = queries.op6_mix_sources(spark, sf).withColumn("n", F.lit(0))
    docs = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    same_mix([tuple(r) for r in docs], fair_queue(spark, fixture_rows()[0]))
    for name, value in (("WINDOW_ROWS", 3), ("GROUP", 4), ("BROADCAST_SOURCES", 0)):  # many ranges and groups, a shuffled join of the targets
        monkeypatch.setattr(mixing, name, value)
        assert sorted(map(key, got.collect())) == sorted(map(key, queries.op6_mix_sources(spark, sf).collect()))
    assert sorted(map(key, got.collect())) == sorted(map(key, docs))


def test_quality_query_on_held_out_rows(spark, sf):
    got = queries.op10_quality(spark, sf).collect()
    assert len(got) == len(fixture_rows()[0])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert len(held) > 30 and np.mean([r.predicted == int(r.doc_id % 4 != 1) for r in held]) > 0.95


def test_toxicity_query_on_unlabelled_rows(spark, sf):
    got = [r for r in queries.op2_toxicity(spark, sf).collect() if r.doc_id >= 200]
    assert all(r.toxic == is_toxic(r.doc_id) and 0 <= r.expected_severity <= 3 for r in got)


def test_licence_query_against_brute_force(spark, sf):
    import re

    got = queries.op1_license_scan(spark, sf).collect()
    text = collections.defaultdict(list)
    for i, t, _ in fixture_rows()[0]:
        text[i].append(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())))
    assert sorted((r.doc_id, r.n_words) for r in got) == sorted((i, n) for i, ns in text.items() for n in ns)
    assert all((r.n_base, r.labels, r.first_word) == (0, "", None) for r in got)


@pytest.mark.parametrize("kind", ["empty", "null", "repeated"])
def test_pipeline_on_odd_tables(spark, tmp_path, kind):
    """No rows; nulls in every column; repeated, null and shared ids, with clashing column names."""
    text, other, item = prose(60, 1), prose(60, 2), prose(30, 9000)
    rows = {
        "empty": [], "null": [(None, None, None, None, None, None, None)] * 3,
        "repeated": [(1, text, "en", "a", 0, "r", 1)] * 3 + [(None, text, "en", "a", 0, "r", 1), (None, prose(20, 3) + " " + item, "en", "b", 0, "r", 1), (2, prose(20, 4) + " " + item, "en", "b", 0, "r", 1), (2, other, "en", "b", 0, "r", 1), (None, prose(50, 5), None, None, None, None, None)],
    }[kind]
    spark.createDataFrame(rows, DOCS + ", row string, n long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if kind == "empty" else [(None, None), (0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([] if kind == "empty" else [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "n"]
    want = {"empty": [], "null": [None] * 3, "repeated": [None, 1, 2]}[kind]
    assert sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i or 0)) == want
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in mixed} <= set(want) and all(r["size"] > 0 for r in mixed)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, prose(40, 1), "en", "a", 0)], DOCS)
    for out in (
        license_scan.scan(docs), token_count.count_tokens(docs), language_model.score(docs), mixing.mix(docs), near_dup.near_duplicates(docs),
        decontaminate.find(docs, items), decontaminate.find(one, items), toxicity.score(docs, toxicity.fit(docs, labels)), quality.score(docs, quality.fit(docs, labels)),
        url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")), topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert out.count() == 0
    nothing = language_model.score(one, training=F.lit(False)).collect()[0]
    assert nothing.train_tokens == 0 and nothing.n_known == 0 and nothing.score < 0
    assert near_dup.one_of_each(one).count() == decontaminate.drop_contaminated(one, items).count() == 1


def test_all_columns_null(spark):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 3, DOCS)
    labels = spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(None, None)], "item_id long, text string")
    for out in (license_scan.scan(docs), token_count.count_tokens(docs), language_model.score(docs), mixing.mix(docs), near_dup.near_duplicates(docs), toxicity.score(docs, toxicity.fit(docs, labels)), quality.score(docs, quality.fit(docs, labels))):
        assert [r.doc_id for r in out.collect()] == [None] * 3
    assert decontaminate.find(docs, items).count() == 0
    assert [(r.host, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame([(None, None)], "page_id long, url string")).collect()] == [("", "allow")]
    assert topk.top_k(spark.createDataFrame([(None, None), (50, [None])], "vec_id long, embedding array<float>")).count() == 0
