"""The operators against brute force, round trips, held-out accuracy and edge rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import bpe, decontaminate, graph, langid, lm, metric_join, ngram_join, packing, quality, sharding, textops, toxicity, warc
from corpuslab.llm.queries import ORACLES, QUERIES, vocabulary_path
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_links(sets, percent):
    """Links and smallest reachable id of a list of (id, set)."""
    up, degree, inverted = list(range(len(sets))), Counter(), defaultdict(list)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, s) in enumerate(sets):
        shared = Counter(j for x in s for j in inverted[x])
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j][1]) - k):
                degree[i] += 1
                degree[j] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
        for x in s:
            inverted[x].append(i)
    low = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return {i: (degree[i], low.get(find(i))) for i in range(len(sets))}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, docs_table, n, percent, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(docs_table.select(F.col("doc_id") + 100_000, "text").toDF("doc_id", "text"))
    rows = docs.collect()
    want = brute_links([(r.doc_id, shingle_set(r.text, n)) for r in rows], percent)
    expected = Counter((r.doc_id, len(shingle_set(r.text, n)), want[i][1] if shingle_set(r.text, n) else r.doc_id, want[i][0]) for i, r in enumerate(rows))
    for block, shingles in ((2000, 1 << 20), (2, 500)):  # also with groups cut into blocks and several buckets
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "BUCKET_SHINGLES", shingles * 10)
        got = ngram_join.jaccard_classes(docs, n=n, percent=percent).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == expected


def test_t_occurrence_equals_counting():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 400, 40).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(40) < 0.08, rng.integers(0, 400, 40).astype(np.uint64), base)) for _ in range(60)]
    sets.sort(key=len)
    sizes = np.array([len(s) for s in sets])
    got = {(q, int(p)): int(o) for q, ps, os_ in ngram_join.t_occurrence(sets, sizes, None, 80) for p, o in zip(ps, os_)}
    want = {}
    for q in range(60):
        for p in range(q):
            o = len(np.intersect1d(sets[q], sets[p]))
            if 100 * o >= 80 * (sizes[q] + sizes[p] - o):
                want[q, p] = o
    assert got == want and want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_rows_hash_like_short_segments(monkeypatch):
    import pyarrow as pa

    col = pa.array(["Ab c", None, "", "x" * 5000 + " y z " * 900, " a\tb\n"])
    whole, off = textops.words(col)
    monkeypatch.setattr(textops, "SEGMENT", 700)
    cut, off2 = textops.words(col)
    assert (whole == cut).all() and (off == off2).all()
    assert np.diff(off).tolist() == [2, 0, 0, 1801, 2]


def test_packing_covers_every_id_once(spark, docs_table):
    encoder = bpe.Encoder(open(vocabulary_path(), encoding="utf-8").read())
    docs = docs_table.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    pieces = packing.pack(docs, vocabulary_path(), with_ids=True).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*encoder.library.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[r.doc_id, ids.tobytes()] += 1
    runs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        sequences[p.sequence_id].append(p)
        runs[p.doc_id, p.doc_tokens].append(p)
    padded = 0
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        total = 0
        for p in own:
            assert p.offset == total
            total += p.length
        assert total == own[0].sequence_tokens and total <= 2048
        padded += 0 if total & (total - 1) == 0 else 2048 - total
    assert padded <= 2048 * docs.rdd.getNumPartitions()
    for (doc, n), own in runs.items():
        if doc == 3:  # a repeated row
            assert sum(p.length for p in own) == 2 * n
            continue
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own[:-1]]))
        want[doc, b"".join(p.ids for p in own)] -= 1
    assert sum(v for k, v in want.items() if k[0] != 3) == 0
    groups = defaultdict(int)
    for own in sequences.values():
        groups[own[0].tier, own[0].step_group] += own[0].sequence_tokens
    assert max(groups.values()) <= packing.STEP_TOKENS


@pytest.mark.parametrize("text", ["don't 's it's 'store x 're", "a  b\n\nc \n d  ", "it''s \"'s 'll'll", "\n", "<|endoftext|> hi", "45½ $$$", "é 漢字 x's", "\t's", "1's 2're!'s", "a b  c"])
def test_piecewise_ids_equal_the_library(text):
    import pyarrow as pa

    e = bpe.Encoder(open(vocabulary_path(), encoding="utf-8").read())
    ids, off = e.column(pa.array([text, None, text + " ok"]))
    assert ids[off[0] : off[1]].tolist() == e.library.encode(text, add_special_tokens=False).ids and off[1] == off[2]


def test_feistel_is_a_permutation_and_inverts():
    for n in (1, 2, 3, 40, 41, 1000, 4097):
        p = sharding.permute(np.arange(n), n)
        assert sorted(p.tolist()) == list(range(n))
        shard, slot = sharding.place(np.arange(n), n, 40)
        assert sharding.row_at(shard, slot, n, 40).tolist() == list(range(n))


def test_shards_are_even_and_gapless(spark, docs_table, monkeypatch):
    rows = sharding.shuffle_into_shards(docs_table, 4).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        text = {x.doc_id: x.text for x in docs_table.collect()}[r.doc_id]
        assert r.size == len((text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text or "").encode())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    key = lambda rows: sorted((r.doc_id or 0, r.shard, r.slot) for r in rows)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 2)  # more ranges, same numbers
    assert key(sharding.shuffle_into_shards(docs_table.repartition(5), 4).collect()) == key(rows)


def test_spaced_seeds_find_substituted_passages(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
    swapped = list(item)
    for k in (4, 9, 14):
        swapped[k] = "other"
    clean = " ".join(item[::2])
    docs = [(1, "before it " + " ".join(item) + " after"), (2, "x y z " + ", ".join(swapped).upper()), (3, clean), (4, None), (5, ""), (6, " ".join(item[:6])), (1, " ".join(item)), (7, "tiny item")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, ""), (13, "Tiny item"), (14, " ".join(item))], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.doc_start, r.tokens, r.equal_tokens) for r in decontaminate.overlaps(docs, bench).collect())
    assert got == [(1, 10, 0, 20, 20), (1, 10, 2, 20, 20), (1, 14, 0, 20, 20), (1, 14, 2, 20, 20), (2, 10, 3, 20, 17), (2, 14, 3, 20, 17), (7, 13, 0, 2, 2)]
    assert sorted(r.doc_id for r in decontaminate.remove(docs, bench).collect()) == [3, 4, 5, 6]
    assert decontaminate.remove(docs, bench.where("false")).count() == 8


def test_decontamination_finds_every_13_gram(spark):
    clean = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    grams = defaultdict(set)
    for r in bench.collect():
        w = clean(r.text)
        for k in range(len(w) - 12):
            grams[tuple(w[k : k + 13])].add(r.item_id)
    want = {(r.doc_id, i) for r in docs.collect() for w in [clean(r.text)] for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert want <= got


def test_lm_base_score_and_normalisation(spark, docs_table):
    docs = docs_table.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    train = docs.where("coalesce(doc_id, 0) % 3 > 0")
    model, counts = lm.fit(train, frequent=200, classes=12)
    text = lambda t: [*words(t), None]
    c = Counter(w for r in train.collect() for w in text(r.text))
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.distinct) == (n, v)
    want = Counter((r.doc_id, len(text(r.text)), sum(c[w] > 0 for w in text(r.text)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in text(r.text)), 6)) for r in docs.collect())
    rows = lm.score(docs, model, counts).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert np.allclose((10.0**model.log_next).sum(1), 1)
    seen = [s for s in range(lm.OPEN) if model.mass[s]]
    for s in seen[:5]:  # emissions of an open class sum to one over its words and the unknown word
        own = [k for k in c if k and int(lm._LAST[k.encode()[-1]] + lm._GROUPS * (not k.isascii())) == s]
        import pyarrow as pa

        h = lm.sequence(pa.array([" ".join(own)]))[0][:-1]
        at, there = model.units.find(h)
        top = there & (model.units.rank[at] < model.units.frequent)
        count = np.array([c[k] for k in own])[~top]
        total = (10.0 ** model.log_open(count, np.full(len(count), s))).sum() + 10.0 ** model.log_unknown[s]
        assert abs(total - 1) < 1e-6


def test_lm_gives_every_training_word_a_class_by_its_neighbours(spark):
    rng = np.random.default_rng(1)
    rare = {g: [f"{g}{i}x" for i in range(300)] for g in "pq"}  # equal last bytes: the shape does not tell the groups apart
    texts = []
    for _ in range(400):
        t = []
        for _ in range(6):
            g = "pq"[rng.integers(2)]
            t += [f"{g}left{rng.integers(3)}", rare[g][min(299, int(rng.pareto(0.5)))], f"{g}right{rng.integers(3)}"]
        texts.append((" ".join(t),))
    model, counts = lm.fit(spark.createDataFrame(texts, "text string"), frequent=24, classes=6)
    rows = {r.word: r for r in counts.collect()}
    assert all(0 <= r.cls < model.k for r in rows.values()) and len(rows) == model.distinct - 1  # without the end of text
    import pyarrow as pa

    seen = Counter(w for (t,) in texts for w in t.split())
    of = {w: rows[int(lm.sequence(pa.array([w]))[0][:1].view(np.int64)[0])] for w in seen}
    found = {g: {of[w].cls for w in rare[g] if w in of} for g in "pq"}
    assert not found["p"] & found["q"]
    assert model.placed == len(of) - 24 and model.moved <= lm.FEW * model.placed
    for c in range(model.k):  # emissions of a class sum to one
        n = np.array([r.n for r in rows.values() if r.cls == c])
        assert abs((10.0 ** model.log_emission(n, np.full(len(n), c))).sum() - 1) < 1e-6
    assert np.allclose((10.0**model.log_next).sum(1), 1)


def test_best_class_is_the_largest_gain_of_the_likelihood():
    rng = np.random.default_rng(2)
    matrix, vectors, cls = rng.integers(50, 400, (4, 10)).astype(float), rng.integers(0, 40, (30, 10)), rng.integers(-1, 4, 30)
    vectors[:8] = 0
    vectors[range(8), [0, 1, 4, 0, 1, 4, 2, 2]] = vectors[range(8), [5, 9, 6, 5, 9, 6, 7, 7]] = 1  # seen once
    entry, slot = np.nonzero(vectors)
    got = lm.best_class(matrix, entry, slot, vectors[entry, slot], cls)
    assert (lm.placed(matrix, np.bincount(entry), slot, vectors[entry, slot], cls) == got).all()
    likelihood = lambda m: lm._xlogx(m).sum() - lm._xlogx(m[:, :5].sum(1)).sum() - lm._xlogx(m[:, 5:].sum(1)).sum()
    for w, v in enumerate(vectors):
        rest = matrix.copy()
        if cls[w] >= 0:
            rest[cls[w]] -= v
        assert got[w] == max(range(4), key=lambda c: likelihood(rest + np.eye(4)[c][:, None] * v))


def test_lm_lookup_sends_words_only_and_bounds_its_groups(spark, docs_table, monkeypatch):
    docs = docs_table.select("doc_id", "text")
    model, counts = lm.fit(docs.where("doc_id <> 2"), frequent=5, classes=3, known=5)
    want = Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs, model, counts).collect())
    monkeypatch.setattr(lm, "CHUNK_WORDS", 20)
    monkeypatch.setattr(lm, "RANGE_WORDS", 20)
    monkeypatch.setattr(lm, "ASKED_WORDS", 20)
    groups, real = [], lm._asks
    monkeypatch.setattr(lm, "_asks", lambda bits, parts: groups.append((bits, parts)) or real(bits, parts))
    docs = docs.crossJoin(spark.range(8).select(F.col("id").alias("copy"))).repartition(8, "copy").drop("copy")
    got = Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs, model, counts).collect())
    assert got == Counter({k: 8 * n for k, n in want.items()})
    assert groups[0][0] > 0 and groups[0][1] > 1  # ranges are cut by the vocabulary, and further by what the chunks ask


def class_likelihood(b, cls):
    one = np.zeros((len(b), cls.max() + 1))
    one[np.arange(len(b)), cls] = 1
    g = one.T @ b @ one
    return lm._xlogx(g).sum() - lm._xlogx(g.sum(0)).sum() - lm._xlogx(g.sum(1)).sum()


def test_exchange_ends_where_no_single_move_helps():
    b = np.random.default_rng(0).integers(0, 5, (14, 14)).astype(float)
    cls = lm.exchange(b, 12, 4)
    for w in range(12):
        for to in range(4):
            other = cls.copy()
            other[w] = to
            assert class_likelihood(b, other) <= class_likelihood(b, cls) + 1e-6


def test_exchange_recovers_planted_classes():
    rng = np.random.default_rng(0)
    group, f = rng.integers(0, 4, 60), rng.pareto(1.2, 60) + 1
    follows = np.where((group[:, None] + 1) % 4 == group[None, :], 1.0, 0.05)
    cls = lm.exchange(np.pad(rng.poisson(np.outer(f, f) * follows * 5).astype(float), ((0, 1), (0, 1))), 60, 4)
    assert len(set(zip(cls[:60].tolist(), group.tolist()))) == 4


def test_archive_round_trip(spark, tmp_path):
    big, other = "é" * 600, "b\r\n\r\nc" * 300
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, other), (4, "http://d", "small"), (5, "http://e\r\nX", "small"), (6, "u", None), (7, "u", ""), (None, "n", big), (2, "http://b", big), (8, "z", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("clash"))
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    got = sorted(((r.page_id or 0), r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_index(spark, path).collect())
    assert got == sorted([(1, 1200, "revisit", 2), (2, 1200, "response", None), (2, 1200, "response", None), (0, 1200, "revisit", 2), (3, 1800, "revisit", 8), (8, 1800, "response", None), (4, 5, "response", None), (5, 5, "response", None), (6, 0, "response", None), (7, 0, "response", None)])
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    for r in warc.records(spark, path, full_revisits=True).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest == (bytes(r.payload) if r.record_type == "response" else b"") + b"\r\n\r\n" and length == len(rest) - 4
    warc.export_warc(spark, path, str(tmp_path / "files"))
    found = 0
    for f in (tmp_path / "files").glob("part-*"):
        data = f.read_bytes()
        while data:  # a plain reader: header, Content-Length bytes, end mark
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert rest[n : n + 4] == b"\r\n\r\n"
            data, found = rest[n + 4 :], found + 1
    assert found == len(rows)


def test_metric_join_edge_rows_and_cells(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6))
    x = np.concatenate([base, base + rng.normal(scale=0.15, size=base.shape), base[:5] * 2])
    rows = [(i, [float(np.float32(v)) for v in r], i % 2) for i, r in enumerate(x)]
    rows += [(100, None, 0), (101, [0.0] * 6, 0), (102, [1.0, None] * 3, 0), (103, [float("nan")] * 6, 1), (104, rows[0][1], None), (105, rows[0][1], 0), (105, rows[0][1], 0), (106, [1.0, 2.0], 0), (107, [], 1), (None, rows[3][1], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit("clash"))
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    sets = brute = Counter()
    up = list(range(len(ok)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    deg = Counter()
    for i in range(len(ok)):
        for j in range(i):
            a, b = ok[i], ok[j]
            if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / math.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.93:
                deg[i] += 1
                deg[j] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (v, _, _) in enumerate(ok):
        if v is not None:
            low[find(i)] = min(low.get(find(i), v), v)
    expected = Counter((v, deg[i], low.get(find(i))) for i, (v, _, _) in enumerate(ok))
    expected += Counter((i, 0, i) for i, v, lab in rows if not (lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)))
    for cell, block in ((2000, 2000), (8, 5)):
        monkeypatch.setattr(metric_join, "CELL", cell)
        monkeypatch.setattr(metric_join, "BLOCK", block)
        got = metric_join.near_vectors(vectors).collect()
        assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == expected
        assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name])["ok"]


def held_out_accuracy(rows, truth, column):
    own = [(r[column], truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return sum(a == b for a, b in own) / len(own)


def test_held_out_accuracy_of_the_classifiers(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert held_out_accuracy(QUERIES["op10_language_filters"](spark, sf).collect(), langs, "lang_pred") > 0.99
    assert held_out_accuracy(QUERIES["op8_compression_quality"](spark, sf).collect(), {r.doc_id: r.quality for r in labels}, "predicted") > 0.9
    assert held_out_accuracy(QUERIES["op3_convolutional_toxicity"](spark, sf).collect(), {r.doc_id: r.toxic for r in labels}, "predicted") > 0.85


def test_classifiers_on_edge_rows(spark, docs_table):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 1), (9, None, None), (None, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
    n = docs_table.count()
    model = langid.fit(docs_table)
    out = {(r.doc_id, r.text): r for r in langid.predict(docs_table, model).collect()}
    assert len(out) == n - 1 and {r.lang_pred for k, r in out.items() if k[1] in (None, "", "12345 !!! ...", " \t\n")} == {"und"}
    assert out[8, next(k[1] for k in out if k[0] == 8)].lang_pred == "fr"
    for op, labelled in ((quality, True), (toxicity, True), (quality, False), (toxicity, False)):
        m = op.fit(docs_table, labels if labelled else labels.where("false"), F.lit(True))
        rows = op.predict(docs_table, m).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    empty = docs_table.where("false")
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    for op in (quality, toxicity):
        assert op.predict(empty, op.fit(empty, labels, F.lit(True))).count() == 0
    assert ngram_join.jaccard_classes(empty).count() == 0
    assert packing.pack(empty, vocabulary_path()).count() == 0
    assert sharding.shuffle_into_shards(empty).count() == 0
    assert decontaminate.overlaps(empty, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    m, counts = lm.fit(empty)
    assert lm.score(empty, m, counts).count() == 0 and lm.score(docs_table, m, counts).count() == n


def test_language_masks_of_more_than_64_languages(spark):
    rng = np.random.default_rng(1)
    grams_of = {f"l{i:02d}": rng.integers(0, 2**32, 50, dtype=np.uint64).astype(np.uint32) for i in range(70)}
    f = langid.LanguageFilters(grams_of, {k: 1 for k in grams_of})
    for i, (lang, g) in enumerate(sorted(grams_of.items())):
        hit = np.ones(len(g), bool)
        for s in langid.slots(g, f.hashes, f.total):
            hit &= (f.table[i // 64][s] >> f.table.dtype.type(i % 64)) & f.table.dtype.type(1) == 1
        assert hit.all()
