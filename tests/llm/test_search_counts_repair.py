"""Ranked search, token counts and conversation repair against brute force, the tokenizer library and their SQL."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import conversation_repair as repair
from corpuslab.llm import ranked_search, token_counts
from corpuslab.llm.queries import ORACLES, QUERIES, vocabulary_path
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    """Sorted (item, rank, score) and the sets of ids at each score, from the formula."""
    counts = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, q in asked.items():
        scored = []
        for d, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in q if c[t])
            if s > 0:
                scored.append((-s, math.inf if d is None else d))
        out += [(item, r + 1, None if d == math.inf else d, -s) for r, (s, d) in enumerate(heapq.nsmallest(k, scored))]
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, docs_table, small, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(docs_table.select("doc_id", "text"))
    items = [(1, "the cat sat; the hens slept"), (1, "and the BARN"), (2, None), (3, ""), (None, "le chat 漢字 12345"), (4, "zzzz-unknown"), (5, "x"), (6, "cat cat cat")]
    items += [(100 + r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    table = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, text string, doc_id string")
    if small:  # many chunks, blocks, groups and passes
        monkeypatch.setattr(ranked_search, "CELLS", 64 * 40)
        monkeypatch.setattr(ranked_search, "GROUP_TERMS", 40)
    got = ranked_search.search(docs, table, k=3 if small else 10, pass_terms=200 if small else ranked_search.PASS_TERMS).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == brute_search(rows, items, 3 if small else 10)


def test_search_blocks_are_skipped_without_loss():
    rng = np.random.default_rng(5)
    topics = rng.random((6, 300)) < 0.05
    impacts = np.where(topics[rng.integers(0, 6, 4000)] & (rng.random((4000, 300)) < 0.6), rng.integers(1, 900_000, (4000, 300)), 0).astype(np.int32)
    weights, ids = rng.integers(1, 9000, 300), rng.permutation(4000)
    queries = [np.unique(rng.choice(np.flatnonzero(topics[i % 6]), 6)) for i in range(12)]
    chunk = ranked_search.Chunk(impacts, weights, ranked_search._partners(np.arange(300), list(enumerate(queries))))
    for q in queries:
        score, found = chunk.search(q, (np.zeros(0, np.int64), np.zeros(0, np.int64)), ids, 10)
        full = impacts[:, q].astype(np.int64) @ weights[q]
        want = sorted(zip((-full).tolist(), ids.tolist()))[:10]
        assert [(-s, d) for s, d in zip(score.tolist(), found.tolist())] == [x for x in want if x[0] < 0]
    assert chunk.skipped > chunk.looked_up / 4 and chunk.scored < 12 * 4000 / 4
    for docs, starts, ends, summary in chunk._blocks.values():
        assert len(np.unique(docs)) == len(docs) and (summary >= 0).all() and ends[-1] == len(docs)


def test_search_of_empty_tables(spark, docs_table):
    empty = docs_table.select("doc_id", "text").limit(0)
    items = spark.createDataFrame([(1, "the cat")], "item_id long, text string")
    assert ranked_search.search(empty, items).count() == 0
    assert ranked_search.search(docs_table, items.limit(0)).count() == 0


def naive_tokens(piece, pairs, made):
    symbols = list(piece)
    while True:
        found = [(pairs[a << 32 | b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a << 32 | b in pairs]
        if not found:
            return len(symbols)
        rank, i = min(found)
        symbols[i : i + 2] = [made[rank]]


def test_heap_merging_equals_naive_merging():
    with open(vocabulary_path(), encoding="utf-8") as f:
        table = token_counts.MergeTable(f.read())
    rng = random.Random(3)
    pieces = [b"", b"a", b" the", b"aaaaaaa", "naïve".encode(), b" " * 40] + [bytes(rng.choice(b"the aonis") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    for p in pieces:
        assert len(p) - token_counts.merges(p, table.pairs, table.made) == naive_tokens(p, table.pairs, table.made)


def test_token_counts_equal_the_library(spark, docs_table):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    rng = random.Random(1)
    alphabet = "ab 'st\n\t <|endoftext|>éñ漢字　\U0001f600٣x1²'re‍́ﬁⅧ "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>", " <|endoftext|><|endoftext|> x"]) for _ in range(400)]
    texts += ["a" * 3000, " " * 3000, "<|endoftext|", "it's we'll I'd", None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(r.doc_id, r.text) for r in docs_table.collect()]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, over_limit string")
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows)
    for cache in (token_counts.CACHE_PIECES, 50):  # also with a cache that keeps starting anew
        got = token_counts.token_counts(table, vocabulary_path(), cache_pieces=cache).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.token_counts(table.limit(0), vocabulary_path()).count() == 0


def test_vocabularies_of_other_kinds_are_refused():
    with open(vocabulary_path("word_bpe_49k.json"), encoding="utf-8") as f:
        with pytest.raises(ValueError):
            token_counts.MergeTable(f.read())


def brute_edits(code):
    """Every edit sequence of at most the cost of deleting all rows; the cheapest, then ASCII-least."""
    best = (4 * len(code), "D" * len(code))
    todo = [(0, "", "", 0)]
    while todo:
        i, audit, roles, cost = todo.pop()
        if (cost, audit) > best and cost >= best[0]:
            continue
        if i == len(code) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit))
        if cost + 3 <= best[0]:
            todo += [(i, audit + "I", roles + c, cost + 3) for c in "ua"]
        if i < len(code):
            row, extra = code[i].lower(), 3 * code[i].isupper()
            todo.append((i + 1, audit + "D", roles, cost + 4))
            if row != "d":
                todo += [(i + 1, audit + "R", roles + c, cost + 3 + extra) for c in "ua"]
                todo.append((i + 1, audit + "K", roles + ("" if row == "e" else row), cost + extra))
    return best


def test_branch_and_bound_equals_enumeration():
    rng = random.Random(11)
    codes = {"".join(rng.choice("dsuaxSUAeuaua") for _ in range(rng.randint(0, 5))) for _ in range(150)} | {"", "d", "s", "u", "a", "ua", "sua", "au", "uu", "ss", "sS"}
    for code in codes:
        assert repair.cheapest_edits(code) == brute_edits(code), code
    cost, audit = repair.cheapest_edits("ua" * 30_000 + "u")
    assert cost == 3 and len(audit) == 60_002


def python_repair(rows):
    """The whole result of one conversation (turn, role, text), written out plainly."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda v: (v[0] is not None, v[0] or 0, hashlib.md5(f"{len(v[1])}:{v[1]}{v[2]}".encode()).hexdigest()))
    seen, code, count = set(), "", Counter()
    for t, r, x in rows:
        vis = x.strip(" \t\n\x0b\x0c\r")
        letter = "e" if r == "" else r[0] if r[0] in "sua" else "x"
        if not vis:
            count["blank"] += 1
            code += "d"
        elif (r, x) in seen:
            count["duplicate"] += 1
            code += "d"
        elif vis[-1] not in ".!?":
            count["truncated"] += 1
            code += letter.upper()
        else:
            code += letter
        seen.add((r, x))
    count["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = brute_edits(code)
    lines, i, states = [], 0, None
    for options in range(1 << sum(e in "IR" for e in audit)):  # which role each I and R gives
        lines, i, bit = [], 0, 0
        for e in audit:
            role, text = ("", "") if e == "I" else rows[i][1:]
            i += e != "I"
            if e in "IR":
                role = ("user", "assistant")[options >> bit & 1]
                bit += 1
            if e != "D":
                lines.append((role, text))
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines)):
            break
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()
    return (gaps, count["blank"], count["duplicate"], count["truncated"], count["illegal"], cost, audit, sha), lines


def test_repair_of_odd_conversations(spark):
    rng = random.Random(2)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "unicorn"], ["Yes.", "Yes.", "no", "", " \n", None, "a. ", "Why?  ", "x!\n"]
    rows = [(c if c else None, rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(roles), rng.choice(texts)) for c in range(40) for _ in range(rng.randint(1, 5))]
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", "Fine. " * 2000) for t in range(4)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int")
    ids = spark.createDataFrame([(1,), (900,), (None,), (900,)], "conv_id long")
    plan = repair.written(repair.plans(table, ids), "plans")
    got = {r.conv_id: tuple(r)[1:] for r in repair.summaries(table, plan).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r, x))
    assert set(got) == set(by) | {900} and got[900] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    turns = defaultdict(list)
    for r in repair.repaired(table, plan).orderBy("conv_id", "position").collect():
        assert r.position == len(turns[r.conv_id])
        turns[r.conv_id].append((r.role, r.text))
    for c, own in by.items():
        want, lines = python_repair(own)
        assert got[c] == want, (c, own)
        assert turns[c] == lines
    empty = table.limit(0)
    assert repair.damage_and_repair(empty).count() == 0 and repair.repaired(empty, plan.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", f"One. Two! {c}?") for c in range(60) for t in range(3)] + [(None, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = Counter()
    for c, t, r, x in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        for _ in range({0: 0, 3: 2}.get(code, 1)):
            want[(c, t, "user" if code == 4 else r, "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x)] += 1
    assert Counter(tuple(r) for r in repair.damaged(table).collect()) == want


@pytest.mark.parametrize("name", ["op11_geometric_blocks_search", "op13_conversation_repair"])
def test_queries_equal_their_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name])["ok"]


def test_token_count_query(spark):
    got = QUERIES["op12_heap_token_counts"](spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    row = got.agg(F.count("*"), F.sum("n_bytes"), F.min("n_tokens")).first()
    docs = spark.read.parquet(f"{SF}/documents.parquet").agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    assert tuple(row)[:2] == tuple(docs) and row[2] >= 0
