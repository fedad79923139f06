import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from touchline.llm import blockwise, collocations, contexts, spelling

W = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_terminal_pairs_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        letters = list("abc"[: rng.integers(2, 4)])
        words = sorted({"".join(rng.choice(letters, rng.integers(1, 7))) for _ in range(rng.integers(1, 40))})
        got = sorted(tuple(sorted(p)) for p in spelling.terminal_pairs(words, 0))
        assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if _near(words[i], words[j])]
    long = ["a" * 3000 + "b" * 3000, "a" * 3000 + "c" + "b" * 2999, "a" * 3001 + "b" * 3000]
    assert sorted(tuple(sorted(p)) for p in spelling.terminal_pairs(sorted(long), 0)) == [(0, 1), (1, 2)]


def _variants(rows, every):
    c = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    n = {w: k for w, k in c.items() if len(w) >= 5 and k >= 3}
    form = {}
    for w in n:
        near = [x for x in n if _near(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = (best if best and n[best] >= 2 * n[w] else None, len(near))
    out = []
    for w in n:
        root = w
        while form[root][0]:
            root = form[root][0]
        out.append((w, form[w][0], root, n[w], form[w][1], n.get(form[w][0])))
    return sorted(out, key=str)


@pytest.mark.parametrize("part", [4096, 3])
def test_variants_equal_brute_force(spark, docs, corpus, nothing, monkeypatch, part):
    monkeypatch.setattr(spelling, "PART", part)  # a small part takes most pairs over the parts' edges
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("aabé"), 6)) for _ in range(14)]
    more = [(200 + i, " ".join([*rng.choice(base, 30), *(w[:k] + w[k + 1 :] for w, k in zip(base, rng.integers(0, 6, 9).tolist()))])) for i in range(12)]
    more += [(300 + i, f"{'x' * 200} {'x' * 201} {'x' * 70}×{'X' * 130}") for i in range(3)] + [(None, "zzzzzz zzzzzz zzzzzz")]
    more += [(310 + i, "kkkkkk " * 6 + "kkkkkm " * 3 + "kkkkmm") for i in range(4)]  # a chain of forms
    extra = spark.createDataFrame([(d, t, None, None, 0, "", 0.0, "") for d, t in more], docs.schema)
    for every in (97, 5):
        got = spelling.variants(docs.unionByName(extra), every).collect()
        want = _variants([(r[0], r[1]) for r in corpus] + more, every)
        assert sorted(map(tuple, got), key=str) == want and any(r[1] for r in want) and (every == 5 or any(r[2] != (r[1] or r[0]) for r in want))
    assert spelling.variants(nothing).isEmpty()


def test_no_table_of_words_is_broadcast(spark, docs, monkeypatch):
    plans = []

    def written(df, tag):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return table(df, tag)

    table = spelling.written
    monkeypatch.setattr(spelling, "written", written)
    last = spelling.variants(docs, 5)
    plans.append(("last", last._jdf.queryExecution().executedPlan().toString()))
    assert {"forms", "roots", "last"} < {tag for tag, _ in plans}
    # which prefixes are cut again is a row for more than PART words
    assert [tag for tag, plan in plans if tag != "trie" and "BroadcastExchange" in plan] == []


def _scores(rows, depth):
    """Context-tree weighting by its definition, with recursion over the tree."""
    count = defaultdict(lambda: [0, 0])
    tokens = Counter()

    def steps(text):
        data = b"\xff" * depth + text.encode() + b"\xff"
        for i in range(depth, len(data)):
            node = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                yield data[i - depth : i][::-1], node, bit
                node = 2 * node + bit

    children = defaultdict(set)
    for text, held in rows:
        if not held:
            tokens.update([*W.findall(text.translate(LOW)), None])
            for ctx, node, bit in steps(text):
                for d in range(depth + 1):
                    count[ctx[:d], node][bit] += 1
                    if d < depth:
                        children[ctx[:d], node].add(ctx[: d + 1])

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(n[0] + n[1] + 1) - math.log(math.pi)

    def weighted(ctx, node):
        own = kt(count.get((ctx, node), [0, 0]))
        if len(ctx) == depth:
            return own
        return math.log(0.5) + np.logaddexp(own, sum(weighted_once(c, node) for c in children.get((ctx, node), ())))

    held_weights = {}

    def weighted_once(ctx, node):
        if (ctx, node) not in held_weights:
            held_weights[ctx, node] = weighted(ctx, node)
        return held_weights[ctx, node]

    total, kinds = sum(tokens.values()), len(tokens)
    for text, _ in rows:
        log = 0.0
        for ctx, node, bit in steps(text):
            p = None
            for d in range(depth, -1, -1):
                n = count.get((ctx[:d], node), [0, 0])
                own = (n[1] + 0.5) / (sum(n) + 1)
                if p is None:
                    p = own
                else:
                    a, b = kt(n), sum(weighted_once(c, node) for c in children.get((ctx[:d], node), ()))
                    share = 1 / (1 + math.exp(min(700, max(-700, b - a))))
                    p = share * own + (1 - share) * p
            log += math.log10(p if bit else 1 - p)
        own = [*W.findall(text.translate(LOW)), None]
        base = sum(math.log10((tokens[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own) if total else 0.0
        yield len(own), sum(tokens[w] > 0 for w in own), total, base, log


def test_context_tree_equals_its_definition(spark, docs, corpus, nothing, monkeypatch):
    monkeypatch.setattr(contexts, "PART", 500)
    some = [r for r in corpus if r[1] is None or len(r[1]) < 1500][:45] + [r for r in corpus if r[0] is None or r[0] >= 72]
    some = [r if len(r[1] or "") < 1500 else (*r[:1], r[1][:700], *r[2:]) for r in some]
    rows = spark.createDataFrame(some, docs.schema)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    got = contexts.score(rows, "crc32(encode(cast(doc_id as string), 'UTF-8')) % 10 = 0").collect()
    want = [(r[0], held(r[0]), *s) for r, s in zip(some, _scores([(r[1] or "", held(r[0])) for r in some], contexts.DEPTH))]
    key = lambda r: (str(r[0]), r[2], round(r[6], 1))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-5)
    assert any(r[1] for r in want)
    assert contexts.score(nothing, "false").isEmpty()
    none = contexts.score(rows.limit(3), "true").collect()  # nothing to learn from: every bit has probability a half
    for r in none:
        assert r["train_tokens"] == 0 and r["score"] == pytest.approx(-8 * math.log10(2) * (len((dict((x[0], x[1]) for x in some)[r["doc_id"]] or "").encode()) + 1), rel=1e-5)


def _phrases(rows, least, first):
    f, total = defaultdict(Counter), Counter()
    for t, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def test_collocations_equal_brute_force(spark, docs, corpus, nothing):
    extra = [(400 + i, "Ping pong ping pong. ping\tpong, ping  pong ping", [None, "und", "en"][i % 3]) for i in range(9)] + [(500, "a b c d e f " * 40 + "日本 日本", "en"), (501, "...", "fr"), (None, "x y x y x y", "de")]
    rows = docs.unionByName(spark.createDataFrame([(d, t, g, None, 0, "", 0.0, "") for d, t, g in extra], docs.schema))
    want = [(r[1], r[2]) for r in corpus] + [(t, g) for _, t, g in extra]
    for least, first in ((3, 2000), (2, 7)):
        got = sorted(map(tuple, collocations.collocations(rows, least, first=first).collect()))
        assert got == _phrases(want, least, first) and len(got) > 10
    assert collocations.collocations(nothing).isEmpty()


def test_phrases_are_spans_of_spaced_words():
    texts = ["Ab  \u00c9t\t c,d", "", " \U0001f642 x"]
    begin = np.cumsum([0, *(len(t.encode()) for t in texts)])
    shard = collocations.Shard(np.frombuffer("".join(texts).encode(), np.uint8), begin, ["en"] * 3)
    data, starts, stops = shard.spaced()
    words = ["ab", "\u00c9t", "c", "d", "\U0001f642", "x"]
    for k in (1, 2, 3):
        got = collocations.spans(data, starts[: len(words) - k + 1], stops[k - 1 :]).to_pylist()
        assert got == [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    assert collocations.spans(data, starts[:0], stops[:0]).to_pylist() == []


def test_windows_do_not_go_through_all_frequent_keys(monkeypatch):
    rng = np.random.default_rng(4)
    some = np.unique(rng.integers(1, 2**44, 1_000_000).astype(np.uint64))
    keys = np.concatenate([rng.choice(some, 50), rng.integers(0, 2**45, 50).astype(np.uint64), some[[0, -1]], np.zeros(1, np.uint64)])
    for few in (some, some[:1], some[:0]):
        assert np.array_equal(collocations.among(keys, few), np.isin(keys, few))
    monkeypatch.setattr(blockwise, "WINDOW", 600)
    texts = pa.RecordBatch.from_arrays([pa.nulls(100), pa.array(["one two one two " * 20] * 100), pa.array(["en"] * 100)], names=["_", "text", "lang"])
    own = collocations.Shard(np.frombuffer(b"one two one", np.uint8), np.array([0, 11]), ["en"])
    own = np.concatenate([own.word_keys(), own.pair_keys()[:-1]])

    def seconds(frequent):
        told, began, rows = {0: blockwise.pack(np.unique(frequent), True)}, time.process_time(), 0
        for b in collocations._counted(4)(told, iter([texts])):
            rows += b.num_rows
        return time.process_time() - began, rows

    (few, n), (many, m) = seconds(own), seconds(np.concatenate([own, some]))
    assert n == m == 100 * (1 + 2 + 2 + 2 + 2) and many - few < 5


def test_suffixes_are_sorted_by_their_first_words():
    rng = np.random.default_rng(3)
    ids, joined = rng.integers(0, 3, 200), rng.random(199) < 0.9
    left = collocations.lengths(joined, 200)
    assert left.tolist() == [next(k for k in range(1, 201) if i + k == 200 or not joined[i + k - 1]) for i in range(200)]
    order, shared = collocations.suffix_order(ids, left, 4)
    first = [tuple(ids[i : i + min(4, left[i])]) for i in order]
    assert first == sorted(first)
    for a, b, n in zip(first, first[1:], shared[1:]):
        assert n == next((k for k in range(4) if k >= len(a) or k >= len(b) or a[k] != b[k]), 4)


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        x = np.sort(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        assert np.array_equal(blockwise.unpack(blockwise.pack(x, True), True), x) and np.array_equal(blockwise.unpack(blockwise.pack(x, False), False), x)
    keys, counts = blockwise.together(np.array([5, 3, 5], np.uint64), np.array([1, 2, 4]))
    assert keys.tolist() == [3, 5] and counts.tolist() == [2, 5]
