import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from touchline.llm import archive, bitslice, blocks, common, jaccard, lines
from touchline.llm.common import components, scratch_path
from touchline.llm.lines import even

W = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def _roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return [find(i) for i in range(n)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (3, 30), (30, 29), (29, 28), (28, 27), (10, 11), (11, 10)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 30: 1, 29: 1, 28: 1, 27: 1, 10: 10, 11: 10}


@pytest.mark.parametrize("block", [512, 4])
def test_join_equals_brute_force(docs, corpus, nothing, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # a small block takes every cell through the path of hot ones
    sets = []
    for r in corpus:
        w = W.findall((r[1] or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if corpus[i][0] is not None and corpus[j][0] is not None and (corpus[i][0] == corpus[j][0] or (sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])))]
    root, least = _roots(len(sets), linked), {}
    for i, r in enumerate(corpus):
        if r[0] is not None:
            least[root[i]] = min(r[0], least.get(root[i], r[0]))
    want = sorted((str(r[0]), len(sets[i]), str(least[root[i]] if r[0] is not None else None)) for i, r in enumerate(corpus))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.join(docs).collect()) == want
    assert jaccard.join(nothing).isEmpty()
    kept = jaccard.thin_out(docs)
    assert kept.columns == docs.columns
    none = sum(r[0] is None for r in corpus)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([str(x) for x in {int(v) for v in least.values()}] + ["None"] * none)


def test_points_bound_overlaps_at_every_size():
    rng = np.random.default_rng(8)
    for n, m, both in ((5, 6, 5), (130, 160, 130), (3000, 3500, 2900), (300, 20_000, 100), (0, 4, 0)):
        every = rng.integers(0, 2**63, n + m, dtype=np.int64).astype(np.uint64)
        a, b = every[:n], np.concatenate([every[:both], every[n : n + m - both]])
        x, y = (jaccard.point_of(jaccard.packed_point(s)) for s in (a, b))
        groups = min(x.size, y.size)
        assert x.sum() == a.size and y.sum() == b.size
        assert np.minimum(jaccard.folded(x, groups), jaccard.folded(y, groups)).sum() >= both
    assert jaccard.point_of(jaccard.packed_point(np.full(1000, 1 << 20, np.uint64))).max() == 1000


def test_documents_known_by_earlier_texts(spark):
    full = [(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(4)]
    docs = spark.createDataFrame([full[0], full[1], (2, "only a scrap is left"), (3, full[3][1])], "doc_id long, text string")
    # documents with texts of very different sizes, that share a passage in several cells
    long = " ".join(f"v{k}" for k in range(1500))
    mixed = spark.createDataFrame([(i, t) for i in range(5) for t in (f"{long} " + " ".join(f"q{i}z{k}" for k in range(700 + 300 * i)), " ".join(f"v{k}" for k in range(40 + 3 * i)))], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.join(mixed).collect()} == {0}
    also = spark.createDataFrame([full[0], full[1], (2, full[1][1] + " more"), full[3], (9, full[3][1])], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in jaccard.thin_out(docs).collect()) == [0, 1, 2, 3]
    assert sorted(r["doc_id"] for r in jaccard.thin_out(docs, also=also).collect()) == [0, 1, 3]


def test_lines_equal_brute_force(spark, nothing):
    rng = np.random.default_rng(5)
    line = lambda: "".join(rng.choice(list("abcdefghij  "), 90))
    base = [line() for _ in range(30)]
    near = [b[:40] + "Z" + b[41:] for b in base[:8]]
    rows = [(i, "\n".join([*rng.choice(base + near, 5).tolist(), "", "one two", line()])) for i in range(40)] + [(50, None), (51, ""), (52, " \n\n"), (53, "ab\nab\ncd"), (None, base[0]), (None, base[0])]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, _split string, line int")
    every = [(d, i, x) for d, t in rows if d is not None for i, x in enumerate((t or "").split("\n")) if even(x)]
    every.sort()
    sets = [{even(x)[k : k + 7] for k in range(max(1, len(even(x)) - 6))} for _, _, x in every]
    links = [(i, j) for i in range(len(every)) for j in range(i) if every[i][2] == every[j][2] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = _roots(len(every), links)
    gone = {(d, i) for k, (d, i, _) in enumerate(every) if root[k] != k}
    want = sorted((str(d), None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in rows if t is not None)
    out = lines.dedup(df)
    assert out.columns == [*df.columns, "_lines", "_removed"]
    got = out.collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got if r["text"] is not None) == want
    assert sum(r["_removed"] for r in got) == len(gone)
    assert lines.dedup(nothing).isEmpty()


@pytest.mark.parametrize("piece", [50_000, 20])
def test_many_lines_are_hashed_at_once_as_each_alone(monkeypatch, piece):
    monkeypatch.setattr(lines, "PIECE", piece)
    rng = np.random.default_rng(21)
    some = ["".join(rng.choice(list("abcdeF \t\x0b\x1c\x85\xa0\u3000É\u03a3ß日\U0001f642İ"), n)) for n in rng.integers(0, 60, 300)] + ["", "a", "A\u03a3", "  ab  cdefgh "]
    for every in (some, [x.encode("ascii", "ignore").decode() for x in some], ["a"], [""], []):
        codes, begin = lines.evened(every)
        assert ["".join(map(chr, codes[a:b].tolist())) for a, b in zip(begin, begin[1:])] == [even(x) for x in every]
        full = [x for x in every if even(x)]
        if full:
            together = lines.bands(*lines.evened(full))
            assert (together == np.concatenate([lines.bands(*lines.evened([x])) for x in full])).all()
            plain = [{even(x)[k : k + 7] for k in range(max(1, len(even(x)) - 6))} for x in full]
            sets = lines.line_sets(pa.array([*full, *full[:3]]))
            assert [s.size for s in sets[: len(full)]] == list(map(len, plain)) and all((a == b).all() for a, b in zip(sets, sets[len(full) :]))


@pytest.mark.parametrize("block", [512, 3])
def test_lines_linked_only_through_a_hub(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK", block)  # a small block takes cells through the path of large ones
    rng = np.random.default_rng(11)
    line = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    every = []
    for _ in range(3):
        hub = line(400)
        # the hub is the longest: a copy lacks a piece of its own, and is unlike all other copies
        every += [hub, *(hub[: 48 * i] + hub[48 * i + 45 + i :] for i in range(8))]
    every += [line(380 + i) for i in range(6)]
    sets = [{x[k : k + 7] for k in range(len(x) - 6)} for x in every]
    links = [(i, j) for i in range(len(every)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert sorted(links) == sorted((9 * g + i, 9 * g) for g in range(3) for i in range(1, 9))
    rng.shuffle(order := list(range(len(every))))
    at = {k: n for n, k in enumerate(order)}
    root = _roots(len(every), [(at[i], at[j]) for i, j in links])
    got = lines.removals(spark.createDataFrame([(n, every[k]) for n, k in enumerate(order)], "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [n for n in range(len(every)) if root[n] != n]


@pytest.mark.parametrize("pairs", [1 << 18, 7])
def test_block_links_equal_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(blocks, "PAIRS", pairs)
    rng = np.random.default_rng(12)
    texts, part = [""], [0]
    for _ in range(12):
        base = "".join(rng.choice(list("abcdefghij "), 120))
        texts += [base[: k - 4] + base[k:] for k in rng.integers(4, 120, 4).tolist()]
        part += [len(part)] * 2 + [len(part) + 2, len(part) + 3]
    part, cell = np.array(part), rng.integers(0, 2, len(texts))
    sets = lines.line_sets(pa.array(texts))
    plain = [{lines.even(x)[k : k + 7] for k in range(len(lines.even(x)) - 6)} for x in texts]
    for side in (rng.integers(0, 2, len(texts)), np.full(len(texts), 2)):
        ok = [(i, j) for i in range(len(texts)) for j in range(i) if cell[i] == cell[j] and (side[i] == 2 or side[i] != side[j]) and plain[i] & plain[j] and 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j])]
        top = int(part.max()) + 1
        assert ok and _roots(top, [(part[i], part[j]) for i, j in ok]) == _roots(top, blocks.part_links(sets, cell, part, side, 4, 5))


def test_a_copy_of_every_line_stays(spark):
    """Near copies keep what is only theirs, and of each group of lines one is left."""
    rng = np.random.default_rng(7)
    line = lambda: "".join(rng.choice(list("abcdefghij"), 60))
    a, b, c, d, e = (line() for _ in range(5))
    rows = [(1, "\n".join([a, b, c])), (2, "\n".join([a, b, d])), (3, "\n".join([a, *(line() for _ in range(5))])), (4, f"{e}\n{line()}"), (5, line())]
    out = {r["doc_id"]: (r["text"], r["_removed"]) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[2] == (d, 2) and {k: n for k, (_, n) in out.items()} == {1: 0, 2: 2, 3: 1, 4: 0, 5: 0}
    assert sorted(x for t, _ in out.values() for x in t.split("\n")) == sorted({x for _, t in rows for x in t.split("\n")})


def test_archive(spark):
    big, other = "é" * 600, "y" * 2000
    pages = [(1, "u", big), (5, "u", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "a\r\nb", other), (8, "u", other), (None, "u", other), (9, "u", "z" * 1000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, address string")
    path = scratch_path(spark, "warc")
    archive.write(df, path)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in archive.index(spark, path).collect())
    kind = {1: ("revisit", 5), 3: ("revisit", 5), None: ("revisit", 8)}
    want = sorted((str(p), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), *kind.get(p, ("response", None))) for p, _, h in pages)
    assert got == want
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in pages})
    records = {r["page_id"]: bytes(r["record"]) for r in archive.reconstruct(spark, path).where("page_id in (1, 5)").collect()}
    assert records[5].endswith(b"\r\n\r\n" + big.encode() + b"\r\n\r\n") and records[5].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert b"Content-Length: 0\r\n\r\n\r\n\r\n" in records[1] and b"WARC-Refers-To: <urn:page:5>" in records[1]
    empty = scratch_path(spark, "warc")
    archive.write(df.limit(0), empty)
    assert archive.index(spark, empty).isEmpty()


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    vecs = [(i, rng.normal(0, 0.2, 8).round(2).tolist()) for i in range(200)]
    vecs += [(200, vecs[3][1]), (201, vecs[3][1]), (202, None), (203, []), (204, [float("nan")] * 8), (205, [1.0] * 7 + [None]), (206, [float("inf")] + [0.0] * 7), (207, [0.5] * 4), (208, [0.25] * 4), (None, [0.1] * 8), (50, [9.0] * 8)]
    df = spark.createDataFrame([(*v, 1) for v in vecs], "vec_id long, embedding array<double>, dims int")
    rows = bitslice.integers(df, 256, "vec_id", "embedding")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in bitslice.search(rows, rows.where("id % 50 = 0 or id = 207"), 5).collect()}
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vecs if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q in (0, 50, 100, 150, 200, 207):
        x = max(v for i, v in ints if i == q)
        best = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in ints if i != q and len(v) == len(x))[:5]
        assert [got[q, k + 1] for k in range(len(best))] == [(i, -s) for s, i in best]
    assert bitslice.search(rows.limit(0), rows.limit(0), 5).isEmpty()


def test_selection_keeps_ties():
    sums = np.array([5, 7, 7, 1, 7, 0], np.int64)
    maps = bitslice.slices(sums[:, None], 3)[0]
    live = np.array([0b111111], np.uint64)
    assert bitslice.select_top(maps, live, 2).tolist() == [1, 2, 4]
    assert bitslice.select_top(maps, live, 4).tolist() == [0, 1, 2, 4]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_earlier_texts_move_once(spark, tmp_path, monkeypatch):
    """What the join reads, again and again, are tables: no text is dealt anew for each of its passes."""
    spark.createDataFrame([(i, f"a{i} b c d e f g") for i in range(9)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(i, f"a{i} b c d e f g" + " more" * (i == 2)) for i in range(12)], "doc_id long, text string").write.parquet(str(tmp_path / "also"))
    seen, plain = [], jaccard.join
    monkeypatch.setattr(jaccard, "join", lambda texts, *a: seen.append((_plan(texts), texts.count())) or plain(texts, *a))
    out = jaccard.thin_out(spark.read.parquet(str(tmp_path / "docs")), also=spark.read.parquet(str(tmp_path / "also")))
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(9))
    assert len(seen) == 1 and "Exchange" not in seen[0][0] and seen[0][1] == 10


def test_plans_of_rounds_and_meetings_stay_small(spark, tmp_path, monkeypatch):
    """The driver keeps the plans of many rounds; each reads its rows a few times only, and no round follows the last one needed."""
    plans, plain = [], common.written
    monkeypatch.setattr(common, "written", lambda df, tag: plans.append(_plan(df)) or plain(df, tag))
    rng = np.random.default_rng(3)
    edges = rng.integers(0, 900, (500, 2)).tolist()
    root = _roots(900, edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {x: root[x] for a, b in edges for x in (a, b) if a != b}
    assert max(p.count("FileScan") for p in plans) <= 4
    plans.clear()
    stars = [(10 * i + k, 10 * i) for i in range(20) for k in range(1, 5)]
    assert components(spark.createDataFrame(stars, "a long, b long"), "t").count() == 100 and len(plans) == 1

    rows = [(k, i, p, 1) for k, n, parts in ((1, 9, 3), (2, 40, 4), (3, 8, 1)) for i in range(n) for p in [i % parts if i % 5 else 0]]
    spark.createDataFrame(rows, "key long, id long, part long, size long").write.parquet(str(tmp_path / "rows"))
    met = blocks.meetings(spark.read.parquet(str(tmp_path / "rows")), 10)
    assert _plan(met).count("FileScan") <= 2
    blocks_of = {}
    for r in met.collect():
        blocks_of.setdefault((r["key"], r["low"], r["high"]), []).append(r)
    pairs = {(k, *sorted((x["id"], y["id"]))) for (k, _, _), held in blocks_of.items() for x in held for y in held if x["part"] != y["part"] and (x["side"] == 2 or x["side"] != y["side"])}
    assert pairs == {(k, i, j) for k, i, p, _ in rows for h, j, q, _ in rows if k == h and i < j and p != q}
    assert {len(h) for (k, _, _), h in blocks_of.items() if k == 1} == {9} and sum(r["key"] == 2 for h in blocks_of.values() for r in h) > 40
