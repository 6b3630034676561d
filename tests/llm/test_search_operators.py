"""Near duplicates, decontamination, mixing, Simple-8b, WARC and the pipeline, against brute force and round trips."""

import gzip
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from llm import common, decontam, minhash, mixing, simple8b, tokens, warc


def prose(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(rng.randrange(40)) for _ in range(n)]


def edited(rng, words, rate):
    return [rng.choice("pqrs") + str(rng.randrange(999)) if rng.random() < rate else w for w in words]


def closed(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_groups_are_those_of_all_pairs(make):
    rng = random.Random(5)
    texts = [" ".join(prose(rng, rng.randrange(3, 80))) for _ in range(60)]
    boiler = " ".join(prose(rng, 40))
    texts = [t + " " + boiler if i % 3 == 0 else t for i, t in enumerate(texts)]
    base = prose(rng, 200)
    texts += [" ".join(edited(rng, base, r)) for r in (0, 0, 0.01, 0.02, 0.04, 0.05, 0.08, 0.1, 0.15)] + texts[:4] + ["one", "one", "one two", None, "", "!!"]
    df = make(texts).selectExpr("*", "1 AS node", "2 AS __row", "3 AS key")
    p = minhash.Params()
    signature, has = minhash.signatures(pa.array(texts), p)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if has[i] and has[j] and (signature[i] == signature[j]).sum() >= p.matches]
    want = closed(pairs, range(len(texts)))
    got = {r["doc_id"]: r["group_id"] for r in minhash.groups(df).collect()}
    assert got == want
    assert sum(len({k for k in want if want[k] == g}) > 2 for g in set(want.values())) >= 1


def test_near_copies_are_found_by_exact_jaccard(make):
    """Pairs of 0.6 or more by exact Jaccard of word 3-grams: nine in ten are grouped; hardly any pair under 0.4 is."""
    rng = random.Random(21)
    texts = []
    for i in range(150):
        base = prose(rng, rng.randrange(60, 200))
        copy = edited(rng, base, (0.02, 0.05, 0.08, 0.11, 0.2)[i % 5])
        texts += [" ".join(base), " ".join(copy + (prose(rng, len(base) // 4) if i % 3 == 0 else []))]
    grams = [{tuple(t[k : k + 3]) for k in range(len(t) - 2)} for t in map(str.split, texts)]
    jaccard = [len(a & b) / len(a | b) for a, b in zip(grams[::2], grams[1::2])]
    rows = {r["doc_id"]: r for r in minhash.groups(make(texts)).collect()}
    together = [rows[2 * i]["group_id"] == rows[2 * i + 1]["group_id"] for i in range(150)]
    near = [t for t, j in zip(together, jaccard) if j >= 0.6]
    far = [t for t, j in zip(together, jaccard) if j < 0.4]
    assert len(near) >= 40 and np.mean(near) >= 0.9 and len(far) >= 20 and np.mean(far) <= 0.1
    assert all(r["n_links"] == r["group_size"] - r["n_copies"] for r in rows.values())


def test_links_and_copies(make):
    text, long = " ".join(prose(random.Random(2), 90)), " ".join(["same", "words"] * 40_000)
    near = text.rsplit(" ", 2)[0] + " other end"
    rows = {r["doc_id"]: r for r in minhash.groups(make([text] * 30 + [near] * 5 + [long, long, "alone here now", None])).collect()}
    assert all(rows[i]["n_links"] == 1 and rows[i]["n_copies"] == (30 if i < 30 else 5) and rows[i]["group_size"] == 35 and rows[i]["kept"] == (i == 0) for i in range(35))
    assert [(rows[i]["n_links"], rows[i]["n_copies"], rows[i]["group_size"]) for i in (35, 36, 37, 38)] == [(0, 2, 2)] * 2 + [(0, 1, 1)] * 2


def test_long_lists_link_as_short_ones(monkeypatch):
    rng = np.random.default_rng(3)
    signature = rng.integers(0, 1 << 32, (600, 64)).astype(np.uint32)
    signature[:, 0] = 7
    for i in range(0, 600, 3):  # pairs and triples at 28 to 40 equal coordinates
        n = 28 + i % 13
        signature[i + 1, :n] = signature[i, :n]
        signature[i + 2, 64 - n :] = signature[i + 1, 64 - n :]
    groups = lambda: sorted((sorted(m.tolist()), least) for m, least in minhash.linked(np.arange(600), signature, 32))
    long = groups()
    monkeypatch.setattr(minhash, "LONG", 10_000)
    assert long == groups() and len(long) > 100
    apart = rng.integers(0, 1 << 32, (30_000, 64)).astype(np.uint32)
    apart[:, 0] = 7
    monkeypatch.setattr(minhash, "LONG", 256)
    assert list(minhash.linked(np.arange(30_000), apart, 32)) == []  # not a comparison of each with each


def test_signature_estimates_jaccard():
    rng = random.Random(1)
    a = prose(rng, 400)
    b = edited(rng, a, 0.05)
    grams = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    signature, _ = minhash.signatures(pa.array([" ".join(a), " ".join(b)]), minhash.Params(coordinates=512))
    assert abs((signature[0] == signature[1]).mean() - len(grams(a) & grams(b)) / len(grams(a) | grams(b))) < 0.08


def test_deduplicate_keeps_one_row_of_each(make):
    text = " ".join(prose(random.Random(2), 50))
    other = " ".join(prose(random.Random(3), 50))
    df = make([text, other, text, None, ""], [(None, text, None, None, None), (1, other, "xx", None, None), (9, None, None, None, None)]).selectExpr("*", "1 AS __row")
    kept = minhash.deduplicate(df).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(0, text), (1, other), (3, ""), (4, ""), (9, "")]
    assert minhash.deduplicate(df).columns == df.columns and minhash.deduplicate(df.limit(0)).count() == 0


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_scores():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 15)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 25)).astype(np.uint64)
        score, first, end = decontam.align(a, b)
        assert score == smith_waterman(a.tolist(), b.tolist()) and (not score or smith_waterman(a.tolist(), b[first:end].tolist()) == score)


def test_decontamination(make, spark):
    rng = random.Random(8)
    items = [prose(rng, rng.randrange(15, 60)) for _ in range(12)] + [["too", "short"], []]
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(99, None)], "item_id long, text string")
    texts, want = [], set()
    for d in range(60):
        body = prose(rng, rng.randrange(0, 150))
        if d % 3 == 0:
            i = rng.randrange(12)
            copy = edited(rng, items[i], 0.08) if d % 2 else list(items[i])
            if d % 4 == 0:
                del copy[len(copy) // 2]
            at = rng.randrange(len(body) + 1)
            body[at:at] = copy
        texts.append(" ".join(body))
        for i, item in enumerate(items):
            if len(item) >= 4 and smith_waterman(item, body) / (2 * len(item)) >= 0.5:
                want.add((d, i))
    df = make([*texts, None, ""], [(None, texts[0], None, None, None)]).selectExpr("*", "1 AS item_id", "2 AS similarity")
    got = decontam.contaminated(df, benchmark).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got if r["doc_id"] is not None}
    assert found <= want and len(found) >= 0.95 * len(want) and len(want) >= 20
    assert sum(r["doc_id"] is None for r in got) == sum(d == 0 for d, _ in found)
    parts = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, benchmark, decontam.Params(part_chars=800)).collect() if r["doc_id"] is not None}
    assert parts == found
    clean = decontam.decontaminate(df, benchmark)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {d for d in range(62) if d not in {x for x, _ in found}}
    assert decontam.contaminated(df, benchmark.limit(0)).count() == 0 and decontam.contaminated(df.limit(0), benchmark).count() == 0
    assert decontam.decontaminate(df, benchmark.limit(0)).count() == df.count()


def test_edited_copies_with_an_intact_seed_are_found(make, spark):
    rng = random.Random(13)
    items = [prose(rng, n) for n in range(15, 60)]
    regular = [[f"x{i}" if i % 5 == 4 else w for i, w in enumerate(t)] for t in items]
    short = [prose(rng, rng.randrange(15, 26)) for _ in range(90)]
    scattered = [edited(rng, t, (0.1, 0.2, 0.3)[i % 3]) for i, t in enumerate(short)]
    want, every = set(), 0
    for i, (item, copy) in enumerate(zip(items + short, regular + scattered)):
        if smith_waterman(item, copy) / (2 * len(item)) >= 0.5:
            every += 1
            if {tuple(item[k : k + 4]) for k in range(len(item) - 3)} & {tuple(copy[k : k + 4]) for k in range(len(copy) - 3)}:
                want.add(i)
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items + short)], "item_id long, text string")
    found = {r["doc_id"] for r in decontam.contaminated(make([" ".join(t) for t in regular + scattered]), benchmark).collect() if r["doc_id"] == r["item_id"]}
    assert found == want and set(range(45)) <= want and len(want) >= 0.9 * every, (len(found), len(want), every)


def test_copies_near_the_threshold_have_the_full_similarity(make, spark):
    """Intact words with single insertions between: as many wrong words as the threshold allows, over twice the item's length."""
    item = prose(random.Random(3), 40)
    texts, want = [], []
    for start in (0, 10, 20, 33):
        for intact in (5, 6, 7):
            copy = item[:start] + [w for i, x in enumerate(item[start : start + intact]) for w in [x]]
            for i, w in enumerate(item[start + intact :]):
                copy += [f"new{i}", w]
            copy = [w for i, x in enumerate(item[:start]) for w in (x, f"old{i}")] + copy[start:]
            texts.append(" ".join(["pad"] * 90 + copy + ["pad"] * 90))
            want.append(smith_waterman(item, texts[-1].split()) / 80)
    rows = {r["doc_id"]: r["similarity"] for r in decontam.contaminated(make(texts), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert rows == {i: s for i, s in enumerate(want) if s >= 0.5} and len(rows) >= 10


def test_decontamination_odd_rows(make, spark):
    item = " ".join(prose(random.Random(4), 30))
    long = "word " * 60_000 + item + " other" * 60_000
    for kind, ids in (("string", ["", "x", None]), ("smallint", [0, 1, None]), ("struct<a: int>", [(1,), None, (2,)])):
        benchmark = spark.createDataFrame([(i, item) for i in ids] + [(ids[1], None), (ids[1], ""), (ids[1], "one two")], f"item_id {kind}, text string").selectExpr("*", "1 AS similarity")
        rows = decontam.contaminated(make([None, "", long, item, item]), benchmark).collect()
        assert len(rows) == 9 and {(r["doc_id"], r["similarity"]) for r in rows} == {(2, 1.0), (3, 1.0), (4, 1.0)}
        assert sorted(str(r["item_id"]) for r in rows if r["doc_id"] == 2) == sorted(str(r["item_id"]) for r in benchmark.limit(3).collect())
        assert {r["first_word"] for r in rows if r["doc_id"] == 2} == {60_000}


def test_permutation():
    for n in (1, 2, 3, 10, 64, 65, 1000):
        for key in (0, 5, 1 << 60):
            assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64)).tolist()) == list(range(n))
    assert mixing.permuted(np.arange(50), np.full(50, 50), np.full(50, 1)).tolist() != mixing.permuted(np.arange(50), np.full(50, 50), np.full(50, 2)).tolist()


def test_mixing(make, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(prose(rng, rng.randrange(0, 200))) for _ in range(90)] + [None, ""]
    df = make(texts, [(None, "no id and no source", None, None, None)]).selectExpr("*", "1 AS shard", "2 AS task", "3 AS rest").repartition(3, "doc_id")
    p = mixing.Params(block_tokens=64, shard_blocks=50, weights={"s0": 6, "s1": 3, "s2": 1, "absent": 5})
    df = common.saved(df.repartition(7), "test")
    monkeypatch.setattr(mixing, "FAN", 2)
    rows = mixing.mix_blocks(df, p).collect()
    encoder = tokens.tokenizer()
    stream = {}
    for r in df.collect():
        stream.setdefault(r["source"], []).append((r["doc_id"], encoder.encode(pa.array([r["text"]]))[0].tolist()))
    n_tokens = {s: sum(len(t) + 1 for _, t in x if t) for s, x in stream.items()}
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows) and {r["source"] for r in rows} == {"s0", "s1", "s2"}
    blocks = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], np.uint16).tolist()
        assert len(ids) == r["n_tokens"] <= 64 and blocks.setdefault((r["source"], r["index"]), (ids, r["doc_ids"])) == (ids, r["doc_ids"])
    for s in ("s0", "s1", "s2"):
        assert sum(len(ids) < 64 for (of, _), (ids, _) in blocks.items() if of == s) <= 1
        own = [r for r in rows if r["source"] == s]
        epochs = {}
        for r in own:
            epochs.setdefault(r["epoch"], []).append(r["index"])
        full = [e for e in epochs if e < max(epochs)]
        size = len(set(epochs[full[0]])) if full else None
        assert all(len(set(x)) == len(x) for x in epochs.values()) and all(sorted(epochs[e]) == list(range(size)) for e in full)
        if full:  # all of the source's ids, each once in an epoch
            assert sum(len(blocks[s, i][0]) for i in range(size)) == n_tokens[s]
    for shard in {r["shard"] for r in rows}:
        counts = [sum(r["shard"] == shard and r["source"] == s for r in rows) for s in ("s0", "s1", "s2")]
        total = sum(counts)
        assert counts == mixing.draw(shard, total, np.array([0.6, 0.3, 0.1]), p.seed).tolist()
    assert mixing.mix_blocks(df.limit(0), p).count() == 0 and mixing.mix_blocks(df, mixing.Params(weights={"absent": 1})).count() == 0
    assert {r["source"] for r in mixing.mix_blocks(df, mixing.Params(block_tokens=64)).collect()} == {"s0", "s1", "s2", None}


def test_mixed_documents_are_stretches_of_theirs(make, monkeypatch):
    texts = ["Grüße ñandú " * 30, "plain words " * 100, None, "", "日本語テキスト" * 40, "short", "long " * 30_000, "日本"]
    df = common.saved(make(texts).selectExpr("*", "doc_id * 2 AS task", "'x' AS body").repartition(6), "test")
    monkeypatch.setattr(mixing, "FAN", 2)
    p = mixing.Params(block_tokens=16, weights={"s0": 1, "s1": 1})
    out = mixing.mix_documents(df, p)
    assert out.columns == df.columns
    rows = out.collect()
    assert all(r["text"] in texts[r["doc_id"]] and len(r["text"]) == r["n_chars"] and r["task"] == 2 * r["doc_id"] and r["source"] == f"s{r['doc_id'] % 3}" for r in rows)
    pieces, blocks = {i: [] for i in range(8)}, {}
    for r in mixing._pieces(df, p).collect():
        pieces[r["rest"]["doc_id"]].append(((r["task"], r["nth"]), r["body"]))
        blocks.setdefault(r["key"], set()).add((r["task"], r["nth"]))
    assert all("".join(b for _, b in sorted(pieces[i], key=lambda x: x[0])) == (texts[i] or "") for i in range(8))
    encode = tokens.tokenizer().encoding.encode_ordinary
    ids = {f"s{k}": sum(len(encode(t)) + 1 for i, t in enumerate(texts) if t and i % 3 == k) for k in range(3)}
    assert {s: len(b) for s, b in blocks.items()} == {s: -(-n // 16) for s, n in ids.items()}  # full but for one each
    assert mixing.mix_documents(df.limit(0), p).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_simple8b_round_trip(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 1500))
    values = (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) >> rng.integers(0, 64, n).astype(np.uint64)
    if seed % 3 == 0:
        values[rng.random(n) < 0.9] = 0
    if seed % 7 == 0:
        values[:] = seed % 2
    bounds = np.sort(np.concatenate([[0, n], rng.integers(0, n + 1, 4)]))
    words, word_bounds, offsets, block_bounds = simple8b.encode(values, bounds)
    for i in range(5):
        own, at = words[word_bounds[i] : word_bounds[i + 1]], offsets[block_bounds[i] : block_bounds[i + 1]]
        assert (simple8b.decode(own, at, bounds[i + 1] - bounds[i]) == values[bounds[i] : bounds[i + 1]]).all()
        for k in range(len(at)):  # each block alone, by its offset
            part = own[at[k] : at[k + 1] if k + 1 < len(at) else len(own)]
            size = min(simple8b.BLOCK, bounds[i + 1] - bounds[i] - k * simple8b.BLOCK)
            lo = bounds[i] + k * simple8b.BLOCK
            assert (simple8b.decode(part, np.zeros(1, np.uint32), size) == values[lo : lo + size]).all()


def test_token_binary_is_the_tokenizers_ids(make):
    texts = ["Hello wörld <|endoftext|> 1²", None, "", "x" * 5000, "a b " * 3000]
    df = make(texts, [(None, "no id", None, None, None), (0, texts[0], None, None, None)]).selectExpr("*", "1 AS words", "2 AS offsets")
    rows = simple8b.token_binary(df).collect()
    encoding = tokens.tokenizer().encoding
    assert len(rows) == 7
    for r, t in zip(rows, [*texts, "no id", texts[0]]):
        ids = simple8b.decode(np.frombuffer(r["words"], np.uint64), np.frombuffer(r["offsets"], np.uint32), r["n_tokens"])
        assert ids.tolist() == encoding.encode_ordinary(t or "") and r["n_blocks"] == -(-len(ids) // simple8b.BLOCK)
    assert simple8b.token_binary(df.limit(0)).count() == 0


def record(body, uri=b"http://x/"):
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: " + uri + b"\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


def test_warc_goes_on_after_a_malformed_header(tmp_path):
    bad = [b"WARC/1.0\r\nWARC-Type: response\r\n\r\nno length\r\n\r\n", b"WARC/1.0\r\nContent-Length: many\r\n\r\n" + b"x\n" * 800_000, b"stray line\r\n", record(b"lf").replace(b"Length: 2", b"Length: -2")]
    bodies = [b"one", b"two\r\n\r\n", b"three", b"four"]
    raw = b"".join(x for b, body in zip(bad, bodies) for x in (b, record(body))) + record(b"five\r\n\r\n").replace(b"\r\n", b"\n")
    raw = raw.replace(b"Length: 8\n\n", b"Length: 6\n\n")
    (tmp_path / "bad").write_bytes(gzip.compress(raw))
    target = str(tmp_path / "out" / "bad.warc.gz")
    rows = list(warc.normalise_file(str(tmp_path / "bad"), target))
    assert [r[9] for r in rows] == ["malformed", None] * 4 + [None]
    with open(target, "rb") as f:
        got = [warc.read_record(f, r[2], r[3]) for r in rows if r[9] is None]
    assert [payload for _, payload in got] == [*bodies, b"five\n\n"] and all(fields["warc-target-uri"] == "http://x/" for fields, _ in got)


def test_warc_files(tmp_path):
    bodies = [b"a", b"", os.urandom(2_500_000), b"x" * 3_000_000, b"WARC/1.0\r\nContent-Length: 9\r\n\r\n", b"a"]
    raw = b"".join(map(record, bodies))
    files = {
        "whole": (gzip.compress(raw), 6, None), "members": (b"".join(gzip.compress(record(b)) for b in bodies), 6, None), "odd": (gzip.compress(raw[:77]) + gzip.compress(raw[77:]), 6, None),
        "cut": (gzip.compress(raw)[:-1000], 3, "truncated"), "short": (gzip.compress(raw[:-50]), 5, "truncated"), "bad": (gzip.compress(record(b"hi") + b"junk\r\n\r\n"), 1, "malformed"), "empty": (b"", 0, None), "nothing": (gzip.compress(b""), 0, None),
    }
    for name, (data, n, problem) in files.items():
        (tmp_path / name).write_bytes(data)
        target = str(tmp_path / "out" / f"{name}.warc.gz")
        rows = list(warc.normalise_file(str(tmp_path / name), target))
        good = [r for r in rows if r[9] is None]
        assert len(good) == n and [r[9] for r in rows if r[9]] == ([problem] if problem else [])
        with open(target, "rb") as f:
            for r in good:
                fields, payload = warc.read_record(f, r[2], r[3])
                assert payload == (b"hi" if name == "bad" else bodies[r[1]]) and fields["warc-target-uri"] == "http://x/"
        if not problem and n:
            assert gzip.decompress((tmp_path / "out" / f"{name}.warc.gz").read_bytes()) == raw  # the same records, still one gzip file
        assert len((tmp_path / "out" / f"{name}.warc.gz.index.tsv").read_text().splitlines()) == n


def test_warc_names_ids_and_bytes(spark, tmp_path):
    """Files of one name in two folders, record ids of other makers, payloads that aren't UTF-8."""
    for folder, body in (("a", b"\xff\xfe binary \x00"), ("b", b"plain")):
        (tmp_path / folder).mkdir()
        head = record(body).replace(b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1234-%s>" % folder.encode())
        (tmp_path / folder / "x.warc.gz").write_bytes(gzip.compress(head + (record(b"second") if folder == "a" else b"")))
    paths = spark.createDataFrame([(str(tmp_path / f / "x.warc.gz"),) for f in "ab"] + [(None,)], "path string").selectExpr("*", "1 AS file")
    index = common.saved(warc.normalise(paths, str(tmp_path / "out")), "index")
    assert index.count() == 3 and index.select("file").distinct().count() == 2
    rows = warc.read_records(index).collect()
    assert sorted(r["payload"] for r in rows) == sorted([bytearray(b"\xff\xfe binary \x00"), bytearray(b"second"), bytearray(b"plain")])
    assert {r["headers"].get("warc-record-id") for r in rows} == {"<urn:uuid:1234-a>", "<urn:uuid:1234-b>", None}
    pages = warc.read_pages(index).collect()
    assert {r["page_id"] for r in pages} == {None} and {r["html"] for r in pages} == {"\ufffd\ufffd binary \x00", "second", "plain"}


def test_warc_tables(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>ü</p>"), (2, None, ""), (None, "http://b/", None), (1, "http://a/", "<p>ü</p>"), (3, "http://c/\r\nx", "z" * 3_000_000)], "page_id long, url string, html string").selectExpr("*", "1 AS path", "2 AS file")
    files = warc.write_monolithic(pages.coalesce(1), str(tmp_path / "whole"))
    index = common.saved(warc.normalise(common.saved(files, "files"), str(tmp_path / "members")), "index")
    back = sorted(map(tuple, warc.read_pages(index).collect()), key=str)
    assert back == sorted([(1, "http://a/", "<p>ü</p>"), (2, None, ""), (None, "http://b/", None), (1, "http://a/", "<p>ü</p>"), (3, "http://c/%0D%0Ax", "z" * 3_000_000)], key=str)
    assert warc.normalise(warc.write_monolithic(pages.limit(0), str(tmp_path / "none")), str(tmp_path / "m2")).count() == 0
