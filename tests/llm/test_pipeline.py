"""Every stage of the pipeline against a version that goes row by row and pair by pair, on rows of every odd kind."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from llm import common, langid, minhash, mixing, simple8b, tokens
from test_search_operators import closed, edited, prose, smith_waterman

KINDS = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, __row int"


def fixture(spark, folder):
    rng = random.Random(31)
    de = "der die das und nicht wir haben heute einen kleinen Hund gesehen aber morgen gehen sie wieder nach Hause".split()
    fr = "le la les des nous avons vu un petit chien mais demain ils vont rentrer chez eux avec une grande joie".split()
    items = [prose(rng, n) for n in (20, 30, 40)]
    texts = [(" ".join(rng.choice(w) for _ in range(rng.randrange(30, 90))), lang) for _ in range(12) for w, lang in ((de, "de"), (fr, "fr"))]
    own = [prose(rng, rng.randrange(60, 140)) for _ in range(30)]
    for i in range(0, 30, 4):
        at = rng.randrange(len(own[i]))
        own[i][at:at] = edited(rng, items[i % 3], (0, 0.1, 0.2)[i % 3])
    texts += [(" ".join(t), "en") for t in own]
    texts += [(" ".join(edited(rng, own[i], 0.02)), "en") for i in (1, 1, 2, 3)] + [(" ".join(own[5]), "en")] * 6
    texts += [(" ".join(prose(rng, 30_000)), "en"), (None, "en"), ("", "de"), ("12 34 !!", None), ("tiny", None), (" ".join(own[7]), None)]
    rows = [(i, t, lang, (None, "s1", "s1", "s1", "s2")[i % 5], None if t is None else len(t), i % 3, "k", 7) for i, (t, lang) in enumerate(texts)]
    rows += [rows[30], rows[30], (None, *rows[31][1:]), (None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, KINDS).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def counted(rows):
    return Counter(tuple(r) for r in rows)


def test_stages_one_by_one(spark, tmp_path):
    items = fixture(spark, tmp_path)
    sf_dir = str(tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixture", "token_binary"]
    stage = dict(corpus_pipeline.STAGES)
    docs = common.table(spark, sf_dir, "documents")

    # language ID: each text alone, its n-grams in a dictionary
    model = langid.fit(docs)
    assert model.classes == ["de", "en", "fr"]

    def confidence(text):
        bounds, at, count = langid.features(pa.array([text], pa.string()))
        x = [(1 + np.log(c)) * model.idf[j] for j, c in zip(at.tolist(), count.tolist())]
        if not x:
            return 0.0
        z = sum(v * model.weights[j].astype(float) for v, j in zip(x, at.tolist())) / np.sqrt(sum(v * v for v in x)) / model.temperature
        return float(np.exp(z.max() - np.log(np.exp(z - z.max()).sum()) - z.max()))

    rows = docs.collect()
    told = common.saved(stage["language_id"](spark, docs, sf_dir), "told")
    want = [r for r in rows if confidence(r["text"]) >= 0.4]
    assert counted(told.collect()) == counted(want) and told.columns == docs.columns
    assert all(r in want for r in rows if r["lang"] and r["text"]) and not any(r["text"] in (None, "", "12 34 !!") for r in want)

    # near duplicates: all pairs of signatures, closed to groups; the least doc_id, then the first row, stays
    rows = told.collect()
    p = minhash.Params()
    signature, has = minhash.signatures(pa.array([r["text"] for r in rows]), p)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if has[i] and has[j] and (signature[i] == signature[j]).sum() >= p.matches]
    root = closed(pairs, range(len(rows)))
    least = {}
    for i in root:
        key = (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0, i)
        least[root[i]] = min(least.get(root[i], key), key)
    single = common.saved(stage["near_duplicates"](spark, told, sf_dir), "single")
    want = [rows[k[2]] for k in least.values()]
    assert counted(single.collect()) == counted(want) and len(want) <= len(rows) - 14

    # decontamination: full Smith-Waterman of every text and item that share four words in a row
    grams = lambda t: {tuple(t[k : k + 4]) for k in range(len(t) - 3)}
    rows = single.collect()

    def copied(text):
        words = text.lower().split()
        return len(words) < 1000 and any(grams(t) & grams(words) and smith_waterman(t, words) >= len(t) for t in items)

    want = [r for r in rows if not copied(r["text"])]
    clean = common.saved(stage["decontamination"](spark, single, sf_dir).coalesce(1), "clean")
    assert counted(clean.collect()) == counted(want) and len(want) <= len(rows) - 5

    # mixture: each source's ids in blocks, in order; each block drawn as often as its source's slots say, one more or less
    rows = clean.collect()
    q = mixing.Params()
    encoding = tokens.tokenizer().encoding
    blocks, filled = {}, Counter()
    for r in rows:
        ids = encoding.encode_ordinary(r["text"])
        lengths = [len(encoding.decode_single_token_bytes(i)) for i in ids] + [0]
        place = 0
        for k in range(0, len(lengths)):
            block = filled[r["source"]] // q.block_tokens
            blocks.setdefault((r["source"], block), Counter())[r["doc_id"], r["text"]] += lengths[k]
            filled[r["source"]] += 1
            place += lengths[k]
    number = Counter(s for s, _ in blocks)
    total = sum(number.values())
    names = sorted(number, key=lambda s: (s is not None, s or ""))
    share = np.array([(number[s] / total) ** q.temper for s in names])
    slots = np.random.Generator(np.random.Philox(key=[q.seed, 0])).multinomial(total, share / share.sum())
    mixed = common.saved(stage["mixture"](spark, clean, sf_dir), "mixed")
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    whole = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert all(r["text"] in whole[r["doc_id"]] for r in rows)
    for s, n in zip(names, slots.tolist()):
        times = Counter(r["doc_id"] for r in rows if r["source"] == s and r["text"] == whole[r["doc_id"]])  # of documents within one block
        inside = [d for (of, _), own in blocks.items() if of == s for (d, t), size in own.items() if size == len(t.encode())]
        assert all(n // number[s] <= times[d] <= -(-n // number[s]) for d in inside)
        sizes = sum(len(r["text"].encode()) for r in rows if r["source"] == s)
        each = sorted(sum(own.values()) for (of, _), own in blocks.items() if of == s)
        assert n // number[s] * sum(each) <= sizes <= -(-n // number[s]) * sum(each)

    # token binary: the tokenizer's ids
    got = Counter()
    for r in stage["token_binary"](spark, mixed, sf_dir).collect():
        ids = simple8b.decode(np.frombuffer(r["words"], np.uint64), np.frombuffer(r["offsets"], np.uint32), r["n_tokens"])
        got[r["doc_id"], tuple(ids.tolist())] += 1
    assert got == Counter((r["doc_id"], tuple(encoding.encode_ordinary(r["text"]))) for r in rows)

    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), sf_dir).count() == 0, name
